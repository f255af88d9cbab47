"""Forecast preparation, baseline, model and review over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal, stock as S
from ..functions.numeric import half_even
from ..session import ensure_checkpoint_dir, staged
from ..operators import demand_model as dm, forecast as fc, forecast_review as fr, joins
from . import fixtures as fx
from .fixtures import with_ctes
from .registry import he, register

DAYS = 7

# Special events (name, first day, last day) in listing order; the second and third overlap.
EVENTS = [("Spring fair", "1996-03-01", "1996-03-10"), ("Summer sale", "1998-06-15", "1998-07-15"),
          ("Founders week", "1998-07-10", "1998-07-20"), ("Year end", "1999-12-20", "2000-01-05"),
          ("Autumn launch", "2001-10-25", "2001-11-12")]
# Season days of the Umm al-Qura calendar between 1994 and 2002, for the oracle.
SEASONS = [
    ("1994-01-27", "1994-02-11", "Ramadan_Preparation"), ("1994-02-12", "1994-02-12", "Ramadan_Start"),
    ("1994-05-14", "1994-05-21", "Eid_Al_Adha_Preparation"), ("1995-01-17", "1995-01-31", "Ramadan_Preparation"),
    ("1995-02-01", "1995-02-01", "Ramadan_Start"), ("1995-05-03", "1995-05-10", "Eid_Al_Adha_Preparation"),
    ("1996-01-06", "1996-01-21", "Ramadan_Preparation"), ("1996-01-22", "1996-01-22", "Ramadan_Start"),
    ("1996-04-21", "1996-04-28", "Eid_Al_Adha_Preparation"), ("1996-12-26", "1997-01-09", "Ramadan_Preparation"),
    ("1997-01-10", "1997-01-10", "Ramadan_Start"), ("1997-04-11", "1997-04-18", "Eid_Al_Adha_Preparation"),
    ("1997-12-15", "1997-12-30", "Ramadan_Preparation"), ("1997-12-31", "1997-12-31", "Ramadan_Start"),
    ("1998-03-31", "1998-04-07", "Eid_Al_Adha_Preparation"), ("1998-12-04", "1998-12-19", "Ramadan_Preparation"),
    ("1998-12-20", "1998-12-20", "Ramadan_Start"), ("1999-03-21", "1999-03-28", "Eid_Al_Adha_Preparation"),
    ("1999-11-23", "1999-12-08", "Ramadan_Preparation"), ("1999-12-09", "1999-12-09", "Ramadan_Start"),
    ("2000-03-09", "2000-03-16", "Eid_Al_Adha_Preparation"), ("2000-11-11", "2000-11-26", "Ramadan_Preparation"),
    ("2000-11-27", "2000-11-27", "Ramadan_Start"), ("2001-02-26", "2001-03-05", "Eid_Al_Adha_Preparation"),
    ("2001-10-31", "2001-11-15", "Ramadan_Preparation"), ("2001-11-16", "2001-11-16", "Ramadan_Start"),
    ("2002-02-15", "2002-02-22", "Eid_Al_Adha_Preparation"), ("2002-10-21", "2002-11-05", "Ramadan_Preparation"),
    ("2002-11-06", "2002-11-06", "Ramadan_Start")]

_EV = "(VALUES " + ", ".join(f"({i}, '{n}', DATE '{a}', DATE '{b}')" for i, (n, a, b) in enumerate(EVENTS)) \
    + ") e(pos, event_name, a, b)"
_SE = "(VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}', '{n}')" for a, b, n in SEASONS) + ") h(a, b, label)"


def events(spark):
    rows = [(i, n, a, b) for i, (n, a, b) in enumerate(EVENTS)]
    return spark.createDataFrame(rows, "event_order int, event_name string, start_date string, end_date string") \
        .withColumns({"start_date": F.to_date("start_date"), "end_date": F.to_date("end_date")})


def history(spark, d, reread=True):
    """Daily totals of active items; written out once where a query reads them more than once."""
    daily = fc.daily_history(fx.sales(spark, d), fx.inventory(spark, d))
    return staged(daily) if reread else daily


_TIME = """isodow(sale_date) - 1 AS day_of_week, dayname(sale_date) AS sale_day,
  CASE WHEN isodow(sale_date) IN (5, 6) THEN 1 ELSE 0 END AS is_weekend, day(sale_date) AS day, month(sale_date) AS month,
  weekofyear(sale_date) AS week_of_year, CASE WHEN day(sale_date) >= 25 OR day(sale_date) <= 10 THEN 1 ELSE 0 END AS is_salary_peak"""
_TIME_NAMES = "day_of_week sale_day is_weekend day month week_of_year is_salary_peak".split()
_TIME_INT = ", ".join(f"CAST({c} AS INTEGER) AS {c}" if c != "sale_day" else c for c in _TIME_NAMES)

_DAILY = f""", daily AS (
  SELECT s.product_code, s.branch_code, sale_date, sum(quantity_sold) AS quantity_sold, sum(revenue) AS revenue,
    avg(CASE WHEN quantity_sold > 0 THEN CAST(revenue AS DOUBLE) / quantity_sold ELSE 0 END) AS price, sum(discount) AS discount,
    min(Last_on_hand) AS Last_on_hand, min(product_name) AS product_name, min(item_category1) AS item_category1, min(item_category2) AS item_category2
  FROM sales s LEFT JOIN inventory i ON i.product_code = s.product_code AND i.branch_code = s.branch_code
  GROUP BY 1, 2, 3),
span AS (SELECT max(sale_date) AS last FROM daily),
pairs AS (SELECT DISTINCT product_code, branch_code FROM daily),
ahead AS (SELECT unnest(range(1, {DAYS + 1})) AS n),
grid AS (SELECT product_code, branch_code, CAST(last + CAST(n AS INTEGER) AS DATE) AS sale_date FROM pairs, span, ahead),
wd AS (SELECT product_code, branch_code, isodow(sale_date) AS w, sum(quantity_sold) / count(*) AS m FROM daily GROUP BY 1, 2, 3),
ov AS (SELECT product_code, branch_code, sum(quantity_sold) / count(*) AS m FROM daily GROUP BY 1, 2),
fut AS (SELECT g.product_code, g.branch_code, g.sale_date, greatest({he('coalesce(wd.m, ov.m)')}, 0) AS predicted_quantity_sold
  FROM grid g JOIN ov ON ov.product_code = g.product_code AND ov.branch_code = g.branch_code
  LEFT JOIN wd ON wd.product_code = g.product_code AND wd.branch_code = g.branch_code AND wd.w = isodow(g.sale_date)),
fitted AS (SELECT d.product_code, d.branch_code, d.sale_date, d.quantity_sold, greatest({he('wd.m')}, 0) AS predicted_quantity_sold
  FROM daily d JOIN wd ON wd.product_code = d.product_code AND wd.branch_code = d.branch_code AND wd.w = isodow(d.sale_date)),
long AS (SELECT product_code, branch_code, sale_date, product_name, item_category1, item_category2, Last_on_hand, quantity_sold,
    CAST(NULL AS DOUBLE) AS predicted_quantity_sold FROM daily
  UNION ALL SELECT product_code, branch_code, sale_date, NULL, NULL, NULL, NULL, NULL, predicted_quantity_sold FROM fut),
margin AS (SELECT 1.96 * greatest(stddev_pop(quantity_sold - predicted_quantity_sold), 1e-6) AS m FROM fitted),
conf AS (SELECT l.*, CASE WHEN predicted_quantity_sold IS NULL THEN 0.99::DOUBLE WHEN predicted_quantity_sold <= 0 THEN 0.05::DOUBLE
    ELSE greatest(least(1.0 - m / predicted_quantity_sold - 0.005 * CAST(sale_date - (SELECT last + 1 FROM span) AS DOUBLE), 0.98), 0.01) END AS confidence
  FROM long l, margin),
summ AS (SELECT product_code, branch_code, sum(predicted_quantity_sold) AS forecast_quantity,
    avg(confidence) FILTER (predicted_quantity_sold IS NOT NULL) AS confidence,
    coalesce(arg_max(Last_on_hand, sale_date) FILTER (Last_on_hand IS NOT NULL), 0) AS have,
    arg_max(product_name, sale_date) FILTER (product_name IS NOT NULL) AS product_name,
    arg_max(item_category1, sale_date) FILTER (item_category1 IS NOT NULL) AS item_category1,
    arg_max(item_category2, sale_date) FILTER (item_category2 IS NOT NULL) AS item_category2
  FROM conf GROUP BY 1, 2 HAVING count(predicted_quantity_sold) > 0),
summary AS (SELECT product_code, product_name, item_category1, item_category2, branch_code, CAST(have AS DOUBLE) AS Last_on_hand,
    forecast_quantity, CASE WHEN forecast_quantity > have THEN {he('forecast_quantity - have')} END AS expected_demand,
    greatest(least(confidence, 0.99), 0.01) AS confidence,
    CASE WHEN have < forecast_quantity THEN '{S.RESTOCK}' WHEN have > forecast_quantity * 1.5 THEN '{S.OVERSTOCK}'
         ELSE '{S.ADEQUATE}' END AS recommendations FROM summ)
"""


def _daily_sql(tail: str) -> str:
    return with_ctes("sales inventory", _DAILY + tail)


# --- D1-D4, J7, J8 --------------------------------------------------------------------------------

_DATES = ", dates AS (SELECT DISTINCT sale_date FROM sales)"


def _dates(spark, d):
    return fx.sales(spark, d).select("sale_date").distinct()


@register("time_features", with_ctes("sales", _DATES + f"""
SELECT CAST(sale_date AS VARCHAR) AS sale_date, {_TIME_INT} FROM (SELECT sale_date, {_TIME} FROM dates)"""))
def _(spark, d):
    return cal.with_time_features(_dates(spark, d))


@register("special_event_tag", with_ctes("sales", _DATES + f"""
SELECT CAST(sale_date AS VARCHAR) AS sale_date, coalesce(arg_max(event_name, pos), 'None') AS special_event_name,
  CAST(count(event_name) > 0 AS INTEGER) AS is_special_event
FROM dates LEFT JOIN {_EV} ON sale_date BETWEEN a AND b GROUP BY sale_date"""))
def _(spark, d):
    return cal.tag_special_events(_dates(spark, d), events(spark))


@register("hijri_season", with_ctes("sales", _DATES + f"""
SELECT CAST(sale_date AS VARCHAR) AS sale_date, label AS seasonal_event, CAST(label IS NOT NULL AS INTEGER) AS is_seasonal
FROM dates LEFT JOIN {_SE} ON sale_date BETWEEN a AND b"""))
def _(spark, d):
    dates = _dates(spark, d)
    return cal.tag_hijri_season(dates, cal.seasons_of(dates))


@register("discount_features", with_ctes("sales", f"""
, r AS (SELECT product_code, branch_code, sale_date, CAST(revenue AS DOUBLE) / quantity_sold AS price,
    CASE WHEN discount > 2000 THEN 0 ELSE CAST(discount AS DOUBLE) END AS promo,
    CASE WHEN quantity_sold = 3 THEN 1 ELSE quantity_sold END AS quantity_sold FROM sales)
SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold, promo,
  {he('(price * quantity_sold - promo) / quantity_sold', 4)} AS price_after_discount,
  {he('promo / quantity_sold', 4)} AS discount_per_unit, CAST(promo > 0 AS INTEGER) AS has_discount FROM r"""))
def _(spark, d):
    q = F.col("quantity_sold")
    s = fx.sales(spark, d).select(
        "product_code", "branch_code", "sale_date", (F.col("revenue").cast("double") / q).alias("price"),
        F.when(F.col("discount") <= 2000, F.col("discount").cast("double")).alias("promo"),
        F.when(q == 3, 0.0).otherwise(q).alias("quantity_sold"))
    out = cal.discount_features(s).drop("price")
    return out.withColumns({c: half_even(F.col(c), 4) for c in ("price_after_discount", "discount_per_unit")})


@register("daily_features", _daily_sql(f"""
SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold, CAST(revenue AS DOUBLE) AS revenue,
  {he('price', 4)} AS price, CAST(discount AS DOUBLE) AS discount, CAST(Last_on_hand AS DOUBLE) AS Last_on_hand, product_name,
  item_category1, item_category2, {_TIME_INT}, label AS seasonal_event, CAST(label IS NOT NULL AS INTEGER) AS is_seasonal,
  coalesce(ev, 'None') AS special_event_name, CAST(ev IS NOT NULL AS INTEGER) AS is_special_event
FROM (SELECT d.*, {_TIME}, label, (SELECT arg_max(event_name, pos) FROM {_EV} WHERE sale_date BETWEEN a AND b) AS ev
      FROM daily d LEFT JOIN {_SE} ON sale_date BETWEEN a AND b)"""))
def _(spark, d):
    out = fc.daily_features((h := history(spark, d)), events(spark), cal.seasons_of(h))
    return out.drop("predicted_quantity_sold").withColumns({
        "revenue": F.col("revenue").cast("double"), "discount": F.col("discount").cast("double"),
        "price": half_even(F.col("price"), 4), "Last_on_hand": F.col("Last_on_hand").cast("double")})


# --- J9, J10, G4, U2, C11, A12 --------------------------------------------------------------------

@register("future_grid", _daily_sql("SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date FROM grid"))
def _(spark, d):
    return fc.future_grid(history(spark, d), DAYS)


# Prices are blanked on the first of a month, so carrying the last known value has gaps to cross.
@register("future_with_last_known", _daily_sql(f"""
SELECT g.product_code, g.branch_code, CAST(g.sale_date AS VARCHAR) AS sale_date, product_name, Last_on_hand, {he('price', 4)} AS price
FROM grid g JOIN (SELECT product_code, branch_code, arg_max(product_name, sale_date) AS product_name,
    CAST(arg_max(Last_on_hand, sale_date) AS DOUBLE) AS Last_on_hand,
    arg_max(price, sale_date) FILTER (day(sale_date) <> 1) AS price FROM daily GROUP BY 1, 2) k
  ON k.product_code = g.product_code AND k.branch_code = g.branch_code"""))
def _(spark, d):
    h = history(spark, d).withColumn("price", F.when(F.dayofmonth("sale_date") != 1, F.col("price")))
    out = fc.attach_last_known(fc.future_grid(h, DAYS), h, ["product_name", "Last_on_hand", "price"])
    return out.withColumns({"price": half_even(F.col("price"), 4), "Last_on_hand": F.col("Last_on_hand").cast("double")})


@register("price_forward_fill", _daily_sql(f"""
SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, {he('''last_value(CASE WHEN day(sale_date) > 10 THEN price END IGNORE NULLS)
  OVER (PARTITION BY product_code, branch_code ORDER BY sale_date)''', 4)} AS price FROM daily"""))
def _(spark, d):
    h = history(spark, d, False).select(*fc.PAIR, "sale_date", F.when(F.dayofmonth("sale_date") > 10, F.col("price")).alias("price"))
    return fc.fill_forward_price(h).withColumn("price", half_even(F.col("price"), 4))


@register("baseline_forecast", _daily_sql(
    "SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, predicted_quantity_sold FROM fut"))
def baseline(spark, d):
    return fc.baseline_forecast(history(spark, d), DAYS)


def _long(spark, d):
    h = history(spark, d)
    past = h.select(*fc.PAIR, "sale_date", "product_name", "item_category1", "item_category2", "Last_on_hand",
                    "quantity_sold")
    return h, fc.forecast_long(past, fc.baseline_forecast(h, DAYS))


@register("forecast_long", _daily_sql("""
SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold, predicted_quantity_sold FROM long"""))
def _(spark, d):
    return _long(spark, d)[1].select(*fc.PAIR, "sale_date", "quantity_sold", "predicted_quantity_sold")


def confident(spark, d):
    h, long = _long(spark, d)
    return h, fc.forecast_confidence(long, fc.error_margin(fc.baseline_fitted(h)), fc.first_future_day(h))


@register("forecast_confidence", _daily_sql(f"""
SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, predicted_quantity_sold, {he('confidence', 6)} AS confidence FROM conf"""))
def _(spark, d):
    return confident(spark, d)[1].select(*fc.PAIR, "sale_date", "predicted_quantity_sold",
                                         half_even(F.col("confidence"), 6).alias("confidence"))


def summary(spark, d):
    return fc.forecast_summary(confident(spark, d)[1])


_SUM = f"SELECT * REPLACE ({he('confidence', 6)} AS confidence) FROM summary"


@register("forecast_summary", _daily_sql(_SUM))
def _(spark, d):
    return summary(spark, d).withColumn("confidence", half_even(F.col("confidence"), 6))


@register("forecast_high_demand", _daily_sql(_SUM + " WHERE forecast_quantity > 250 ORDER BY forecast_quantity DESC, product_code, branch_code"))
def _(spark, d):
    return fc.high_demand(summary(spark, d), 250).withColumn("confidence", half_even(F.col("confidence"), 6))


@register("forecast_low_stock", _daily_sql(_SUM + " WHERE Last_on_hand < 100"))
def _(spark, d):
    return fc.low_stock(summary(spark, d), 100).withColumn("confidence", half_even(F.col("confidence"), 6))


@register("forecast_report", _daily_sql(f"""
SELECT product_code, coalesce(product_name, '{fc.TEXT_MISSING}') AS product_name,
  coalesce(item_category1, '{fc.TEXT_MISSING}') AS item_category1, coalesce(item_category2, '{fc.TEXT_MISSING}') AS item_category2,
  branch_code, Last_on_hand, forecast_quantity, expected_demand,
  {he('greatest(least(coalesce(CASE WHEN (SELECT max(confidence) FROM summary) <= 1.01 THEN confidence * 100 ELSE confidence END, 75), 99), 1)', 2)} AS confidence,
  recommendations FROM summary"""))
def _(spark, d):
    return fc.forecast_report_table(summary(spark, d))


@register("forecast_chart_series", _daily_sql("""
SELECT branch_code, CAST(sale_date AS VARCHAR) AS sale_date, CASE WHEN predicted_quantity_sold IS NULL THEN quantity_sold END AS actual,
  predicted_quantity_sold AS predicted FROM long WHERE product_code = '17'"""))
def _(spark, d):
    return fc.chart_series(_long(spark, d)[1], "17")


_GROWTH = ("CASE WHEN g IS NULL AND a = 0 AND p > 0 THEN '" + S.NOTE_NEW + "' WHEN g IS NULL THEN '" + S.NOTE_NONE
           + "' WHEN g > 20 THEN '" + S.NOTE_GROWTH + "' WHEN g < -20 THEN '" + S.NOTE_DECLINE + "' ELSE '"
           + S.NOTE_STABLE + "' END")


# A product unknown to history: the future rows of branch ASIA are listed under a new code.
@register("forecast_growth", _daily_sql(f""", f AS (
  SELECT CASE WHEN branch_code = 'ASIA' THEN 'NEW-' || product_code ELSE product_code END AS product_code, branch_code, sale_date,
    predicted_quantity_sold AS p FROM fut),
av AS (SELECT product_code, {he('avg(quantity_sold)', 2)} AS a FROM daily GROUP BY 1),
j AS (SELECT f.*, coalesce(a, 0) AS a FROM f LEFT JOIN av ON av.product_code = f.product_code),
k AS (SELECT *, CASE WHEN a <> 0 THEN {he('(p - a) / a * 100', 2)} END AS g FROM j)
SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, p AS predicted_quantity_sold, a AS avg_daily_sales,
  {_GROWTH} AS notes, coalesce(g, 100) AS growth_rate FROM k"""))
def _(spark, d):
    h = history(spark, d)
    future = fc.baseline_forecast(h, DAYS).withColumn("product_code", F.when(
        F.col("branch_code") == "ASIA", F.concat(F.lit("NEW-"), "product_code")).otherwise(F.col("product_code")))
    return fc.forecast_growth(h.select("product_code", "quantity_sold"), future)


@register("forecast_accuracy", _daily_sql(f""", e AS (SELECT quantity_sold AS a, quantity_sold - predicted_quantity_sold AS e FROM fitted)
SELECT {he('avg(abs(e))', 6)} AS mae, {he('sqrt(avg(e * e))', 6)} AS rmse,
  {he('avg(abs(e / CASE WHEN a = 0 THEN 1 ELSE a END) * 100)', 6)} AS mape, {he('stddev_pop(e)', 6)} AS std_resid FROM e"""))
def _(spark, d):
    out = fc.forecast_accuracy(fc.baseline_fitted(history(spark, d)))
    return out.select(*[half_even(F.col(c), 6).alias(c) for c in out.columns])


_SPREAD = f"""SELECT branch_code, sum(predicted_quantity_sold) AS total_predicted_quantity, {he('avg(predicted_quantity_sold)', 6)} AS average_prediction,
  {he('var_samp(predicted_quantity_sold)', 6)} AS prediction_variance, CAST(min(sale_date) AS VARCHAR) AS start_date,
  CAST(max(sale_date) AS VARCHAR) AS end_date, CAST(max(sale_date) - min(sale_date) AS INTEGER) AS duration_days FROM fut GROUP BY 1"""


@register("forecast_spread", _daily_sql(_SPREAD))
def _(spark, d):
    return fc.forecast_spread(baseline(spark, d), ["branch_code"]).withColumns({
        "average_prediction": half_even(F.col("average_prediction"), 6),
        "prediction_variance": half_even(F.col("prediction_variance"), 6)})


# --- W4, W5, W9, A21, per-series trend ------------------------------------------------------------

def _series_cte(keys: str) -> str:
    return f""", ser AS (SELECT {keys}, sale_date, sum(quantity_sold) AS quantity_sold FROM sales GROUP BY ALL),
num AS (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY sale_date) - 1 AS DOUBLE) AS x,
   count(*) OVER (PARTITION BY {keys}) AS n FROM ser)"""


@register("normalized_trend", with_ctes("sales", _series_cte("product_code") + f"""
SELECT product_code, count(quantity_sold) AS points,
  CASE WHEN count(quantity_sold) < 2 THEN 0 ELSE {he('regr_slope(quantity_sold, x) / avg(quantity_sold)', 6)} END AS trend
FROM num GROUP BY product_code"""))
def _(spark, d):
    s = fc.daily_series(fx.sales(spark, d), ["product_code"])
    return fc.normalized_trend(s, ["product_code"]).withColumn("trend", half_even(F.col("trend"), 6))


@register("temporal_split", with_ctes("sales", _series_cte("product_code") + """
SELECT product_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold,
  CASE WHEN x + 1 > n - ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM num"""))
def _(spark, d):
    return fc.temporal_split(fc.daily_series(fx.sales(spark, d), ["product_code"]), ["product_code"])


@register("per_series_trend", with_ctes("sales", _series_cte("product_code, branch_code") + f"""
, fit AS (SELECT product_code, branch_code, regr_slope(quantity_sold, CAST(sale_date - DATE '1970-01-01' AS DOUBLE)) AS s,
   regr_intercept(quantity_sold, CAST(sale_date - DATE '1970-01-01' AS DOUBLE)) AS i, max(sale_date) AS last FROM ser GROUP BY 1, 2),
days AS (SELECT unnest(range(1, {DAYS + 1})) AS n)
SELECT product_code, branch_code, CAST(last + CAST(n AS INTEGER) AS VARCHAR) AS sale_date,
  {he("greatest(s * CAST(last + CAST(n AS INTEGER) - DATE '1970-01-01' AS DOUBLE) + i, 0)", 3)} AS predicted
FROM fit, days WHERE s IS NOT NULL AND NOT isnan(s)"""))
def _(spark, d):
    keys = ["product_code", "branch_code"]
    return fc.per_series_trend(fc.daily_series(fx.sales(spark, d), keys), keys, DAYS).withColumn(
        "predicted", half_even(F.col("predicted"), 3))


@register("weekly_totals", with_ctes("sales", """
, w AS (SELECT CAST(date_trunc('week', sale_date) AS DATE) + 6 AS week_end, sum(quantity_sold) AS total FROM sales GROUP BY 1),
all_w AS (SELECT CAST(unnest(generate_series((SELECT min(week_end) FROM w)::TIMESTAMP, (SELECT max(week_end) FROM w)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week_end)
SELECT CAST(a.week_end AS VARCHAR) AS week_end, coalesce(total, 0) AS total FROM all_w a LEFT JOIN w ON w.week_end = a.week_end"""))
def _(spark, d):
    return fc.weekly_totals(fx.sales(spark, d), "quantity_sold")


@register("sales_trend_flag", with_ctes("sales", f"""
, top AS (SELECT avg(CAST(revenue AS DOUBLE)) AS r FROM (SELECT revenue FROM sales
    ORDER BY sale_date DESC, product_code DESC, branch_code DESC, quantity_sold DESC, revenue DESC LIMIT 10)),
o AS (SELECT avg(CAST(revenue AS DOUBLE)) AS o FROM sales)
SELECT {he('o', 4)} AS overall_avg, {he('r', 4)} AS recent_avg, CASE WHEN r > o * 1.1 THEN '{fc.TREND_UP}' WHEN r < o * 0.9 THEN '{fc.TREND_DOWN}' END AS trend
FROM top, o"""))
def _(spark, d):
    out = fc.recent_vs_overall(fx.sales(spark, d),
                               ["sale_date", "product_code", "branch_code", "quantity_sold", "revenue"])
    return out.withColumns({c: half_even(F.col(c), 4) for c in ("overall_avg", "recent_avg")})


# --- M1-M3, G7 ------------------------------------------------------------------------------------

_C = 4  # columns of the forecast table that enter the missing-cell share


def _arr(*vals: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


_REVIEW = f""", f AS (SELECT product_code, branch_code, sale_date, CASE WHEN product_code LIKE '%7' AND branch_code = 'ASIA' THEN NULL ELSE predicted_quantity_sold END AS p FROM fut),
fig AS (SELECT branch_code, sum(p) AS total_predicted_quantity, avg(p) AS average_prediction, var_samp(p) AS pv,
    CAST(min(sale_date) AS VARCHAR) AS start_date, CAST(max(sale_date) AS VARCHAR) AS end_date,
    CAST(max(sale_date) - min(sale_date) AS INTEGER) AS duration_days,
    sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) / (count(*) * 4.0::DOUBLE) AS missing_ratio FROM f GROUP BY 1),
hv AS (SELECT branch_code, var_samp(quantity_sold) AS hv FROM sales GROUP BY 1),
ser AS (SELECT branch_code, sale_date, sum(quantity_sold) AS q FROM sales GROUP BY 1, 2),
num AS (SELECT *, CAST(row_number() OVER (PARTITION BY branch_code ORDER BY sale_date) - 1 AS DOUBLE) AS x FROM ser),
tr AS (SELECT branch_code, regr_slope(q, x) / avg(q) AS historical_trend FROM num GROUP BY 1),
b0 AS (SELECT fig.*, hv, historical_trend, least(greatest((hv + pv) / 100, 0.5), 2.0) AS vf
  FROM fig JOIN hv ON hv.branch_code = fig.branch_code JOIN tr ON tr.branch_code = fig.branch_code),
b AS (SELECT *, greatest(1.0 - 0.2 * vf, 0.3) AS lower_bound, least(1.0 + 0.2 * vf, 3.0) AS upper_bound,
   CASE WHEN hv > 0 AND pv > 0 THEN least(0.6 + 0.3 / vf, 0.95) ELSE 0.8 END AS confidence_level FROM b0),
k0 AS (SELECT *, list_filter([CASE WHEN pv > 100 THEN '{fr.RISK_VARIANCE}' END, '{fr.RISK_SEASON}',
    CASE WHEN missing_ratio > 0.1 THEN '{fr.RISK_QUALITY}' END, CASE WHEN abs(historical_trend) > 0.1 THEN '{fr.RISK_TREND}' END],
    lambda t: t IS NOT NULL) AS found FROM b),
k AS (SELECT *, CASE WHEN len(found) = 0 THEN {_arr(*fr.RISK_DEFAULTS)} ELSE found[1:5] END AS risk FROM k0),
r AS (SELECT *, CAST(len(risk) AS INTEGER) AS risk_count, greatest(least(75.0::DOUBLE + CASE WHEN upper_bound - lower_bound < 0.3 THEN 15
     WHEN upper_bound - lower_bound > 0.8 THEN -15 ELSE 0 END - least(20, len(risk) * 4), 100), 0) AS confidence_score,
   CASE WHEN len(risk) > 3 THEN '{fr.LEVEL_HIGH}' WHEN len(risk) < 2 THEN '{fr.LEVEL_LOW}' ELSE '{fr.LEVEL_MEDIUM}' END AS risk_level FROM k),
a AS (SELECT *, {_arr(fr.FACTOR_WINTER, fr.FACTOR_PROMO, *fr.FACTORS_GENERAL)} AS external_factors,
   list_filter([CASE WHEN lower_bound < 0.7 THEN '{fr.ADJUST_LOWER}' END, CASE WHEN upper_bound > 1.5 THEN '{fr.ADJUST_UPPER}' END,
     CASE WHEN list_contains(risk, '{fr.RISK_VARIANCE}') THEN '{fr.ADJUST_VARIANCE}' END,
     CASE WHEN list_contains(risk, '{fr.RISK_SEASON}') THEN '{fr.ADJUST_SEASON}' END], lambda t: t IS NOT NULL) AS adj0,
   list_concat(list_filter([CASE WHEN list_contains(risk, '{fr.RISK_VARIANCE}') THEN '{fr.ADVISE_MODELS}' END,
     CASE WHEN list_contains(risk, '{fr.RISK_QUALITY}') THEN '{fr.ADVISE_QUALITY}' END, '{fr.ADVISE_WINTER}', '{fr.ADVISE_PROMO}'],
     lambda t: t IS NOT NULL), {_arr(*fr.ADVISE_GENERAL)})[1:7] AS rec FROM r)
"""


def _review_input(spark, d):
    """Written out once: the figures read it twice, the enhanced rows once more."""
    p = F.col("predicted_quantity_sold")
    return staged(baseline(spark, d).withColumn("predicted_quantity_sold", F.when(
        ~(F.col("product_code").endswith("7") & (F.col("branch_code") == "ASIA")), p)))


def _figures(spark, d):
    return fr.group_figures(_review_input(spark, d), fx.sales(spark, d), ["branch_code"])


@register("forecast_bounds", _daily_sql(_REVIEW + f"""
SELECT branch_code, {he('pv', 4)} AS prediction_variance, {he('hv', 4)} AS historical_variance, {he('historical_trend', 6)} AS historical_trend,
  {he('missing_ratio', 6)} AS missing_ratio, {he('lower_bound', 6)} AS lower_bound, {he('upper_bound', 6)} AS upper_bound,
  {he('confidence_level', 6)} AS confidence_level FROM b"""))
def _(spark, d):
    out = fr.forecast_bounds(_figures(spark, d))
    return out.select("branch_code", *[half_even(F.col(c), n).alias(c) for c, n in (
        ("prediction_variance", 4), ("historical_variance", 4), ("historical_trend", 6), ("missing_ratio", 6),
        ("lower_bound", 6), ("upper_bound", 6), ("confidence_level", 6))])


@register("forecast_risk", _daily_sql(_REVIEW + """
SELECT branch_code, array_to_string(risk, ' | ') AS risk_factors, risk_count, confidence_score, risk_level FROM r"""))
def _(spark, d):
    return fr.forecast_risk(fr.forecast_bounds(_figures(spark, d)), "peak").select(
        "branch_code", "risk_factors", "risk_count", "confidence_score", "risk_level")


@register("forecast_actions", _daily_sql(_REVIEW + f"""
SELECT branch_code, array_to_string(external_factors, ' | ') AS external_factors,
  array_to_string(CASE WHEN len(adj0) = 0 THEN {_arr(*fr.ADJUST_DEFAULTS)} ELSE adj0[1:5] END, ' | ') AS adjustments,
  array_to_string(rec, ' | ') AS forecast_recommendations FROM a"""))
def _(spark, d):
    out = fr.forecast_actions(fr.forecast_risk(fr.forecast_bounds(_figures(spark, d)), "peak"), 11,
                              promotional_period=True)
    return out.select("branch_code", "external_factors", "adjustments", "forecast_recommendations")


@register("enhanced_forecast", _daily_sql(_REVIEW + f"""
SELECT f.product_code, f.branch_code, CAST(f.sale_date AS VARCHAR) AS sale_date, p AS predicted_quantity_sold,
  {he('p * lower_bound', 4)} AS predicted_quantity_sold_lower, {he('p * upper_bound', 4)} AS predicted_quantity_sold_upper,
  {he('confidence_level', 6)} AS confidence_level, risk_level, confidence_score
FROM f JOIN a ON a.branch_code = f.branch_code"""))
def _(spark, d):
    out = fr.enhance_forecast(_review_input(spark, d), fx.sales(spark, d), ["branch_code"], 11, "peak",
                              promotional_period=True)
    return out.select("product_code", "branch_code", "sale_date", "predicted_quantity_sold",
                      half_even(F.col("predicted_quantity_sold_lower"), 4).alias("predicted_quantity_sold_lower"),
                      half_even(F.col("predicted_quantity_sold_upper"), 4).alias("predicted_quantity_sold_upper"),
                      half_even(F.col("confidence_level"), 6).alias("confidence_level"), "risk_level",
                      "confidence_score")


# --- G1-G3, G6, L5: feature vectors, and trained models (rows-only checks) ------------------------

_MODELS: dict[tuple[str, str], dm.DemandModel] = {}


def _features(spark, d):
    return fc.daily_features((h := history(spark, d)), events(spark), cal.seasons_of(h))


def model_path(spark, rows) -> str:
    """Where the demand model of day rows is kept: named by the fingerprint of what it learns from, in the folder that
    outlives the session if ``spark.checkpoint.dir`` names one.

    Sums of floats depend on the order of their rows in the last places, so those are left out."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    learned = rows.select(*fc.PAIR, "sale_date", *[F.col(c).cast("float") for c in ("quantity_sold", "price", "discount")])
    return f"{root.rstrip('/')}/demand-models/{dm.data_fingerprint(learned)}"


def fitted_model(spark, d, rows, features) -> dm.DemandModel:
    """The saved demand model of a table folder's day rows, whichever session trained it; only without one it is trained here, on
    their ``features``, and saved. ``rows`` are stored already, so that neither reads the sales again."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        path = model_path(spark, rows)
        model = dm.load_model(spark, path)
        if model is None:
            model = dm.train_demand_model(features)
            dm.save_model(spark, model, path)
        _MODELS[key] = model
    return _MODELS[key]


def train_model(spark, d) -> tuple[dm.DemandModel, str]:
    """Train the demand model of a table folder and save it: an action of its own, which ``tools/train_models.py`` runs. Gives its place, too."""
    rows = history(spark, d)
    model, path = dm.train_demand_model(fc.daily_features(rows, events(spark), cal.seasons_of(rows))), model_path(spark, rows)
    dm.save_model(spark, model, path)
    return model, path


_HOT = "list_transform((SELECT list(DISTINCT {0} ORDER BY {0}) FROM f), lambda x: CAST(x = {0} AS INTEGER))"


@register("forecast_features", _daily_sql(f""", f AS (
  SELECT d.*, {_TIME}, coalesce(label, 'None') AS se, CAST(label IS NOT NULL AS INTEGER) AS seasonal,
    coalesce((SELECT arg_max(event_name, pos) FROM {_EV} WHERE sale_date BETWEEN a AND b), 'None') AS ev
  FROM daily d LEFT JOIN {_SE} ON sale_date BETWEEN a AND b)
SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold, {he('price', 4)} AS price,
  CAST(discount AS DOUBLE) AS discount,
  concat_ws(' | ', day_of_week, is_weekend, day, month, week_of_year, is_salary_peak, seasonal, CAST(ev <> 'None' AS INTEGER)) AS calendar,
  array_to_string(list_concat({_HOT.format('ev')}, {_HOT.format('se')}), ' | ') AS one_hot FROM f"""))
def _(spark, d):
    out = dm.as_arrays(dm.encode_features(_features(spark, d)))
    at = dm.BASE_FEATURES.index
    # Prices first, discounts last of the numbers; between them whole numbers, after them one place per category.
    return out.select(*fc.PAIR, "sale_date", "quantity_sold",
                      half_even(F.get("features", F.lit(at("price"))), 4).alias("price"),
                      F.get("features", F.lit(at("discount"))).alias("discount"),
                      F.slice("features", 2, len(dm.BASE_FEATURES) - 2).cast("array<int>").alias("calendar"),
                      F.slice("features", len(dm.BASE_FEATURES) + 1, F.size("features") - len(dm.BASE_FEATURES))
                      .cast("array<int>").alias("one_hot"))


def _learned(spark, d):
    """The features of all day rows, their model, and the calendars of their dates. Only what the model reads is stored."""
    listed = events(spark)
    rows = staged(fc.daily_history(fx.sales(spark, d), fx.inventory(spark, d)).select(*fc.PAIR, "sale_date", "quantity_sold", *dm.AMOUNTS))
    seasons = cal.seasons_of(rows)
    features = fc.daily_features(rows, listed, seasons)
    return features, fitted_model(spark, d, rows, features), dm.calendars_of(rows.select("sale_date").distinct(), listed, seasons)


@register("forecast_metrics")
def _(spark, d):
    features, model, calendars = _learned(spark, d)
    return dm.model_metrics(model, features, calendars=calendars)


@register("feature_importance_top")
def _(spark, d):
    features, model, _ = _learned(spark, d)
    # A row for each feature, read for the total and for the rows.
    return dm.top_importances(staged(dm.importance_use(model, features)), 10)


def _run(spark, d):
    h, listed = history(spark, d), events(spark)
    seasons = cal.seasons_of(h, DAYS)
    model = fitted_model(spark, d, h, fc.daily_features(h, listed, seasons))
    return dm.run_forecast(h, DAYS, listed, seasons, model, written=True)


@register("forecast_daily")
def _(spark, d):
    return _run(spark, d)[0]


@register("forecast_product_summary")
def _(spark, d):
    return _run(spark, d)[1]


def _category_series(spark, d):
    keys = ["branch_code", "item_category1"]
    s = joins.sales_with_item_info(fx.sales(spark, d), fx.inventory(spark, d))
    return fc.daily_series(s, keys), keys


@register("per_series_forecast")
def _(spark, d):
    return dm.per_series_forecast(*_category_series(spark, d), 30, model="trees")


@register("per_series_least_squares")
def _(spark, d):
    return dm.per_series_forecast(*_category_series(spark, d), 30)
