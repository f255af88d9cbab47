"""Preparing, predicting and summarising demand per (product, branch)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stock as S
from ..functions.calendar import tag_hijri_season, tag_special_events, with_time_features
from ..functions.numeric import clip, half_even, ratio
from ..session import staged
from .activity import active_days
from .clean import with_price
from .joins import ITEM_COLUMNS

PAIR = ["product_code", "branch_code"]
ATTRIBUTES = ["product_name", "item_category1", "item_category2", "Last_on_hand"]
INFO = [*ATTRIBUTES, "price", "discount"]
HISTORY_CONFIDENCE, NO_DEMAND_CONFIDENCE = 0.99, 0.05


def daily_totals(unified: DataFrame) -> DataFrame:
    """One row per (product, branch, day)."""
    aggs = [F.sum("quantity_sold").alias("quantity_sold"), F.sum("revenue").alias("revenue"),
            F.avg("price").alias("price"),
            *[F.min(c).alias(c) for c in ("Last_on_hand", "product_name", "item_category1", "item_category2")]]
    if "discount" in unified.columns:
        aggs.append(F.sum("discount").alias("discount"))
    return unified.dropna(subset=[*PAIR, "sale_date"]).groupBy(*PAIR, "sale_date").agg(*aggs)


def daily_history(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Daily totals of active items with their stock attributes.

    Sales are brought to day grain first: a product with a third of all rows shrinks to one row per day in
    the tasks that read it, before any join sees it. After that the day rows are shuffled once, by product, which serves
    the activity rule and the attributes."""
    discount = F.coalesce("discount", F.lit(0)) if "discount" in sales.columns else F.lit(0)
    priced = with_price(sales.withColumn("discount", discount.cast("decimal(18,4)")), positive_only=True)
    daily = priced.dropna(subset=[*PAIR, "sale_date"]).groupBy(*PAIR, "sale_date").agg(
        F.sum("quantity_sold").alias("quantity_sold"), F.sum("revenue").alias("revenue"), F.avg("price").alias("price"),
        F.sum("discount").alias("discount"), F.max("quantity_sold").alias("top_sale"))
    return active_days(daily, inventory, ITEM_COLUMNS).drop("top_sale")


def with_calendar(df: DataFrame, events: DataFrame | None, seasons: DataFrame) -> DataFrame:
    return tag_special_events(tag_hijri_season(with_time_features(df), seasons), events)


def daily_features(daily: DataFrame, events: DataFrame | None, seasons: DataFrame) -> DataFrame:
    """Calendar features on the rows of ``daily_history`` or ``daily_totals``."""
    return with_calendar(daily, events, seasons).withColumn(
        "predicted_quantity_sold", F.lit(None).cast("double"))


def _ahead(days: int) -> int:
    if days < 1:
        raise ValueError("a forecast looks at least one day ahead")
    return days


def future_grid(history: DataFrame, days: int) -> DataFrame:
    """Every (product, branch) on each of the ``days`` dates after the last date of the whole table."""
    last = history.agg(F.max("sale_date")).scalar()
    return history.select(*PAIR).distinct().withColumn("_last", last).select(
        *PAIR, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", _ahead(days)))).alias("sale_date"))


def last_known(history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Last non-null value of each column per (product, branch), by date."""
    return history.groupBy(*PAIR).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("sale_date", F.col(c).alias("_v")))).alias(c)
        for c in columns])


def attach_last_known(grid: DataFrame, history: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns or [c for c in INFO if c in history.columns]
    return grid.join(last_known(history, columns), PAIR, "left")


def future_days(history: DataFrame, days: int) -> DataFrame:
    """The ``days`` dates after the last date of the whole table; none where it has no date."""
    last = history.agg(F.max("sale_date")).scalar()
    return history.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, _ahead(days)))).alias("sale_date"))


def future_rows(history: DataFrame, days: int, columns: Sequence[str] | None = None) -> DataFrame:
    """``future_grid`` with ``attach_last_known``, for days that all have a product and branch: one aggregate gives the pairs and their
    values, and the days unfold from its rows."""
    last = history.agg(F.max("sale_date")).scalar()
    columns = columns or [c for c in INFO if c in history.columns]
    return last_known(history, columns).withColumn("_last", last).select(
        *PAIR, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", _ahead(days)))).alias("sale_date"), *columns)


def fill_forward_price(df: DataFrame) -> DataFrame:
    """Carry the last price forward inside each (product, branch), by date.

    Input is at day grain, so a partition holds at most one row per calendar day."""
    upto = Window.partitionBy(*PAIR).orderBy("sale_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("price", F.last("price", ignorenulls=True).over(upto))


def weekday_means(daily: DataFrame) -> DataFrame:
    """Per (product, branch): mean daily quantity by weekday as a map of at most seven entries, and overall.

    The weekdays are columns of one aggregate per pair, so the days shrink to pairs before the only shuffle."""
    q, week = F.col("quantity_sold"), range(7)
    on = [F.when(F.weekday("sale_date") == d, q) for d in week]
    per = daily.groupBy(*PAIR).agg(
        *[F.sum(c).alias(f"_q{d}") for d, c in enumerate(on)], *[F.count(c).alias(f"_n{d}") for d, c in enumerate(on)],
        F.bit_or(F.expr("shiftleft(1, weekday(sale_date))")).alias("_days"))
    entries = F.array(*[F.struct(F.lit(d).alias("_wd"), F.try_divide(f"_q{d}", f"_n{d}").alias("_m")) for d in week])
    known = F.filter(entries, lambda e: F.getbit("_days", e["_wd"]) == 1)
    total, count = (sum((F.coalesce(f"_{c}{d}", F.lit(0)) for d in week), F.lit(0)) for c in "qn")
    return per.select(*PAIR, F.map_from_entries(known).alias("by_weekday"), F.try_divide(total, count).alias("overall"))


def _baseline(date: str) -> Column:
    return F.greatest(half_even(F.coalesce(F.try_element_at("by_weekday", F.weekday(date)), F.col("overall"))),
                      F.lit(0.0))


def baseline_forecast(daily: DataFrame, days: int) -> DataFrame:
    """Weekday mean per (product, branch), overall mean where the weekday never sold.

    Means and dates unfold from one row per pair, so the future rows are never joined."""
    last = daily.agg(F.max("sale_date")).scalar()
    return (weekday_means(daily).withColumn("_last", last)
            .withColumn("sale_date", F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", _ahead(days)))))
            .select(*PAIR, "sale_date", _baseline("sale_date").alias("predicted_quantity_sold")))


def baseline_fitted(daily: DataFrame) -> DataFrame:
    """The baseline's value on the days it was built from, next to the actual quantity."""
    return daily.join(weekday_means(daily), PAIR).select(
        *PAIR, "sale_date", "quantity_sold", _baseline("sale_date").alias("predicted_quantity_sold"))


def forecast_long(history: DataFrame, future: DataFrame) -> DataFrame:
    past = history.withColumn("predicted_quantity_sold", F.lit(None).cast("double"))
    return past.unionByName(future, allowMissingColumns=True)


def error_margin(fitted: DataFrame, actual: str = "quantity_sold", predicted: str = "predicted_quantity_sold") -> Column:
    """Half width of the 95 % band: 1.96 population standard deviations of the residuals, as a scalar."""
    spread = F.stddev_pop(F.col(actual) - F.col(predicted))
    return fitted.agg(F.greatest(spread, F.lit(1e-6)) * 1.96).scalar()


def confidence_score(predicted: Column, margin: Column, days_out: Column) -> Column:
    usable = predicted.isNotNull() & ~F.isnan(predicted) & (predicted != float("inf")) & (predicted > 0)
    raw = F.lit(1.0) - margin / predicted - F.lit(0.005) * days_out
    return F.when(usable, clip(raw, 0.01, 0.98)).otherwise(NO_DEMAND_CONFIDENCE)


def first_future_day(history: DataFrame) -> Column:
    return history.agg(F.date_add(F.max("sale_date"), 1)).scalar()


def forecast_confidence(long: DataFrame, margin: Column, start: Column) -> DataFrame:
    """Confidence per row: fixed on history, falling with relative error and distance from ``start`` on the future."""
    p = F.col("predicted_quantity_sold")
    rows = long.withColumns({"_margin": margin, "_start": start})
    score = F.when(p.isNull(), HISTORY_CONFIDENCE).otherwise(
        confidence_score(p, F.col("_margin"), F.datediff("sale_date", "_start")))
    return rows.withColumn("confidence", score).drop("_margin", "_start")


def forecast_summary(long: DataFrame) -> DataFrame:
    """Per (product, branch) with future rows: forecast, order quantity, mean confidence and advice."""
    p = F.col("predicted_quantity_sold")
    conf = F.col("confidence") if "confidence" in long.columns else F.lit(0.85)
    info = [c for c in ATTRIBUTES if c in long.columns]
    per = long.groupBy(*PAIR).agg(
        F.count(p).alias("_future"), F.sum(p).alias("forecast_quantity"),
        F.avg(F.when(p.isNotNull(), conf)).alias("confidence"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("sale_date", F.col(c).alias("_v")))).alias(c)
          for c in info])
    return _with_advice(per)


def future_summary(future: DataFrame) -> DataFrame:
    """``forecast_summary`` of rows ahead that hold their pair's last known attributes, as ``future_rows`` gives them.

    No row of the past says more, and rows of a pair agree in the attributes, which therefore are keys: numbers alone are summed, without
    a sort of the rows, where the pairs' rows lie."""
    p = F.col("predicted_quantity_sold")
    per = future.groupBy(*PAIR, *ATTRIBUTES).agg(
        F.count(p).alias("_future"), F.sum(p).alias("forecast_quantity"), F.avg(F.when(p.isNotNull(), F.col("confidence"))).alias("confidence"))
    return _with_advice(per)


def _with_advice(per: DataFrame) -> DataFrame:
    have = F.coalesce(F.col("Last_on_hand").try_cast("double"), F.lit(0.0))
    need = F.coalesce("forecast_quantity", F.lit(0.0))
    return per.filter("_future > 0").select(
        "product_code", "product_name", "item_category1", "item_category2", "branch_code",
        have.alias("Last_on_hand"), need.alias("forecast_quantity"),
        F.when(need > have, half_even(need - have)).alias("expected_demand"),
        clip(F.coalesce("confidence", F.lit(0.75)), 0.01, 0.99).alias("confidence"),
        S.restock_advice(have, need).alias("recommendations"))


def forecast_growth(history: DataFrame, future: DataFrame) -> DataFrame:
    """Future rows with the product's mean past quantity, growth against it and a note."""
    past = (history.filter("quantity_sold IS NOT NULL AND product_code IS NOT NULL").groupBy("product_code")
            .agg(half_even(F.avg("quantity_sold"), 2).alias("avg_daily_sales")))
    rows = future.join(past, "product_code", "left").withColumn(
        "avg_daily_sales", F.coalesce("avg_daily_sales", F.lit(0.0)))
    p, a = F.col("predicted_quantity_sold"), F.col("avg_daily_sales")
    rows = rows.withColumn("_growth", half_even(ratio(p - a, a) * 100, 2))
    return rows.withColumns({"notes": S.growth_note(F.col("_growth"), a, p),
                             "growth_rate": F.coalesce("_growth", F.lit(100.0))}).drop("_growth")


def high_demand(summary: DataFrame, threshold: float = 1000) -> DataFrame:
    return summary.filter(F.col("forecast_quantity") > threshold).orderBy(
        F.desc("forecast_quantity"), "product_code", "branch_code")


def low_stock(summary: DataFrame, threshold: float = 100) -> DataFrame:
    return summary.filter(F.col("Last_on_hand") < threshold).orderBy("Last_on_hand", "product_code", "branch_code")


def chart_series(long: DataFrame, product: str, branch: str | None = None) -> DataFrame:
    """Dates of one product in order, with the actual or else the predicted quantity."""
    rows = long.filter(F.col("product_code") == product)
    if branch not in (None, "", "all"):
        rows = rows.filter(F.col("branch_code") == branch)
    p = F.col("predicted_quantity_sold")
    return rows.select("branch_code", "sale_date", F.when(p.isNull(), F.col("quantity_sold")).alias("actual"),
                       p.alias("predicted")).orderBy("sale_date", "branch_code")


def forecast_accuracy(fitted: DataFrame, actual: str = "quantity_sold",
                      predicted: str = "predicted_quantity_sold") -> DataFrame:
    """MAE, RMSE, MAPE (an actual of 0 counts as 1) and population deviation of the residuals."""
    a, e = F.col(actual), F.col(actual) - F.col(predicted)
    return fitted.agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e / F.when(a == 0, 1.0).otherwise(a)) * 100).alias("mape"), F.stddev_pop(e).alias("std_resid"))


def forecast_report_table(summary: DataFrame) -> DataFrame:
    """Export form of the summary: no infinities, confidence as a bounded percent, gaps filled except in the
    order quantities.

    The summary is written once: the highest confidence and the rows both read it."""
    summary = staged(summary)
    def finite(c: str) -> Column:
        v = F.col(c)
        return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)

    top = summary.agg(F.max(finite("confidence"))).scalar()
    rows = summary.withColumn("_top", top)
    conf = F.when(F.col("_top") <= 1.01, finite("confidence") * 100).otherwise(finite("confidence"))
    out = []
    for name, kind in summary.dtypes:
        if name == "confidence":
            c = half_even(clip(F.coalesce(conf, F.lit(75.0)), 1, 99), 2)
        elif name in ("forecast_quantity", "expected_demand"):
            c = finite(name)
        elif kind in ("double", "float"):
            c = F.coalesce(finite(name), F.lit(0.0))
        elif kind == "string":
            c = F.coalesce(name, F.lit(TEXT_MISSING))
        else:
            c = F.coalesce(F.col(name), F.lit(0).cast(kind))
        out.append(c.alias(name))
    return rows.select(*out)


TEXT_MISSING = "غير متوفر"

# --- series -------------------------------------------------------------------------------------


def daily_series(df: DataFrame, keys: Sequence[str], value: str = "quantity_sold", date: str = "sale_date") -> DataFrame:
    """One row per key and day. After this a series is no longer than its calendar, whatever the row count."""
    return df.dropna(subset=[*keys, date]).groupBy(*keys, date).agg(F.sum(value).alias(value))


def normalized_trend(series: DataFrame, keys: Sequence[str], value: str = "quantity_sold",
                     date: str = "sale_date") -> DataFrame:
    """Slope of a straight line over the day index, relative to the mean; nulls keep their index but are skipped."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(date)) - 1
    fit = series.withColumn("_x", at.cast("double")).groupBy(*keys).agg(
        F.count(value).alias("points"), F.regr_slope(F.col(value), F.col("_x")).alias("_s"), F.avg(value).alias("_m"))
    slope = F.when(F.col("points") < 2, 0.0).otherwise(F.coalesce(F.try_divide("_s", "_m"), F.lit(0.0)))
    return fit.select(*keys, "points", slope.alias("trend"))


def temporal_split(series: DataFrame, keys: Sequence[str], share: float = 0.2, date: str = "sale_date") -> DataFrame:
    """Mark the newest ``ceil(share * n)`` rows of each day series as test, the older ones as train."""
    by = Window.partitionBy(*keys)
    at, n = F.row_number().over(by.orderBy(date)), F.count(F.lit(1)).over(by)
    return series.withColumns({"_at": at, "_n": n}).withColumn(
        "split", F.when(F.col("_at") > F.col("_n") - F.ceil(F.col("_n") * share), "test").otherwise("train")) \
        .drop("_at", "_n")


def per_series_trend(series: DataFrame, keys: Sequence[str], periods: int, value: str = "quantity_sold",
                     date: str = "sale_date") -> DataFrame:
    """Straight-line outlook per series, never negative.

    Days move to their series as they are, at most one row per calendar day: sums of a line are wider than a day, and where
    a series' days are spread over the tasks, as after ``daily_series``, they would be built for nearly every day first."""
    x = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("double")
    fit = series.repartition(*keys).withColumn("_x", x).groupBy(*keys).agg(
        F.regr_slope(F.col(value), F.col("_x")).alias("_s"), F.regr_intercept(F.col(value), F.col("_x")).alias("_i"),
        F.max(date).alias("_last"))
    rows = fit.filter("_s IS NOT NULL").withColumn(
        date, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", _ahead(periods)))))
    return rows.select(*keys, date, F.greatest(F.col("_s") * x + F.col("_i"), F.lit(0.0)).alias("predicted"))


def weekly_totals(df: DataFrame, value: str, date: str = "sale_date") -> DataFrame:
    """Sum per week ending on Sunday; weeks without rows are there with 0."""
    week = F.date_add(F.trunc(date, "week"), 6)
    per = df.groupBy(week.alias("week_end")).agg(F.sum(value).alias("total"))
    ends = per.agg(F.struct(F.min("week_end").alias("a"), F.max("week_end").alias("b"))).scalar()
    weeks = per.sparkSession.range(1).select(ends.alias("_e")).select(
        F.explode(F.expr("sequence(_e.a, _e.b, interval 7 days)")).alias("week_end"))
    return weeks.join(per, "week_end", "left").select("week_end", F.coalesce("total", F.lit(0.0)).alias("total"))


def recent_vs_overall(sales: DataFrame, order: Sequence[str], n: int = 10, value: str = "revenue") -> DataFrame:
    """Mean of the newest ``n`` rows against the mean of all, with a rise/fall flag."""
    newest = sales.orderBy(*[F.desc(c) for c in order]).limit(n).agg(F.avg(F.col(value).cast("double"))).scalar()
    overall = sales.agg(F.avg(F.col(value).cast("double")).alias("overall_avg")).withColumn("recent_avg", newest)
    r, o = F.col("recent_avg"), F.col("overall_avg")
    return overall.withColumn("trend", F.when(r > o * 1.1, TREND_UP).when(r < o * 0.9, TREND_DOWN))


# Trend findings.
TREND_UP, TREND_DOWN = "اتجاه تصاعدي في المبيعات الأخيرة", "انخفاض في المبيعات الأخيرة"


def forecast_spread(forecast: DataFrame, keys: Sequence[str] = (), value: str = "predicted_quantity_sold",
                    date: str = "sale_date") -> DataFrame:
    """Total, mean, sample variance and date span of the predictions, per group."""
    return forecast.groupBy(*keys).agg(
        F.sum(value).alias("total_predicted_quantity"), F.avg(value).alias("average_prediction"),
        F.var_samp(value).alias("prediction_variance"), F.min(date).alias("start_date"), F.max(date).alias("end_date"),
        F.datediff(F.max(date), F.min(date)).alias("duration_days"))
