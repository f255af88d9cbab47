import datetime as dt
import itertools
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from branchlight.functions import calendar as cal, stock as S
from branchlight.operators import cell_trees as ct, demand_model as dm, forecast as fc, forecast_review as fr, series_trees as trees
from branchlight.plans import q_forecast

D = dt.date


def dates(spark, *days):
    return spark.createDataFrame([(d,) for d in days], "sale_date date")


def test_calendar_features(spark):
    r = cal.with_time_features(dates(spark, D(2024, 3, 8))).first()   # a Friday
    assert (r.day_of_week, r.sale_day, r.is_weekend, r.week_of_year, r.is_salary_peak) == (4, "Friday", 1, 10, 1)


def test_lunar_seasons(spark):
    got = {r.sale_date: r.seasonal_event for r in cal.tag_hijri_season(
        dates(spark, D(2024, 3, 10), D(2024, 3, 11), D(2024, 3, 12), D(2024, 6, 9)), cal.hijri_seasons(spark, D(2020, 1, 1), D(2030, 1, 1))).collect()}
    assert got == {D(2024, 3, 10): cal.SEASON_BEFORE_FAST, D(2024, 3, 11): cal.SEASON_FAST_START, D(2024, 3, 12): None,
                   D(2024, 6, 9): cal.SEASON_BEFORE_FEAST}


def test_last_listed_event_wins_and_no_calendar_means_none(spark):
    ev = spark.createDataFrame([(0, "late", D(2024, 1, 1), D(2024, 1, 5)), (1, "early", D(2024, 1, 4), D(2024, 1, 6))],
                               "event_order int, event_name string, start_date date, end_date date")
    days = dates(spark, D(2024, 1, 1), D(2024, 1, 5), D(2024, 1, 7))
    got = {r.sale_date.day: (r.special_event_name, r.is_special_event) for r in cal.tag_special_events(days, ev).collect()}
    assert got == {1: ("late", 1), 5: ("early", 1), 7: ("None", 0)}
    assert {r.special_event_name for r in cal.tag_special_events(days, None).collect()} == {"None"}


def history(spark):
    rows = [("p", "A", D(2024, 1, n), float(n), 2.0 if n != 3 else None, 10) for n in (1, 2, 3)] + \
        [("q", "B", D(2024, 1, 2), 4.0, 1.0, None)]
    return spark.createDataFrame(rows, "product_code string, branch_code string, sale_date date, quantity_sold double, "
                                       "price double, Last_on_hand long")


def test_grid_starts_after_the_global_last_day(spark):
    grid = fc.future_grid(history(spark), 2).collect()
    assert sorted({(r.product_code, r.sale_date) for r in grid}) == [
        ("p", D(2024, 1, 4)), ("p", D(2024, 1, 5)), ("q", D(2024, 1, 4)), ("q", D(2024, 1, 5))]


def test_last_known_skips_nulls_and_prices_do_not_cross_products(spark):
    got = {r.product_code: r for r in fc.last_known(history(spark), ["price", "Last_on_hand"]).collect()}
    assert got["p"].price == 2.0 and got["q"].Last_on_hand is None
    filled = {(r.product_code, r.sale_date.day): r.price for r in fc.fill_forward_price(history(spark)).collect()}
    assert filled[("p", 3)] == 2.0 and filled[("q", 2)] == 1.0


def test_confidence_bounds(spark):
    df = spark.createDataFrame([(None, 0), (0.0, 0), (1.0, 0), (1000.0, 0), (1000.0, 10)], "p double, n int")
    got = [r[0] for r in df.select(fc.confidence_score(F.col("p"), F.lit(2.0), F.col("n"))).collect()]
    assert got[:4] == [0.05, 0.05, 0.01, 0.98] and got[4] == pytest.approx(0.948)


def test_summary_advice_and_order(spark):
    past = history(spark).withColumns({"product_name": F.lit("n"), "item_category1": F.lit("c"), "item_category2": F.lit("d")})
    ahead = spark.createDataFrame([("p", "A", D(2024, 1, 4), 30.0), ("q", "B", D(2024, 1, 4), 0.0)],
                                  "product_code string, branch_code string, sale_date date, predicted_quantity_sold double")
    long = fc.forecast_confidence(fc.forecast_long(past, ahead), F.lit(1.0), F.lit("2024-01-04").cast("date"))
    got = {r.product_code: r for r in fc.forecast_summary(long).collect()}
    assert got["p"].expected_demand == 20.0 and got["p"].recommendations == S.RESTOCK
    assert got["q"].expected_demand is None and got["q"].recommendations == S.ADEQUATE and got["q"].confidence == 0.05


def test_growth_notes(spark):
    past = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("z", 0.0)], "product_code string, quantity_sold double")
    ahead = spark.createDataFrame([("a", 13.0), ("b", 7.0), ("a", 11.0), ("new", 5.0), ("new", 0.0)],
                                  "product_code string, predicted_quantity_sold double")
    got = [(r.product_code, r.growth_rate, r.notes) for r in fc.forecast_growth(past, ahead).collect()]
    assert sorted(got) == sorted([("a", 30.0, S.NOTE_GROWTH), ("b", -30.0, S.NOTE_DECLINE), ("a", 10.0, S.NOTE_STABLE),
                                  ("new", 100.0, S.NOTE_NEW), ("new", 100.0, S.NOTE_NONE)])


def test_trend_and_split(spark):
    s = fc.daily_series(history(spark), ["product_code"])
    got = {r.product_code: r.trend for r in fc.normalized_trend(s, ["product_code"]).collect()}
    assert got["p"] == pytest.approx(0.5) and got["q"] == 0.0
    split = {r.sale_date.day: r.split for r in fc.temporal_split(s.filter("product_code = 'p'"), ["product_code"]).collect()}
    assert split == {1: "train", 2: "train", 3: "test"}


def test_weeks_without_sales_are_listed(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 3.0), (D(2024, 1, 17), 2.0)], "sale_date date, quantity_sold double")
    assert [(r.week_end.day, r.total) for r in fc.weekly_totals(df, "quantity_sold").orderBy("week_end").collect()] == [
        (7, 3.0), (14, 0.0), (21, 2.0)]


def test_review_defaults(spark):
    fig = spark.createDataFrame([("g", 1.0, 1.0, 0.0, 0.0)], "g string, prediction_variance double, "
                                "historical_variance double, historical_trend double, missing_ratio double")
    r = fr.forecast_actions(fr.forecast_risk(fr.forecast_bounds(fig)), 3).first()
    assert r.risk_factors == fr.RISK_DEFAULTS and r.adjustments == fr.ADJUST_DEFAULTS
    assert r.confidence_score == 82.0 and r.risk_level == fr.LEVEL_MEDIUM
    assert r.lower_bound == pytest.approx(0.9) and r.confidence_level == 0.95


def test_review_of_one_group_for_all(spark):
    past = history(spark)
    ahead = spark.createDataFrame([("p", "A", D(2024, 1, 4), 30.0), ("q", "B", D(2024, 1, 5), 10.0)],
                                  "product_code string, branch_code string, sale_date date, predicted_quantity_sold double")
    got = fr.enhance_forecast(ahead, past, [], 12).collect()
    assert len(got) == 2 and got[0].prediction_variance == 200.0 and fr.FACTOR_WINTER in got[0].external_factors
    assert {r.predicted_quantity_sold_upper for r in got} == {30.0 * 1.4, 14.0}


def test_model_beats_the_global_mean_and_predictions_are_usable(spark):
    rows = [("p" + str(i % 3), "A", D(2024, 1, 1) + dt.timedelta(days=n), 5.0 + 10 * (n % 7 == 4) + i % 3, 2.0)
            for i in range(3) for n in range(90)]
    u = spark.createDataFrame(rows, "product_code string, branch_code string, sale_date date, quantity_sold double, price double") \
        .selectExpr("*", "cast(quantity_sold * price as decimal(18,4)) AS revenue", "cast(0 as decimal(18,4)) AS discount",
                    "50L AS Last_on_hand", "'n' AS product_name", "'c' AS item_category1", "'d' AS item_category2")
    long, summary, model = dm.run_forecast(fc.daily_totals(u), 7, None, cal.hijri_seasons(spark, D(2020, 1, 1), D(2030, 1, 1)), trees=8, depth=4, rate=0.3)
    assert model.metrics["rmse"] < model.metrics["global_std"]
    assert sum(w for _, w in model.importances) == pytest.approx(1.0)
    ahead = long.filter("predicted_quantity_sold IS NOT NULL").collect()
    assert len(ahead) == 21 and all(r.predicted_quantity_sold >= 0 and 0.01 <= r.confidence <= 0.98 for r in ahead)
    assert summary.count() == 3


def test_trees_on_cells_are_those_on_rows(spark, tmp_path):
    """Amounts of few values have one bin each, so cells and rows give the same trees; a cell holds many rows."""
    rng = np.random.default_rng(1)  # noise, so that no two splits are equally good
    rows = [(f"p{p}", "A", D(2024, 1, 1) + dt.timedelta(days=i), float(rng.normal() + 3 * (i % 7 > 4) + 2 * (p % 3) - p % 2 + i / 20), 1.0 + p % 3, float(p % 2))
            for p in range(60) for i in range(60)]
    daily = spark.createDataFrame(rows, "product_code string, branch_code string, sale_date date, quantity_sold double, price double, discount double")
    features = fc.daily_features(daily, None, cal.hijri_seasons(spark, D(2024, 1, 1), D(2024, 3, 1)))
    plain = dm.train_demand_model(features, trees=4, depth=3)
    cells = dm.train_demand_model(features, trees=4, depth=3, most_rows=0)
    assert cells.metrics["train_rows"] == plain.metrics["train_rows"] > 10 * 60
    for k, v in plain.metrics.items():
        assert cells.metrics[k] == pytest.approx(v, rel=1e-6)
    assert dict(cells.importances) == pytest.approx(dict(plain.importances), rel=1e-6, abs=1e-9)
    assert cells.pipeline.stages[-1].getFeaturesCol() == "bins"
    dm.save_model(spark, cells, str(tmp_path / "m"))
    again = dm.load_model(spark, str(tmp_path / "m"))
    assert dm.model_metrics(again, features).first().asDict() == pytest.approx(plain.metrics, rel=1e-6)
    used = {r.feature: r.used_rows for r in dm.importance_use(again, features).collect()}
    assert used["price"] == 3600 and used["discount"] == 1800


def test_a_saved_model_is_loaded_not_trained(spark, tmp_path, monkeypatch):
    rows = [(f"p{i % 3}", "N", D(2024, 1, 1) + dt.timedelta(days=i // 3), float(i % 7 + (i // 3) % 7), 2.0) for i in range(240)]
    u = spark.createDataFrame(rows, "product_code string, branch_code string, sale_date date, quantity_sold double, price double") \
        .selectExpr("*", "cast(quantity_sold * price as decimal(18,4)) AS revenue", "cast(0 as decimal(18,4)) AS discount",
                    "50L AS Last_on_hand", "'n' AS product_name", "'c' AS item_category1", "'d' AS item_category2")
    features = fc.daily_features(fc.daily_totals(u), None, cal.hijri_seasons(spark, D(2020, 1, 1), D(2030, 1, 1)))
    model = dm.train_demand_model(features, trees=3, depth=3)
    path = str(tmp_path / "model")
    assert dm.load_model(spark, path) is None
    dm.save_model(spark, model, path)
    monkeypatch.setattr(dm, "train_demand_model", None)
    again = dm.load_model(spark, path)
    assert (again.metrics, again.importances, again.margin) == (model.metrics, model.importances, model.margin)
    scored = [dm.model_metrics(m, features).first() for m in (model, again)]
    assert scored[0].asDict() == pytest.approx(scored[1].asDict()) and scored[0].mae == pytest.approx(model.metrics["mae"])
    used = {r.feature: r for r in dm.importance_use(again, features).collect()}
    assert {f: r.importance for f, r in used.items()} == pytest.approx(dict(model.importances))
    assert used["day"].used_rows == features.count() and used["discount"].used_rows == 0
    assert used["is_weekend"].used_rows == features.filter("is_weekend = 1").count()
    assert dm.data_fingerprint(u) == dm.data_fingerprint(u.repartition(5)) != dm.data_fingerprint(u.limit(3))


def test_series_outlook_follows_a_straight_line(spark):
    s = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(days=n), 100.0 + n) for n in range(120)],
                              "k string, sale_date date, quantity_sold double")
    got = dm.per_series_forecast(s, ["k"], 5).orderBy("sale_date").collect()
    assert len(got) == 5 and abs(got[0].predicted - 220) < 5 and all(0 <= r.confidence <= 0.98 for r in got)


def steps(n, seed=0):
    """Weekends, a summer and the ends of months stand out; ``n`` days with a little noise."""
    days = pd.date_range("2021-03-01", periods=n)
    rnd = np.random.default_rng(seed)
    level = 20 + 15 * (days.dayofweek >= 5) + 10 * days.month.isin([6, 7, 8]) + 8 * (days.day >= 28)
    return days, np.asarray(level, float) + rnd.normal(0, 0.5, n)


def test_series_trees_split_best_and_learn_steps():
    days, y = steps(300)
    x = trees.calendar_bins(days)
    stump = trees.fit_series(x, y, trees=1, depth=1)
    g = y - y.mean()

    def gain(left):
        parts = [(g[s].sum(), s.sum()) for s in (left, ~left)]
        return max(-1.0, sum(a * a / (n + 1) for a, n in parts)) if all(n for _, n in parts) else -1.0
    best = max(gain(x[:, j] <= c) for j in range(3) for c in range(31))
    left = x[:, stump.feature[0, 0]] <= stump.cut[0, 0]
    assert gain(left) == pytest.approx(best)
    assert stump.predict(x)[left][0] == pytest.approx(y.mean() + 0.1 * g[left].sum() / (left.sum() + 1))
    days, y = steps(1_000)
    x = trees.calendar_bins(days)
    model = trees.fit_series(x[:800], y[:800])
    assert model.feature.shape == (100, 63) and np.sqrt(((model.predict(x[800:]) - y[800:]) ** 2).mean()) < 1.5
    # Learning more never fits the learned days worse, and a constant series stays constant.
    errors = [np.abs(trees.fit_series(x, y, trees=n).predict(x) - y).mean() for n in (0, 1, 10, 100)]
    assert errors == sorted(errors, reverse=True)
    assert trees.fit_series(x, np.full(1_000, 4.0)).predict(x) == pytest.approx(np.full(1_000, 4.0))
    assert trees.fit_series(x[:1], y[:1]).predict(x[:5]) == pytest.approx(np.full(5, y[0]))


def test_series_trees_beat_least_squares_on_calendar_steps(spark):
    rows = [(k, d.date(), float(v)) for k in range(4) for d, v in zip(*steps(900, k))] + [(9, D(2024, 1, 1), 3.0)]
    s = spark.createDataFrame(rows, "k int, sale_date date, quantity_sold double")
    found = {m: {r.k: r for r in dm.per_series_forecast(s, ["k"], 30, model=m).collect()} for m in ("trees", "least_squares")}
    for k in range(4):
        assert found["trees"][k].rmse < found["least_squares"][k].rmse
    ahead = dm.per_series_forecast(s.filter("k = 9"), ["k"], 30, model="trees").collect()
    assert len(ahead) == 30 and {r.predicted for r in ahead} == {3.0}


def test_seasons_follow_the_dates(spark):
    far = dates(spark, D(1950, 6, 1), D(2060, 1, 1))
    days = cal.seasons_of(far, 3).agg(F.min("season_day"), F.max("season_day")).first()
    assert days[0].year == 1950 and days[1].year >= 2059
    assert cal.seasons_of(far.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cal.hijri_seasons(spark, D(1800, 1, 1), D(2000, 1, 1))


def test_reversed_events_have_no_day(spark):
    ev = spark.createDataFrame([(1, "x", D(2024, 1, 10), D(2024, 1, 5)), (2, "y", D(2024, 1, 8), D(2024, 1, 8))],
                               "event_order int, event_name string, start_date date, end_date date")
    got = {r.sale_date: r.special_event_name for r in cal.tag_special_events(dates(spark, D(2024, 1, 7), D(2024, 1, 8)), ev).collect()}
    assert got == {D(2024, 1, 7): "None", D(2024, 1, 8): "y"}


def test_at_least_one_day_ahead(spark):
    for build in (lambda h: fc.future_grid(h, 0), lambda h: fc.baseline_forecast(h, 0), lambda h: fc.per_series_trend(h, ["product_code"], 0)):
        with pytest.raises(ValueError):
            build(history(spark))


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_the_report_computes_its_summary_once(spark):
    """F8"""
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    summary = spark.createDataFrame([("p", "A", 5.0, 0.5), ("q", "A", 7.0, 0.25)], "product_code string, branch_code string, forecast_quantity double, "
                                    "confidence double").withColumn("confidence", F.udf(note, "double")("confidence"))
    got = {r.product_code: r.confidence for r in fc.forecast_report_table(summary).collect()}
    assert got == {"p": 50.0, "q": 25.0} and seen.value == 2


def sales_rows(spark, rows):
    return spark.createDataFrame(rows, "product_code string, branch_code string, sale_date date, quantity_sold double, revenue double")


def stock_rows(spark, rows):
    return spark.createDataFrame(rows, "product_code string, branch_code string, product_name string, item_category1 string, "
                                       "item_category2 string, Last_on_hand long")


def test_daily_history_keeps_active_days_with_their_stock(spark):
    day = D(2024, 1, 1)
    sales = sales_rows(spark, [("sold", "A", day, 2.0, 8.0), ("sold", "A", day, 1.0, 4.0), ("sold", "B", day, 1.0, 1.0), ("idle", "A", day, 0.0, 0.0),
                               ("stocked", "A", day, 0.0, 0.0), ("orphan", "A", day, 1.0, 1.0), (None, "A", day, 1.0, 1.0), ("sold", None, day, 1.0, 1.0)])
    stock = stock_rows(spark, [("sold", "A", "b", "c", "d", 0), ("sold", "A", "a", "z", "z", 0), ("sold", None, "n", "c", "d", 0), ("idle", "A", "i", "c", "d", 0),
                               ("stocked", "B", "s", "c", "d", 3), (None, "A", "x", "c", "d", 3), (None, None, "y", "c", "d", 3)])
    out = fc.daily_history(sales, stock)
    assert out.columns == ["product_code", "branch_code", "sale_date", "quantity_sold", "revenue", "price", "discount", "product_name", "item_category1",
                           "item_category2", "Last_on_hand"]
    assert {(r.product_code, r.branch_code, r.quantity_sold, r.product_name, r.Last_on_hand) for r in out.collect()} == {
        ("sold", "A", 3.0, "a", 0), ("sold", "B", 1.0, None, None), ("stocked", "A", 0.0, None, None)}
    assert fc.daily_history(sales, stock.limit(0)).count() == 5
    assert fc.daily_history(sales, stock.filter("product_code IS NULL")).count() == 0


def test_day_rows_are_shuffled_by_product_once(spark, capsys):
    """F10, F16: after the grouping by day, the activity rule and the attributes need one more shuffle of the days; calendar days are broadcast."""
    sales, stock = sales_rows(spark, [("p", "A", D(2024, 1, 1), 2.0, 8.0)]), stock_rows(spark, [("p", "A", "n", "c", "d", 1)])
    daily = fc.daily_history(sales, stock)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        history = plan_of(daily, capsys)
        ev = spark.createDataFrame([(0, "fair", D(2024, 1, 1), D(2024, 1, 5))], "event_order int, event_name string, start_date date, end_date date")
        features = plan_of(fc.daily_features(daily, ev, cal.seasons_of(daily)), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # By (product, branch, day), by product, and the stock rows by product.
    assert history.count("Exchange hashpartitioning") == 3
    # Beside these only the event list's own grouping, whose rows are days of the calendar.
    assert features.count("Exchange hashpartitioning") == 4 and features.count("BroadcastHashJoin") == 2


def test_weekday_means_shuffle_pairs_not_days(spark, capsys):
    """F12 to F14, F17"""
    rows = spark.createDataFrame([("p", "A", D(2024, 1, n), q) for n, q in ((1, 2.0), (8, 4.0), (2, None), (3, 9.0))] + [("q", "A", D(2024, 1, 1), None)],
                                 "product_code string, branch_code string, sale_date date, quantity_sold double")
    means = fc.weekday_means(rows)
    got = {r.product_code: (r.by_weekday, r.overall) for r in means.collect()}
    assert got == {"p": ({0: 3.0, 1: None, 2: 9.0}, 5.0), "q": ({0: None}, None)}
    assert plan_of(fc.weekday_means(rows), capsys).count("Exchange") == 1


def test_review_of_few_groups_is_broadcast(spark, capsys, monkeypatch):
    """F11"""
    ahead = spark.createDataFrame([("p", b, D(2024, 1, n), float(n)) for b in "AB" for n in (8, 9)], "product_code string, branch_code string, sale_date date, "
                                  "predicted_quantity_sold double")
    past = spark.createDataFrame([("p", b, D(2024, 1, n), float(n)) for b in "AB" for n in (1, 2, 3)], "product_code string, branch_code string, sale_date date, "
                                 "quantity_sold double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = fr.enhance_forecast(ahead, past, ["branch_code"], 11)
        assert "Exchange hashpartitioning" not in plan_of(few, capsys)
        monkeypatch.setattr(fr, "FEW_GROUPS", 1)
        many = fr.enhance_forecast(ahead, past, ["branch_code"], 11)
        assert "Exchange hashpartitioning" in plan_of(many, capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() == 4


def test_line_sums_are_built_after_days_have_met(spark, capsys):
    """F9"""
    rows = spark.createDataFrame([("p", D(2024, 1, n), float(n)) for n in (1, 2, 4)], "product_code string, sale_date date, quantity_sold double")
    plan = plan_of(fc.per_series_trend(fc.daily_series(rows, ["product_code"]), ["product_code"], 1), capsys)
    assert 0 < plan.index("partial_regr_slope") < plan.index("Exchange hashpartitioning(product_code")


def noisy_features(spark, days=60, products=20):
    rng = np.random.default_rng(2)
    rows = [(f"p{p}", "A", D(2024, 1, 1) + dt.timedelta(days=i), float(rng.normal() + 3 * (i % 7 > 4) + p % 3 + i / 20), float(p % 7), float((p + i) % 5))
            for p in range(products) for i in range(days)]
    daily = spark.createDataFrame(rows, "product_code string, branch_code string, sale_date date, quantity_sold double, price double, discount double")
    return fc.daily_features(daily, None, cal.hijri_seasons(spark, D(2024, 1, 1), D(2024, 12, 31)))


def test_cells_give_the_best_split_of_all_and_one_value_each():
    """F1 to F4"""
    rng = np.random.default_rng(5)
    x = np.zeros((30, 4))
    x[:, 1], x[:, 2] = np.arange(30) % 7, np.arange(30) // 7
    rows = rng.poisson(1.5, (30, 12)).astype(float)  # four bins by three, some cells empty
    total = rows * rng.normal(size=(30, 12))

    def gain(left):
        parts = [(rows[s].sum(), total[s].sum()) for s in (left, ~left)]
        return sum(t * t / n for n, t in parts) if all(n for n, _ in parts) else -1.0
    first, second = np.broadcast_to(np.arange(12) // 3, rows.shape), np.broadcast_to(np.arange(12) % 3, rows.shape)
    best = max([gain(np.isin(b, s)) for b, n in ((first, 4), (second, 3)) for k in range(1, n) for s in itertools.combinations(range(n), k)] +
               [gain(np.broadcast_to((x[:, f] <= c)[:, None], rows.shape)) for f in (1, 2) for c in range(7)])
    grown, gains = ct.fit_cells(x, rows, total, (0, 3), (4, 3), 32, trees=1, depth=1, rate=.1)
    assert gains.sum() == pytest.approx(best - total.sum() ** 2 / rows.sum())
    grown, gains = ct.fit_cells(x, rows, total, (0, 3), (4, 3), 32, trees=20, depth=4, rate=.1)
    full = np.repeat(x, 12, axis=0)
    full[:, 0], full[:, 3] = first.ravel(), second.ravel()
    assert grown.surface(x, (4, 3)).ravel() == pytest.approx(grown.predict(full))
    errors = [((total - rows * ct.fit_cells(x, rows, total, (0, 3), (4, 3), 32, n, 3, .1)[0].surface(x, (4, 3))) ** 2 / np.maximum(rows, 1)).sum() for n in (1, 5, 50)]
    assert errors == sorted(errors, reverse=True)
    # Nothing to gain: one leaf.
    flat, gains = ct.fit_cells(x, rows, 2 * rows, (0, 3), (4, 3), 32, trees=2, depth=2, rate=.1)
    assert gains.sum() == 0 and flat.surface(x, (4, 3)) == pytest.approx(2.0)
    assert ct.cuts_of(np.arange(53.), np.ones(53), 32).size == 31 and ct.cuts_of(np.array([3., 1., 3.]), np.ones(3), 32).tolist() == [2.0]


def test_trees_on_cells_take_few_jobs_and_rows_look_their_value_up(spark, tmp_path, capsys):
    """F1 to F4: the jobs of a training don't grow with its trees, and no row walks the trees."""
    features = noisy_features(spark)
    spark.sparkContext.setJobGroup("cells", "")
    try:
        model = dm.train_demand_model(features, trees=30, depth=4, most_rows=0)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cells"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 60
    dm.save_model(spark, model, str(tmp_path / "m"))
    again = dm.load_model(spark, str(tmp_path / "m"))
    # Days, prices and discounts beyond those of the training, and gaps.
    other = features.withColumns({"price": F.col("price") * 3 - 2, "discount": F.when(F.col("price") > 2, F.col("discount") + .5),
                                  "sale_date": F.date_add("sale_date", 40)}).select(*fc.PAIR, "sale_date", "quantity_sold", "price", "discount")
    rows = dm.model_inputs(fc.daily_features(other, None, cal.hijri_seasons(spark, D(2024, 1, 1), D(2024, 12, 31))))
    looked_up = dm.scored(again.pipeline, rows)
    plan = plan_of(looked_up, capsys)
    assert plan.count("ArrowEvalPython") == 1 and "UDF(" not in plan.split("BroadcastExchange")[0]
    got = {(r.product_code, r.sale_date): r.prediction for r in looked_up.collect()}
    walked = {(r.product_code, r.sale_date): r.prediction for r in again.pipeline.transform(rows).collect()}
    assert len(got) == 1200 and got == pytest.approx(walked) and len(set(got.values())) > 50
    with pytest.raises(ValueError):
        dm.train_demand_model(features.withColumn("quantity_sold", F.when(F.col("price") > 1, F.col("quantity_sold"))), trees=1, most_rows=0)
    with pytest.raises(Exception, match="NaN"):
        dm.scored(again.pipeline, rows.withColumn("price", F.lit(float("nan")))).collect()


def test_a_model_is_found_by_the_stored_day_rows(spark, monkeypatch):
    """F1 to F4: finding, training and saving a model read no sales beyond the stored history."""
    monkeypatch.setattr(q_forecast.fx, "sales", None)
    monkeypatch.setattr(q_forecast, "_MODELS", {})
    trained = []
    monkeypatch.setattr(dm, "train_demand_model", lambda features, train=dm.train_demand_model: trained.append(1) or train(features, trees=2, depth=2))
    # Models outlive a session where it names their folder: rows that no run before had.
    features = noisy_features(spark).withColumn("branch_code", F.lit(uuid.uuid4().hex))
    rows = features.select(*fc.PAIR, "sale_date", "quantity_sold", "price", "discount")
    model = q_forecast.fitted_model(spark, "d", rows, features)
    q_forecast._MODELS.clear()
    # Another order of sums changes a float's last places only.
    again = q_forecast.fitted_model(spark, "d", rows.withColumn("price", F.col("price") * (1 + 1e-15)).repartition(3), features)
    assert again.metrics == model.metrics and len(trained) == 1
    q_forecast._MODELS.clear()
    q_forecast.fitted_model(spark, "d", rows.withColumn("price", F.col("price") + 1), features)
    assert len(trained) == 2


def test_used_rows_are_counted_without_unfolding_vectors(spark, capsys):
    """F4"""
    features = noisy_features(spark)
    for most in (0, 10_000):
        model = dm.train_demand_model(features, trees=2, depth=2, most_rows=most)
        out = dm.importance_use(model, features)
        plan = plan_of(out, capsys)
        assert plan.count("Exchange SinglePartition") == 1 and not any(s in plan for s in ("Exchange hashpartitioning", "UDF", "posexplode"))
        got = {r.feature: r for r in out.collect()}
        encoded = dm.as_arrays(model.pipeline.transform(dm.model_inputs(features))).select("features").collect()
        want = {n: sum(r.features[i] != 0 for r in encoded) for i, n in enumerate(dm._feature_names(model.pipeline))}
        assert {n: r.used_rows for n, r in got.items()} == want and set(want.values()) > {1200, 0}
        assert {n: r.importance for n, r in got.items()} == pytest.approx(dict(model.importances))
        assert dm.importance_use(model, features.limit(0)).count() == 0


def full_history(spark):
    """Pairs of one day and of more, with gaps in their values."""
    rows = [("p", "A", D(2024, 1, 1), 3.0, 2.0, 0.5, "n", "c", "d", 10), ("p", "A", D(2024, 1, 3), 4.0, None, None, None, "c2", None, None),
            ("p", "B", D(2024, 1, 2), 5.0, 9.0, 0.0, "n", "c", "d", 1), ("q", "A", D(2024, 1, 2), 6.0, None, 1.0, None, None, None, None)]
    return spark.createDataFrame(rows, "product_code string, branch_code string, sale_date date, quantity_sold double, price double, discount double, "
                                       "product_name string, item_category1 string, item_category2 string, Last_on_hand long")


def test_future_rows_unfold_from_the_last_known_values(spark, capsys):
    """F3"""
    history = full_history(spark)
    got, want = fc.future_rows(history, 3), fc.attach_last_known(fc.future_grid(history, 3), history)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 9
    assert [r.sale_date for r in fc.future_days(history, 3).collect()] == [D(2024, 1, n) for n in (4, 5, 6)]
    assert fc.future_days(history.limit(0), 3).count() == fc.future_rows(history.limit(0), 3).count() == 0
    model = dm.train_demand_model(noisy_features(spark), trees=3, depth=3, most_rows=0)
    seasons = cal.hijri_seasons(spark, D(2024, 1, 1), D(2024, 3, 1))
    ahead = dm.predict_future(model, history, 3, None, seasons)
    # The pairs' one shuffle; joins meet broadcast calendars only, and these come from the days ahead.
    plan = plan_of(ahead, capsys).split("Subqueries")[0]
    assert plan.count("Exchange hashpartitioning(product_code") == 1 and "SortMergeJoin" not in plan
    rows = dm.model_inputs(fc.with_calendar(want, None, seasons))
    walked = {(r.product_code, r.branch_code, r.sale_date): max(float(np.rint(r.prediction)), 0.0) for r in model.pipeline.transform(rows).collect()}
    assert {(r.product_code, r.branch_code, r.sale_date): r.predicted_quantity_sold for r in ahead.collect()} == walked


def test_a_stored_history_is_not_written_again(spark, monkeypatch):
    """F3"""
    model = dm.train_demand_model(noisy_features(spark), trees=3, depth=3, most_rows=0)
    seasons = cal.hijri_seasons(spark, D(2024, 1, 1), D(2024, 3, 1))
    both = [dm.run_forecast(full_history(spark), 2, None, seasons, model)[:2]]
    monkeypatch.setattr(dm, "staged", None)
    both.append(dm.run_forecast(full_history(spark), 2, None, seasons, model, written=True)[:2])
    for first, second in zip(*both):
        assert first.columns == second.columns and sorted(map(str, first.collect())) == sorted(map(str, second.collect()))
    assert both[1][0].count() == 4 + 6 and both[1][1].count() == 3


def test_the_summary_reads_the_days_ahead_only(spark, capsys):
    """F1"""
    model = dm.train_demand_model(noisy_features(spark), trees=3, depth=3, most_rows=0)
    long, summary, _ = dm.run_forecast(full_history(spark), 4, None, cal.hijri_seasons(spark, D(2024, 1, 1), D(2024, 3, 1)), model)
    got, want = ({(r.product_code, r.branch_code): r for r in frame.collect()} for frame in (summary, fc.forecast_summary(long)))
    assert summary.columns == fc.forecast_summary(long).columns and got.keys() == want.keys() and len(got) == 3
    for pair, row in want.items():
        assert got[pair].confidence == pytest.approx(row.confidence)
        assert got[pair].asDict() | {"confidence": 0} == row.asDict() | {"confidence": 0}
    assert got[("p", "A")].Last_on_hand == 10 and got[("p", "A")].item_category1 == "c2"
    # The pairs' shuffle serves the sums, too, and only the last known values are sorted for.
    plan = plan_of(summary.select("*"), capsys).split("Subqueries")[0]
    assert "Union" not in plan and plan.count("Exchange hashpartitioning(product_code") == 1
