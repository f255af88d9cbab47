"""Summaries, rule-based report findings and size-reducing exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import half_even, money, number_or_zero, ratio
from .forecast_review import chosen, texts

LOW_STOCK = 10


def category_summary(inventory: DataFrame) -> DataFrame:
    return inventory.filter("item_category1 IS NOT NULL").groupBy("item_category1").agg(
        F.count("product_code").alias("products"), F.sum("Last_on_hand").alias("total_stock"),
        money(F.sum("inventory_value")).alias("total_value"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_summary(df: DataFrame) -> DataFrame:
    """One row per numeric column: sum, mean, least, greatest and count, from one pass."""
    names = numeric_columns(df)
    stats = df.agg(*[F.struct(
        F.sum(n).cast("double").alias("total"), F.avg(n).cast("double").alias("mean"),
        F.min(n).cast("double").alias("least"), F.max(n).cast("double").alias("greatest"),
        F.count(n).alias("values")).alias(n) for n in names])
    cells = [F.struct(F.lit(n).alias("column_name"), F.col(n).alias("s")) for n in names]
    return stats.select(F.explode(F.array(*cells)).alias("_r")).select("_r.column_name", "_r.s.*")


def stock_levels(inventory: DataFrame) -> DataFrame:
    have = F.col("Last_on_hand")
    return inventory.agg(F.count(F.lit(1)).alias("total_products"), F.count_if(have < LOW_STOCK).alias("low_stock_items"),
                         F.count_if(have == 0).alias("out_of_stock_items"),
                         F.coalesce(F.sum(have), F.lit(0)).alias("total_stock_value"))


def sales_totals(sales: DataFrame) -> DataFrame:
    return sales.agg(money(F.sum("revenue")).alias("total_revenue"),
                     half_even(F.sum("revenue").cast("double") / F.count("revenue"), 4).alias("average_transaction"),
                     F.count(F.lit(1)).alias("transaction_count"))


def branch_list(inventory: DataFrame) -> DataFrame:
    """One row per distinct branch, each with the number of branches."""
    one = inventory.filter("branch_code IS NOT NULL").select("branch_code").distinct()
    return one.withColumn("branch_count", one.agg(F.count(F.lit(1))).scalar())


def report_metrics(sales: DataFrame, inventory: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sales and stock figures per group; without keys one row for everything."""
    keys = list(keys)
    have = F.col("Last_on_hand")
    s = sales.groupBy(*keys).agg(F.count(F.lit(1)).alias("transaction_count"), F.sum("revenue").alias("_rev"))
    i = inventory.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_products"),
                                     F.count_if(have < LOW_STOCK).alias("low_stock_items"),
                                     F.count_if(have == 0).alias("out_of_stock_items"))
    if keys:
        rows = s.join(i, keys, "full")
    else:
        rows = i.withColumn("_s", s.select(F.struct("transaction_count", "_rev")).scalar()).select("*", "_s.*").drop("_s")
    n = F.coalesce("transaction_count", F.lit(0))
    return rows.select(*keys, n.alias("transaction_count"),
                       F.coalesce(money(F.col("_rev")), F.lit(0.0)).alias("total_revenue"),
                       half_even(ratio(F.col("_rev"), n, 0.0), 4).alias("avg_transaction"),
                       *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_products", "low_stock_items",
                                                                    "out_of_stock_items")])


def data_quality_score(sales: DataFrame, inventory: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """100, less 20 for an empty table each and up to 30 for missing inventory cells."""
    keys = list(keys)
    gaps = [F.col(f"`{c}`").isNull().cast("bigint") for c in inventory.columns]
    i = inventory.groupBy(*keys).agg(F.sum(sum(gaps[1:], gaps[0])).alias("_gaps"), F.count(F.lit(1)).alias("_rows"))
    s = sales.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sales"))
    rows = i.join(s, keys, "full") if keys else i.withColumn("_sales", s.scalar())
    n = F.coalesce("_rows", F.lit(0))
    missing = ratio(F.col("_gaps"), n * len(inventory.columns), 0.0)
    score = (F.lit(100) - F.when(F.coalesce("_sales", F.lit(0)) == 0, 20).otherwise(0)
             - F.when(n == 0, 20).otherwise(0) - (missing * 30).cast("int"))
    return rows.select(*keys, F.greatest(F.least(score, F.lit(100)), F.lit(0)).alias("data_quality_score"))


# Report texts.
PATTERN_HIGH_LOW = "نسبة عالية من المنتجات بمستوى مخزون منخفض"
PATTERN_HEALTHY = "مستويات مخزون صحية عبر معظم المنتجات"
INSIGHT_RESTOCK = ("يوجد ", " منتج يحتاج إعادة تخزين")
INSIGHT_REVENUE = "الأداء المالي يظهر نتائج إيجابية"
RECOMMEND_RESTOCK = ("إعادة تخزين ", " منتج بمستوى مخزون منخفض")
RECOMMEND_PEAK = "زيادة مستويات المخزون استعداداً لموسم الذروة"
RECOMMEND_LOW = "تحسين إدارة التدفق النقدي خلال الموسم المنخفض"
RECOMMEND_DEFAULTS = ["مراجعة دورية لمستويات المخزون", "تحليل اتجاهات المبيعات الشهرية", "تحسين دقة التنبؤات"]
RISK_OUT, RISK_LOW = "مخاطر نفاد المخزون", "مخاطر عدم كفاية المخزون"
RISK_NONE, RISK_PREFIX = "مستوى المخاطر منخفض - الوضع مستقر", "مخاطر محددة: "
KPI_EFFICIENCY = ("مستوى كفاءة عالي في الأداء", "مستوى كفاءة منخفض يحتاج تحسين", "مستوى كفاءة متوسط مع إمكانية للتحسين")
KPI_TARGET = ("تجاوز الأهداف المحددة بشكل ممتاز", "تحقيق الأهداف المحددة", "اقتراب من تحقيق الأهداف",
              "عدم تحقيق الأهداف المطلوبة")
KPI_MEAN = ("مؤشرات الأداء الرئيسية ممتازة", "مؤشرات الأداء الرئيسية جيدة", "مؤشرات الأداء الرئيسية تحتاج تحسين")
SUMMARY_STOCK = ("تحليل المخزون يظهر وجود ", " منتج في النظام. ", "هناك ", " منتج بمستوى مخزون منخفض و ",
                 " منتج نفد من المخزون. ", "يتطلب الأمر اتخاذ إجراءات فورية لإعادة التخزين.",
                 "جميع المنتجات في مستوى مخزون مناسب.")
SUMMARY_SALES = ("تحليل المبيعات يظهر إجمالي إيرادات قدرها ", " من ", " معاملة. ", "متوسط قيمة المعاملة الواحدة ", ". ",
                 "الأداء جيد مع متوسط معاملات مرتفع.", "هناك فرصة لتحسين قيمة المعاملة الواحدة.")
SUMMARY_OTHER = {
    "performance": "تحليل الأداء العام يظهر مؤشرات متنوعة تتطلب المراجعة والتحسين المستمر.",
    "forecast": "تحليل التنبؤات يوفر رؤى مستقبلية لاتخاذ قرارات استراتيجية مدروسة.",
    "general": "التحليل العام للبيانات يوفر نظرة شاملة على الأداء الحالي والفرص المتاحة للتحسين."}


def _with_number(pair: tuple[str, str], number: Column) -> Column:
    return F.concat(F.lit(pair[0]), number.cast("string"), F.lit(pair[1]))


def _kept(cells: Sequence[Column]) -> Column:
    return F.filter(F.array(*cells), lambda t: t.isNotNull())


def report_findings(metrics: DataFrame, season: str | None = None) -> DataFrame:
    """Patterns, insights (up to 5), recommendations (up to 10), risk text and confidence per metrics row.

    Needs the columns of ``report_metrics`` and ``data_quality_score``."""
    low, out, all_ = F.col("low_stock_items"), F.col("out_of_stock_items"), F.col("total_products")
    share = ratio(low, all_)
    insights = F.slice(_kept([F.when(low > 0, _with_number(INSIGHT_RESTOCK, low)),
                              F.when(F.col("total_revenue") > 10000, INSIGHT_REVENUE)]), 1, 5)
    found = _kept([F.when(low > 0, _with_number(RECOMMEND_RESTOCK, low)),
                   F.lit({"peak": RECOMMEND_PEAK, "low": RECOMMEND_LOW}.get(season)).cast("string")])
    risks = chosen([(out > 0, RISK_OUT), (low > F.when(all_ > 0, all_).otherwise(1) * 0.3, RISK_LOW)])
    rows = metrics.withColumns({"insights": insights, "_rec": found, "_risks": risks})
    lift = (F.col("data_quality_score") - 50) * 0.3 + F.when(F.size("insights") >= 3, 10).otherwise(0)
    return rows.withColumns({
        "patterns": chosen([(share > 0.2, PATTERN_HIGH_LOW), (share < 0.05, PATTERN_HEALTHY)]),
        "recommendations": F.slice(F.when(F.size("_rec") == 0, texts(RECOMMEND_DEFAULTS)).otherwise(F.col("_rec")), 1, 10),
        "risk_assessment": F.when(F.size("_risks") == 0, RISK_NONE).otherwise(
            F.concat(F.lit(RISK_PREFIX), F.array_join("_risks", ", "))),
        "confidence_score": F.greatest(F.least((F.lit(75.0) + lift).cast("int"), F.lit(100)), F.lit(0))}) \
        .drop("_rec", "_risks")


def kpi_findings(df: DataFrame) -> DataFrame:
    """Positive, pattern and negative findings from efficiency, target achievement and a map of indicators."""
    e, t = F.coalesce("efficiency_score", F.lit(0.0)), F.coalesce("target_achievement", F.lit(0.0))
    values = F.map_values("kpi_metrics")
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))
    return df.withColumns({
        "positive_trends": chosen([(e >= 80, KPI_EFFICIENCY[0]), (t >= 1.2, KPI_TARGET[0]),
                                   ((t >= 1.0) & (t < 1.2), KPI_TARGET[1]), (mean >= 85, KPI_MEAN[0])]),
        "patterns": chosen([((e < 80) & (e > 50), KPI_EFFICIENCY[2]), ((t >= 0.8) & (t < 1.0), KPI_TARGET[2]),
                            ((mean >= 70) & (mean < 85), KPI_MEAN[1])]),
        "negative_trends": chosen([(e <= 50, KPI_EFFICIENCY[1]), (t < 0.8, KPI_TARGET[3]), (mean < 70, KPI_MEAN[2])])})


def executive_summary(metrics: DataFrame, report_type: str = "general") -> DataFrame:
    """One sentence or two per metrics row, worded by report type."""
    def n(c: str) -> Column:
        return F.col(c).cast("string")

    if report_type == "inventory":
        a = SUMMARY_STOCK
        short = (F.col("low_stock_items") > 0) | (F.col("out_of_stock_items") > 0)
        text = F.concat(F.lit(a[0]), n("total_products"), F.lit(a[1]), F.when(short, F.concat(
            F.lit(a[2]), n("low_stock_items"), F.lit(a[3]), n("out_of_stock_items"), F.lit(a[4] + a[5]))).otherwise(a[6]))
    elif report_type == "sales":
        a = SUMMARY_SALES
        text = F.concat(F.lit(a[0]), F.format_number(half_even(F.col("total_revenue"), 2), 2), F.lit(a[1]),
                        n("transaction_count"), F.lit(a[2] + a[3]),
                        F.format_number(half_even(F.col("avg_transaction"), 2), 2), F.lit(a[4]),
                        F.when(F.col("avg_transaction") > 100, a[5]).otherwise(a[6]))
    else:
        text = F.lit(SUMMARY_OTHER.get(report_type, SUMMARY_OTHER["general"]))
    return metrics.withColumn("executive_summary", text)


# --- smaller exports ------------------------------------------------------------------------------

def reduce_rows(df: DataFrame, n: int, strategy: str = "head", keys: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Keep ``n`` rows: a seeded sample by key hash, the newest by the first date column, the largest by the first
    numeric column, or the first ones. ``keys`` make the order total."""
    ties = [F.col(k) for k in keys]
    if strategy == "sample":
        text = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in (keys or df.columns)]
        return df.orderBy(F.md5(F.concat_ws("|", *text, F.lit(str(seed))).cast("binary")), *ties).limit(n)
    if strategy == "recent":
        dates = [c for c in df.columns if "date" in c.lower()]
        return df.orderBy(F.desc(dates[0]), *ties).limit(n) if dates else \
            df.orderBy(*[t.desc() for t in ties]).limit(n)
    if strategy == "top_values":
        numbers = numeric_columns(df)
        return df.orderBy(F.desc(numbers[0]), *ties).limit(n) if numbers else df.orderBy(*ties).limit(n)
    return df.orderBy(*ties).limit(n)


def reduction_report(df: DataFrame, n: int, strategy: str) -> DataFrame:
    """What ``reduce_rows`` will do to a table of this size."""
    rows = df.agg(F.count(F.lit(1)).alias("original_rows"))
    kept = F.least("original_rows", F.lit(n).cast("bigint"))
    share = F.when(F.col("original_rows") > n, (F.col("original_rows") - kept) / F.col("original_rows") * 100).otherwise(0.0)
    return rows.select((F.col("original_rows") > n).alias("reduced"), "original_rows", kept.alias("final_rows"),
                       half_even(share, 4).alias("reduction_percent"), F.lit(strategy).alias("strategy_used"))


ESSENTIAL_PARTS = ("code", "name", "date", "value", "amount", "qty")


def essential_columns(df: DataFrame) -> DataFrame:
    """Only the columns whose name marks them as essential; all of them when none does."""
    kept = [c for c in df.columns if any(p in c.lower() for p in ESSENTIAL_PARTS)]
    return df.select(*kept) if kept else df


# Texts of the summary row.
SUM_PREFIX, ROWS_PREFIX = "المجموع: ", "إجمالي السجلات: "


def partial_export(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows as text and one closing row: totals of numeric columns, row count elsewhere."""
    first = df.orderBy(*order).limit(n).select(F.lit(0).alias("is_summary"), *[F.col(c).cast("string").alias(c)
                                                                              for c in df.columns])
    numbers = set(numeric_columns(df))

    def total(c: str) -> Column:
        if c in numbers:
            return F.concat(F.lit(SUM_PREFIX), F.sum(number_or_zero(F.col(c), "decimal(28,4)"))
                            .cast("decimal(38,2)").cast("string"))
        return F.concat(F.lit(ROWS_PREFIX), F.count(F.lit(1)).cast("string"))

    return first.unionAll(df.agg(*[total(c).alias(c) for c in df.columns]).select(F.lit(1), *df.columns))
