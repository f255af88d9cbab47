"""Stock classification rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import AnalysisParams
from .numeric import whole_text

# Status labels, their priorities and the advice texts.
OUT_OF_STOCK = "نفد المخزون"
LOW_STOCK = "مخزون منخفض"
OVERSTOCK = "مخزون زائد"
STAGNANT = "راكد"
NORMAL = "طبيعي"
STATUS_PRIORITY = {OUT_OF_STOCK: 1, LOW_STOCK: 2, OVERSTOCK: 3, STAGNANT: 4, NORMAL: 5}

ADVICE_OUT = "طلب عاجل - نفد المخزون"
ADVICE_LOW = ("إعادة طلب - يكفي ", " يوم")
ADVICE_OVER = "تقليل الطلبات - مخزون زائد"
ADVICE_NO_SALES = "مراجعة المنتج - لا توجد مبيعات"
ADVICE_SLOW = ("مراجعة المنتج - مبيعات ضعيفة (", " يوم تغطية)")
ADVICE_NORMAL = "مستوى طبيعي"

# The advice grid of the Pareto analysis (below, above, within the coverage band).
PARETO_ADVICE = {
    "A": ("⚠️ زيادة عاجلة", "⬇️ تخفيض تدريجي", "✅ مستوى مثالي"),
    "B": ("⬆️ زيادة محدودة", "⬇️ تخفيض جزئي", "✅ حافظ على المستوى"),
    "C": ("⬆️ طلب صغير", "⏳ تصفية المخزون", "➖ لا إجراء"),
}
PARETO_STOP = "🛑 إيقاف التوريد"
PARETO_NO_DATA = "❓ بيانات غير كافية"
PARETO_UNKNOWN = "❓ غير معروف"

# Alert bands (level, lowest stock, highest stock, label, style class, priority).
ALERT_BANDS = [
    ("out_of_stock", 0, 0, "نفد المخزون", "bg-red-600/10 text-red-600 border-red-600/20", 1),
    ("very_low", 1, 5, "منخفض جداً", "bg-red-500/10 text-red-500 border-red-500/20", 2),
    ("low", 6, 15, "منخفض", "bg-orange-500/10 text-orange-500 border-orange-500/20", 3),
    ("reorder", 16, 25, "إعادة طلب", "bg-blue-500/10 text-blue-500 border-blue-500/20", 4),
]
NO_NAME = "غير محدد"

# Branch balance labels.
SHORTAGE, BALANCED, SURPLUS = "❌ عجز", "✅ متوازن", "📦 فائض"


def stock_status(stock: Column, coverage: Column, daily: Column, p: AnalysisParams) -> Column:
    return (F.when(stock == 0, OUT_OF_STOCK)
            .when(coverage < p.min_coverage, LOW_STOCK)
            .when((daily == 0) & (stock > 0), STAGNANT)
            .when((daily > 0) & (coverage > p.stagnant_period), STAGNANT)
            .when(coverage > p.max_coverage, OVERSTOCK)
            .otherwise(NORMAL))


def status_priority(status: Column) -> Column:
    out = F.when(status == NORMAL, STATUS_PRIORITY[NORMAL])
    for label, rank in STATUS_PRIORITY.items():
        if label != NORMAL:
            out = out.when(status == label, rank)
    return out


def abc_by_rate(daily: Column) -> Column:
    return F.when(daily > 10, "A").when(daily > 1, "B").otherwise("C")


def status_advice(status: Column, coverage: Column, daily: Column) -> Column:
    days = whole_text(coverage)
    return (F.when(status == OUT_OF_STOCK, ADVICE_OUT)
            .when(status == LOW_STOCK, F.concat(F.lit(ADVICE_LOW[0]), days, F.lit(ADVICE_LOW[1])))
            .when(status == OVERSTOCK, ADVICE_OVER)
            .when((status == STAGNANT) & (daily == 0), ADVICE_NO_SALES)
            .when(status == STAGNANT, F.concat(F.lit(ADVICE_SLOW[0]), days, F.lit(ADVICE_SLOW[1])))
            .otherwise(ADVICE_NORMAL))


def pareto_advice(abc: Column, coverage: Column, daily: Column, p: AnalysisParams) -> Column:
    out = F.when(daily <= 0, PARETO_STOP).when(coverage.isNull(), PARETO_NO_DATA)
    for grade, (below, above, within) in PARETO_ADVICE.items():
        out = (out.when((abc == grade) & (coverage < p.min_coverage), below)
               .when((abc == grade) & (coverage > p.max_coverage), above)
               .when(abc == grade, within))
    return out.otherwise(PARETO_UNKNOWN)


def clean_stock(raw: Column) -> Column:
    """Missing or unreadable stock counts as none, fractions are cut, negatives count as none."""
    number = raw.try_cast("double")
    cut = F.when(F.isnan(number), F.lit(None)).otherwise(number).try_cast("bigint")
    return F.greatest(F.coalesce(cut, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def alert_level(stock: Column) -> Column:
    """Struct (level, status, style, priority) of the band a clean stock falls in, NULL above all bands."""
    out = None
    for level, low, high, label, style, rank in ALERT_BANDS:
        cell = F.struct(F.lit(level).alias("level"), F.lit(label).alias("status"),
                        F.lit(style).alias("style"), F.lit(rank).alias("priority"))
        hit = stock.between(low, high)
        out = F.when(hit, cell) if out is None else out.when(hit, cell)
    return out


def short_name(name: Column, longest: int = 30) -> Column:
    return (F.when(name.isNull() | (name == ""), NO_NAME)
            .when(F.length(name) <= longest, name)
            .otherwise(F.concat(F.substring(name, 1, longest - 3), F.lit("..."))))


def coverage_label(coverage: Column, low: float, high: float) -> Column:
    """An unknown coverage is in no band and falls to surplus."""
    return F.when(coverage < low, SHORTAGE).when(coverage <= high, BALANCED).otherwise(SURPLUS)


def restock_advice(stock: Column, forecast: Column) -> Column:
    have, need = F.coalesce(stock, F.lit(0)), F.coalesce(forecast, F.lit(0))
    return F.when(have < need, RESTOCK).when(have > need * 1.5, OVERSTOCK).otherwise(ADEQUATE)


# Advice on forecast rows and notes on growth.
RESTOCK, ADEQUATE = "يحتاج إعادة تخزين", "مستوى المخزون مناسب"
NOTE_NEW, NOTE_NONE = "منتج جديد ✅", "لا يمكن حساب النمو"
NOTE_GROWTH, NOTE_DECLINE, NOTE_STABLE = "فرصة نمو ✅", "انخفاض مقلق ⚠️", "أداء مستقر 🔄"


def growth_note(growth: Column, average: Column, predicted: Column) -> Column:
    return (F.when(growth.isNull() & (average == 0) & (predicted > 0), NOTE_NEW)
            .when(growth.isNull(), NOTE_NONE)
            .when(growth > 20, NOTE_GROWTH).when(growth < -20, NOTE_DECLINE).otherwise(NOTE_STABLE))
