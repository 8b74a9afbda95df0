"""Derived labels: sale badges, stock classes, unit labels, alert headline.

Three pages classify stock with three different NULL rules (SURVEY T5); each
rule has its own function here so no page borrows another page's rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.schemas import AVAILABLE, DEFAULT_LOW_STOCK_THRESHOLD, UNAVAILABLE
from tallyspark.functions.text import ascii_lower, ucfirst

# ---------------------------------------------------------------------------
# These must equal the reference application's values.
BADGE_COMPLETED = "completed"
BADGE_VOID = "void"
BADGE_CANCELLED = "cancelled"
BADGE_PENDING = "pending"
CANCELLED_SPELLINGS = ("cancelled", "canceled")
STOCK_LABELS = ("Low", "Mid", "Good")                        # dashboard and report
REPORT_CLASSES = ("badge-bad", "badge-mid", "badge-good")    # report filter values
FILTER_TAGS = ("Low", "Medium", "Good")                       # report filter tag
CARD_LEVELS = ("low", "mid", "high")                         # inventory page
UNIT_SUFFIX = "-based"
UNKNOWN_UNIT = "Other"
# End of fixed values.
# ---------------------------------------------------------------------------


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def status_badge(status: str | Column = "status") -> Column:
    """Badge of a sale status, compared case-insensitively; anything else is pending."""
    s = ascii_lower(F.coalesce(_c(status), F.lit("")))
    return (F.when(s == BADGE_COMPLETED, BADGE_COMPLETED)
            .when(s == BADGE_VOID, BADGE_VOID)
            .when(s.isin(*CANCELLED_SPELLINGS), BADGE_CANCELLED)
            .otherwise(BADGE_PENDING))


def _three_way(stock: Column, thr: Column, labels) -> Column:
    # A NULL stock compares as "low" (PHP: null <= x is always true).
    low, mid, good = labels
    stock, thr = stock.cast("long"), thr.cast("long")  # three times a limit may leave 32 bits
    return (F.when(stock.isNull() | (stock <= thr), low)
            .when(stock <= thr * 3, mid)
            .otherwise(good))


def stock_label(stock: str | Column = "stock",
                threshold: str | Column = "low_stock_threshold") -> Column:
    """Dashboard rule: NULL threshold counts as the default (5); Low/Mid/Good."""
    thr = F.coalesce(_c(threshold), F.lit(DEFAULT_LOW_STOCK_THRESHOLD))
    return _three_way(_c(stock), thr, STOCK_LABELS)


def report_stock_class(stock: str | Column = "stock",
                       threshold: str | Column = "low_stock_threshold") -> Column:
    """Report rule: same as the dashboard, as the report's class names."""
    thr = F.coalesce(_c(threshold), F.lit(DEFAULT_LOW_STOCK_THRESHOLD))
    return _three_way(_c(stock), thr, REPORT_CLASSES)


def class_to_label(cls: str | Column = "cls") -> Column:
    c = _c(cls)
    return (F.when(c == REPORT_CLASSES[0], STOCK_LABELS[0])
            .when(c == REPORT_CLASSES[1], STOCK_LABELS[1])
            .otherwise(STOCK_LABELS[2]))


def filter_tag(value: str | None) -> str | None:
    """The report's active-filter tag of a stock status: the middle class reads
    ``Medium`` there, and an unknown value is shown as it came."""
    return dict(zip(REPORT_CLASSES, FILTER_TAGS)).get(value, value)


def stock_level_filter(level: str | None, stock: str | Column = "stock",
                       threshold: str | Column = "low_stock_threshold") -> Column | None:
    """Search-page rule: plain SQL comparisons, so a NULL matches no level.

    Returns None (no filter) for an empty or unknown level.
    """
    s, t = _c(stock).cast("long"), _c(threshold).cast("long")
    if level == "low":
        return s <= t
    if level == "mid":
        return (s > t) & (s <= t * 3)
    if level == "high":
        return s > t * 3
    return None


def stock_card_level(stock: str | Column = "stock",
                     threshold: str | Column = "low_stock_threshold") -> Column:
    """Inventory-card rule, with PHP's loose comparison of NULLs.

    NULL stock is low. With a NULL threshold the first test compares truth
    values (stock 0 is low) and the second compares with 0 (a negative stock
    is mid); every other stock is high.
    """
    s, t = _c(stock).cast("long"), _c(threshold).cast("long")
    return (F.when(s.isNull(), CARD_LEVELS[0])
            .when(t.isNull(), F.when(s == 0, CARD_LEVELS[0])
                  .when(s < 0, CARD_LEVELS[1]).otherwise(CARD_LEVELS[2]))
            .when(s <= t, CARD_LEVELS[0])
            .when(s <= t * 3, CARD_LEVELS[1])
            .otherwise(CARD_LEVELS[2]))


def unit_label(unit: str | Column = "unit", suffix: str = UNIT_SUFFIX) -> Column:
    """Report unit label: first letter upper-cased, suffix appended even when
    the unit already ends with it; NULL unit becomes ``Other``."""
    return F.concat(ucfirst(F.coalesce(_c(unit), F.lit(UNKNOWN_UNIT))), F.lit(suffix))


def availability_label(status: str | Column = "status") -> Column:
    s = _c(status)
    return F.when(s == AVAILABLE, AVAILABLE).otherwise(UNAVAILABLE)


def alert_message(count: str | Column) -> Column:
    """Headline of the low-stock banner; NULL when there is nothing to show."""
    n = _c(count)
    return F.when(n > 0, F.concat(
        n.cast("string"), F.lit(" ingredient"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")),
        F.lit(" need"), F.when(n == 1, F.lit("s")).otherwise(F.lit("")), F.lit(" restocking")))
