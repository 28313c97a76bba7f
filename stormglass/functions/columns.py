"""Scalar functions that return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings that instrument labels carry, and those that headers carry.
LABEL_ENDINGS = ("US Equity", "Commodity", "Currency", "Index")
HEADER_PARTS = (" Index", " US Equity", " Curncy")
# Parts of names that hint at information from the future, first match wins.
SUSPICIOUS = ("future", "forward", "leaked", "target", "label", "outcome", "post_event")


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)


def canonical_ticker(label: Column) -> Column:
    """Label without its ending and with single underscores for white space."""
    single = F.trim(F.regexp_replace(label, r"\s+", " "))
    return F.replace(F.regexp_replace(single, f" ({'|'.join(LABEL_ENDINGS)})$", ""), F.lit(" "), F.lit("_"))


def clean_name(name: str) -> str:
    """A header without vendor parts, underscores for spaces."""
    for part in HEADER_PARTS:
        name = name.replace(part, "")
    return name.strip().replace(" ", "_")


def next_business_day(day: Column) -> Column:
    """The day after, past the weekend; no holidays."""
    weekday = F.dayofweek(day)
    return F.date_add(day, F.when(weekday == 6, 3).when(weekday == 7, 2).otherwise(1))


def next_business_time(day: Column, hour: int = 14, minute: int = 30) -> Column:
    """The next business day at a time of day."""
    return F.timestamp_add("MINUTE", F.lit(60 * hour + minute), next_business_day(day).cast("timestamp"))


def ratio_change(a: Column, b: Column) -> Column:
    """a / b - 1; null where b is 0."""
    return F.try_divide(a, b) - 1


def suspicious_part(name: Column) -> Column:
    """The first suspicious part of a name, null if none."""
    low = F.lower(name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in SUSPICIOUS])


def root_of(column: Column) -> Column:
    """Text before the first underscore of a feature column's name."""
    return F.split(column, "_", 2)[0]


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of pairwise complete rows; null for constant input."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def skip_null_mean(*columns: Column) -> Column:
    """Mean over the columns of a row that are not null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, n)
