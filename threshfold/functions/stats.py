"""Column expressions of statistics and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval, within 0 and 1; (0, 0) for no trials."""
    p, m = ratio(k, n), n.cast("double")
    d = 1 + z * z / m
    c, h = (p + z * z / (2 * m)) / d, z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), c - h)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), c + h)).otherwise(0.0)


def add_years(d: Column, years: Column | int) -> Column:
    """The same day years later; 29 February becomes the 28th where there is none."""
    return F.add_months(d, 12 * years)


def utc_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def month_of(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def months_between(later: Column, earlier: Column) -> Column:
    """Whole calendar months between two dates."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def annualised(monthly: Column) -> Column:
    return F.pow(1 + monthly, F.lit(12.0)) - 1


def lift_verdict(lo: Column, hi: Column) -> Column:
    """What an interval of a lift says: above 1, below 1, both sides, or nothing."""
    return F.when(lo.isNull() | hi.isNull(), "INCONCLUSIVE").when(lo > 1, "POSITIVE").when(hi < 1, "NEGATIVE").otherwise("NULL")


def funnel_verdict(share: Column) -> Column:
    """FAIL above one half, MARGINAL above one quarter, else PASS."""
    return F.when(share > 0.5, "FAIL").when(share > 0.25, "MARGINAL").otherwise("PASS")


def division(code: Column) -> Column:
    """The division of a four-digit industry code; unknown for anything else."""
    n = code.try_cast("int")
    out = F.when(n.isNull(), "unknown")
    for lo, hi, name in DIVISIONS:
        out = out.when(n.between(lo, hi), name)
    return out.otherwise("unknown")


# Closed ranges of industry codes.
DIVISIONS = (
    (100, 999, "agriculture"), (1000, 1499, "mining"), (1500, 1799, "construction"), (2000, 3999, "manufacturing"), (4000, 4999, "transport_utilities"),
    (5000, 5199, "wholesale"), (5200, 5999, "retail"), (6000, 6799, "finance"), (7000, 8999, "services"), (9100, 9729, "public_administration"),
)
