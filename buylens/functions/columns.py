"""Column rules: tiers, terms, currencies, dates, encodings. All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the business rules.
TIER_RANK = {"PUBLIC": 1, "INTERNAL": 2, "RESTRICTED": 3}
TERMS_DAYS = {"NET30": 30, "NET60": 60, "NET90": 90, "2/10NET30": 30, "IMMEDIATE": 0}
USD_RATES = {"USD": 1.0, "EUR": 1.08, "JPY": 0.0067, "SGD": 0.74, "KRW": 0.00075, "THB": 0.028, "CNY": 0.14,
             "VND": 0.000041, "GBP": 1.27, "CHF": 1.13}
COUNTRY_RISK = {"JP": 1, "DE": 1, "US": 1, "SG": 2, "KR": 2, "TH": 3, "CN": 3, "VN": 4}
CRITICALITY = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
CONFIDENTIALITY = {"PUBLIC": 0, "INTERNAL": 1, "RESTRICTED": 2}
VENDOR_STATUS = {"ACTIVE": 2, "CONDITIONAL": 1, "BLOCKED": 0}
PRIORITY = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
MATCH_CLASS = {"FULL_MATCH": 0, "PRICE_VARIANCE": 1, "QUANTITY_VARIANCE": 2, "BOTH_VARIANCE": 3}
REGION = {"JP": "APAC", "CN": "APAC", "KR": "APAC", "TW": "APAC", "SG": "APAC", "MY": "APAC", "VN": "APAC",
          "TH": "APAC", "HK": "APAC", "DE": "EMEA", "GB": "EMEA", "CH": "EMEA", "US": "AMER"}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: str | Column, mapping: dict, other) -> Column:
    """``mapping[c]``, or ``other`` for unknown and NULL keys."""
    c = col(c)
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(other))


def ordinal(c: str | Column, mapping: dict) -> Column:
    return lookup(c, mapping, -1)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is NULL."""
    return F.when(condition, 1).otherwise(0)


def ratio(a: Column, b: Column) -> Column:
    """Double division; NULL on a zero or NULL denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean(c: str | Column) -> Column:
    """Average through an exact sum: decimals and integers give the same double in any order."""
    c = col(c)
    return ratio(F.sum(c), F.count(c))


def share(condition: Column) -> Column:
    """Share of all rows of the group for which the condition holds."""
    return ratio(F.sum(flag(condition)), F.count(F.lit(1)))


def terms_days(c: str | Column) -> Column:
    return lookup(c, TERMS_DAYS, 30)


def has_discount(c: str | Column) -> Column:
    return col(c) == "2/10NET30"


def discount_pct(c: str | Column) -> Column:
    return F.when(col(c).rlike(r"^\d+/\d+NET\d+$"), F.regexp_extract(col(c), r"^(\d+)/(\d+)NET(\d+)$", 1).cast("int")).otherwise(0)


def discount_days(c: str | Column) -> Column:
    return F.when(col(c).rlike(r"^\d+/\d+NET\d+$"), F.regexp_extract(col(c), r"^(\d+)/(\d+)NET(\d+)$", 2).cast("int")).otherwise(0)


def tier_value(c: str | Column) -> Column:
    """1 PUBLIC, 2 INTERNAL, 3 RESTRICTED; NULL and unknown count as INTERNAL."""
    return lookup(c, TIER_RANK, 2)


def tier_name(value: Column) -> Column:
    return F.when(value == 1, "PUBLIC").when(value == 3, "RESTRICTED").otherwise("INTERNAL")


def max_tier(*tiers: str | Column) -> Column:
    return tier_name(F.greatest(*[tier_value(c) for c in tiers]))


def to_usd(amount: str | Column, currency: str | Column) -> Column:
    return col(amount).cast("double") * lookup(currency, USD_RATES, 1.0)


def add_business_days(day: str | Column, n: int) -> Column:
    """Monday-to-Friday day arithmetic in closed form; ``n`` may be negative."""
    day = col(day)
    wd = F.weekday(day)  # Monday is 0
    if n == 0:
        return day
    if n > 0:
        start = F.date_sub(day, F.greatest(wd - 4, F.lit(0)))
        return F.date_add(start, n + 2 * F.floor((F.least(wd, F.lit(4)) + n) / 5).cast("int"))
    back = -n
    start = F.date_add(day, F.when(wd > 4, 7 - wd).otherwise(0))
    weekday = F.when(wd > 4, 0).otherwise(wd)
    return F.date_sub(start, back + 2 * F.floor((4 - weekday + back) / 5).cast("int"))


def slope(y: Column, x: Column) -> Column:
    """Regression slope of integer ``y`` on integer ``x`` from exact sums; NULL for a single x.

    Unlike a floating-point accumulation it does not depend on the order of the rows.
    """
    known = y.isNotNull() & x.isNotNull()
    n, sx, sy, sxy, sxx = (F.sum(F.when(known, v).cast("decimal(20,0)")).cast("double")
                           for v in (F.lit(1), x, y, x.cast("bigint") * y, x.cast("bigint") * x))
    return F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)


def one_hot(c: str | Column, domain: list[str], prefix: str) -> list[Column]:
    """Indicator columns over a fixed domain, so train and serve agree."""
    return [flag(col(c) == value).alias(f"{prefix}_{value.lower()}") for value in domain]


def cyclical(c: str | Column, period: int, name: str) -> list[Column]:
    angle = col(c) * F.lit(2.0) * F.pi() / F.lit(float(period))
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]
