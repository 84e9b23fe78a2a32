"""Exact money arithmetic on whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a, b) -> Column:
    """Whole-number division."""
    return F.call_function("div", col(a), b if isinstance(b, Column) else F.lit(b))


def euros(c) -> Column:
    return col(c) / F.lit(100.0)


def cents(amount) -> Column:
    """Euros (decimal or double) to whole cents."""
    return F.round(col(amount) * 100).cast("bigint")


def half_up(num, den) -> Column:
    """num / den rounded to a whole number, halves away from zero. den must be positive."""
    num, den = col(num), den if isinstance(den, Column) else F.lit(den)
    size = idiv(F.abs(num) * 2 + den, den * 2)
    return F.when(num < 0, -size).otherwise(size)


def half_even(num, den) -> Column:
    """num / den rounded to a whole number, halves to the even neighbour. den must be positive."""
    num, den = col(num), den if isinstance(den, Column) else F.lit(den)
    doubled = F.abs(num) * 2 + den
    up = idiv(doubled, den * 2)
    tie_to_odd = (doubled % (den * 2) == 0) & (up % 2 == 1)
    size = F.when(tie_to_odd, up - 1).otherwise(up)
    return F.when(num < 0, -size).otherwise(size)


def safe_pct(num, den, digits: int = 1, empty=0.0) -> Column:
    """Percent with fixed digits; `empty` when the denominator is not positive."""
    num, den = col(num), col(den)
    scale = 10**digits
    return F.when(den > 0, half_up(num * (100 * scale), den) / F.lit(float(scale))).otherwise(F.lit(empty))


# The same rules as SQL text (for the comparison queries).
def sql_half_up(num: str, den: str) -> str:
    return f"(CASE WHEN ({num}) < 0 THEN -1 ELSE 1 END * ((2*abs({num}) + ({den})) // (2*({den}))))"


def sql_half_even(num: str, den: str) -> str:
    doubled = f"(2*abs({num}) + ({den}))"
    up = f"({doubled} // (2*({den})))"
    return (
        f"(CASE WHEN ({num}) < 0 THEN -1 ELSE 1 END * "
        f"CASE WHEN {doubled} % (2*({den})) = 0 AND {up} % 2 = 1 THEN {up} - 1 ELSE {up} END)"
    )


def sql_pct(num: str, den: str, digits: int = 1, empty: str = "0.0") -> str:
    scale = 10**digits
    rounded = sql_half_up(f"({num})*{100 * scale}", den)
    return f"CASE WHEN ({den}) > 0 THEN cast({rounded} as double) / {scale} ELSE {empty} END"
