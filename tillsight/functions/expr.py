"""Column-expression helpers (JVM-side, codegen friendly).

Each helper returns a ``Column``; ``*_sql`` twins return the same expression
as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NO_DISCOUNT


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, nd: int = 4) -> Column:
    """Round half up with plain IEEE arithmetic (identical bits in Spark and DuckDB).

    ``+ 1e-6`` makes exact decimal ties (a mean of 2-dp prices over 8k rows ends
    in ...5) round the same way whatever the summation order; a non-tie value of
    such a mean is at least 1/(2n) >> 1e-6 away from the boundary.
    """
    s = 10 ** nd
    return F.floor(col(c) * s + 0.500001) / s


def rnd_sql(e: str, nd: int = 4) -> str:
    return f"floor(({e}) * {10 ** nd} + 0.500001) / {10 ** nd}"


def dstr(c, alias: str | None = None) -> Column:
    """Date/timestamp as ISO text for result frames (engine-neutral hashing)."""
    name = alias or (c if isinstance(c, str) else None)
    out = col(c).cast("string")
    return out.alias(name) if name else out


def sdiv(a, b) -> Column:
    """Division that yields null for a zero / null denominator (pandas inf/NaN -> null)."""
    return F.try_divide(col(a), col(b))


def float_div(a, b) -> Column:
    """Division as floating-point numbers have it and the oracle does it: x / 0 is +-infinity, 0 / 0 is NaN; null stays null."""
    x, y = col(a).cast("double"), col(b).cast("double")
    by_zero = (F.when(F.isnan(x) | (x == 0), float("nan")).when(x > 0, float("inf")).when(x < 0, float("-inf")))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def nz(c, default=0.0) -> Column:
    return F.coalesce(col(c), F.lit(default))


# ---- discount & price (P4, P5, P6, P8) ----------------------------------------

def discount_rate(variant: str = "amount") -> Column:
    """Realised price multiplier of a line (1 = no discount).

    variants: ``amount``  1 - discount/gross (default),
              ``net``     net/gross,
              ``qty``     discount*qty/gross (share form of the amount-per-unit data),
              ``none``    0 (source without a net column).
    Null when gross <= 0.
    """
    g = F.col("gross_amount")
    if variant == "amount":
        v = 1 - F.col("discount_amount") / g
    elif variant == "net":
        v = F.col("net_amount") / g
    elif variant == "qty":
        v = F.col("discount_amount") * F.col("qty") / g
    elif variant == "none":
        return F.lit(0.0)
    else:
        raise ValueError(variant)
    return F.when(g > 0, v)


def avg_selling_price(form: str = "net") -> Column:
    """P5: per-unit selling price, null when qty is 0."""
    if form == "net":
        return sdiv("net_amount", "qty")
    return sdiv(F.col("gross_amount") - F.col("discount_amount"), F.col("qty"))


def is_promo(prefix: bool = False) -> Column:
    """Promotion flag from the discount type (exact label or ``n-`` prefix form)."""
    if prefix:
        return (~F.col("discount_type").startswith("n-")).cast("int")
    return (F.col("discount_type") != F.lit(NO_DISCOUNT)).cast("int")


# ---- time (P7, P10, P14, P17, P37) ---------------------------------------------

def time_slot(ts, gap_minutes: int = 60) -> Column:
    """1-based slot of the day, ``floor(minute_of_day / gap) + 1``."""
    t = col(ts)
    return ((F.hour(t) * 60 + F.minute(t)) / gap_minutes).cast("int") + 1


def clock_slot(hhmm: str, gap_minutes: int = 60) -> int:
    """P7 on a literal ``"HH:MM"``."""
    h, m = (int(x) for x in hhmm.split(":"))
    return (h * 60 + m) // gap_minutes + 1


def day_part(hour) -> Column:
    """P10: left-closed bands [0,6,9,11,14,17,20,24) -> label."""
    h = col(hour)
    return (F.when(h < 6, "night").when(h < 9, "morning").when(h < 11, "forenoon")
            .when(h < 14, "noon").when(h < 17, "afternoon").when(h < 20, "evening")
            .otherwise("late"))


def season_label(month) -> Column:
    """Season label from month."""
    m = col(month)
    return (F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring")
            .when(m.isin(6, 7, 8), "summer").otherwise("autumn"))


def season_code(month) -> Column:
    """Season code 1-4 (spring=1 ... winter=4)."""
    m = col(month)
    return (F.when(m.isin(3, 4, 5), 1).when(m.isin(6, 7, 8), 2)
            .when(m.isin(9, 10, 11), 3).otherwise(4))


def cyclic(x, period: float):
    """(sin, cos) of 2*pi*x/period."""
    a = col(x) * (2 * math.pi / period)
    return F.sin(a), F.cos(a)


def hours_between_clock(h0, h1) -> Column:
    """Hours from clock hour h0 forward to h1 with midnight wrap."""
    return F.pmod(col(h1) - col(h0), F.lit(24))
