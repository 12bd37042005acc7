"""SQL fragments shared by the DuckDB oracles."""

from __future__ import annotations

from ..schema import NO_DISCOUNT
from ..sources.dims import calendar_sql, weather_sql
from ..sources.starschema import hx_sql, tx_sql
from ..functions.expr import rnd_sql

PROMO = f"CAST(discount_type <> '{NO_DISCOUNT}' AS INT)"


def r(e: str, nd: int = 4) -> str:
    return rnd_sql(e, nd)


def tx_cte(orders: bool = False, part: bool = False, name: str = "tx") -> str:
    return f"{name} AS (\n  {tx_sql(orders, part)}\n)"


def hx_cte(name: str = "hx") -> str:
    return f"{name} AS (\n  {hx_sql()}\n)"


def dates_cte(src: str = "tx", name: str = "dates") -> str:
    return f"{name} AS (SELECT DISTINCT sale_date AS date FROM {src})"


def weather_cte(dates: str = "dates", name: str = "weather") -> str:
    return f"{name} AS (\n  {weather_sql(dates)}\n)"


def calendar_cte(dates: str = "dates") -> str:
    """Adds CTEs ending with ``cal``."""
    return calendar_sql(dates).strip()


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


# ---- typed result projections ------------------------------------------------
# spec: "name:kind ..." with kind  s=string  d=date->text  t=timestamp->text
#       i=INT  l=BIGINT  f=double rounded to 4 dp  f2=double rounded to 2 dp  x=as is

def _spec(spec: str):
    out = []
    for tok in spec.split():
        name, _, kind = tok.partition(":")
        out.append((name, kind or "x"))
    return out


def out_cols(spec: str):
    from pyspark.sql import functions as F
    from ..functions.expr import rnd
    cols = []
    for name, kind in _spec(spec):
        c = F.col(name)
        if kind == "d":
            c = c.cast("date").cast("string")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "i":
            c = c.cast("int")
        elif kind == "l":
            c = c.cast("long")
        elif kind == "f":
            c = rnd(c.cast("double"))
        elif kind == "f2":
            c = rnd(c.cast("double"), 2)
        elif kind == "s":
            c = c.cast("string")
        cols.append(c.alias(name))
    return cols


def out_sql(spec: str, prefix: str = "") -> str:
    parts = []
    for name, kind in _spec(spec):
        e = f"{prefix}{name}"
        if kind == "d":
            e = f"CAST(CAST({e} AS DATE) AS VARCHAR)"
        elif kind == "t":
            e = f"strftime({e}, '%Y-%m-%d %H:%M:%S')"
        elif kind == "i":
            e = f"CAST({e} AS INTEGER)"
        elif kind == "l":
            e = f"CAST({e} AS BIGINT)"
        elif kind == "f":
            e = r(f"CAST({e} AS DOUBLE)")
        elif kind == "f2":
            e = r(f"CAST({e} AS DOUBLE)", 2)
        elif kind == "s":
            e = f"CAST({e} AS VARCHAR)"
        parts.append(f"{e} AS {name}")
    return ", ".join(parts)
