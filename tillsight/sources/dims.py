"""Daily dimensions derived from the fact table's dates: weather and calendar.

The driver ships no weather or holiday tables, so both are derived from the
distinct dates with integer arithmetic (weather) and a fixed holiday rule
table (calendar). Their size is bounded by the number of distinct days, so
joining them back to fact rows is a broadcast join with a proven bound.

Expressions that differ between Spark SQL and DuckDB go through ``Dialect``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import WEATHER_SEVERITY, WEATHER_TYPE_CODES


class Dialect:
    def __init__(self, name: str):
        self.name = name

    def weekday(self, x):        # Monday = 0
        return f"weekday({x})" if self.name == "spark" else f"(isodow({x}) - 1)"

    def sun_dow(self, x):        # Sunday = 0
        return f"(dayofweek({x}) - 1)" if self.name == "spark" else f"dayofweek({x})"

    def idiv(self, a, b):
        return f"(({a}) div ({b}))" if self.name == "spark" else f"(({a}) // ({b}))"

    def sunday_week(self, x):    # strftime('%U')
        return self.idiv(f"dayofyear({x}) + 6 - {self.sun_dow(x)}", 7)


SPARK = Dialect("spark")
DUCK = Dialect("duckdb")

# ---- weather ------------------------------------------------------------------
_DOY = "dayofyear(date)"
_TEXT = ("CASE {c} WHEN '01' THEN '晴' WHEN '02' THEN '多云' WHEN '03' THEN '阴' "
         "WHEN '04' THEN '阵雨' WHEN '07' THEN '小雨' WHEN '08' THEN '中雨' "
         "WHEN '09' THEN '大雨' WHEN '10' THEN '暴雨' WHEN '13' THEN '阵雪' "
         "WHEN '14' THEN '小雪' WHEN '15' THEN '中雪' WHEN '16' THEN '大雪' "
         "WHEN '18' THEN '雾' WHEN '53' THEN '霾' ELSE '多云' END")
_CODE_DAY = f"lpad(CAST(1 + ({_DOY} * 7) % 19 AS STRING), 2, '0')"
_CODE_NIGHT = f"lpad(CAST(1 + ({_DOY} * 11) % 19 AS STRING), 2, '0')"
_RAINY = "('" + "','".join(WEATHER_TYPE_CODES["is_rainy"]) + "')"

# Raw weather source shape: date, text_day, code_day, text_night, code_night, high, low
# plus the station precipitation column (rainfall, mm).
WEATHER_EXPRS = [
    ("text_day", _TEXT.format(c=_CODE_DAY)),
    ("code_day", _CODE_DAY),
    ("text_night", _TEXT.format(c=_CODE_NIGHT)),
    ("code_night", _CODE_NIGHT),
    ("high", f"CAST(10 + ({_DOY} * 7) % 26 AS INT)"),
    ("low", f"CAST(10 + ({_DOY} * 7) % 26 - {_DOY} % 12 AS INT)"),
    ("rainfall", f"CASE WHEN {_CODE_DAY} IN {_RAINY} THEN CAST(({_DOY} * 13) % 40 AS DOUBLE) ELSE 0.0 END"),
]


def weather_sql(dates_rel: str) -> str:
    cols = ",\n    ".join(f"{e} AS {a}" for a, e in WEATHER_EXPRS)
    return f"SELECT date,\n    {cols}\n  FROM {dates_rel}"


def weather_from_dates(dates: DataFrame) -> DataFrame:
    """Raw weather rows for a frame with one ``date`` column (distinct)."""
    return dates.select("date", *[F.expr(e).alias(a) for a, e in WEATHER_EXPRS])


def severity_sql(code: str) -> str:
    """CASE expression: 2-digit weather code -> severity (0 if unknown)."""
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEATHER_SEVERITY.items())
    return f"CASE lpad({code}, 2, '0') {arms} ELSE 0 END"


# ---- calendar -----------------------------------------------------------------
# Legal holidays, effective-dated: (name, from year, to year, month, day, first legal day after
# the anchor, legal days, influence window lo, hi). Month 0: the anchor comes from HOLIDAY_ANCHORS.
HOLIDAY_RULES = [
    ("元旦", 1950, 2099, 1, 1, 0, 1, 0, 1),
    ("春节", 1950, 2007, 0, 0, 0, 3, -3, 3),
    ("春节", 2008, 2013, 0, 0, -1, 3, -3, 3),
    ("春节", 2014, 2024, 0, 0, 0, 3, -3, 3),
    ("春节", 2025, 2099, 0, 0, -1, 4, -3, 3),
    ("清明节", 2008, 2099, 0, 0, 0, 1, 0, 1),
    ("劳动节", 1950, 1999, 5, 1, 0, 1, -1, 1),
    ("劳动节", 2000, 2007, 5, 1, 0, 3, -1, 1),
    ("劳动节", 2008, 2024, 5, 1, 0, 1, -1, 1),
    ("劳动节", 2025, 2099, 5, 1, 0, 2, -1, 1),
    ("端午节", 2008, 2099, 0, 0, 0, 1, 0, 1),
    ("中秋节", 2008, 2099, 0, 0, 0, 1, 0, 1),
    ("国庆节", 1950, 1998, 10, 1, 0, 2, -2, 2),
    ("国庆节", 1999, 2099, 10, 1, 0, 3, -2, 2),
]
# Dates of the holidays that move with the lunar calendar.
_SPRING = """1995-01-31 1996-02-19 1997-02-07 1998-01-28 1999-02-16 2000-02-05 2001-01-24 2002-02-12 2003-02-01
    2004-01-22 2005-02-09 2006-01-29 2007-02-18 2008-02-07 2009-01-26 2010-02-14 2011-02-03 2012-01-23 2013-02-10
    2014-01-31 2015-02-19 2016-02-08 2017-01-28 2018-02-16 2019-02-05 2020-01-25 2021-02-12 2022-02-01 2023-01-22
    2024-02-10 2025-01-29 2026-02-17 2027-02-06 2028-01-26"""
_DRAGON_BOAT = """2008-06-08 2009-05-28 2010-06-16 2011-06-06 2012-06-23 2013-06-12 2014-06-02 2015-06-20 2016-06-09
    2017-05-30 2018-06-18 2019-06-07 2020-06-25 2021-06-14 2022-06-03 2023-06-22 2024-06-10 2025-05-31 2026-06-19
    2027-06-09 2028-05-28"""
_MID_AUTUMN = """2008-09-14 2009-10-03 2010-09-22 2011-09-12 2012-09-30 2013-09-19 2014-09-08 2015-09-27 2016-09-15
    2017-10-04 2018-09-24 2019-09-13 2020-10-01 2021-09-21 2022-09-10 2023-09-29 2024-09-17 2025-10-06 2026-09-25
    2027-09-15 2028-10-03"""


def _tomb_sweeping(year: int) -> str:
    """The solar term in early April, by the usual rule for this century."""
    y = year - 2000
    return f"{year}-04-{int(y * 0.2422 + 4.81) - y // 4:02d}"


# (name, date): one for each year that has data; years without one are refused.
HOLIDAY_ANCHORS = [(n, d) for n, ds in (("春节", _SPRING), ("端午节", _DRAGON_BOAT), ("中秋节", _MID_AUTUMN)) for d in ds.split()] \
    + [("清明节", _tomb_sweeping(y)) for y in range(2008, 2029)]
# Announced days (date, name, kind): off = free day around a holiday, work = worked weekend day for it.
# They override the rules; years without entries have the rules' legal days alone.
HOLIDAY_DAYS = [(f"{y}-{d}", n, k) for y, n, k, ds in (
    (2023, "元旦", "off", "01-02"), (2023, "春节", "off", "01-21 01-25 01-26 01-27"), (2023, "春节", "work", "01-28 01-29"),
    (2023, "劳动节", "off", "04-29 04-30 05-02 05-03"), (2023, "劳动节", "work", "04-23 05-06"),
    (2023, "端午节", "off", "06-23 06-24"), (2023, "端午节", "work", "06-25"),
    (2023, "中秋节", "off", "09-30"), (2023, "国庆节", "off", "10-04 10-05 10-06"), (2023, "国庆节", "work", "10-07 10-08"),
    (2024, "春节", "off", "02-13 02-14 02-15 02-16 02-17"), (2024, "春节", "work", "02-04 02-18"),
    (2024, "清明节", "off", "04-05 04-06"), (2024, "清明节", "work", "04-07"),
    (2024, "劳动节", "off", "05-02 05-03 05-04 05-05"), (2024, "劳动节", "work", "04-28 05-11"),
    (2024, "端午节", "off", "06-08 06-09"), (2024, "中秋节", "off", "09-15 09-16"), (2024, "中秋节", "work", "09-14"),
    (2024, "国庆节", "off", "10-04 10-05 10-06 10-07"), (2024, "国庆节", "work", "09-29 10-12"),
    (2025, "春节", "off", "02-01 02-02 02-03 02-04"), (2025, "春节", "work", "01-26 02-08"),
    (2025, "清明节", "off", "04-05 04-06"), (2025, "劳动节", "off", "05-03 05-04 05-05"), (2025, "劳动节", "work", "04-27"),
    (2025, "端午节", "off", "06-01 06-02"), (2025, "国庆节", "off", "10-04 10-05 10-07 10-08"), (2025, "国庆节", "work", "09-28 10-11"),
) for d in ds.split()]
# Days with a name and no legal rank (month, day, name); the shopping festivals are among them.
OBSERVANCES = [(2, 14, "情人节"), (3, 8, "妇女节"), (6, 1, "儿童节"), (6, 18, "618"), (11, 11, "双11"), (12, 12, "双12"), (12, 25, "圣诞节")]

RULE_SCHEMA = "name string, y0 int, y1 int, m int, d int, first int, days int, lo int, hi int"


def holiday_tables(spark: SparkSession, rules=None, anchors=None, days=None):
    """The three inputs of the calendar as frames: effective-dated rules, anchor dates, announced days. Any of them can be
    handed in as a frame of the same columns, to replace the built-in one."""
    rules = rules if rules is not None else spark.createDataFrame(HOLIDAY_RULES, RULE_SCHEMA)
    anchors = anchors if anchors is not None else spark.createDataFrame(HOLIDAY_ANCHORS, "name string, anchor string")
    days = days if days is not None else spark.createDataFrame(HOLIDAY_DAYS, "date string, name string, kind string")
    return rules, anchors.withColumn("anchor", F.col("anchor").cast("date")), days.withColumn("date", F.col("date").cast("date"))


def holiday_days(dates: DataFrame, rules=None, anchors=None, days=None) -> DataFrame:
    """(date, name, kind, lo, hi) of every holiday day of the years of ``dates``: kind legal (by rule), off or work (announced).
    Announced days override rules; of two rules on one day the earlier name in text order stands.

    A year for which a rule needs an anchor that is not in the table fails the query instead of losing the holiday."""
    rules, anchors, days = holiday_tables(dates.sparkSession, rules, anchors, days)
    # holidays reach over the turn of the year, so the neighbouring years count as far as they have data
    years = dates.select(F.year("date").alias("y")).distinct()
    near = (years.select(F.explode(F.array(*[F.struct((F.col("y") + k).alias("y"), F.lit(k == 0).alias("own")) for k in (-1, 0, 1)])).alias("x"))
            .select("x.*").groupBy("y").agg(F.max("own").alias("own")))
    moved = anchors.select(F.col("name").alias("a_name"), F.year("anchor").alias("a_y"), "anchor")
    # range join of years and effective dates: both sides are a few rows a year
    at = (near.join(F.broadcast(rules), (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")))
          .join(F.broadcast(moved), (F.col("m") == 0) & (F.col("name") == F.col("a_name")) & (F.col("y") == F.col("a_y")), "left"))
    known = F.when(F.col("m") != 0, F.make_date("y", F.col("m"), F.col("d"))).otherwise(F.col("anchor"))
    missing = F.raise_error(F.concat(F.lit("no date of the holiday "), F.col("name"), F.lit(" in the year "), F.col("y").cast("string")))
    at = at.withColumn("anchor", F.when(known.isNull() & F.col("own"), missing.cast("date")).otherwise(known)).where(F.col("anchor").isNotNull())
    legal = at.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("days") - 1)).alias("k"), "anchor", "name", "lo", "hi") \
              .select(F.date_add("anchor", F.col("k")).alias("date"), "name", F.lit("legal").alias("kind"), "lo", "hi", F.lit(1).alias("rank"))
    windows = rules.groupBy("name").agg(F.max_by("lo", "y0").alias("lo"), F.max_by("hi", "y0").alias("hi"))
    told = days.join(F.broadcast(windows), "name", "left").select(
        "date", "name", "kind", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(1)).alias("hi"), F.lit(0).alias("rank"))
    told = told.join(F.broadcast(near), F.year("date") == F.col("y"), "left_semi")
    first = F.min_by(F.struct("name", "kind", "lo", "hi"), F.struct("rank", "name")).alias("x")
    return legal.unionByName(told).groupBy("date").agg(first).select("date", "x.*")


def _holiday_frames(dates: DataFrame, **tables):
    """(holiday days with legal_name and kind, influence-window names) for the years of ``dates``."""
    held = holiday_days(dates, **tables)
    free = held.where("kind <> 'work'")
    window = (free.select(F.col("name"), F.col("date").alias("hdate"), F.explode(F.sequence("lo", "hi")).alias("off"))
              .select(F.date_add("hdate", F.col("off")).alias("date"), "name", "hdate")
              .groupBy("date").agg(F.min_by("name", "hdate").alias("window_name")))
    return held.select("date", F.col("name").alias("legal_name"), "kind"), window


def _named(d: DataFrame) -> DataFrame:
    """Adds free (day off by holiday), worked (weekend day worked for one) and observance (name without rank)."""
    seen = F.lit(None).cast("string")
    for m, day, name in OBSERVANCES:
        seen = F.when((F.month("date") == m) & (F.dayofmonth("date") == day), name).otherwise(seen)
    return d.select("*", F.coalesce(F.col("kind").isin("legal", "off"), F.lit(False)).alias("free"),
                    F.coalesce(F.col("kind") == "work", F.lit(False)).alias("worked"), seen.alias("observance"))


def calendar_from_dates(dates: DataFrame, **tables) -> DataFrame:
    """Calendar rows for a distinct ``date`` frame.

    Columns: date, year, month, yearweek (Sunday-based, %U), yearday, week
    (Mon=0), weekend, workday, holiday_type (holiday / recess / null),
    is_legal_workday, holiday_legal, holiday_recess (holiday or swap day), holiday_name.
    ``tables``: rules, anchors, days of ``holiday_tables``.
    """
    held, _ = _holiday_frames(dates, **tables)
    d = _named(dates.join(F.broadcast(held), "date", "left"))
    free, worked = F.col("free"), F.col("worked")
    workday = F.when(worked, 1).when(free | (F.weekday("date") >= 5), 0).otherwise(1)
    return d.select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.expr(SPARK.sunday_week("date")).cast("int").alias("yearweek"),
        F.dayofyear("date").alias("yearday"),
        F.weekday("date").alias("week"),
        (F.weekday("date") >= 5).cast("int").alias("weekend"),
        workday.alias("workday"),
        F.when(free, "holiday").when(worked, "recess").alias("holiday_type"),
        workday.alias("is_legal_workday"),
        free.cast("int").alias("holiday_legal"),
        (free | worked).cast("int").alias("holiday_recess"),
        F.coalesce("legal_name", "observance").alias("holiday_name"),
    )


def calendar_for_years(spark: SparkSession, start_year: int, end_year: int, **tables) -> DataFrame:
    """S5 + J11: one row per day of [start_year, end_year] with influence windows."""
    dates = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(start_year), F.lit(1), F.lit(1)),
                                                       F.make_date(F.lit(end_year), F.lit(12), F.lit(31)))).alias("date"))
    return calendar_years_from(dates, **tables)


def calendar_years_from(dates: DataFrame, **tables) -> DataFrame:
    """S5 + J11 for a frame of days: holiday_recess 2 in a holiday's influence window, 1 on a swap workday outside of
    them; the name is the window's, else the swap day's holiday, else an observance."""
    held, window = _holiday_frames(dates, **tables)
    d = _named(dates.join(F.broadcast(held), "date", "left").join(F.broadcast(window), "date", "left"))
    weekend = F.weekday("date") >= 5
    workday = F.col("worked") | ~(weekend | F.col("free"))
    recess = (F.when(F.col("window_name").isNotNull(), 2)
              .when(workday & weekend, 1).otherwise(0))
    return d.select(
        (F.year("date") * 10000 + F.month("date") * 100 + F.dayofmonth("date")).alias("date_int"),
        F.col("date").alias("ds"),
        F.year("date").alias("year"),
        (F.year("date") * 100 + F.month("date")).alias("month"),
        (F.year(F.date_add("date", 3 - F.weekday("date"))) * 100 + F.weekofyear("date")).alias("yearweek"),
        F.dayofyear("date").alias("yearday"),
        F.weekday("date").alias("week"),
        weekend.cast("int").alias("weekend"),
        workday.cast("int").alias("workday"),
        F.col("free").cast("int").alias("holiday_legal"),
        recess.alias("holiday_recess"),
        F.when(recess == 2, "holiday").when(recess == 1, "recess").otherwise("normal").alias("holiday_type"),
        F.coalesce("window_name", "legal_name", "observance", F.lit("")).alias("holiday_name"),
    )


# ---- oracle side ---------------------------------------------------------------

def holiday_sql(dates_rel: str) -> str:
    """CTE body list (DuckDB) producing ``hdays(date, name, kind)``, ``legal(date, legal_name)`` (days off),
    ``hwin(date, window_name)`` and ``hobs(m, d, obs_name)``."""
    q = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    values = lambda rows: ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)
    return f"""
hyears AS (SELECT DISTINCT year(date) + k AS y FROM {dates_rel}, (VALUES (-1), (0), (1)) ks(k)),
hrules(name, y0, y1, m, d, first, days, lo, hi) AS (VALUES {values(HOLIDAY_RULES)}),
hmoved(name, anchor) AS (SELECT name, CAST(day AS DATE) FROM (VALUES {values(HOLIDAY_ANCHORS)}) v(name, day)),
htold(date, name, kind) AS (SELECT CAST(day AS DATE), name, kind FROM (VALUES {values(HOLIDAY_DAYS)}) v(day, name, kind)
                            WHERE year(CAST(day AS DATE)) IN (SELECT y FROM hyears)),
hanchor AS (
  SELECT r.name, r.first, r.days, r.lo, r.hi,
         CASE WHEN r.m = 0 THEN hmoved.anchor ELSE make_date(CAST(y AS INT), r.m, r.d) END AS anchor
  FROM hyears JOIN hrules r ON y BETWEEN r.y0 AND r.y1
  LEFT JOIN hmoved ON r.m = 0 AND hmoved.name = r.name AND year(hmoved.anchor) = y),
hrule_days AS (
  SELECT name, lo, hi, CAST(anchor + CAST(first + k AS INTEGER) AS DATE) AS date
  FROM hanchor, (SELECT unnest(range(0, 7)) AS k) ks WHERE anchor IS NOT NULL AND k < days),
hall AS (
  SELECT date, name, 'legal' AS kind, lo, hi, 1 AS rank FROM hrule_days
  UNION ALL SELECT t.date, t.name, t.kind, w.lo, w.hi, 0
  FROM htold t LEFT JOIN (SELECT name, arg_max(lo, y0) AS lo, arg_max(hi, y0) AS hi FROM hrules GROUP BY name) w ON w.name = t.name),
hdays AS (SELECT * FROM hall QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank, name) = 1),
legal AS (SELECT date, name AS legal_name FROM hdays WHERE kind <> 'work'),
hwin AS (
  SELECT CAST(h.date + CAST(off AS INTEGER) AS DATE) AS date, arg_min(name, h.date) AS window_name
  FROM hdays h, (SELECT unnest(range(-7, 8)) AS off) os
  WHERE kind <> 'work' AND off BETWEEN lo AND hi
  GROUP BY 1),
hobs(m, d, obs_name) AS (VALUES {values(OBSERVANCES)})"""


def calendar_sql(dates_rel: str) -> str:
    """S4 calendar as DuckDB CTEs; final CTE is named ``cal``."""
    D = DUCK
    return holiday_sql(dates_rel) + f""",
cal0 AS (
  SELECT d.date, h.name, coalesce(h.kind IN ('legal', 'off'), false) AS free, coalesce(h.kind = 'work', false) AS worked, hobs.obs_name
  FROM {dates_rel} d LEFT JOIN hdays h ON h.date = d.date LEFT JOIN hobs ON hobs.m = month(d.date) AND hobs.d = day(d.date)),
cal AS (
  SELECT date, year(date) AS year, month(date) AS month,
         CAST({D.sunday_week('date')} AS INT) AS yearweek,
         dayofyear(date) AS yearday, {D.weekday('date')} AS week,
         CAST({D.weekday('date')} >= 5 AS INT) AS weekend,
         CASE WHEN worked THEN 1 WHEN free OR {D.weekday('date')} >= 5 THEN 0 ELSE 1 END AS workday,
         CASE WHEN free THEN 'holiday' WHEN worked THEN 'recess' END AS holiday_type,
         CASE WHEN worked THEN 1 WHEN free OR {D.weekday('date')} >= 5 THEN 0 ELSE 1 END AS is_legal_workday,
         CAST(free AS INT) AS holiday_legal,
         CAST(free OR worked AS INT) AS holiday_recess,
         coalesce(name, obs_name) AS holiday_name
  FROM cal0)"""


def calendar_years_sql(days_rel: str) -> str:
    """S5 + J11 as DuckDB CTEs over a relation of days; final CTE is named ``cyears``."""
    return holiday_sql(days_rel).strip() + f""",
cy0 AS (
  SELECT d.date, isodow(d.date) >= 6 AS wk, coalesce(h.kind IN ('legal', 'off'), false) AS free,
         coalesce(h.kind = 'work', false) OR NOT (isodow(d.date) >= 6 OR coalesce(h.kind IN ('legal', 'off'), false)) AS workday,
         hwin.window_name, h.name, hobs.obs_name
  FROM {days_rel} d LEFT JOIN hdays h ON h.date = d.date LEFT JOIN hwin ON hwin.date = d.date
  LEFT JOIN hobs ON hobs.m = month(d.date) AND hobs.d = day(d.date)),
cy1 AS (SELECT *, CASE WHEN window_name IS NOT NULL THEN 2 WHEN workday AND wk THEN 1 ELSE 0 END AS holiday_recess FROM cy0),
cyears AS (
  SELECT year(date) * 10000 + month(date) * 100 + day(date) AS date_int, date AS ds,
         year(date) AS year, year(date) * 100 + month(date) AS month,
         year(CAST(date + CAST(3 - (isodow(date) - 1) AS INTEGER) AS DATE)) * 100 + weekofyear(date) AS yearweek,
         dayofyear(date) AS yearday, isodow(date) - 1 AS week, CAST(wk AS INT) AS weekend, CAST(workday AS INT) AS workday,
         CAST(free AS INT) AS holiday_legal, holiday_recess,
         CASE holiday_recess WHEN 2 THEN 'holiday' WHEN 1 THEN 'recess' ELSE 'normal' END AS holiday_type,
         coalesce(window_name, name, obs_name, '') AS holiday_name
  FROM cy1)"""
