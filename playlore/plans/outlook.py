"""Forecasts of a listener's days, the log of them, and what weather and seasons do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlore.functions.compat import text
from playlore.functions.config import Lens
from playlore.operators.joins import top_by
from playlore.plans.base import Catalogue

C = Catalogue()
QUERIES, ORACLE = C.queries, C.oracle
ALL = Lens()
TODAY = "2000-06-05"
#: Days of history: weekday rates, and recent days.
LONG, RECENT = 84, 14

_PAST = f"p AS (SELECT * FROM plays WHERE attended AND day < DATE '{TODAY}' AND day >= DATE '{TODAY}' - {LONG})"
_DAYS = _PAST + f""", d AS (SELECT owner, day, sum(ms)::BIGINT AS ms FROM p GROUP BY ALL), o AS (SELECT owner, count(*) FILTER (day >= DATE '{TODAY}' - {RECENT}) AS recent, sum(ms)::BIGINT AS ms, count(*) AS days, sum(ms) FILTER (day >= DATE '{TODAY}' - {RECENT}) AS late FROM d GROUP BY owner),
b AS (SELECT owner, isodow(day) AS dow, count(*) AS n FROM d GROUP BY ALL), g AS (SELECT owner, recent, ms, days, late, unnest(generate_series(DATE '{TODAY}', DATE '{TODAY}' + 6, INTERVAL 1 DAY))::DATE AS day FROM o),
f AS (SELECT g.owner, g.day, round(CASE WHEN recent >= 3 THEN 0.5 * coalesce(n, 0) / {LONG // 7} + 0.5 * recent / {RECENT} ELSE coalesce(n, 0) / {LONG // 7}.0 END, 6)::DOUBLE AS p_any,
  round(g.ms / 60000.0::DOUBLE / days * least(1.8, greatest(0.5, (coalesce(late, 0) / {RECENT}.0::DOUBLE) / (g.ms / {LONG}.0::DOUBLE))), 4) AS minutes FROM g LEFT JOIN b ON b.owner = g.owner AND b.dow = isodow(g.day))"""
_WORDS = "CASE WHEN p_any < 0.2 THEN 'clear' WHEN p_any < 0.5 THEN 'scattered' WHEN p_any < 0.8 OR minutes < 60 THEN 'showers' ELSE 'storm' END"


def past(plays: DataFrame) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    return ALL.plays(plays).filter((F.col("day") < today) & (F.col("day") >= F.date_sub(today, LONG)))


def condition(p_any: Column, minutes: Column) -> Column:
    """The weather word of a chance and an amount."""
    return F.when(p_any < 0.2, "clear").when(p_any < 0.5, "scattered").when((p_any < 0.8) | (minutes < 60), "showers").otherwise("storm")


def outlook(plays: DataFrame) -> DataFrame:
    """(owner, day, p_any, minutes) of the seven days from today: half the weekday's rate, half the last fortnight's, the amount with its trend between 0.5 and 1.8."""
    today = F.lit(TODAY).cast("date")
    late = F.col("day") >= F.date_sub(today, RECENT)
    d = past(plays).groupBy("owner", "day").agg(F.sum("ms").alias("ms"))
    o = d.groupBy("owner").agg(F.count_if(late).alias("recent"), F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("days"), F.coalesce(F.sum(F.when(late, F.col("ms"))), F.lit(0)).alias("late"))
    b = d.groupBy("owner", F.weekday("day").alias("dow")).agg(F.count(F.lit(1)).alias("n"))
    grid = o.withColumn("day", F.explode(F.sequence(today, F.date_add(today, 6)))).withColumn("dow", F.weekday("day")).join(b, ["owner", "dow"], "left")
    usual = F.coalesce("n", F.lit(0)) / F.lit(float(LONG // 7))
    p_any = F.when(F.col("recent") >= 3, 0.5 * usual + 0.5 * F.col("recent") / F.lit(float(RECENT))).otherwise(usual)
    trend = F.least(F.lit(1.8), F.greatest(F.lit(0.5), (F.col("late") / F.lit(float(RECENT))) / (F.col("ms") / F.lit(float(LONG)))))
    return grid.select("owner", "day", F.round(p_any, 6).alias("p_any"), F.round(F.col("ms") / 60000.0 / F.col("days") * trend, 4).alias("minutes"))


@C.query("f_week_outlook", "plays", "artists", sql=_DAYS + f""", s AS (SELECT owner, scene, row_number() OVER (PARTITION BY owner ORDER BY sum(ms) DESC, scene) AS r FROM p JOIN artists USING (artist) GROUP BY owner, scene), t AS (SELECT owner, array_to_string(list(scene ORDER BY r), ',') AS scenes FROM s WHERE r <= 3 GROUP BY 1)
SELECT owner, strftime(day, '%Y-%m-%d') AS day, p_any, minutes, {_WORDS} AS condition, scenes FROM f LEFT JOIN t USING (owner)""")
def week_outlook(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Seven days ahead, with the scenes to expect."""
    n = past(plays).join(artists.select("artist", "scene"), "artist").groupBy("owner", "scene").agg(F.sum("ms").alias("ms"))
    best = top_by(n, ["owner"], 3, F.desc("ms"), F.col("scene")).groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "scene"))), lambda x: x["scene"].cast("string")), ",").alias("scenes"))
    return outlook(plays).join(best, "owner", "left").select("owner", text(F.col("day")).alias("day"), "p_any", "minutes", condition(F.col("p_any"), F.col("minutes")).alias("condition"), "scenes")


@C.query("f_day_radar", "plays", sql=_PAST + f" SELECT owner, hour, count(DISTINCT day) AS days, count(DISTINCT day) / {LONG}.0::DOUBLE AS chance, count(*) AS plays FROM p GROUP BY ALL")
def day_radar(plays: DataFrame) -> DataFrame:
    """The chance of a play in each hour."""
    h = past(plays).groupBy("owner", "hour").agg(F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("plays"))
    return h.withColumn("chance", F.col("days") / F.lit(float(LONG)))


_PICKS = lambda key, n: f"SELECT owner, '{key}' AS kind, {key} AS id, round(0.5 * count(DISTINCT day) FILTER (isodow(day) = isodow(DATE '{TODAY}')) / {LONG // 7}.0::DOUBLE + 0.5 * count(DISTINCT day) FILTER (day >= DATE '{TODAY}' - {RECENT}) / {RECENT}.0::DOUBLE, 6) AS chance FROM p GROUP BY owner, {key}"


@C.query("f_day_picks", "plays", sql=_PAST + f", a AS ({_PICKS('artist', 12)}), t AS ({_PICKS('track', 25)}) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY owner ORDER BY chance DESC, id) <= 12 UNION ALL SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY owner ORDER BY chance DESC, id) <= 25")
def day_picks(plays: DataFrame) -> DataFrame:
    """The twelve artists and twenty-five songs most likely today."""
    today = F.lit(TODAY).cast("date")
    same, late = F.weekday("day") == F.weekday(today), F.col("day") >= F.date_sub(today, RECENT)

    def part(key: str, n: int) -> DataFrame:
        c = past(plays).groupBy("owner", F.col(key).alias("id")).agg(F.round(0.5 * F.count_distinct(F.when(same, F.col("day"))) / F.lit(float(LONG // 7)) + 0.5 * F.count_distinct(F.when(late, F.col("day"))) / F.lit(float(RECENT)), 6).alias("chance"))
        return top_by(c, ["owner"], n, F.desc("chance"), F.col("id")).select("owner", F.lit(key).alias("kind"), "id", "chance")

    return part("artist", 12).unionByName(part("track", 25))


@C.query("f_forecast_log", "plays", sql=_DAYS + f", log AS (SELECT DISTINCT owner, day FROM plays WHERE NOT attended) SELECT f.owner, strftime(f.day, '%Y-%m-%d') AS day, p_any, {_WORDS} AS condition FROM f ANTI JOIN log USING (owner, day)")
def forecast_log(plays: DataFrame) -> DataFrame:
    """What a write-once log lacks (F78): forecasts of days that are not in it. The log here: days with a play in passing."""
    log = plays.filter("not attended").select("owner", "day").distinct()
    return outlook(plays).join(log, ["owner", "day"], "left_anti").select("owner", text(F.col("day")).alias("day"), "p_any", condition(F.col("p_any"), F.col("minutes")).alias("condition"))


_SKY = "CASE WHEN abs(d - 183) < 60 THEN 'sun' WHEN d % 3 = 0 THEN 'rain' ELSE 'cloud' END"


@C.query("f_range_weather", "plays", sql=f"""d AS (SELECT owner, date_trunc('quarter', day)::DATE AS q, {_SKY.replace('d ', 'dayofyear(day) ')} AS sky, sum(ms)::BIGINT AS ms, count(DISTINCT day) AS days FROM plays WHERE attended GROUP BY ALL),
t AS (SELECT *, sum(ms) OVER (PARTITION BY owner, q)::DOUBLE / sum(days) OVER (PARTITION BY owner, q)::DOUBLE AS usual FROM d)
SELECT owner, strftime(q, '%Y-%m-%d') AS quarter, sky, days, round(ms::DOUBLE / days / usual, 6) AS lift FROM t WHERE round(ms::DOUBLE / days / usual, 6) >= 1.15""")
def range_weather(plays: DataFrame) -> DataFrame:
    """Skies under which more is heard than usual in a quarter (F144). The sky of a day is by its number, where no weather table is given."""
    n = F.dayofyear("day")
    sky = F.when(F.abs(n - 183) < 60, "sun").when(n % 3 == 0, "rain").otherwise("cloud")
    d = ALL.plays(plays).groupBy("owner", F.trunc("day", "quarter").alias("q"), sky.alias("sky")).agg(F.sum("ms").alias("ms"), F.count_distinct("day").alias("days"))
    w = Window.partitionBy("owner", "q")
    lift = F.round(F.col("ms").cast("double") / F.col("days") / (F.sum("ms").over(w).cast("double") / F.sum("days").over(w).cast("double")), 6)
    return d.withColumn("lift", lift).filter("lift >= 1.15").select("owner", text(F.col("q")).alias("quarter"), "sky", "days", "lift")
