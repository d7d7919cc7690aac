"""Queries over stored sketches, laid-out joins, global ranks and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.operators import join_plans as J
from trackmill.operators import sketches as S
from trackmill.operators.aggregates import global_rank, value_ranks
from trackmill.operators.calendars import local_days
from trackmill.registry import query
from trackmill.sources.scratch import kept


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    day = F.datediff("ts", F.lit("2024-01-01"))
    return e.select("event_id", "user_id", "event_type", "ts", "value", day.alias("day"), F.floor(day / 7).cast("int").alias("week"))


_WEEKS = "(SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, (date_diff('day', DATE '2024-01-01', ts::DATE) // 7)::INTEGER AS week FROM events)"


@query("AGG-18", f"SELECT coalesce(week, -1) AS week, coalesce(event_type, 'all') AS event_type, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS users_ok, TRUE AS median_ok, TRUE AS high_ok, (SELECT max(c) FROM (SELECT count(*) AS c FROM {_WEEKS} i WHERE (o.week IS NULL OR i.week = o.week) AND (o.event_type IS NULL OR i.event_type = o.event_type) GROUP BY user_id)) AS most FROM {_WEEKS} o GROUP BY CUBE (week, event_type)")
def agg_18(spark, sf_dir):
    """A cube by week and type out of daily sketches alone, and whether its estimates are within their bounds
    of the exact ones. Where more users than a sketch counts exactly share a cell, its most frequent one is
    counted from the rows."""
    events = _events(spark, sf_dir)
    daily = kept(S.sketched(events, ["week", "day", "event_type"], "user_id", "value", "user_id"), "sketches")
    cube = kept(S.estimated(S.merged_cube(daily, ["week", "event_type"]), [0.5, 0.9], 1), "cube")
    levels = events.select(F.explode(F.array(*[F.struct((F.col("week") if i < 2 else F.lit(None).cast("int")).alias("week"), (F.col("event_type") if i % 2 == 0 else F.lit(None).cast("string")).alias("event_type")) for i in range(4)])).alias("k"), "user_id", "value")
    same = [F.col("k.week").eqNullSafe(F.col("c.week")), F.col("k.event_type").eqNullSafe(F.col("c.event_type"))]
    joined = levels.join(cube.alias("c"), same)
    cell = [F.coalesce("c.week", F.lit(-1)).alias("week"), F.coalesce("c.event_type", F.lit("all")).alias("event_type"), "n"]
    below = [F.count_if(F.col("value") < F.col("quantiles")[i]).alias(f"below{i}") for i in range(2)]
    upto = [F.count_if(F.col("value") <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(2)]
    per_user = joined.groupBy(*cell, "user_id").agg(F.count("*").alias("events"), F.count("value").alias("values"), *below, *upto, F.max("distincts").alias("distincts"), F.max(F.get("top", F.lit(0))["count"]).alias("top"))
    near = lambda i, q: (F.try_divide(F.sum(f"below{i}"), F.sum("values")) <= q + 4 * S.RANK_ERROR) & (F.try_divide(F.sum(f"upto{i}"), F.sum("values")) >= q - 4 * S.RANK_ERROR)
    users = F.count("user_id")
    most = F.when(users <= S.ITEMS, F.max("top")).otherwise(F.max("events"))
    return per_user.groupBy("week", "event_type", "n").agg(users.alias("users"), (F.abs(F.max("distincts") - users) <= 4 * S.DISTINCT_ERROR * users).alias("users_ok"), near(0, 0.5).alias("median_ok"), near(1, 0.9).alias("high_ok"), most.alias("most"))


_JOINED = "SELECT l_returnflag AS flag, o_orderstatus AS status, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey {more}GROUP BY ALL"


def _summed(joined: DataFrame) -> DataFrame:
    return joined.groupBy(F.col("l_returnflag").alias("flag"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("JON-21", _JOINED.format(more=""))
def jon_21(spark, sf_dir):
    """Two tables in buckets of their key, joined without a shuffle."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_returnflag", "l_quantity")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    buckets = J.buckets_for(lines, orders)
    return _summed(J.bucketed(lines, ["key"], buckets, "lines").join(J.bucketed(orders, ["key"], buckets, "orders"), "key"))


@query("JON-21b", _JOINED.format(more="WHERE o_custkey % 50 = 7 "))
def jon_21b(spark, sf_dir):
    """A join of which most rows have no partner: they go before the shuffle."""
    orders = _table(spark, sf_dir, "orders").filter("o_custkey % 50 = 7").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_returnflag", "l_quantity")
    return _summed(J.prefiltered(lines, orders, ["key"]).join(orders, "key"))


@query("JON-21c", "SELECT k, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN 0 ELSE o_custkey % 40 END AS k, o_custkey FROM orders) JOIN (SELECT c_custkey % 50 AS k FROM customer WHERE c_custkey <= 200) USING (k) GROUP BY k")
def jon_21c(spark, sf_dir):
    """A join in which one key holds two thirds of the rows, dealt to parts by its count."""
    k = F.when(F.col("o_orderkey") % 3 != 0, 0).otherwise(F.col("o_custkey") % 40).cast("long")
    orders = _table(spark, sf_dir, "orders").select(k.alias("k"), "o_custkey")
    customers = _table(spark, sf_dir, "customer").filter("c_custkey <= 200").select((F.col("c_custkey") % 50).cast("long").alias("k"))
    return J.salted_join(orders, customers, ["k"], 500).groupBy("k").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@query("WIN-7", "SELECT l_linenumber AS line, l_orderkey AS key, l_quantity::DOUBLE AS quantity, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 9) AS percent_rank, round(cume_dist() OVER w, 9) AS cume_dist FROM lineitem WINDOW w AS (ORDER BY l_quantity)")
def win_7(spark, sf_dir):
    """Ranks over the whole table, from the counts of its values."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("key"), F.col("l_quantity").cast("double").alias("quantity"))
    ranked = value_ranks(lines, "quantity")
    return ranked.select("line", "key", "quantity", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))


@query("WIN-7b", "SELECT event_id, ntile(7) OVER (ORDER BY event_id) AS tile FROM events")
def win_7b(spark, sf_dir):
    """Seven tiles of the whole table in order."""
    ranked = global_rank(_table(spark, sf_dir, "events").select("event_id"), "event_id")
    size, more = F.expr("n_rows div 7"), F.col("n_rows") % 7
    place = F.col("rank")
    tile = F.when(place < more * (size + 1), F.expr("rank div (n_rows div 7 + 1)")).otherwise(more + F.expr("(rank - (n_rows % 7) * (n_rows div 7 + 1)) div greatest(n_rows div 7, 1)"))
    return ranked.select("event_id", (tile + 1).alias("tile"))


@query("WIN-7c", "SELECT event_id, count(*) OVER w AS n, sum(round(value * 100)::BIGINT) OVER w::BIGINT AS cents FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND INTERVAL 1 HOUR FOLLOWING)")
def win_7c(spark, sf_dir):
    """What a user did in the six hours before each event and the hour after it."""
    e = _table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long")).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    around = Window.partitionBy("user_id").orderBy("at").rangeBetween(-6 * 3_600_000_000, 3_600_000_000)
    return e.select("event_id", F.count("*").over(around).alias("n"), F.sum("cents").over(around).alias("cents"))


_DAYS = """SELECT zone, day::VARCHAR AS day, hours, count(event_id) AS n FROM (
  SELECT zone, d::DATE AS day, (epoch(timezone(zone, (d::DATE + 1)::TIMESTAMP)) - epoch(timezone(zone, d::DATE::TIMESTAMP)))::BIGINT // 3600 AS hours
  FROM (VALUES ('America/New_York'), ('Europe/Berlin')) z(zone), LATERAL (SELECT unnest(generate_series(
    (SELECT min(timezone(zone, timezone('UTC', ts + INTERVAL 65 DAYS)))::DATE::TIMESTAMP FROM events), (SELECT max(timezone(zone, timezone('UTC', ts + INTERVAL 65 DAYS)))::DATE::TIMESTAMP FROM events), INTERVAL 1 DAY)) AS d)) days
LEFT JOIN (SELECT event_id, zone AS z, timezone(zone, timezone('UTC', ts + INTERVAL 65 DAYS))::DATE AS local FROM events, (VALUES ('America/New_York'), ('Europe/Berlin')) y(zone) WHERE event_type = 'error') e ON e.z = zone AND e.local = day
GROUP BY ALL"""


@query("DTE-1", _DAYS)
def dte_1(spark, sf_dir):
    """Errors by local day in two zones over their changes of the clock, days without any included."""
    e = _table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 65 DAYS")).alias("ts"))
    out = None
    for zone in ("America/New_York", "Europe/Berlin"):
        days = local_days(e, "ts", zone).withColumn("zone", F.lit(zone))
        errors = e.filter("event_type = 'error'").select("event_id", F.to_date(F.from_utc_timestamp("ts", zone)).alias("day"))
        part = days.join(errors, "day", "left").groupBy("zone", F.col("day").cast("string").alias("day"), "hours").agg(F.count("event_id").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
