"""Queries over events as a stream that arrives out of order, against plain aggregates over the table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.registry import query
from trackmill.sources.scratch import kept, scratch_dir
from trackmill.streaming import event_time as E

#: Rows come up to this late, and each ninety-seventh by three days more.
JITTER, DELAY = 2 * 3600, "3 hours"
FILES = 4


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


def _arrival(very_late: bool) -> Column:
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(JITTER))
    more = F.when(F.col("event_id") % 97 == 0, F.lit(3 * 86400)).otherwise(0) if very_late else F.lit(0)
    return F.unix_seconds("ts") + jitter + more


def _streamed(spark: SparkSession, events: DataFrame, arrival: Column, step) -> DataFrame:
    """The rows that a step over the replayed events writes to its sink."""
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = E.replayed(spark, kept(events, "events"), f"{folder}/in", arrival, FILES)
    out = step(source)
    E.run_to(out, f"{folder}/out", f"{folder}/log")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _closing(events: DataFrame, key: str) -> DataFrame:
    """The events, and for each key a last row long after all others, which closes its windows."""
    last = events.agg(F.max("ts").alias("last"))
    ends = events.select(key).distinct().crossJoin(F.broadcast(last))  # one row
    columns = [F.lit(None).cast(k).alias(c) if c not in (key, "ts") else F.col(key) if c == key else (F.col("last") + F.expr("INTERVAL 30 DAYS")).alias("ts") for c, k in events.dtypes]
    return events.unionByName(ends.select(*columns))


_EVENTS = "(SELECT event_id, ts, user_id, event_type, round(value * 100)::BIGINT AS cents FROM events) e"


@query("STR-W1", f"SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, sum(cents)::BIGINT AS cents FROM {_EVENTS} GROUP BY ALL")
def str_w1(spark, sf_dir):
    """Windows of six hours by type, of a stream in which some rows come days late; none is lost."""
    events = _closing(_events(spark, sf_dir), "event_type")
    rows = _streamed(spark, events, _arrival(True), lambda s: E.settling_windows(s, 6 * 3600, "event_type", {"cents": "cents"}, 3 * 3600))
    found = E.settled(rows.filter("n > 0"), ["event_type", "start"], ["n", "cents"])
    return found.select("event_type", F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "n", "cents")


@query("STR-W2", f"SELECT event_type, start, count(*) AS n FROM {_EVENTS}, LATERAL (SELECT time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') - unnest([INTERVAL 0 HOURS, INTERVAL 2 HOURS, INTERVAL 4 HOURS]) AS start) GROUP BY ALL")
def str_w2(spark, sf_dir):
    """Windows of six hours every two hours, under a watermark that all rows keep."""
    events = _closing(_events(spark, sf_dir), "event_type")
    rows = _streamed(spark, events, _arrival(False), lambda s: E.windows(s, "6 hours", ["event_type"], {"cents": "cents"}, DELAY, slide="2 hours"))
    return rows.select("event_type", F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "n")


@query("STR-W3", f"SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n, sum(cents)::BIGINT AS cents FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 5 HOURS THEN 0 ELSE 1 END AS new FROM {_EVENTS})) GROUP BY user_id, run")
def str_w3(spark, sf_dir):
    """Sessions of users: runs without five hours of silence."""
    events = _closing(_events(spark, sf_dir), "user_id")
    rows = _streamed(spark, events, _arrival(False), lambda s: E.sessions(s, "5 hours", ["user_id"], {"cents": "cents"}, DELAY))
    last = _events(spark, sf_dir).agg(F.max("ts").alias("last"))
    return rows.join(F.broadcast(last), F.col("start") <= F.col("last")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "cents")  # without the closing rows


@query("STR-W4", f"SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM {_EVENTS} GROUP BY 1")
def str_w4(spark, sf_dir):
    """Events of which every third comes twice, an hour apart: each counts once."""
    events = _events(spark, sf_dir).withColumn("copy", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = _streamed(spark, events, _arrival(False) + F.col("copy") * 3600, lambda s: E.once(s, ["event_id"], "6 hours"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
