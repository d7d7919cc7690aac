"""Streams of events against batches, file by file, with late rows, copies and restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from trackmill.streaming import event_time as E

SCHEMA = "event_id long, ts timestamp, kind string, v long"
START = dt.datetime(2024, 3, 1)


def rows(seed, n, late=()):
    """Events ten minutes apart on average, in order of arrival; those in ``late`` are two days old."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts = START + dt.timedelta(minutes=10 * i, seconds=rng.randrange(-1500, 1500))
        out.append((i, ts - dt.timedelta(days=2) if i in late else ts, rng.choice("ab"), rng.randrange(100)))
    return out


def streamed(spark, tmp_path, batches, step):
    """The sink after a run per batch: every run but the first is a restart from the checkpoint."""
    queries = []
    (tmp_path / "in").mkdir(exist_ok=True)
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = step(source)
        queries.append(E.run_to(out, str(tmp_path / "out"), str(tmp_path / "log")))
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")), queries


def split(events, n):
    return [events[i * len(events) // n : (i + 1) * len(events) // n] for i in range(n)]


def hours(ts, n):
    return ts - dt.timedelta(hours=ts.hour % n, minutes=ts.minute, seconds=ts.second)


def test_no_row_is_lost_and_late_ones_count_once(spark, tmp_path):
    late = {150, 170, 199}
    events = rows(1, 240, late)
    closing = [(10_000, START + dt.timedelta(days=30), k, 0) for k in "ab"]
    out, _ = streamed(spark, tmp_path, [*split(events, 4), closing], lambda s: E.settling_windows(s, 6 * 3600, "kind", {"v": "v"}, 3600))
    got = out.collect()
    assert sorted(r.n for r in got if r.late) == [1] * len(late)
    want = {}
    for _, ts, k, v in events:
        w = want.setdefault((k, hours(ts, 6)), [0, 0])
        w[0], w[1] = w[0] + 1, w[1] + v
    assert {(r.kind, r.start): [r.n, r.v] for r in E.settled(out, ["kind", "start"], ["n", "v"]).collect()} == want
    windows = [(r.kind, r.start) for r in got if not r.late]
    assert len(windows) == len(set(windows))  # each came out once, restarts or not


def test_watermark_drops_and_counts_late_rows(spark, tmp_path):
    events = rows(2, 240, {200, 210})
    closing = [(10_000, START + dt.timedelta(days=30), "a", 0)]
    out, queries = streamed(spark, tmp_path, [*split(events, 4), closing], lambda s: E.windows(s, "6 hours", ["kind"], {"v": "v"}, "2 hours"))
    want = {}
    for i, ts, k, v in events:
        if i not in (200, 210):
            w = want.setdefault((k, hours(ts, 6)), [0, 0])
            w[0], w[1] = w[0] + 1, w[1] + v
    got = [((r.kind, r.start), [r.n, r.v]) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert sum(map(E.dropped_rows, queries)) == 2


def test_sliding_windows_and_sessions_equal_batches(spark, tmp_path):
    events = [r for r in rows(3, 200) if not 60 <= r[0] < 100]
    closing = [(10_000, START + dt.timedelta(days=30), k, 0) for k in "ab"]
    parts = [*split(events, 3), closing]
    table = spark.createDataFrame(events, SCHEMA)
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    out, _ = streamed(spark, tmp_path / "x", parts, lambda s: E.windows(s, "4 hours", ["kind"], {"v": "v"}, "2 hours", slide="1 hour"))
    want = table.groupBy(F.window("ts", "4 hours", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("v").alias("v")).select("w.start", "w.end", "kind", "n", "v")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    out, _ = streamed(spark, tmp_path / "y", parts, lambda s: E.sessions(s, "90 minutes", ["kind"], {"v": "v"}, "2 hours"))
    want = table.groupBy(F.session_window("ts", "90 minutes").alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("v").alias("v")).select("w.start", "w.end", "kind", "n", "v")
    got = [tuple(r) for r in out.filter("n > 1 OR v > 0 OR start < '2024-03-20'").collect()]
    assert sorted(got) == sorted(map(tuple, want.collect())) and len(got) > 2


def test_copies_within_the_delay_count_once(spark, tmp_path):
    events = rows(4, 120)
    again = [(i, ts + dt.timedelta(minutes=20), k, v) for i, ts, k, v in events if i % 4 == 0]
    batches = split(events, 3)
    for b in range(3):
        batches[b] = batches[b] + [r for r in again if r[0] in {x[0] for x in batches[b]}][::2]
    batches[2] += [r for r in again if r[0] >= 90]
    out, _ = streamed(spark, tmp_path, batches, lambda s: E.once(s, ["event_id"], "12 hours"))
    got = [r.event_id for r in out.collect()]
    assert sorted(got) == list(range(120))
