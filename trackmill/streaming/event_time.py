"""Event time: windows over streams, rows that come late, copies that come twice.

``windows`` and ``sessions`` are Spark's own aggregations under a watermark over all rows: a window comes out
once, when the watermark has passed its end, and rows that come after that are dropped and only counted
(``dropped_rows``). Where no row may be lost, ``settling_windows`` keeps the open windows itself: every key has
its own clock, a window comes out when the key's clock has passed its end by the delay, and a row that comes
for a window that is out already comes out alone, marked late. ``settled`` adds up windows and late rows: the
same as a batch over all rows.

``run_to`` writes a stream's rows to a Parquet sink, whose log and checkpoint together give each row exactly
once, also after a restart. A key with many rows is salted by the caller; ``settled`` adds the parts up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackmill.sources.scratch import kept


def windows(events: DataFrame, width: str, by: list[str], sums: dict[str, str], delay: str, time: str = "ts", slide: str | None = None) -> DataFrame:
    """(start, end, *by, n, sums): tumbling windows, or sliding ones; ``sums`` names column and sum."""
    window = F.window(time, width, slide)
    found = events.withWatermark(time, delay).groupBy(window, *by).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for c, name in sums.items()])
    return found.select("window.start", "window.end", *by, "n", *sums.values())


def sessions(events: DataFrame, gap: str, by: list[str], sums: dict[str, str], delay: str, time: str = "ts") -> DataFrame:
    """(start, end, *by, n, sums): runs of rows without a silence of ``gap``; end is that of the silence."""
    session = F.session_window(time, gap)
    found = events.withWatermark(time, delay).groupBy(session, *by).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for c, name in sums.items()])
    return found.select("session_window.start", "session_window.end", *by, "n", *sums.values())


def once(events: DataFrame, keys: list[str], delay: str, time: str = "ts") -> DataFrame:
    """The first row of each key; copies that come within the delay go, and their keys are forgotten after it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


_KEPT = "starts array<long>, counts array<long>, sums array<array<long>>, clock long"


def settling_windows(events: DataFrame, width_seconds: int, key: str, sums: dict[str, str], delay_seconds: int, time: str = "ts") -> DataFrame:
    """(key, start, n, sums, late) of tumbling windows of whole seconds since the epoch; sums of whole numbers.

    The clock of a key is its latest time so far. State is the windows that are open, so its size is bounded by
    delay and width, not by the rows.
    """
    kind = events.schema[key].dataType.simpleString()
    names = list(sums)

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, counts, totals, clock = state.get if state.exists else ([], [], [], -(1 << 62))
        held = {s: [n, *t] for s, n, t in zip(starts, counts, totals, strict=True)}
        rows = pd.concat(list(batches), ignore_index=True)
        out = [(k[0], int(s), 1, *map(int, v), True) for s, *v in rows.loc[rows["_start"] + width_seconds + delay_seconds <= clock, ["_start", *names]].itertuples(index=False)]
        here = rows[rows["_start"] + width_seconds + delay_seconds > clock]
        for start, part in here.groupby("_start"):
            own = held.setdefault(int(start), [0] * (1 + len(names)))
            own[0] += len(part)
            for i, c in enumerate(names, 1):
                own[i] += int(part[c].sum())
        clock = max(clock, int(rows["_second"].max()))
        for start in sorted(s for s in held if s + width_seconds + delay_seconds <= clock):
            out.append((k[0], start, *held.pop(start), False))
        state.update((list(held), [v[0] for v in held.values()], [v[1:] for v in held.values()], clock))
        if out:
            yield pd.DataFrame(out, columns=["key", "start", "n", *sums.values(), "late"])

    second = F.unix_seconds(F.col(time).cast("timestamp"))
    narrow = events.select(F.col(key).alias("key"), second.alias("_second"), (second - F.pmod(second, F.lit(width_seconds))).alias("_start"), *[F.col(c).cast("long").alias(c) for c in names])
    schema = f"key {kind}, start long, n long, {''.join(f'{s} long, ' for s in sums.values())}late boolean"
    found = narrow.groupBy("key").applyInPandasWithState(update, schema, _KEPT, "append", GroupStateTimeout.NoTimeout)
    return found.select(F.col("key").alias(key), F.timestamp_seconds("start").alias("start"), "n", *sums.values(), "late")


def settled(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Windows with the late rows (or parts of a salted key) added up."""
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])


def run_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that has come so far to a Parquet sink, and stop; the next run goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came for windows that were out already, in the progress that Spark still keeps of a query."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in map(dict, p["stateOperators"]))


def replayed(spark: SparkSession, events: DataFrame, folder: str, arrival: Column, files: int, per_batch: int = 1) -> DataFrame:
    """A table as a stream: its rows in files by the order of ``arrival``, so many files to a batch."""
    ranged = events.withColumn("_arrival", arrival).repartitionByRange(files, "_arrival").drop("_arrival")
    parts = kept(ranged.withColumn("_part", F.spark_partition_id()), "replay")  # bounds are drawn anew each time
    for part in range(files):  # one after the other: the source takes files in the order in which they were written
        parts.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
