"""The trackers over a stream in event time, with a state per track.

Frames may come in any order within the watermark's delay: rows are held until the watermark has passed
their frame's time, a timer then takes the frames that are due in order of their numbers. The state of a
video is a few values, its held frames, and an entry for each track; a frame writes the entries of the tracks
that it changed. A video is at its end when the watermark is past its last frame by ``idle``: what its tracker
still held back comes out, and all of its state goes.

Results are those of ``track`` over all rows, in the same form. A row of a frame that is done comes out with
track id -2; Spark itself drops rows that the watermark has passed by then, and counts them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackmill.operators.tracking import COLUMNS, RESULT, Run
from trackmill.streaming.tracking_stream import LATE

#: Tasks can't keep the state of several keys in the default store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def taken_apart(run: Run) -> tuple[bytes, dict[tuple[str, int], bytes]]:
    """What a run holds: everything but its tracks, and each track by its tracker's table and its id."""
    rest, tracks = {}, {}
    for name, value in vars(run.tracker).items():
        if isinstance(value, dict) and all(isinstance(k, int) for k in value):
            tracks |= {(name, k): pickle.dumps(v) for k, v in value.items()}
            rest[name] = list(value)  # in the order of the table
        else:
            rest[name] = value
    tables = [n for n, v in vars(run.tracker).items() if isinstance(v, dict) and all(isinstance(k, int) for k in v)]
    return pickle.dumps((rest, tables, run.last, run.held)), tracks


def put_together(config: dict, rest: bytes, tracks: dict[tuple[str, int], bytes]) -> Run:
    run = Run(config)
    values, tables, run.last, run.held = pickle.loads(rest)
    for name, value in values.items():
        setattr(run.tracker, name, {k: pickle.loads(tracks[name, k]) for k in value} if name in tables else value)
    return run


class TrackProcessor(StatefulProcessor):
    def __init__(self, config: dict, idle_ms: int, time: str):
        self.config, self.idle, self.time = config, idle_ms, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = handle.getValueState("rest", "value binary, done long, latest long")
        self.tracks = handle.getMapState("tracks", "name string, id long", "value binary")
        self.frames = handle.getMapState("frames", "frame_id long", "value binary, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        rest, done, latest = self.rest.get() if self.rest.exists() else (b"", -1, -1)
        late = new[new["frame_id"] <= done]
        if len(late):
            yield late.assign(track_id=LATE)[NAMES]
        due = new[self.time].max().value // 1_000_000 + 1
        for frame, part in new[new["frame_id"] > done].groupby("frame_id"):
            at = int(part[self.time].max().value // 1_000_000) + 1
            if self.frames.containsKey((int(frame),)):
                held, before = self.frames.getValue((int(frame),))
                part, at = pd.concat([pickle.loads(held), part], ignore_index=True), max(at, before)
            self.frames.updateValue((int(frame),), (pickle.dumps(part), at))
            self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        latest = max(latest, int(due))
        self.rest.update((rest, done, latest))
        self.handle.registerTimer(latest + self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.rest.exists():
            return
        now = timerValues.getCurrentWatermarkInMs()
        rest, done, latest = self.rest.get()
        held = sorted((k[0], at) for k, (_, at) in self.frames.iterator())
        # the frames up to the last one that is due: later rows of those before would be late
        due = [frame for frame, _ in held[: max((i + 1 for i, (_, at) in enumerate(held) if at <= now), default=0)]]
        over = latest + self.idle <= now
        if not due and not over:
            return
        old = {(k[0], k[1]): v[0] for k, v in self.tracks.iterator()}
        run = put_together(self.config, rest, old) if rest else Run(self.config)
        out: list[pd.DataFrame] = []
        for frame in due:
            part, _ = self.frames.getValue((frame,))
            out += run.frame(frame, pickle.loads(part).sort_values("ord"), True)
            self.frames.removeKey((frame,))
            done = frame
        if over:
            out += run.close()
            self.rest.clear()
            self.tracks.clear()
            self.frames.clear()
        else:
            rest, new = taken_apart(run)
            for k in old.keys() - new.keys():
                self.tracks.removeKey(k)
            for k, v in new.items():
                if old.get(k) != v:
                    self.tracks.updateValue(k, (v,))
            self.rest.update((rest, done, latest))
        if out:
            yield pd.concat(out)[NAMES]

    def close(self) -> None:
        pass


def track_events(detections: DataFrame, config: dict, delay: str, idle_seconds: int, time: str = "ts") -> DataFrame:
    """``track`` for a streaming frame with event times: a frame is taken once the watermark (the latest time
    less ``delay``) has passed it, a video ends ``idle_seconds`` after its last frame. Needs the RocksDB
    store (``PROVIDER``) as the session's state store."""
    needed = detections.select(*COLUMNS, F.col(time).cast("timestamp").alias(time)).withWatermark(time, delay)
    processor = TrackProcessor(config, idle_seconds * 1000, time)
    return needed.groupBy("video_id").transformWithStateInPandas(processor, RESULT, "Append", "EventTime")
