"""The trackers over a stream of detections: state per video, whole frames, explicit late output.

Rows carry a frame-complete flag on the last detection of a frame. State is the pickled tracker, the
rows of frames not complete yet, and the last frame done; frame 0 starts a video anew. A row of a frame
that is done already comes out with track id -2, so that nothing is lost in silence.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackmill.operators.tracking import COLUMNS, RESULT, Run

LATE = -2
STATE = "tracker binary, pending binary, last long"


def track_stream(detections: DataFrame, config: dict) -> DataFrame:
    """Like ``track``, for a streaming frame with the column ``complete``. Frames that the tracker may
    still mend come out when later ones have settled them, the last ones when the video starts anew."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            raw, pending, last = state.get
            now, pending = pickle.loads(raw), pickle.loads(pending)
        else:
            now, pending, last = Run(config), [], -1
        rows = pd.concat([*pending, *batches], ignore_index=True)
        out, kept = [], []
        for frame, part in sorted(rows.groupby("frame_id"), key=lambda x: x[0]):
            if frame == 0 and last > 0 and part["complete"].any():
                out += now.close()
                now, last = Run(config), -1
            if frame <= last:
                out.append(part.assign(track_id=LATE))
            elif part["complete"].any():
                out += now.frame(int(frame), part.sort_values("ord"), True)
                last = int(frame)
            else:
                kept.append(part)
        state.update((pickle.dumps(now), pickle.dumps(kept), last))
        names = [c.split()[0] for c in RESULT.split(", ")]
        if out:
            yield pd.concat(out)[names]

    needed = detections.select(*COLUMNS, "complete")
    return needed.groupBy("video_id").applyInPandasWithState(update, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def screen_stream(events: DataFrame, gap_seconds: float, key: str = "user_id", time: str = "ts") -> DataFrame:
    """(key, previous, ts, gap) wherever a key is silent for longer than a gap, across micro-batches."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = pd.Timestamp(state.get[0]) if state.exists else None
        times = pd.concat(list(batches))[time].sort_values()
        rows = []
        for now in times:
            if before is not None and (now - before).total_seconds() > gap_seconds:
                rows.append((k[0], before, now, (now - before).total_seconds()))
            before = now if before is None else max(before, now)
        state.update((before.to_pydatetime(),))
        if rows:
            yield pd.DataFrame(rows, columns=["key", "previous", "ts", "gap"])

    schema = f"key {events.schema[key].dataType.simpleString()}, previous timestamp, ts timestamp, gap double"
    return events.select(key, time).groupBy(key).applyInPandasWithState(update, schema, "last timestamp", "append", GroupStateTimeout.NoTimeout)
