"""Trackers: one kernel per method, run over sorted frames in batch or from keyed state in streams.

A tracker's ``step`` takes one frame and gives each detection a track id, or -1; ``pause`` takes the frames
without detections between two steps. In batch, partitions are sorted by video and frame and streamed
through, so a task holds one tracker and a frame, or the few that the tracker may still mend, at a time,
however long a video is.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.operators import kernels as K
from trackmill.registry import build, operator


@dataclass
class Frame:
    frame_id: int
    boxes: np.ndarray
    scores: np.ndarray
    labels: np.ndarray
    embeds: np.ndarray

    def take(self, rows: np.ndarray) -> Frame:
        return Frame(self.frame_id, self.boxes[rows], self.scores[rows], self.labels[rows], self.embeds[rows])


@dataclass
class Track:
    box: np.ndarray
    label: int
    embed: np.ndarray
    frame: int
    score: float = 0.0
    hits: int = 1
    history: list = field(default_factory=list)
    motion: tuple | None = None


def moved(kalman: K.BoxKalman, tracks: Iterable[Track]) -> None:
    """The filters of many tracks predict, side by side."""
    tracks = list(tracks)
    if tracks:
        _filtered(tracks, kalman.predict(*_motions(tracks)))


def corrected(kalman: K.BoxKalman, tracks: list[Track], boxes: np.ndarray) -> None:
    """The filters of different tracks take in a box each."""
    if tracks:
        _filtered(tracks, kalman.update(*_motions(tracks), K.BoxKalman.measure(boxes)))


def begun(kalman: K.BoxKalman, tracks: list[Track], boxes: np.ndarray) -> None:
    """Filters of new tracks from a box each."""
    if tracks:
        _filtered(tracks, kalman.initiate(K.BoxKalman.measure(boxes)))


def _motions(tracks: list[Track]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([t.motion[0] for t in tracks]), np.array([t.motion[1] for t in tracks])


def _filtered(tracks: list[Track], states: tuple[np.ndarray, np.ndarray]) -> None:
    for t, mean, cov in zip(tracks, *states, strict=True):
        t.motion = mean, cov


def no_detections(frame_id: int) -> Frame:
    return Frame(frame_id, np.zeros((0, 4)), np.zeros(0), np.zeros(0, int), np.zeros((0, 1)))


class Tracker:
    """Ids from 0 in order of birth; ``step`` sees every frame with detections once, in order.

    After a step, ``fixes`` holds ids found late: (frames back, row in that frame's step, id), at most
    ``delay`` frames back."""

    delay = 0

    def __init__(self):
        self.tracks: dict[int, Track] = {}
        self.next_id = 0
        self.fixes: list[tuple[int, int, int]] = []

    def pause(self, frames: Iterable[int]) -> None:
        """Frames without detections, in order: they leave a memory as it is."""

    def born(self, f: Frame, i: int) -> int:
        self.tracks[self.next_id] = Track(f.boxes[i], int(f.labels[i]), f.embeds[i], f.frame_id, float(f.scores[i]))
        self.next_id += 1
        return self.next_id - 1

    def step(self, f: Frame) -> np.ndarray:
        raise NotImplementedError


@operator("memo")
class MemoTracker(Tracker):
    """Appearance matching against a memory of running means, greedily in detection order.

    method: inter (distractors of any class) or intra (of the same class, and only same-class matches,
    whose score is blended with the remembered one). metric: bisoftmax or cosine. ``motion_weight`` adds
    the overlap with boxes predicted by a Kalman filter; ``fusion`` weighs appearance by how surely
    detections come back to themselves through the memory; ``stable`` keeps large embeddings from
    overflowing.
    """

    def __init__(
        self, init_score=0.5, match_score=0.5, obj_score=0.3, memo_frames=10, momentum=0.8, method="inter", metric="bisoftmax", with_cosine=True, distractor_score=0.5,
        distractor_overlap=0.3, motion_weight=0.0, fusion=0.0, score_momentum=0.5, stable=False,
    ):
        super().__init__()
        self.init_score, self.match_score, self.obj_score = init_score, match_score, obj_score
        self.memo_frames, self.momentum, self.method, self.metric, self.with_cosine = memo_frames, momentum, method, metric, with_cosine
        self.distractor_score, self.distractor_overlap = distractor_score, distractor_overlap
        self.motion_weight, self.fusion, self.score_momentum, self.stable = motion_weight, fusion, score_momentum, stable
        self.kalman = K.BoxKalman()

    def _scores(self, f: Frame, memory: list[Track]) -> np.ndarray:
        embeds = np.stack([t.embed for t in memory])
        same = f.labels[:, None] == np.array([t.label for t in memory])[None]
        cos = K.cosine_matrix(f.embeds, embeds)
        if self.metric == "cosine":
            scores = cos * same
        else:
            dot = f.embeds @ embeds.T
            scores = K.bi_softmax_matrix(dot, same if self.method == "intra" else None, self.stable)
            if self.with_cosine:
                scores = (scores + (cos * same if self.method == "intra" else cos)) / 2
        if self.fusion:
            sure = K.cycle_confidence(cos)[:, None]
            ratio = self.fusion * (1 - sure) ** 2
            scores = (scores + ratio * same * scores) / (1 + ratio)
        if self.motion_weight:
            boxes = K.BoxKalman.box(np.array([t.motion[0] for t in memory]))
            scores = (1 - self.motion_weight) * scores + self.motion_weight * K.iou_matrix(f.boxes, boxes)
        return scores

    def _filter(self, g: Frame, found: np.ndarray, times: int = 1) -> None:
        """The detections go into their tracks' filters, or begin them; each track has one at most."""
        rows = np.flatnonzero(found >= 0)
        tracks = [self.tracks[k] for k in found[rows].tolist()]
        new = np.array([t.motion is None for t in tracks], bool)
        begun(self.kalman, [t for t in tracks if t.motion is None], g.boxes[rows[new]])
        for _ in range(times):
            corrected(self.kalman, [t for t, fresh in zip(tracks, new.tolist(), strict=True) if not fresh], g.boxes[rows[~new]])

    def step(self, f: Frame) -> np.ndarray:
        ids = np.full(len(f.scores), -1)
        kept = np.flatnonzero(K.without_distractors(f.boxes, f.scores, f.labels, self.distractor_score, self.distractor_overlap, self.method == "intra"))
        g = f.take(kept)
        if self.motion_weight:
            moved(self.kalman, self.tracks.values())
        found = np.full(len(kept), -1)
        if len(kept) and self.tracks:
            names, memory = list(self.tracks), list(self.tracks.values())
            hit = K.greedy_match(self._scores(g, memory), self.match_score, g.scores >= self.obj_score)
            found[hit >= 0] = np.array(names)[hit[hit >= 0]]
            if self.method == "intra":
                for i in np.flatnonzero(hit >= 0):
                    g.scores[i] = self.score_momentum * g.scores[i] + (1 - self.score_momentum) * memory[hit[i]].score
        for i in range(len(kept)):
            if found[i] >= 0:
                t = self.tracks[found[i]]
                t.box, t.label, t.frame, t.score, t.hits = g.boxes[i], int(g.labels[i]), f.frame_id, float(g.scores[i]), t.hits + 1
                t.embed = (1 - self.momentum) * t.embed + self.momentum * g.embeds[i]
            elif g.scores[i] > self.init_score:
                found[i] = self.born(g, i)
        if self.motion_weight:
            self._filter(g, found)
        self.tracks = {k: t for k, t in self.tracks.items() if f.frame_id - t.frame < self.memo_frames}
        ids[kept] = found
        return ids


@operator("sort")
class SortTracker(Tracker):
    """Appearance within a motion gate for confirmed tracks, then overlap for those just seen.

    A track is tentative until it has three boxes, and dies if it misses a frame before."""

    def __init__(self, score=0.5, match_distance=2.0, match_iou=0.7, num_samples=10, tentative=3, max_gap=100):
        super().__init__()
        self.score, self.match_distance, self.match_iou = score, match_distance, match_iou
        self.num_samples, self.tentative, self.max_gap = num_samples, tentative, max_gap
        self.kalman = K.BoxKalman()

    def pause(self, frames: Iterable[int]) -> None:
        """Tracks that may not miss a frame die, and others in time; nothing moves."""
        for frame_id in frames:
            if not self.tracks:
                return
            self.step(no_detections(frame_id))

    def _hit(self, f: Frame, i: int, k: int) -> None:
        t = self.tracks[k]
        t.box, t.label, t.frame, t.hits = f.boxes[i], int(f.labels[i]), f.frame_id, t.hits + 1
        t.history = [*t.history, f.embeds[i]][-self.num_samples :]

    def _means(self, tracks: list[int]) -> np.ndarray:
        """The mean of each track's remembered embeddings."""
        held = [self.tracks[k].history for k in tracks]
        size = np.array([len(h) for h in held])
        out = np.zeros((len(held), len(held[0][0])))
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            out[at] = np.array([held[i] for i in at]).mean(1)
        return out

    def step(self, f: Frame) -> np.ndarray:
        ids = np.full(len(f.scores), -1)
        kept = np.flatnonzero(f.scores > self.score)
        if len(kept):
            moved(self.kalman, self.tracks.values())
        sure = [k for k, t in self.tracks.items() if t.hits >= self.tentative]
        if len(kept) and sure:
            cost = np.sqrt(((self._means(sure)[:, None] - f.embeds[kept][None]) ** 2).sum(-1))
            cost[self.kalman.gating_matrix(*_motions([self.tracks[k] for k in sure]), K.BoxKalman.measure(f.boxes[kept])) > K.BoxKalman.gate()] = np.inf
            for r, c in K.assign(cost, self.match_distance):
                ids[kept[c]] = sure[r]
        seen = set(ids.tolist())
        recent = [k for k, t in self.tracks.items() if t.frame == f.frame_id - 1 and k not in seen]
        left = np.array([i for i in kept if ids[i] < 0], int)
        if len(left) and recent:
            cost = 1 - K.iou_matrix(np.stack([self.tracks[k].box for k in recent]), f.boxes[left])
            for r, c in K.assign(cost):
                if cost[r, c] < 1 - self.match_iou:
                    ids[left[c]] = recent[r]
        hit, new = kept[ids[kept] >= 0], kept[ids[kept] < 0]
        for i in hit:
            self._hit(f, i, ids[i])
        for i in new:
            ids[i] = self.born(f, i)
            self.tracks[ids[i]].history = [f.embeds[i]]
        corrected(self.kalman, [self.tracks[k] for k in ids[hit].tolist()], f.boxes[hit])
        begun(self.kalman, [self.tracks[k] for k in ids[new].tolist()], f.boxes[new])
        alive = lambda t: t.frame == f.frame_id or (t.hits >= self.tentative and f.frame_id - t.frame < self.max_gap)
        self.tracks = {k: t for k, t in self.tracks.items() if alive(t)}
        return ids


@operator("blend")
class BlendTracker(MemoTracker):
    """Appearance and predicted overlap blended into one distance, solved for the least total.

    With ``compat`` a matched track's mean and filter take its detection in twice."""

    def __init__(self, match_distance=0.5, motion_weight=0.4, compat=False, **options):
        super().__init__(motion_weight=motion_weight, **options)
        self.match_distance, self.times = match_distance, 2 if compat else 1

    def step(self, f: Frame) -> np.ndarray:
        ids = np.full(len(f.scores), -1)
        kept = np.flatnonzero(K.without_distractors(f.boxes, f.scores, f.labels, self.distractor_score, self.distractor_overlap))
        g = f.take(kept)
        moved(self.kalman, self.tracks.values())
        found = np.full(len(kept), -1)
        if len(kept) and self.tracks:
            names, memory = list(self.tracks), list(self.tracks.values())
            embeds = np.stack([t.embed for t in memory])
            look = (K.bi_softmax_matrix(g.embeds @ embeds.T, stable=self.stable) + (1 + K.cosine_matrix(g.embeds, embeds)) / 2) / 2
            boxes = K.BoxKalman.box(np.array([t.motion[0] for t in memory]))
            score = (1 - self.motion_weight) * look + self.motion_weight * K.iou_matrix(g.boxes, boxes)
            for i, j in K.assign(1 - score, self.match_distance):
                found[i] = names[j]
        for i in range(len(kept)):
            if found[i] >= 0:
                t = self.tracks[found[i]]
                t.box, t.label, t.frame, t.hits = g.boxes[i], int(g.labels[i]), f.frame_id, t.hits + 1
                for _ in range(self.times):
                    t.embed = (1 - self.momentum) * t.embed + self.momentum * g.embeds[i]
            elif g.scores[i] > self.init_score:
                found[i] = self.born(g, i)
        self._filter(g, found, self.times)
        self.tracks = {k: t for k, t in self.tracks.items() if f.frame_id - t.frame < self.memo_frames}
        ids[kept] = found
        return ids


class _Observed:
    """A track of the hybrid tracker: a score-aware filter, its observations, and corner velocities."""

    CORNERS = ((0, 1), (0, 3), (2, 1), (2, 3))

    def __init__(self, box, score, embed, label, steps):
        self.filter = K.ScoreKalman(K.ScoreKalman.measure(box, score))
        self.steps, self.label, self.embed = steps, label, K.unit_rows(embed)
        self.age = self.since = self.streak = 0
        self.last: np.ndarray | None = None
        self.seen: dict[int, np.ndarray] = {}
        self.velocity = np.zeros((4, 2))
        self.score, self.before = score, None

    def predict(self) -> float:
        """A step on; the last score moved on by its last change. The filter is predicted with all others."""
        self.age += 1
        if self.since:
            self.streak = 0
        self.since += 1
        return float(self.score if not self.before else 2 * self.score - self.before)

    def reference(self) -> np.ndarray | None:
        """The observation some steps back: the oldest within reach, else the newest."""
        for back in range(self.steps, 0, -1):
            if self.age - back in self.seen:
                return self.seen[self.age - back]
        return self.last

    def missed(self) -> None:
        self.filter.update(None)
        self.before = None

    @classmethod
    def turned(cls, tracks: list, boxes: np.ndarray) -> None:
        """The velocities of tracks seen before: the sum of the directions from their last few boxes."""
        near = [[t.seen[t.age - k] for k in range(1, t.steps + 1) if t.age - k in t.seen] or [t.last] for t in tracks]
        most = max(map(len, near), default=0)
        if not most:
            return
        held = np.array([[*n, *[n[0]] * (most - len(n))] for n in near])
        real = np.arange(most)[None] < np.array([len(n) for n in near])[:, None]
        moves = np.where(real[..., None, None], cls.directions(held, boxes[:, None]), 0.0).sum(1)
        for t, velocity in zip(tracks, moves, strict=True):
            t.velocity = velocity

    @classmethod
    def found(cls, tracks: list, boxes: np.ndarray, scores: np.ndarray, embeds: np.ndarray | None = None) -> None:
        """Different tracks take in a box each."""
        if not tracks:
            return
        before = [i for i, t in enumerate(tracks) if t.last is not None]
        cls.turned([tracks[i] for i in before], boxes[before])
        K.ScoreKalman.update_all([t.filter for t in tracks], np.array([K.ScoreKalman.measure(b, s) for b, s in zip(boxes, scores, strict=True)]))
        if embeds is not None:
            looks = K.unit_rows(0.8 * np.array([t.embed for t in tracks]) + 0.2 * K.unit_rows(embeds))
        for i, t in enumerate(tracks):
            t.last = t.seen[t.age] = boxes[i]
            t.seen = {k: b for k, b in t.seen.items() if k >= t.age - t.steps}
            t.since, t.streak = 0, t.streak + 1
            if embeds is not None:
                t.embed = looks[i]
            t.before, t.score = t.score, scores[i]

    @classmethod
    def directions(cls, a, b) -> np.ndarray:
        """Unit vectors (dy, dx) of the four corners from each row of a to that of b."""
        a, b = np.asarray(a), np.asarray(b)
        out = np.stack([np.stack([b[..., y] - a[..., y], b[..., x] - a[..., x]], -1) for x, y in cls.CORNERS], -2)
        return out / (np.sqrt((out * out).sum(-1, keepdims=True)) + 1e-6)


@operator("hybrid_sort")
class HybridTracker(Tracker):
    """Three rounds: strong detections by overlap, corner directions, score and appearance; weak ones by
    overlap and score; what is left by the last observations.

    A score equal to ``det_thresh`` falls in neither band. Births take the detection's own class."""

    def __init__(self, det_thresh=0.6, low_thresh=1e-4, iou=0.15, inertia=0.05, max_age=30, min_hits=3, steps=3, score_weight=1.0, look=4.0, look_low=4.4):
        super().__init__()
        self.det_thresh, self.low_thresh, self.iou, self.inertia = det_thresh, low_thresh, iou, inertia
        self.max_age, self.min_hits, self.steps = max_age, min_hits, steps
        self.score_weight, self.look, self.look_low = score_weight, look, look_low
        self.live: dict[int, _Observed] = {}
        self.frames = 0

    def pause(self, frames: Iterable[int]) -> None:
        """Tracks move on, and die in time."""
        for frame_id in frames:
            if not self.live:
                self.frames += 1
            else:
                self.step(no_detections(frame_id))

    def _predicted(self) -> dict[int, tuple]:
        """The prediction of each live track; tracks without a finite one are dropped."""
        if not self.live:
            return {}
        states = K.ScoreKalman.predict_all([t.filter for t in self.live.values()])
        boxes = K.ScoreKalman.boxes(states)
        found = {k: (box, float(x[3]), t.predict()) for (k, t), box, x in zip(self.live.items(), boxes, states, strict=True)}
        for k in [k for k, p in found.items() if not np.isfinite(p[0]).all()]:
            del self.live[k], found[k]
        return found

    def _turn(self, boxes: np.ndarray, scores: np.ndarray, tracks: list[int]) -> np.ndarray:
        """The agreement of each move from a track's reference with its corner velocities."""
        out = np.zeros((len(boxes), len(tracks)))
        refs = [self.live[k].reference() for k in tracks]
        known = [j for j, ref in enumerate(refs) if ref is not None]
        if known:
            velocity = np.array([self.live[tracks[j]].velocity for j in known])
            cos = np.clip((_Observed.directions(np.array([refs[j] for j in known]), boxes[:, None]) * velocity).sum(-1), -1, 1)
            out[:, known] = ((np.pi / 2 - np.abs(np.arccos(cos))) / np.pi).sum(-1) * self.inertia * scores[:, None]
        return out

    def step(self, f: Frame) -> np.ndarray:
        ids = np.full(len(f.scores), -1)
        self.frames += 1
        kept = np.flatnonzero(K.without_distractors(f.boxes, f.scores, f.labels))
        g = f.take(kept)
        scores = g.scores / g.scores.max() if len(kept) and g.scores.max() > 0 else g.scores
        high, low = np.flatnonzero(scores > self.det_thresh), np.flatnonzero((scores > self.low_thresh) & (scores < self.det_thresh))
        predicted = self._predicted()
        tracks = list(self.live)
        owner = np.full(len(kept), -1)
        boxes = np.array([predicted[k][0] for k in tracks]).reshape(-1, 4)
        rest, free = high, tracks
        if len(high) and tracks:
            expect = np.clip([predicted[k][1] for k in tracks], self.det_thresh, 1.0)
            overlap = K.height_iou_matrix(g.boxes[high], boxes)
            gap = np.abs(scores[high][:, None] - expect[None]) * self.score_weight
            far = np.maximum(0, 1 - K.cosine_matrix(g.embeds[high], np.stack([self.live[k].embed for k in tracks])))
            cost = -(overlap + self._turn(g.boxes[high], scores[high], tracks) - gap) + self.look * far
            pairs, left, unseen = K.associate(overlap - gap, self.iou, cost)
            rows = high[pairs[:, 0]]
            owner[rows] = [tracks[j] for j in pairs[:, 1]]
            _Observed.found([self.live[k] for k in owner[rows].tolist()], g.boxes[rows], scores[rows], g.embeds[rows])
            rest, free = high[left], [tracks[j] for j in unseen]
        if len(low) and free:
            at = [tracks.index(k) for k in free]
            expect = np.clip([predicted[k][2] for k in free], 0.1, self.det_thresh)
            overlap = K.height_iou_matrix(g.boxes[low], boxes[at])
            if overlap.max() > self.iou:
                gain = overlap - np.abs(scores[low][:, None] - expect[None]) * self.score_weight
                far = np.maximum(0, 1 - K.cosine_matrix(g.embeds[low], np.stack([self.live[k].embed for k in free])))
                free = self._take(g, scores, low, free, K.assign(-gain + self.look_low * far), gain, owner)
        known = [k for k in free if self.live[k].last is not None]
        if len(rest) and known:
            gain = K.height_iou_matrix(g.boxes[rest], np.stack([self.live[k].last for k in known]))
            if gain.max() > self.iou:
                still = self._take(g, scores, rest, known, K.assign(-gain), gain, owner)
                free = [k for k in free if k not in known or k in still]
                rest = rest[owner[rest] < 0]
        for k in free:
            self.live[k].missed()
        for i in rest:
            self.live[self.next_id] = _Observed(g.boxes[i], scores[i], g.embeds[i], int(g.labels[i]), self.steps)
            owner[i] = self.next_id
            self.next_id += 1
        for i, k in enumerate(owner.tolist()):
            if k >= 0 and self.live[k].since < 1 and (self.live[k].streak >= self.min_hits or self.frames <= self.min_hits):
                ids[kept[i]] = k + 1
        self.live = {k: t for k, t in self.live.items() if t.since <= self.max_age}
        return ids

    def _take(self, g, scores, rows, tracks, pairs, gain, owner) -> list[int]:
        """Apply matches from the threshold up; the tracks still free."""
        pairs = pairs[gain[pairs[:, 0], pairs[:, 1]] >= self.iou]
        taken, gone = rows[pairs[:, 0]], [tracks[j] for j in pairs[:, 1]]
        owner[taken] = gone
        _Observed.found([self.live[k] for k in gone], g.boxes[taken], scores[taken])
        return [k for k in tracks if k not in set(gone)]


class _Centred(_Observed):
    """A track whose direction is that of its centre; it remembers in which rows it was last seen."""

    def __init__(self, box, embed, label, steps):
        super().__init__(box, 1.0, embed, label, steps)
        self.velocity = np.zeros(2)
        self.rows: list[int] = []

    @classmethod
    def directions(cls, a, b) -> np.ndarray:
        """The unit vector (dy, dx) of the centre from each row of a to that of b."""
        a, b = np.asarray(a), np.asarray(b)
        move = np.stack([b[..., 1] + b[..., 3] - a[..., 1] - a[..., 3], b[..., 0] + b[..., 2] - a[..., 0] - a[..., 2]], -1) / 2
        return move / (np.sqrt((move * move).sum(-1, keepdims=True)) + 1e-6)

    @classmethod
    def turned(cls, tracks: list, boxes: np.ndarray) -> None:
        """The velocities of tracks seen before: the direction from the reference."""
        if tracks:
            for t, velocity in zip(tracks, cls.directions(np.array([t.reference() for t in tracks]), boxes), strict=True):
                t.velocity = velocity

    @classmethod
    def seen_in(cls, tracks: list, rows: list[int], boxes: np.ndarray, keep: int) -> None:
        cls.found(tracks, boxes, np.ones(len(rows)))
        for t, row in zip(tracks, rows, strict=True):
            t.rows = [*t.rows, row][-keep:]


@operator("hybrid_sort_public")
class PublicTracker(HybridTracker):
    """For given detections: two rounds among pairs of one class, by overlap and the direction of the
    centre, then by the last observations. A track that has its ``min_hits``-th box in a row is followed
    back over the boxes before it, which were held back until then."""

    def __init__(self, min_hits=3, **options):
        super().__init__(min_hits=min_hits, **options)
        self.delay = max(0, min_hits - 1)

    def _same(self, gain: np.ndarray, labels: np.ndarray, tracks: list[int]) -> np.ndarray:
        return np.where(labels[:, None] == np.array([self.live[k].label for k in tracks])[None], gain, -K.BIG)

    def _heading(self, boxes: np.ndarray, tracks: list[int]) -> np.ndarray:
        out = np.zeros((len(boxes), len(tracks)))
        refs = [self.live[k].reference() for k in tracks]
        known = [j for j, ref in enumerate(refs) if ref is not None]
        if known:
            velocity = np.array([self.live[tracks[j]].velocity for j in known])
            cos = np.clip((_Centred.directions(np.array([refs[j] for j in known]), boxes[:, None]) * velocity).sum(-1), -1, 1)
            out[:, known] = (np.pi / 2 - np.abs(np.arccos(cos))) / np.pi * self.inertia
        return out

    def step(self, f: Frame) -> np.ndarray:
        self.frames += 1
        self.fixes = []
        ids = np.full(len(f.scores), -1)
        rows = np.flatnonzero(f.scores > self.det_thresh)
        predicted = self._predicted()
        tracks = list(self.live)
        owner: dict[int, int] = {}
        rest, free = rows, tracks
        if len(rows) and tracks:
            boxes, labels = f.boxes[rows], f.labels[rows]
            gain = self._same(K.iou_matrix(boxes, np.array([predicted[k][0] for k in tracks])), labels, tracks)
            pairs, left, unseen = K.associate(gain, self.iou, -(gain + self._heading(boxes, tracks)))
            owner = {int(rows[i]): tracks[j] for i, j in pairs}
            rest, free = rows[left], [tracks[j] for j in unseen]
        known = [k for k in free if self.live[k].last is not None]
        if len(rest) and known:
            gain = self._same(K.height_iou_matrix(f.boxes[rest], np.stack([self.live[k].last for k in known])), f.labels[rest], known)
            if gain.max() > self.iou - 0.1:
                again = {int(rest[i]): known[j] for i, j in K.assign(-gain) if gain[i, j] >= self.iou - 0.1}
                owner |= again
                rest = np.array([i for i in rest.tolist() if i not in again], int)
        _Centred.seen_in([self.live[k] for k in owner.values()], list(owner), f.boxes[list(owner)], self.min_hits)
        for i in rest.tolist():
            self.live[self.next_id] = _Centred(f.boxes[i], f.embeds[i], int(f.labels[i]), self.steps)
            owner[i] = self.next_id
            self.next_id += 1
        for i, k in owner.items():
            t = self.live[k]
            if self.frames <= self.min_hits or t.streak >= self.min_hits:
                ids[i] = k + 1
            if t.streak == self.min_hits and t.rows:
                self.fixes += [(back, t.rows[-1 - back], k + 1) for back in range(1, self.min_hits)]
        self.live = {k: t for k, t in self.live.items() if t.since <= self.max_age}
        return ids


COLUMNS = ["video_id", "frame_id", "ord", "category_id", "x1", "y1", "x2", "y2", "score", "embedding"]
RESULT = "video_id long, frame_id long, ord long, track_id long, category_id long, x1 double, y1 double, x2 double, y2 double, score double"


def frame_of(rows: pd.DataFrame) -> Frame:
    embeds = np.stack(rows["embedding"].to_numpy()).astype(float)
    return Frame(int(rows["frame_id"].iloc[0]), rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["score"].to_numpy(float).copy(), rows["category_id"].to_numpy(int), embeds)


OUT = ["video_id", "frame_id", "ord", "track_id", "category_id", "x1", "y1", "x2", "y2", "score"]


def tracked(rows: pd.DataFrame, tracker: Tracker) -> pd.DataFrame:
    """One frame's rows with their track ids."""
    ids = tracker.step(frame_of(rows))
    return rows.assign(track_id=ids)[OUT]


class Run:
    """A tracker over the frames of one video, and the results that it may still mend."""

    def __init__(self, config: dict):
        self.tracker = build(config)
        self.last: int | None = None
        self.held: deque[pd.DataFrame | None] = deque()

    def frame(self, frame_id: int, rows: pd.DataFrame | None, fill: bool) -> list[pd.DataFrame]:
        """The next frame's detections, if any; results that are final. With ``fill`` the frame numbers
        left out since the last frame count as frames without detections."""
        missing = range(self.last + 1, frame_id) if fill and self.last is not None else ()
        out = self._empty(missing)
        self.last = frame_id
        if rows is None:
            return out + self._empty([frame_id])
        self.held.append(tracked(rows, self.tracker))
        for back, row, name in self.tracker.fixes:
            before = self.held[-1 - back]
            before.iloc[row, OUT.index("track_id")] = name
        return out + self._final(self.tracker.delay)

    def _empty(self, frames) -> list[pd.DataFrame]:
        if not len(frames):
            return []
        self.tracker.pause(frames)
        self.held += [None] * min(len(frames), self.tracker.delay)
        return self._final(self.tracker.delay)

    def _final(self, keep: int) -> list[pd.DataFrame]:
        out = []
        while len(self.held) > keep:
            rows = self.held.popleft()
            if rows is not None:
                out.append(rows)
        return out

    def close(self) -> list[pd.DataFrame]:
        return self._final(0)


def frames_of(batch: pd.DataFrame, keys: list[str]) -> list[pd.DataFrame]:
    """The consecutive pieces of a sorted batch with equal keys, as views."""
    if not len(batch):
        return []
    new = np.zeros(len(batch) - 1, bool)
    for k in keys:
        v = batch[k].to_numpy()
        new |= v[1:] != v[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
    return [batch.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def track(detections: DataFrame, config: dict, frames: DataFrame | None = None) -> DataFrame:
    """All detections with track ids, a tracker per video; -1 where none was given.

    ``frames`` (video_id, frame_id) names all frames, those without detections too. Without it every
    number between a video's first and last frame is one."""
    fill = frames is None
    rows = detections.select(*COLUMNS, F.lit(True).alias("real"))
    if frames is not None:
        empty = frames.select("video_id", "frame_id").distinct().join(rows.select("video_id", "frame_id"), ["video_id", "frame_id"], "left_anti")
        blank = [F.lit(-1 if c in ("ord", "category_id") else None).cast(detections.schema[c].dataType).alias(c) for c in COLUMNS[2:]]
        rows = rows.unionByName(empty.select("video_id", "frame_id", *blank, F.lit(False).alias("real")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, video, held = None, None, None
        for batch in chain(batches, [None]):
            if batch is not None:
                batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
                parts = frames_of(batch, ["video_id", "frame_id"])
                held = parts.pop() if parts else None  # the last frame may go on in the next batch
            else:
                parts = [held] if held is not None and len(held) else []
            out = []
            for part in parts:
                if part["video_id"].iloc[0] != video:
                    out += now.close() if now else []
                    now, video = Run(config), part["video_id"].iloc[0]
                out += now.frame(int(part["frame_id"].iloc[0]), part if part["real"].iloc[0] else None, fill)
            if batch is None and now:
                out += now.close()
            if out:
                yield pd.concat(out)

    return rows.repartition("video_id").sortWithinPartitions("video_id", "frame_id", "ord").mapInPandas(run, RESULT)
