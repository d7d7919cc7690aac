"""Numeric kernels for one frame or one track, in NumPy; they know nothing of Spark.

Boxes are rows of corners (x1, y1, x2, y2). All results are independent of the machine.
"""

from __future__ import annotations

import numpy as np

from trackmill.functions.vectors import CHI2_95

BIG = 1e9


def iou_matrix(a: np.ndarray, b: np.ndarray, over: str = "union") -> np.ndarray:
    """Overlap of every pair; over: union, or first (the share of a's area). Zero areas give 0."""
    a, b = a[:, None, :4], b[None, :, :4]
    wh = np.clip(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0, None)
    inter = wh[..., 0] * wh[..., 1]
    area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    base = area(a) + area(b) - inter if over == "union" else np.broadcast_to(area(a), inter.shape)
    return np.divide(inter, base, out=np.zeros_like(inter), where=base > 0)


def height_iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU times the ratio of vertical overlap to vertical hull."""
    p, q = a[:, None, :4], b[None, :, :4]
    overlap = np.minimum(p[..., 3], q[..., 3]) - np.maximum(p[..., 1], q[..., 1])
    span = np.maximum(p[..., 3], q[..., 3]) - np.minimum(p[..., 1], q[..., 1])
    return np.divide(overlap, span, out=np.zeros_like(span), where=span > 0) * iou_matrix(a, b)


def unit_rows(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def cosine_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return unit_rows(a) @ unit_rows(b).T


def bi_softmax_matrix(s: np.ndarray, same: np.ndarray | None = None, stable: bool = False) -> np.ndarray:
    """``stable`` takes the largest score off first, so that none overflows."""
    if stable and s.size:
        s = s - s.max()
    e = np.exp(s) if same is None else np.exp(s) * same
    return (e / (e.sum(1, keepdims=True) + 1e-6) + e / (e.sum(0, keepdims=True) + 1e-6)) / 2


def cycle_confidence(s: np.ndarray) -> np.ndarray:
    """For each row how surely it comes back to itself through the columns."""
    n, m = s.shape
    soft = lambda x: np.exp(x - x.max(1, keepdims=True)) / np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)
    return (soft(s * 10 * np.log(m)) * soft(s.T * 10 * np.log(n)).T).sum(1)


def assign(cost: np.ndarray, limit: float | None = None) -> np.ndarray:
    """The matching of least total cost, as rows (i, j) by i; infinite pairs, and pairs above a limit,
    are left out. Shortest augmenting paths with potentials."""
    n, m = cost.shape
    if not n or not m:
        return np.zeros((0, 2), int)
    if n > m:
        out = assign(cost.T, limit)[:, ::-1]
        return out[np.argsort(out[:, 0])]
    c = np.where(np.isfinite(cost), cost, BIG)
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # of each column, 1-based; 0: free
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, via = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        done = np.zeros(m + 1, bool)
        while owner[j0]:
            done[j0] = True
            row = owner[j0]
            reach = c[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (reach < least[1:])
            least[1:][better], via[1:][better] = reach[better], j0
            j1 = 1 + int(np.where(done[1:], np.inf, least[1:]).argmin())
            delta = least[j1]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j0 = j1
        while j0:
            owner[j0], j0 = owner[via[j0]], via[j0]
    j = np.flatnonzero(owner[1:])
    pairs = np.stack([owner[1:][j] - 1, j], axis=1)
    pairs = pairs[np.argsort(pairs[:, 0])]
    value = cost[pairs[:, 0], pairs[:, 1]]
    return pairs[np.isfinite(value) & (True if limit is None else value <= limit)]


def associate(gain: np.ndarray, threshold: float, cost: np.ndarray | None = None, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matches, unmatched rows, unmatched columns). Where the pairs over the threshold already are one
    to one they are taken without solving; a match below the threshold (in ``check``) is undone."""
    n, m = gain.shape
    over = gain > threshold
    if min(n, m) and over.sum(1).max() == 1 and over.sum(0).max() == 1:
        pairs = np.argwhere(over)
    else:
        pairs = assign(-gain if cost is None else cost)
    check = gain if check is None else check
    pairs = pairs[check[pairs[:, 0], pairs[:, 1]] >= threshold] if len(pairs) else pairs.reshape(0, 2)
    return pairs, np.setdiff1d(np.arange(n), pairs[:, 0]), np.setdiff1d(np.arange(m), pairs[:, 1])


def greedy_match(score: np.ndarray, threshold: float, allowed: np.ndarray | None = None) -> np.ndarray:
    """For each row in order its best column over the threshold, or -1; a column taken is worth 0 to
    all other rows. The threshold must not be negative."""
    if threshold < 0:
        raise ValueError("a negative threshold could match a column twice")
    left = score.copy()
    out = np.full(len(score), -1)
    for i in range(len(score)):
        if not left.shape[1] or (allowed is not None and not allowed[i]):
            continue
        j = int(left[i].argmax())
        if left[i, j] > threshold:
            out[i] = j
            keep = left[i, j]
            left[:, j] = 0
            left[i, j] = keep
    return out


def greedy_nms(boxes: np.ndarray, scores: np.ndarray, threshold: float, classes: np.ndarray | None = None) -> np.ndarray:
    """Indices kept, best first: a box goes if it overlaps a kept one (of its class) by more."""
    order = np.lexsort((np.arange(len(scores)), -scores))
    overlap = iou_matrix(boxes, boxes) > threshold
    if classes is not None:
        overlap &= classes[:, None] == classes[None, :]
    kept: list[int] = []
    gone = np.zeros(len(scores), bool)
    for i in order.tolist():
        if not gone[i]:
            kept.append(i)
            gone |= overlap[i]
    return np.array(kept, int)


def without_distractors(boxes: np.ndarray, scores: np.ndarray, labels: np.ndarray, score_limit: float = 0.5, overlap: float = 0.3, same_class: bool = False) -> np.ndarray:
    """Mask of rows to keep: a low score goes if any row before it, kept or not, overlaps it."""
    m = np.tril(iou_matrix(boxes, boxes) > overlap, -1)
    if same_class:
        m &= labels[:, None] == labels[None, :]
    return ~((scores < score_limit) & m.any(1))


def _diagonal(d: np.ndarray) -> np.ndarray:
    return d[..., None] * np.eye(d.shape[-1])


def _turned(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


class BoxKalman:
    """Constant velocity over (cx, cy, w / h, h); noise in proportion to the height. All take one state
    or, with a leading axis, many."""

    POSITION, VELOCITY = 1 / 20, 1 / 160

    def __init__(self):
        self.move = np.eye(8) + np.eye(8, k=4)

    @staticmethod
    def measure(box: np.ndarray) -> np.ndarray:
        x1, y1, x2, y2 = np.moveaxis(np.asarray(box, float), -1, 0)
        h = y2 - y1
        return np.stack([(x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / np.maximum(h, 1e-9), h], -1)

    @staticmethod
    def box(mean: np.ndarray) -> np.ndarray:
        cx, cy, ratio, h = np.moveaxis(mean, -1, 0)[:4]
        return np.stack([cx - ratio * h / 2, cy - h / 2, cx + ratio * h / 2, cy + h / 2], -1)

    def _spread(self, h: np.ndarray, position: float, velocity: float, ratio: float, turn: float) -> np.ndarray:
        p, v, one = position * self.POSITION * h, velocity * self.VELOCITY * h, np.ones_like(h)
        return _diagonal(np.stack([p, p, ratio * one, p, v, v, turn * one, v], -1) ** 2)

    def initiate(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([z, np.zeros_like(z)], -1), self._spread(z[..., 3], 2, 10, 1e-2, 1e-5)

    def predict(self, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mean @ self.move.T, self.move @ cov @ self.move.T + self._spread(mean[..., 3], 1, 1, 1e-2, 1e-5)

    def project(self, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.POSITION * mean[..., 3]
        return mean[..., :4], cov[..., :4, :4] + _diagonal(np.stack([p, p, 1e-1 * np.ones_like(p), p], -1) ** 2)

    def update(self, mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen, s = self.project(mean, cov)
        gain = _turned(np.linalg.solve(s, cov[..., :4, :]))
        return mean + (gain @ (z - seen)[..., None])[..., 0], cov - gain @ s @ _turned(gain)

    def gating(self, mean: np.ndarray, cov: np.ndarray, z: np.ndarray, position_only: bool = False) -> np.ndarray:
        """Squared Mahalanobis distance of each measurement from one state, or of each from its own."""
        seen, s = self.project(mean, cov)
        if position_only:
            seen, s, z = seen[..., :2], s[..., :2, :2], z[..., :2]
        off = (z - seen)[..., None]
        return (off * np.linalg.solve(np.broadcast_to(s, (*off.shape[:-2], *s.shape[-2:])), off)).sum((-1, -2))

    def gating_matrix(self, means: np.ndarray, covs: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The distance of each measurement (columns) from each state (rows)."""
        seen, s = self.project(means, covs)
        off = _turned(z[None] - seen[:, None])
        return (off * np.linalg.solve(s, off)).sum(1)

    @staticmethod
    def gate(position_only: bool = False) -> float:
        return CHI2_95[2 if position_only else 4]


class ScoreKalman:
    """(cx, cy, area, score, w / h) and velocities of the first four; after a gap the time without
    observations is replayed along a straight line between the two that bound it."""

    def __init__(self, z: np.ndarray):
        self.x = np.r_[z, np.zeros(4)]
        self.f, self.h = np.eye(9), np.eye(5, 9)
        self.f[[0, 1, 2, 3], [5, 6, 7, 8]] = 1
        self.r = np.diag([1, 1, 10, 10, 10.0])
        self.p = np.diag([10.0] * 5 + [10_000.0] * 4)
        self.q = np.diag([1.0] * 5 + [0.01, 0.01, 1e-4, 1e-4])
        self.saved: tuple[np.ndarray, np.ndarray] | None = None
        self.last, self.missed = z, 0

    def predict(self) -> np.ndarray:
        if self.x[7] + self.x[2] <= 0:
            self.x[7] = 0
        self.x = self.f @ self.x
        self.p = self.f @ self.p @ self.f.T + self.q
        return self.x

    def _correct(self, z: np.ndarray) -> None:
        s = self.h @ self.p @ self.h.T + self.r
        gain = np.linalg.solve(s, self.h @ self.p).T
        self.x = self.x + gain @ (z - self.h @ self.x)
        rest = np.eye(9) - gain @ self.h
        self.p = rest @ self.p @ rest.T + gain @ self.r @ gain.T

    def update(self, z: np.ndarray | None) -> None:
        if z is None:
            if not self.missed:
                self.saved = self.x.copy(), self.p.copy()
            self.missed += 1
            return
        if self.missed and self.saved:
            self.x, self.p = self.saved
            gap = self.missed + 1
            for k in range(1, gap):
                self._correct(self._between(self.last, z, k / gap))
                self.predict()
        self._correct(z)
        self.last, self.missed, self.saved = z, 0, None

    @staticmethod
    def predict_all(filters: list[ScoreKalman]) -> np.ndarray:
        """Different filters predict side by side; their states."""
        one = filters[0]
        x, p = np.array([f.x for f in filters]), np.array([f.p for f in filters])
        x[x[:, 7] + x[:, 2] <= 0, 7] = 0
        x, p = x @ one.f.T, one.f @ p @ one.f.T + one.q
        for f, state, cov in zip(filters, x, p, strict=True):
            f.x, f.p = state, cov
        return x

    @staticmethod
    def update_all(filters: list[ScoreKalman], z: np.ndarray) -> None:
        """Different filters take in a measurement each; those after a gap one by one."""
        for f, m in zip(filters, z, strict=True):
            if f.missed:
                f.update(m)
                f.last = None
        at = [i for i, f in enumerate(filters) if f.last is not None]
        if at:
            one, x, p, m = filters[0], np.array([filters[i].x for i in at]), np.array([filters[i].p for i in at]), z[at]
            gain = _turned(np.linalg.solve(p[:, :5, :5] + one.r, p[:, :5]))
            rest = np.eye(9) - np.concatenate([gain, np.zeros((len(at), 9, 4))], 2)
            x, p = x + (gain @ (m - x[:, :5])[..., None])[..., 0], rest @ p @ _turned(rest) + gain @ one.r @ _turned(gain)
            for i, state, cov in zip(at, x, p, strict=True):
                filters[i].x, filters[i].p = state, cov
        for f, m in zip(filters, z, strict=True):
            f.last, f.missed, f.saved = m, 0, None

    @staticmethod
    def boxes(x: np.ndarray) -> np.ndarray:
        w = np.sqrt(np.maximum(x[:, 2] * x[:, 4], 0))
        h = np.divide(x[:, 2], w, out=np.zeros_like(w), where=w > 0)
        return np.stack([x[:, 0] - w / 2, x[:, 1] - h / 2, x[:, 0] + w / 2, x[:, 1] + h / 2], 1)

    @staticmethod
    def _between(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """Widths, heights, centres and scores on the line between two measurements."""
        wh = lambda z: np.array([np.sqrt(max(z[2] * z[4], 0)), np.sqrt(max(z[2] / max(z[4], 1e-9), 0))])
        w, h = (1 - t) * wh(a) + t * wh(b)
        cx, cy, s = (1 - t) * a[[0, 1, 3]] + t * b[[0, 1, 3]]
        return np.array([cx, cy, w * h, s, w / max(h, 1e-9)])

    @staticmethod
    def measure(box: np.ndarray, score: float) -> np.ndarray:
        w, h = box[2] - box[0], box[3] - box[1]
        return np.array([(box[0] + box[2]) / 2, (box[1] + box[3]) / 2, w * h, score, w / max(h, 1e-9)])

    def box(self) -> np.ndarray:
        w = np.sqrt(max(self.x[2] * self.x[4], 0))
        h = self.x[2] / w if w > 0 else 0.0
        return np.array([self.x[0] - w / 2, self.x[1] - h / 2, self.x[0] + w / 2, self.x[1] + h / 2])


class ScoreKalmans:
    """Many score-aware filters side by side, each as ``ScoreKalman``, in the order in which they begin."""

    def __init__(self):
        one = ScoreKalman(np.zeros(5))
        self.f, self.r, self.q, self.first = one.f, one.r, one.q, one.p
        self.x, self.p = np.zeros((0, 9)), np.zeros((0, 9, 9))
        self.saved_x, self.saved_p, self.last = self.x.copy(), self.p.copy(), np.zeros((0, 5))
        self.missed = np.zeros(0, int)

    def begin(self, z: np.ndarray) -> None:
        n = len(z)
        self.x, self.p = np.r_[self.x, np.c_[z, np.zeros((n, 4))]], np.r_[self.p, np.tile(self.first, (n, 1, 1))]
        self.saved_x, self.saved_p = np.r_[self.saved_x, np.zeros((n, 9))], np.r_[self.saved_p, np.zeros((n, 9, 9))]
        self.last, self.missed = np.r_[self.last, z], np.r_[self.missed, np.zeros(n, int)]

    def predict(self, at: np.ndarray) -> None:
        x = self.x[at]
        x[x[:, 7] + x[:, 2] <= 0, 7] = 0
        self.x[at] = x @ self.f.T
        self.p[at] = self.f @ self.p[at] @ self.f.T + self.q

    def _correct(self, at: np.ndarray, z: np.ndarray) -> None:
        x, p = self.x[at], self.p[at]
        gain = _turned(np.linalg.solve(p[:, :5, :5] + self.r, p[:, :5]))
        rest = np.eye(9) - np.concatenate([gain, np.zeros((len(at), 9, 4))], 2)
        self.x[at] = x + (gain @ (z - x[:, :5])[..., None])[..., 0]
        self.p[at] = rest @ p @ _turned(rest) + gain @ self.r @ _turned(gain)

    def update(self, at: np.ndarray, z: np.ndarray, seen: np.ndarray) -> None:
        """Measurements of the filters ``at``; those not seen have none."""
        lost = at[~seen]
        fresh = lost[self.missed[lost] == 0]
        self.saved_x[fresh], self.saved_p[fresh] = self.x[fresh], self.p[fresh]
        self.missed[lost] += 1
        at, z = at[seen], z[seen]
        back = self.missed[at] > 0
        self.x[at[back]], self.p[at[back]] = self.saved_x[at[back]], self.saved_p[at[back]]
        gap = self.missed[at] + 1
        for k in range(1, int(gap.max(initial=1))):
            own = np.flatnonzero(gap > k)
            between = [ScoreKalman._between(self.last[at[i]], z[i], k / gap[i]) for i in own]
            self._correct(at[own], np.array(between))
            self.predict(at[own])
        self._correct(at, z)
        self.last[at], self.missed[at] = z, 0

    def box(self, at: np.ndarray) -> np.ndarray:
        return ScoreKalman.boxes(self.x[at])


class LinearKalman:
    """A linear filter: states move by ``f`` with noise ``q`` and show as ``h`` times the state with noise
    ``r``; ``m`` is the covariance of the two noises."""

    def __init__(self, f: np.ndarray, h: np.ndarray, q: np.ndarray, r: np.ndarray, x: np.ndarray, p: np.ndarray, m: np.ndarray | None = None):
        self.f, self.h, self.q, self.r, self.x, self.p = f, h, q, r, x, p
        self.m = np.zeros((len(x), len(h))) if m is None else m
        self.log_likelihood = 0.0

    def predict(self) -> None:
        self.x, self.p = self.f @ self.x, self.f @ self.p @ self.f.T + self.q

    def update(self, z: np.ndarray | None) -> None:
        """Correct by a measurement, if there is one; ``log_likelihood`` is that of the measurement."""
        if z is None:
            self.log_likelihood = 0.0
            return
        hm = self.h @ self.m
        s = self.h @ self.p @ self.h.T + hm + hm.T + self.r
        off = z - self.h @ self.x
        gain = np.linalg.solve(s, (self.p @ self.h.T + self.m).T).T
        self.x = self.x + gain @ off
        self.p = self.p - gain @ (self.h @ self.p + self.m.T)
        self.log_likelihood = float(-0.5 * (off @ np.linalg.solve(s, off) + np.linalg.slogdet(s)[1] + len(off) * np.log(2 * np.pi)))

    def batch(self, zs: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, float]:
        """The states and covariances after each measurement, and the log-likelihood of all of them."""
        means, covs, total = [], [], 0.0
        for z in zs:
            self.predict()
            self.update(z)
            means.append(self.x)
            covs.append(self.p)
            total += self.log_likelihood
        return np.array(means), np.array(covs), total

    def steady_gain(self, limit: float = 1e-12, rounds: int = 10_000) -> np.ndarray:
        """The gain that a long run of measurements comes to, whatever they are."""
        p, before = self.p, None
        for _ in range(rounds):
            p = self.f @ p @ self.f.T + self.q
            gain = np.linalg.solve(self.h @ p @ self.h.T + self.r, self.h @ p).T
            p = p - gain @ self.h @ p
            if before is not None and np.abs(gain - before).max() < limit:
                break
            before = gain
        return gain

    def steady(self, zs: np.ndarray) -> np.ndarray:
        """States under the steady gain, which needs no covariances."""
        gain, x, out = self.steady_gain(), self.x, []
        for z in zs:
            x = self.f @ x
            x = x + gain @ (z - self.h @ x)
            out.append(x)
        return np.array(out)


def smooth(f: np.ndarray, q: np.ndarray, means: np.ndarray, covs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rauch-Tung-Striebel: filtered states corrected by those after them."""
    x, p = means.copy(), covs.copy()
    for k in range(len(x) - 2, -1, -1):
        ahead = f @ covs[k] @ f.T + q
        gain = np.linalg.solve(ahead, f @ covs[k]).T
        x[k] += gain @ (x[k + 1] - f @ means[k])
        p[k] += gain @ (p[k + 1] - ahead) @ gain.T
    return x, p


def dbscan(points: np.ndarray, eps: float = 0.04, least: int = 3) -> np.ndarray:
    """Labels 0, 1, ... in the order of first members, -1 for noise."""
    near = ((points[:, None] - points[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(points), -1)
    n = 0
    for i in range(len(points)):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        label[i] = n
        while todo:
            j = todo.pop()
            for k in np.flatnonzero(near[j] & (label < 0)).tolist() if core[j] else []:
                label[k] = n
                todo.append(k)
        n += 1
    return label
