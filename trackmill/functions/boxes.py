"""Box geometry as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


@dataclass(frozen=True)
class Box:
    """Corner columns of a box."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def corners(prefix: str = "") -> Box:
        """The box of the columns x1 .. y2 with a prefix; columns are made when they are used, so that a
        box can be named before there is a session."""
        return _Corners(prefix)

    @staticmethod
    def xywh(x, y, w, h) -> Box:
        x, y, w, h = (F.col(c) if isinstance(c, str) else c for c in (x, y, w, h))
        return Box(x, y, x + w, y + h)

    @property
    def w(self) -> Column:
        return self.x2 - self.x1

    @property
    def h(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2

    def to_xywh(self) -> list[Column]:
        return [self.x1, self.y1, self.w, self.h]


class _Corners(Box):
    def __init__(self, prefix: str):
        object.__setattr__(self, "prefix", prefix)

    x1 = property(lambda self: F.col(self.prefix + "x1"))
    y1 = property(lambda self: F.col(self.prefix + "y1"))
    x2 = property(lambda self: F.col(self.prefix + "x2"))
    y2 = property(lambda self: F.col(self.prefix + "y2"))


def _hull(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def union_area(a: Box, b: Box) -> Column:
    return a.area + b.area - intersection(a, b)


def iou(a: Box, b: Box) -> Column:
    """Null where the union is zero."""
    return F.try_divide(intersection(a, b), union_area(a, b))


def iou_or_zero(a: Box, b: Box) -> Column:
    u = union_area(a, b)
    return F.when(u > 0, intersection(a, b) / u).otherwise(0.0)


def iof(a: Box, b: Box) -> Column:
    """The share of a that b covers."""
    return F.try_divide(intersection(a, b), a.area)


def height_modulated_iou(a: Box, b: Box) -> Column:
    overlap = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    span = F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1)
    return F.try_divide(overlap, span) * iou(a, b)


def giou(a: Box, b: Box, standard: bool = False) -> Column:
    """Generalised IoU mapped to [0, 1]. The variant in use subtracts the intersection from the hull;
    the published one (standard) subtracts the union."""
    hull = _hull(a, b).area
    inner = union_area(a, b) if standard else intersection(a, b)
    return (iou(a, b) - F.try_divide(hull - inner, hull) + 1) / 2


def _diagonals(a: Box, b: Box) -> Column:
    hull = _hull(a, b)
    between = (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)
    return F.try_divide(between, hull.w * hull.w + hull.h * hull.h)


def diou(a: Box, b: Box) -> Column:
    return (iou(a, b) - _diagonals(a, b) + 1) / 2


def ciou(a: Box, b: Box) -> Column:
    """Complete IoU with heights taken one pixel larger, mapped to [0, 1]."""
    turn = F.atan(b.w / (b.h + 1)) - F.atan(a.w / (a.h + 1))
    v = turn * turn * 4 / (F.pi() * F.pi())
    alpha = F.try_divide(v, 1 - iou(a, b) + v)
    return (iou(a, b) - _diagonals(a, b) - F.coalesce(alpha, F.lit(0.0)) * v + 1) / 2


def centre_distance(a: Box, b: Box) -> Column:
    return F.sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))


def score_gap(a: Column, b: Column) -> Column:
    return F.abs(b - a)


#: The point of a box that each kind of direction follows; lower-case letters are x, then y side.
POINTS = {"centre": ("cx", "cy"), "lt": ("x1", "y1"), "rt": ("x1", "y2"), "lb": ("x2", "y1"), "rb": ("x2", "y2")}


def direction(a: Box, b: Box, point: str = "centre") -> tuple[Column, Column]:
    """Unit vector (dy, dx) from a to b of one point of the boxes."""
    px, py = POINTS[point]
    dx, dy = getattr(b, px) - getattr(a, px), getattr(b, py) - getattr(a, py)
    norm = F.sqrt(dx * dx + dy * dy) + EPS
    return dy / norm, dx / norm


def direction_cost(move: tuple[Column, Column], inertia: tuple[Column, Column], valid: Column, score: Column, weight: float) -> Column:
    """How well a move agrees with a track's inertia, in [-1/2, 1/2] before weighting."""
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inertia[1] * move[1] + inertia[0] * move[0]))
    gain = (F.pi() / 2 - F.abs(F.acos(cos))) / F.pi()
    return F.when(valid, gain * weight * score).otherwise(0.0)


def to_centre_ratio(b: Box) -> list[Column]:
    """(cx, cy, w / h, h)."""
    return [b.cx, b.cy, F.try_divide(b.w, b.h), b.h]


def from_centre_ratio(cx: Column, cy: Column, ratio: Column, h: Column) -> Box:
    w = ratio * h
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def to_centre_area(b: Box) -> list[Column]:
    """(cx, cy, area, w / h)."""
    return [b.cx, b.cy, b.area, F.try_divide(b.w, b.h)]


def from_centre_area(cx: Column, cy: Column, area: Column, ratio: Column) -> Box:
    w = F.sqrt(area * ratio)
    return from_centre_ratio(cx, cy, ratio, F.try_divide(area, w))


def normalised(b: Box, width: Column, height: Column, share: float = 0.7) -> list[Column]:
    """Corners in units of a share of the image's longer side."""
    side = F.greatest(width, height) * share
    return [c / side for c in (b.x1, b.y1, b.x2, b.y2)]


def cut_distance(overlap: Column, limit: float = 0.5) -> Column:
    """1 - overlap, or null beyond the limit."""
    d = 1 - overlap
    return F.when(d <= limit, d)


def overshoot(b: Box, width: Column, height: Column) -> Column:
    return F.greatest(-b.x1, -b.y1, b.x2 - width, b.y2 - height, F.lit(0.0))


def overshoot_limit(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(8.0), 0.01 * F.greatest(width, height))


def close(a: Column, b: Column, relative: float = 0.0, absolute: float = 1e-4) -> Column:
    bound = F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.abs(a - b) <= bound


def ratio_of_larger(a: Column, b: Column) -> Column:
    return F.try_divide(F.greatest(a, b), F.least(a, b))


def displacement(a: Box, b: Box) -> Column:
    """Centre distance in units of the root of the mean area."""
    return F.try_divide(centre_distance(a, b), F.sqrt((a.area + b.area) / 2))


def warped(b: Box, m: list[list[float]]) -> Box:
    """Both corners under a 2 x 3 affine map."""
    move = lambda x, y, r: m[r][0] * x + m[r][1] * y + m[r][2]
    return Box(move(b.x1, b.y1, 0), move(b.x1, b.y1, 1), move(b.x2, b.y2, 0), move(b.x2, b.y2, 1))


def clipped(b: Box, left, top, right, bottom) -> Box:
    inside = lambda v, lo, hi: F.least(F.greatest(v, F.lit(lo)), F.lit(hi))
    return Box(inside(b.x1, left, right), inside(b.y1, top, bottom), inside(b.x2, left, right), inside(b.y2, top, bottom))


#: Association measures by name, all larger for better pairs.
ASSOCIATIONS = {"iou": iou, "giou": giou, "diou": diou, "ciou": ciou, "height_modulated_iou": height_modulated_iou}
