"""Word boxes as struct columns, and the scalar geometry over them.

A box has four corners a, b, c, d (top left, top right, bottom right, bottom left) as doubles, a unit flag, a text and a
label. All functions take and return Columns, so whole pipelines stay in generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORNERS = ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")
XS, YS = CORNERS[::2], CORNERS[1::2]
BOX = T.StructType([*[T.StructField(c, T.DoubleType()) for c in CORNERS], T.StructField("in_pixels", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])
#: Coordinates that are not pixels may exceed 1 by this much.
LEEWAY = 1.01
#: What pulls coinciding corners apart, normalised and in pixels.
NUDGE, NUDGE_PIXELS = 0.001, 1.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def raw_box(coords: dict[str, Column], in_pixels: Column, text: Column, label: Column) -> Column:
    fields = [coords[c].cast("double").alias(c) for c in CORNERS]
    return F.struct(*fields, in_pixels.cast("boolean").alias("in_pixels"), text.cast("string").alias("text"), label.cast("string").alias("label"))


def with_corners(box: Column, coords: dict[str, Column], in_pixels: Column | None = None) -> Column:
    return raw_box(coords, box["in_pixels"] if in_pixels is None else in_pixels, box["text"], box["label"])


def out_of_range(box: Column) -> Column:
    """Normalised boxes with a coordinate beyond the leeway, to be checked or put aside."""
    return ~box["in_pixels"] & (F.greatest(*[box[c] for c in CORNERS]) > LEEWAY)


def normalised(box: Column, strict: bool = False) -> Column:
    """The canonical form: not negative, corners in their places, no two corners of an edge at one coordinate.

    With strict a normalised box beyond the leeway raises an error; else see out_of_range.
    """

    def sorted_points(b: Column) -> Column:
        return F.sort_array(F.array(*[F.struct(F.greatest(b[x], F.lit(0.0)).alias("x"), F.lit(k).alias("k"), F.greatest(b[y], F.lit(0.0)).alias("y")) for k, (x, y) in enumerate(zip(XS, YS))]))

    def halves(p: Column) -> Column:
        """Two points of the left and two of the right, the upper one first."""
        upper_first = lambda a, b: F.when(p[a]["y"] <= p[b]["y"], F.array(p[a], p[b])).otherwise(F.array(p[b], p[a]))
        return F.concat(upper_first(0, 1), upper_first(2, 3))

    def placed(b: Column, h: Column) -> Column:
        c = {"ax": h[0]["x"], "ay": h[0]["y"], "dx": h[1]["x"], "dy": h[1]["y"], "bx": h[2]["x"], "by": h[2]["y"], "cx": h[3]["x"], "cy": h[3]["y"]}
        eps = F.when(b["in_pixels"], NUDGE_PIXELS).otherwise(NUDGE)
        for first, second in (("ax", "bx"), ("dx", "cx"), ("ay", "dy"), ("by", "cy")):
            c[second] = F.when(c[first] == c[second], c[first] + eps).otherwise(c[second])
        out = with_corners(b, c)
        return F.when(out_of_range(b), F.raise_error(F.lit("a normalised coordinate exceeds 1.01")).cast(BOX)).otherwise(out) if strict else out

    def ordered(b: Column) -> Column:
        """The corners are in their places: left of right, upper above lower, none negative; nothing is to be sorted."""
        apart = (F.greatest(b["ax"], b["dx"]) < F.least(b["bx"], b["cx"])) & (b["ay"] < b["dy"]) & (b["by"] < b["cy"])
        here = reduce(Column.__and__, [b[c].isNotNull() for c in CORNERS])
        return here & apart & (F.least(b["ax"], b["dx"], b["ay"], b["by"]) >= 0)

    def sorted_box(b: Column) -> Column:
        return let(sorted_points(b), lambda p: let(halves(p), lambda h: placed(b, h)))

    if strict:
        return let(box, sorted_box)
    return let(box, lambda b: F.when(ordered(b), with_corners(b, {c: b[c] for c in CORNERS})).otherwise(sorted_box(b)))


def from_xywh(x: Column, y: Column, w: Column, h: Column, in_pixels: bool = False) -> Column:
    c = {"ax": x, "ay": y, "bx": x + w, "by": y, "cx": x + w, "cy": y + h, "dx": x, "dy": y + h}
    return normalised(raw_box(c, F.lit(in_pixels), F.lit(None), F.lit(None)))


def from_floats(values: Column, in_pixels: Column, text: Column, label: Column) -> Column:
    """From an array of eight numbers, clockwise from the top left corner."""
    return normalised(raw_box({c: F.element_at(values, k + 1) for k, c in enumerate(CORNERS)}, in_pixels, text, label))


def from_quad(points: Column, in_pixels: Column, text: Column, label: Column) -> Column:
    """From an array of four (x, y) arrays."""
    return from_floats(F.flatten(points), in_pixels, text, label)


def from_vertices(vertices: Column, x: str, y: str, in_pixels: Column, text: Column, label: Column) -> Column:
    """From an array of four points with these fields."""
    return normalised(raw_box({c: vertices[k // 2][(x, y)[k % 2]] for k, c in enumerate(CORNERS)}, in_pixels, text, label))


def floats(box: Column) -> Column:
    return F.array(*[box[c] for c in CORNERS])


def x_range(box: Column) -> tuple[Column, Column]:
    return F.least(*[box[c] for c in XS]), F.greatest(*[box[c] for c in XS])


def y_range(box: Column) -> tuple[Column, Column]:
    return F.least(*[box[c] for c in YS]), F.greatest(*[box[c] for c in YS])


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    scaled = lambda b: with_corners(b, {c: b[c] * (width if c in XS else height) for c in CORNERS}, F.lit(True))
    return let(box, lambda b: F.when(b["in_pixels"], b).otherwise(normalised(scaled(b))))


def to_normalised(box: Column, width: Column, height: Column) -> Column:
    share = lambda b, c: F.greatest(F.least(b[c] / (width if c in XS else height), F.lit(1.0)), F.lit(0.0))
    scaled = lambda b: with_corners(b, {c: share(b, c) for c in CORNERS}, F.lit(False))
    return let(box, lambda b: F.when(~b["in_pixels"], b).otherwise(normalised(scaled(b))))


def area(box: Column) -> Column:
    """Of the polygon; exact where its edges do not cross."""
    n = len(XS)
    return F.abs(reduce(Column.__add__, [box[XS[k]] * box[YS[(k + 1) % n]] - box[XS[(k + 1) % n]] * box[YS[k]] for k in range(n)])) / 2


def box_height(box: Column) -> Column:
    return F.abs(box["dy"] - box["ay"])


def stands_upright(box: Column, width_by_height: Column) -> Column:
    return F.abs(box["cx"] - box["dx"]) * width_by_height < box_height(box)


def combined(a: Column, b: Column, infix: str = " ") -> Column:
    """The upright hull of both; texts joined, a text that is missing on one side is empty there; no label."""
    (ax0, ax1), (ay0, ay1), (bx0, bx1), (by0, by1) = x_range(a), y_range(a), x_range(b), y_range(b)
    x0, x1, y0, y1 = F.least(ax0, bx0), F.greatest(ax1, bx1), F.least(ay0, by0), F.greatest(ay1, by1)
    text = F.when(a["text"].isNull() & b["text"].isNull(), F.lit(None).cast("string")).otherwise(F.concat(F.coalesce(a["text"], F.lit("")), F.lit(infix), F.coalesce(b["text"], F.lit(""))))
    c = {"ax": x0, "ay": y0, "bx": x1, "by": y0, "cx": x1, "cy": y1, "dx": x0, "dy": y1}
    out = normalised(raw_box(c, a["in_pixels"], text, F.lit(None)))
    return F.when(a["in_pixels"] != b["in_pixels"], F.raise_error(F.lit("boxes in different units")).cast(BOX)).otherwise(out)


def horizontal_gap(a: Column, b: Column) -> Column:
    return x_range(b)[0] - x_range(a)[1]


def rotated(box: Column, angle: Column) -> Column:
    """Counterclockwise by 0, 90, 180 or 270 degrees, normalised boxes only."""
    return let(box, lambda b: _rotated(b, angle))


def _rotated(box: Column, angle: Column) -> Column:
    turn = {90: lambda x, y: (y, 1 - x), 180: lambda x, y: (1 - x, 1 - y), 270: lambda x, y: (1 - y, x)}

    def by(degrees: int) -> Column:
        c = {}
        for x, y in zip(XS, YS):
            c[x], c[y] = turn[degrees](box[x], box[y])
        return normalised(with_corners(box, c))

    fine = F.when(angle == 0, box).when(angle == 90, by(90)).when(angle == 180, by(180)).when(angle == 270, by(270))
    return F.when(box["in_pixels"], F.raise_error(F.lit("only normalised boxes rotate")).cast(BOX)).otherwise(F.coalesce(fine, F.raise_error(F.lit("an angle that is no quarter turn")).cast(BOX)))


def split(box: Column, ratio: float) -> tuple[Column, Column]:
    """Two boxes, cut across the longer of top and left edge; text, label and unit go to both."""
    return (let(box, lambda b: _part(b, ratio, 0)), let(box, lambda b: _part(b, ratio, 1)))


def _part(box: Column, ratio: float, which: int) -> Column:
    between = lambda p, q: box[p] + (box[q] - box[p]) * ratio
    top = F.sqrt(F.pow(box["bx"] - box["ax"], 2) + F.pow(box["by"] - box["ay"], 2))
    side = F.sqrt(F.pow(box["dx"] - box["ax"], 2) + F.pow(box["dy"] - box["ay"], 2))
    upper, lower = (between("ax", "bx"), between("ay", "by")), (between("dx", "cx"), between("dy", "cy"))
    left, right = (between("ax", "dx"), between("ay", "dy")), (between("bx", "cx"), between("by", "cy"))
    own = {c: box[c] for c in CORNERS}
    wide = (own | dict(zip(("bx", "by"), upper)) | dict(zip(("cx", "cy"), lower)), own | dict(zip(("ax", "ay"), upper)) | dict(zip(("dx", "dy"), lower)))
    tall = (own | dict(zip(("dx", "dy"), left)) | dict(zip(("cx", "cy"), right)), own | dict(zip(("ax", "ay"), left)) | dict(zip(("bx", "by"), right)))
    return normalised(F.when(top >= side, with_corners(box, wide[which])).otherwise(with_corners(box, tall[which])))


def jittered(box: Column, most: float, seed: int) -> Column:
    """Each coordinate moved by a random amount below most, and the corners put in their places again."""
    return normalised(with_corners(box, {c: box[c] + F.rand(seed + k) * most for k, c in enumerate(CORNERS)}))


def retext(box: Column, text: Column) -> Column:
    return raw_box({c: box[c] for c in CORNERS}, box["in_pixels"], text, box["label"])


# ---------------------------------------------------------------- general quadrilaterals


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed area of triangles; positive where they turn left."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _crossing(p: np.ndarray) -> np.ndarray:
    """Whether two opposite edges of quadrilaterals (n, 4, 2) cross."""

    def cross(a: int, b: int, c: int, d: int) -> np.ndarray:
        a, b, c, d = (p[:, k] for k in (a, b, c, d))
        return (_turn(a, b, c) * _turn(a, b, d) < 0) & (_turn(c, d, a) * _turn(c, d, b) < 0)

    return cross(0, 1, 2, 3) | cross(1, 2, 3, 0)


def _triangles(p: np.ndarray) -> list[np.ndarray]:
    """Two triangles of each quadrilateral along the diagonal that lies inside, turning left."""
    outside = _turn(p[:, 0], p[:, 1], p[:, 2]) * _turn(p[:, 0], p[:, 2], p[:, 3]) < 0
    p = np.where(outside[:, None, None], np.roll(p, -1, axis=1), p)
    out = []
    for t in (p[:, [0, 1, 2]], p[:, [0, 2, 3]]):
        out.append(np.where((_turn(t[:, 0], t[:, 1], t[:, 2]) < 0)[:, None, None], t[:, ::-1], t))
    return out


def _edges_inside(s: np.ndarray, t: np.ndarray, shared: bool) -> np.ndarray:
    """Sum over the edges of triangles s of the area below the part that lies in t; shared edges count on one side."""
    total = np.zeros(len(s))
    for k in range(3):
        p, q = s[:, k], s[:, (k + 1) % 3]
        low, high = np.zeros(len(s)), np.ones(len(s))
        for m in range(3):
            a, b = t[:, m], t[:, (m + 1) % 3]
            d, e = _turn(a, b, p), _turn(a, b, q)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = d / (d - e)
            low = np.where(d < 0, np.where(e < 0, 1.0, np.maximum(low, at)), low)
            high = np.where(e < 0, np.where(d < 0, 0.0, np.minimum(high, at)), high)
            if not shared:
                along = (d == 0) & (e == 0) & (((q - p) * (b - a)).sum(1) > 0)
                high = np.where(along, 0.0, high)
        inside = high > low
        step = q - p
        total += np.where(inside, _cross(p + low[:, None] * step, p + high[:, None] * step) / 2, 0.0)
    return total


def quad_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of quadrilaterals a that b covers, rows of eight coordinates; 0 where edges cross or there is no area."""
    return quad_shares(a, b)[0]


def quad_shares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of a that b covers and of b that a covers."""
    p, q = np.asarray(a, float).reshape(-1, 4, 2), np.asarray(b, float).reshape(-1, 4, 2)
    area = lambda s: np.abs(sum(_cross(s[:, k], s[:, (k + 1) % 4]) for k in range(4))) / 2
    origin = p[:, :1]
    common = np.zeros(len(p))
    for s in _triangles(p - origin):
        for t in _triangles(q - origin):
            common += _edges_inside(s, t, True) + _edges_inside(t, s, False)
    crossing = _crossing(p) | _crossing(q)

    def share(own: np.ndarray) -> np.ndarray:
        return np.where((own == 0) | crossing, 0.0, np.clip(common / np.where(own == 0, 1, own), 0, 1))

    return share(area(p)), share(area(q))


@F.pandas_udf(T.DoubleType())
def quad_intersection_share(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """quad_share over arrays of eight coordinates, for boxes that are not axis-aligned."""
    for a, b in pairs:
        yield pd.Series(quad_share(np.stack(a.to_list()), np.stack(b.to_list())) if len(a) else [], dtype="float64")
