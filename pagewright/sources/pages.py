"""Page images as tables, and image kernels.

Images come in as rows with their bytes; Spark's own image source decodes them on the JVM. Kernels work on arrays.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from pagewright.functions import geometry as G
from pagewright.functions.angles import sample_size
from pagewright.operators.keys import on_page

#: Of the tilt search: pixels of the image that is searched, points of ink that are needed, step of the first look, how many
#: of its angles are looked at closely, points of ink for that, and how closely.
PIXELS, FEWEST, STEP, BEST, SAMPLE, NEAR = 1 << 20, 100, 0.5, 4, 2_000, 0.0125
#: Pixels that the first look transforms, pixels of a cell of ink, points up to which, and the tilt above which, there are no
#: cells, and the weight of what is across the lines. Where a quarter of a degree leaves more than BLUNT of the sharpness, as
#: on pages of short lines, ink is projected as often as gives OFTEN points.
WAVES, CELL, FEW, FLAT, MARGIN, BLUNT, OFTEN = 1 << 18, 4, 12_000, 12.0, 4, 0.8, 40_000


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Rows (path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, width, height, channels, pixels); files that are no image are left out."""
    image = spark.read.format("image").option("dropInvalid", True).load(path)
    return image.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


def as_array(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """(height, width, channels) in the order blue, green, red (, alpha) of the image source."""
    return np.frombuffer(pixels, np.uint8).reshape(height, width, channels)


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2]).astype(np.float32)
    b, g, r = (image[..., k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.float32)


def binarised(image: np.ndarray, limit: int = 128) -> np.ndarray:
    return np.where(grey(image) < limit, 0, 255).astype(np.uint8)


def turned(image: np.ndarray, angle: int) -> np.ndarray:
    """Counterclockwise by quarter turns."""
    if angle % 90:
        raise ValueError("an angle that is no quarter turn")
    return np.rot90(image, angle // 90 % 4)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """By the nearest pixel."""
    ys = np.minimum(((np.arange(height) + 0.5) * image.shape[0] / height).astype(int), image.shape[0] - 1)
    xs = np.minimum(((np.arange(width) + 0.5) * image.shape[1] / width).astype(int), image.shape[1] - 1)
    return image[ys][:, xs]


def rotated(image: np.ndarray, degrees: float, fill: float = 255) -> np.ndarray:
    """Counterclockwise about the centre by the nearest pixel, on a page large enough for all of it."""
    h, w = image.shape[:2]
    a = np.radians(degrees)
    c, s = np.cos(a), np.sin(a)
    nw, nh = int(np.ceil(abs(w * c) + abs(h * s) - 1e-9)), int(np.ceil(abs(w * s) + abs(h * c) - 1e-9))
    out = np.full((nh, nw, *image.shape[2:]), fill, image.dtype)
    held = image != np.asarray(fill, image.dtype)
    held = held if image.ndim == 2 else held.any(2)
    rows, columns = np.flatnonzero(held.any(1)), np.flatnonzero(held.any(0))
    if not len(rows):
        return out
    # only the part in which something is drawn is looked up
    x, y = np.meshgrid(np.array([columns[0], columns[-1] + 1]) - w / 2, np.array([rows[0], rows[-1] + 1]) - h / 2)
    to_x, to_y = x * c + y * s + nw / 2, y * c - x * s + nh / 2
    x0, x1 = max(int(to_x.min()) - 1, 0), min(int(np.ceil(to_x.max())) + 1, nw)
    y0, y1 = max(int(to_y.min()) - 1, 0), min(int(np.ceil(to_y.max())) + 1, nh)
    x, y = np.arange(x0, x1) + 0.5 - nw / 2, np.arange(y0, y1) + 0.5 - nh / 2
    # places in units of 2 ** -16 pixels, or -12 on very large images
    bits = 16 if max(h, w, nh, nw) < 1 << 14 else 12
    whole = lambda v: np.round(v * (1 << bits)).astype(np.int32)
    u = np.add.outer(whole(-y * s), whole(x * c + w / 2))
    v = np.add.outer(whole(y * c + h / 2), whole(x * s))
    u >>= bits
    v >>= bits
    inside = (u.view(np.uint32) < w) & (v.view(np.uint32) < h)
    v *= w
    v += u
    part = out[y0:y1, x0:x1]
    part[inside] = image.reshape(h * w, *image.shape[2:])[v[inside]]
    return out


def at_least(width: int, height: int, least: int) -> tuple[int, int]:
    """A size whose smaller side is `least` or more, in the same proportion; the other side is cut to an integer."""
    small = min(width, height)
    return (width, height) if small >= least else (width * least // small, height * least // small)


def drawn(image: np.ndarray, quads: list[list[float]], stroke: str | None = "#0000ff", width: int = 3, fill: str | None = None, opacity: float = 0.0) -> np.ndarray:
    """A copy of an image (grey or blue, green, red) in colours, with quadrilaterals of eight pixel coordinates drawn on it.

    What is inside by its centre is filled, what is within half the width of an edge belongs to the stroke; colours are
    #rrggbb, and a colour that is null, or a fill of less than a hundredth, is not drawn. Later ones lie above earlier ones.
    """
    colour = lambda c: np.array([int(c[k : k + 2], 16) for k in (5, 3, 1)], np.float64)
    out = np.repeat(image.reshape(*image.shape[:2], -1)[..., :1], 3, axis=2) if image.ndim == 2 or image.shape[2] == 1 else image[..., :3].copy()
    if len(quads) and not stroke and fill and opacity == 1 and (ranges := _upright(np.asarray(quads, float).reshape(-1, 4, 2))) is not None:
        np.copyto(out, colour(fill).astype(np.uint8), where=_covered(*ranges, *out.shape[:2])[..., None])
        return out
    for quad in quads:
        p = np.asarray(quad, float).reshape(4, 2)
        if not stroke and len(np.unique(p[:, 0])) == len(np.unique(p[:, 1])) == 2 and (p[0] != p[2]).all():  # upright, so its pixels are a slice
            (x0, y0), (x1, y1) = (np.maximum(np.ceil(e - 0.5).astype(int), 0) for e in (p.min(0), p.max(0)))
            if fill and opacity >= 0.01:
                out[y0:y1, x0:x1] = np.round(out[y0:y1, x0:x1] * (1 - opacity) + colour(fill) * opacity).astype(np.uint8)
            continue
        margin = width / 2 + 1
        x0, y0 = np.maximum(np.floor(p.min(0) - margin).astype(int), 0)
        x1, y1 = np.minimum(np.ceil(p.max(0) + margin).astype(int), [out.shape[1], out.shape[0]])
        if x0 >= x1 or y0 >= y1:
            continue
        x, y = np.meshgrid(np.arange(x0, x1) + 0.5, np.arange(y0, y1) + 0.5)
        inside, away = np.zeros(x.shape, bool), np.full(x.shape, np.inf)
        for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, axis=0)):
            crosses = (ay > y) != (by > y)
            if ay != by:
                inside ^= crosses & (x < ax + (y - ay) * (bx - ax) / (by - ay))
            long = max((bx - ax) ** 2 + (by - ay) ** 2, 1e-12)
            t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / long, 0, 1)
            away = np.minimum(away, np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        part = out[y0:y1, x0:x1]
        if fill and opacity >= 0.01:
            part[inside] = np.round(part[inside] * (1 - opacity) + colour(fill) * opacity).astype(np.uint8)
        if stroke and width > 0:
            part[away <= width / 2] = colour(stroke).astype(np.uint8)
    return out


def _upright(p: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(first, last) corners in whole pixels of quadrilaterals that are all upright, else None."""
    low, high = p.min(1), p.max(1)
    at_edge = ((p == low[:, None]) | (p == high[:, None])).all((1, 2))
    if not (at_edge & (low < high).all(1) & (p[:, 0] != p[:, 2]).all(1)).all():
        return None
    return tuple(np.maximum(np.ceil(e - 0.5).astype(np.int64), 0) for e in (low, high))


def _covered(low: np.ndarray, high: np.ndarray, height: int, width: int) -> np.ndarray:
    """Which pixels lie in any of the ranges: those with the same rows are one band."""
    bands, of = np.unique(np.column_stack([low[:, 1], high[:, 1]]), axis=0, return_inverse=True)
    steps = np.zeros(len(bands) * (width + 1), np.int64)
    for x, step in ((low[:, 0], 1), (high[:, 0], -1)):
        steps += step * np.bincount(of.ravel() * (width + 1) + np.minimum(x, width), minlength=len(steps))
    held = np.cumsum(steps.reshape(len(bands), width + 1), axis=1)[:, :width] > 0
    out = np.zeros((height, width), bool)
    for (y0, y1), line in zip(bands.tolist(), held):
        out[y0:y1] |= line
    return out


def draw_boxes(pages: DataFrame, boxes: DataFrame, page: list[str], box: str = "box", stroke: str | None = "#0000ff", width: int = 3, fill: str | None = None, opacity: float = 0.0) -> DataFrame:
    """pages (pixels, width, height, channels) with their boxes drawn on, in colours. Labels and texts are not drawn.

    The boxes of a page come together as one array; a page without boxes stays, in colours.
    """
    quads = boxes.groupBy(*page).agg(F.collect_list(F.struct(F.col(box)["in_pixels"].alias("px"), G.floats(F.col(box)).alias("at"))).alias("_quads"))
    both = on_page(pages, quads, page, "left")

    @F.pandas_udf(BinaryType())
    def run(pixels: pd.Series, widths: pd.Series, heights: pd.Series, channels: pd.Series, quads: pd.Series) -> pd.Series:
        out = []
        for p, w, h, c, qs in zip(pixels, widths, heights, channels, quads):
            at = [np.asarray(q["at"]) * (1 if q["px"] else np.array([w, h] * 4)) for q in (qs if qs is not None else ())]
            out.append(drawn(as_array(p, w, h, c), at, stroke, width, fill, opacity).tobytes())
        return pd.Series(out, dtype=object)

    return both.withColumn("pixels", run("pixels", "width", "height", "channels", "_quads")).withColumn("channels", F.lit(3)).drop("_quads")


def whitened(image: np.ndarray, share: float) -> np.ndarray:
    return (image * (1 - share) + 255 * share).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A grey, RGB or RGBA array as PNG."""
    image = image.reshape(*image.shape[:2], -1).astype(np.uint8)
    h, w, n = image.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * n)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows, 5)) + part(b"IEND", b"")


def _ink(page: np.ndarray) -> np.ndarray:
    """What is darker than the page's mean, by how much it is not white, and 0 elsewhere; cut to the part that holds ink."""
    dark = 255 - page
    limit = dark.mean(dtype=np.float64)
    dark[dark <= (int(limit) if dark.dtype == np.uint8 else limit)] = 0
    rows, columns = np.flatnonzero(dark.any(1)), np.flatnonzero(dark.any(0))
    return dark[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] if len(rows) else dark[:0, :0]


def _points(ink: np.ndarray, cell: tuple[int, int] = (1, 1), times: int = 1, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, weight) of cells of ink, each so many times, or of as many as `most`. A point lies at a fixed pseudo-random place inside its pixel along a side of one pixel,
    so that no angle is favoured by the pixels' grid, and in the middle of a longer side."""
    h, w = ink.shape
    for axis, n in enumerate(cell):
        if n > 1:
            ink = np.add.reduceat(ink, np.arange(0, ink.shape[axis], n), axis=axis, dtype=np.float32)
    at = np.flatnonzero(ink)
    if most and len(at) > most:
        at = at[np.random.default_rng(1).integers(0, len(at), most)]
    at = np.tile(at, times)
    y, x = np.divmod(at, ink.shape[1])
    inside = np.random.default_rng(0).random((2, len(at)), np.float32)
    y, x = (k * n + (n / 2 if n > 1 else r) for k, n, r in zip((y, x), cell, inside))
    return x - w / 2, y - h / 2, ink.ravel()[at].astype(np.float64)


@lru_cache(maxsize=8)
def _directions(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the waves of rfft2() on h by w pixels: (steps of angle, squared frequencies); the longest waves do not count."""
    y, x = np.fft.fftfreq(h)[:, None], np.fft.rfftfreq(w)[None, :]
    angle = np.degrees(np.arctan2(x, y)) % 180  # of the lines that lie across the wave
    square = y * y + x * x
    return (np.round(angle / STEP).astype(np.int64) % round(180 / STEP)).ravel(), np.where(square < 0.02**2, 0, square).astype(np.float32).ravel()


def _first_look(ink: np.ndarray) -> np.ndarray:
    """Angles across which the ink's waves are strong, from -90 to 90: those of lines are among them."""
    ink = ink.astype(np.float32, copy=False)
    while ink.size > WAVES:
        h, w = (k // 2 * 2 for k in ink.shape)
        ink = ink[:h:2, :w:2] + ink[1:h:2, :w:2] + ink[:h:2, 1:w:2] + ink[1:h:2, 1:w:2]
    h, w = (max(64, -(-k // 32) * 32) for k in ink.shape)  # few sizes, and such as are transformed fast
    waves = np.fft.rfft2(ink, (h, w))
    of, square = _directions(h, w)
    power = np.bincount(of, (waves.real**2 + waves.imag**2).ravel() * square, minlength=round(180 / STEP))
    power = power + (np.roll(power, 1) + np.roll(power, -1)) / 2
    out = []
    for k in np.argsort(-power).tolist():
        if all(min((k - o) % len(power), (o - k) % len(power)) > 2 for o in out):
            out.append(k)
        if len(out) == BEST:
            break
    return (np.array(out) * STEP + 90) % 180 - 90


def _edges(x: np.ndarray, y: np.ndarray, weight: np.ndarray, degrees: float) -> float:
    """How sharply ink begins and ends across lines of this tilt: squared steps of the profile of rows."""
    a = np.radians(degrees)
    row = (y * np.cos(a) + x * np.sin(a)).astype(np.int64)
    return float(np.square(np.diff(np.bincount(row - row.min() + 1, weight))).sum())


def _scan(x: np.ndarray, y: np.ndarray, weight: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """_edges() of many angles; the profiles of some angles at a time are one count."""
    size = int(np.hypot(np.abs(x).max(), np.abs(y).max())) + 2
    x, y, out = x.astype(np.float32), y.astype(np.float32), []
    even = (weight == weight[0]).all()
    for part in np.array_split(np.radians(angles).astype(np.float32), min(len(angles), max(1, len(angles) * len(x) >> 16))):
        row = (np.outer(np.cos(part), y) + np.outer(np.sin(part), x) + np.float32(size)).astype(np.intp)
        row += np.arange(len(part))[:, None] * (2 * size + 1)
        profile = np.bincount(row.ravel(), None if even else np.broadcast_to(weight, row.shape).ravel(), minlength=len(part) * (2 * size + 1))
        profile = profile * weight[0] if even else profile
        out.append(np.square(np.diff(profile.reshape(len(part), -1), axis=1)).sum(1))
    return np.concatenate(out)


def find_tilt(image: np.ndarray) -> float:
    """Tilt of the lines of a page in degrees, from -90 to 90; 0 where there is too little ink to tell.

    Angles come from the waves in the ink, some ink is projected close to each, and around the best one all of it, along
    lines and across: short lines tell their tilt by where they begin.
    """
    page = grey(image) if image.dtype != np.uint8 or image.ndim == 3 and image.shape[2] > 1 else image.reshape(image.shape[:2])
    h, w = page.shape
    if h * w > PIXELS:
        factor = (PIXELS / (w * h)) ** 0.5
        page = resized(page, max(1, int(w * factor)), max(1, int(h * factor)))
    ink = _ink(page)
    held = np.count_nonzero(ink)
    if held < FEWEST:
        return 0.0
    some = _points(ink, most=SAMPLE * 3)
    few = [v[:: max(1, len(v) // SAMPLE)] for v in some]
    near = np.arange(-0.75, 0.76, 0.25)
    angles = np.add.outer(_first_look(ink), near)
    scan = _scan(*few, angles.ravel()).reshape(angles.shape)
    i, j = np.unravel_index(np.argmax(scan), scan.shape)
    best = float(angles[i, j])
    quarter = round(best / 90)
    blunt = max(scan[i, max(j - 1, 0)], scan[i, min(j + 1, len(near) - 1)]) > BLUNT * scan[i, j]
    if blunt:
        along = across = _points(ink, times=max(1, OFTEN // held))
    elif held > FEW and abs(best - 90 * quarter) <= FLAT:  # cells along the lines, and across
        along, across = _points(ink, (1, CELL)), _points(ink, (CELL, 1))
        along, across = (across, along) if quarter % 2 else (along, across)
    else:
        along = across = _points(ink)
    for k, step in ((6, 0.05), *(((8, 0.04),) * 2 if blunt else ((2, NEAR),))):
        angles = best + np.arange(-k, k + 1) * step
        sides = (along, across) if blunt or k < 6 else (some, some)
        sharp = _scan(*sides[0], angles) + MARGIN * _scan(*sides[1], angles + 90)
        best = float(angles[np.argmax(sharp)])
        if blunt and k > 6:  # the middle of a peak is surer than its top
            best = float(np.average(angles, weights=np.square(sharp - sharp.min()) + 1e-9))
    return float((best + 90) % 180 - 90)


@F.pandas_udf(DoubleType())
def tilt_angle(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """find_tilt over columns pixels, width, height and channels; 0 where it cannot be told."""
    for pixels, widths, heights, channels in batches:
        yield pd.Series([find_tilt(as_array(p, w, h, c)) for p, w, h, c in zip(pixels, widths, heights, channels)], dtype="float64")


def corrected(image: np.ndarray, most: float = 10.0, least: float = 0.0) -> tuple[np.ndarray, float]:
    """(the image turned upright, its tilt against the nearest right angle). A tilt of `most` or more is taken as none, one
    of at most `least` is told but not turned. What comes into view is white, and the page grows to hold all of it."""
    found = find_tilt(image)
    tilt = found - 90 * float(np.round(found / 90))
    tilt = 0.0 if abs(tilt) >= most else tilt
    return (rotated(image, -tilt) if abs(tilt) > least else image), tilt


_UPRIGHT = "pixels binary, width int, height int, tilt double"


def correct_tilt(pages: DataFrame, most: float = 10.0, least: float = 0.0) -> DataFrame:
    """pages (pixels, width, height, channels) turned upright, with a column tilt."""

    @F.pandas_udf(_UPRIGHT)
    def run(pixels: pd.Series, widths: pd.Series, heights: pd.Series, channels: pd.Series) -> pd.DataFrame:
        rows = []
        for p, w, h, c in zip(pixels, widths, heights, channels):
            image, tilt = corrected(as_array(p, w, h, c), most, least)
            rows.append((np.ascontiguousarray(image).tobytes(), image.shape[1], image.shape[0], tilt))
        return pd.DataFrame(rows, columns=["pixels", "width", "height", "tilt"])

    turned = pages.withColumn("_up", run("pixels", "width", "height", "channels"))
    return turned.withColumns({c: F.col("_up")[c] for c in ("pixels", "width", "height", "tilt")}).drop("_up")


def sample_pages(pages: DataFrame, samples: int, k: float = 0.2) -> DataFrame:
    """Each page `samples` times (sample_id from 0), each time smaller: what several readings of one page are taken from."""
    width, height = sample_size(F.col("width"), F.col("height"), F.col("sample_id"), k)
    out = pages.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumns({"_w": width, "_h": height})

    @F.pandas_udf(BinaryType())
    def run(pixels: pd.Series, widths: pd.Series, heights: pd.Series, channels: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        sized = zip(pixels, widths, heights, channels, w, h)
        return pd.Series([resized(as_array(p, a, b, c), x, y).tobytes() for p, a, b, c, x, y in sized], dtype=object)

    smaller = out.withColumn("pixels", run("pixels", "width", "height", "channels", "_w", "_h"))
    return smaller.withColumns({"width": F.col("_w"), "height": F.col("_h")}).drop("_w", "_h")


def paddle_size(width: Column, height: Column, most: tuple[int, int] = (1700, 2338)) -> tuple[Column, Column, Column]:
    """Width, height and the ratio to scale back by: shrunk where a side is above the largest known to work."""
    ratio = F.greatest(width / most[0], height / most[1])
    large = (width > most[0]) | (height > most[1])
    cut = lambda s: F.when(large, F.floor(s / ratio)).otherwise(s).cast("int")
    return cut(width), cut(height), F.when(large, ratio).otherwise(1.0)
