"""Reading order of the words of a page.

For each of a range of tilts the words spread a parabola of gain over the rows of pixels that they cover; the tilt with
the sharpest profile wins, its local maxima are the lines, and each word goes to the nearest line. One kernel for a page
works on arrays and runs where the rows lie after one exchange by page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators.keys import on_page

#: The largest tilt in degrees, the number of tilts, the least size of a page, words for a reliable median.
MOST_TILT, TILTS, LEAST_SIDE, RELIABLE = 11, 21, 200, 10
TILT_FRACTIONS = np.linspace(-np.tan(np.radians(MOST_TILT)), np.tan(np.radians(MOST_TILT)), TILTS)


def measured(boxes: DataFrame, width: Column, height: Column, box: str = "box") -> DataFrame:
    """Adds pixel measures of each box, its dominant character type and whether it is a word."""
    b = F.col(box)
    full = [F.greatest(F.lit(LEAST_SIDE), s).cast("double") for s in (width, height)]
    within = lambda p, q: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (b[p] + b[q]) / 2))
    text = F.coalesce(b["text"], F.lit(""))
    out = boxes.withColumn("left", full[0] * within("ax", "dx")).withColumn("right", full[0] * within("bx", "cx"))
    out = out.withColumn("wide", F.greatest(F.lit(1.0), F.col("right") - F.col("left"))).withColumn("x", (F.col("left") + F.col("right")) / 2)
    out = out.withColumn("x_center", F.col("x") - width / 2).withColumn("top", full[1] * within("ay", "by"))
    out = out.withColumn("bottom", F.greatest(F.col("top") + 1, full[1] * within("dy", "cy"))).withColumn("high", F.greatest(F.lit(1.0), F.col("bottom") - F.col("top")))
    out = out.withColumn("y", (F.col("top") + F.col("bottom")) / 2).withColumn("int_top", F.bround("top").cast("int"))
    out = out.withColumn("int_height", F.greatest(F.lit(1), F.bround("bottom").cast("int") - F.col("int_top")))
    return out.withColumn("type", T.box_type(text)).withColumn("is_word", T.is_word(text))


def page_measures(words: DataFrame, page: list[str]) -> DataFrame:
    """Rows (page, n_words, median_height, median_char_width, rtl, bidirectional); medians are null for few words."""
    length = F.length(F.col("box")["text"])
    word = F.col("is_word")
    reliable = F.count_if(word) > RELIABLE
    n = [F.count_if(F.col("type") == k) for k in range(6)]
    return words.groupBy(*page).agg(
        F.count_if(word).alias("n_words"),
        F.when(reliable, F.median(F.when(word, F.col("high")))).alias("median_height"),
        F.when(reliable, F.percentile(F.when(word, F.col("wide") / length), 0.5, F.when(word, length).otherwise(1))).alias("median_char_width"),
        (n[1] > n[0]).alias("rtl"),
        (F.least(n[0] + n[2] + n[4], n[1]) > 1).alias("bidirectional"),
    )


def _profile(x_center: np.ndarray, top: np.ndarray, height: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Gain by (tilt, row of pixels), the row of pixel 0, and the best tilt."""
    shift = np.trunc(np.outer(TILT_FRACTIONS, x_center)).astype(np.int64)
    low = int(top.min() + shift.min()) - 1
    size = int((top + height).max() + shift.max()) - low + 2
    gains = np.zeros((TILTS, size))
    shift += top - low
    parabola = lambda step, half: 1 - ((step - half) / np.maximum(0.5, half)) ** 2
    # the weights of boxes of one height, where these are many, are summed by row first and spread then
    heights, n = np.unique(height, return_counts=True)
    single = np.ones(len(height), bool)
    for h in heights[4 * n > size].tolist():
        of = height == h
        single &= ~of
        rows = shift[:, of] + size * np.arange(TILTS)[:, None]
        sums = np.bincount(rows.ravel(), np.tile(weight[of], TILTS), minlength=TILTS * size).reshape(TILTS, size)
        for step in range(h + 1):
            if gain := float(parabola(step, h / 2)):
                gains[:, step:] += gain * sums[:, : size - step]
    if single.any():
        counts = height[single] + 1
        box = np.repeat(np.flatnonzero(single), counts)
        step = np.arange(len(box)) - np.repeat(np.cumsum(counts) - counts, counts)
        gain = parabola(step, height[box] / 2) * weight[box]
        for k, s in enumerate(shift):
            gains[k] += np.bincount(s[box] + step, gain, minlength=size)
    return gains, -low, int(np.argmax((gains**2).sum(1)))


def page_lines(x: np.ndarray, x_center: np.ndarray, y: np.ndarray, top: np.ndarray, height: np.ndarray, wide: np.ndarray, median: float | None, rtl: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(line of each box, its position in reading order, best tilt); boxes come in the order of the page."""
    weight = wide * (np.minimum(1, height / median) if median else 1.0)
    gains, zero, best = _profile(x_center, top, height, weight)
    g = gains[best]
    maxima = np.flatnonzero((g[:-2] <= g[1:-1]) & (g[2:] < g[1:-1])) + 1 - zero
    if not len(maxima):
        maxima = np.zeros(1, np.int64)
    tilted = y + x_center * TILT_FRACTIONS[best]
    # the nearest of the two maxima around a word, the upper one if both are as near
    below = np.searchsorted(maxima, tilted).clip(0, len(maxima) - 1)
    above = np.maximum(below - 1, 0)
    line = np.where(np.abs(tilted - maxima[above]) <= np.abs(tilted - maxima[below]), above, below)
    line = np.unique(line, return_inverse=True)[1]
    order = np.lexsort((np.arange(len(x)), -x if rtl else x, line))
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    return line, rank, best


def reading_order(boxes: DataFrame, page: list[str], width: Column, height: Column, key: str = "box_id") -> DataFrame:
    """Rows (page, key, line_id, position, tilt): the place of each box. key is the order of the boxes on the page."""
    words = measured(boxes, width, height)
    words = on_page(words, page_measures(words, page), page)
    fields = ["x", "x_center", "y", "int_top", "int_height", "wide"]
    schema = ", ".join([*(f"`{p}` {boxes.schema[p].dataType.simpleString()}" for p in page), f"`{key}` {boxes.schema[key].dataType.simpleString()}", "line_id int, position int, tilt int"])
    sorted_ = words.select(*page, key, *fields, "median_height", "rtl").repartition(*page).sortWithinPartitions(*page, key)
    n = len(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(t: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
            c = {f: t.column(f).to_numpy() for f in (*fields, "rtl")}
            medians = t.column("median_height").to_pylist()
            line, rank, tilt = (np.empty(t.num_rows, np.int32) for _ in range(3))
            for a, z in zip(edges[:-1], edges[1:]):
                line[a:z], rank[a:z], tilt[a:z] = page_lines(
                    c["x"][a:z], c["x_center"][a:z], c["y"][a:z], c["int_top"][a:z].astype(np.int64), c["int_height"][a:z].astype(np.int64), c["wide"][a:z], medians[a], bool(c["rtl"][a])
                )
            columns = [t.column(k).combine_chunks() for k in range(n + 1)]
            return pa.record_batch([*columns, pa.array(line), pa.array(rank), pa.array(tilt)], [*page, key, "line_id", "position", "tilt"])

        def cuts(t: pa.Table) -> np.ndarray:
            change = np.zeros(max(0, t.num_rows - 1), bool)
            for k in range(n):
                x, y = t.column(k).slice(1), t.column(k).slice(0, t.num_rows - 1)
                unequal = pc.fill_null(pc.not_equal(x, y), False).to_numpy(zero_copy_only=False) if t.num_rows > 1 else change
                change |= unequal | (np.asarray(x.is_null()) != np.asarray(y.is_null()))  # nulls are equal
            return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])

        def ends(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
            """Whether the page at the end of a is not that at the start of b."""
            return any(a.column(k)[a.num_rows - 1].as_py() != b.column(k)[0].as_py() for k in range(n))

        for batch in batches:
            if not batch.num_rows:
                continue
            edges = cuts(pa.Table.from_batches([batch]))
            if held and (len(edges) > 2 or ends(held[-1], batch)):
                # the page that is held ends here; its batches are put together once
                whole = [*held, batch.slice(0, edges[1])] if not ends(held[-1], batch) else held
                t = pa.Table.from_batches(whole).combine_chunks()
                yield solved(t, cuts(t))
                batch = batch.slice(edges[1]) if whole is not held else batch
                held = []
                edges = cuts(pa.Table.from_batches([batch]))
            if len(edges) > 2:
                yield solved(pa.Table.from_batches([batch.slice(0, edges[-2])]), edges[:-1])
            held.append(batch.slice(edges[-2]))
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield solved(t, cuts(t))

    return sorted_.mapInArrow(run, schema)
