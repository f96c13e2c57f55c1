"""Several sources of one page to one sequence of boxes, as one kernel a page."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators.cleaning import RANGE_RUN, TALL, date_run_places
from pagewright.operators.merging import merged_places
from pagewright.operators.ordering import LEAST_SIDE, RELIABLE
from pagewright.operators.overlap import pairs_of_page

#: Kinds of rows; the names of the sources in the order in which they are merged.
FIRST, SECOND, MARKS, CODES = range(4)
#: What a hole of the first source may have in common with it, and how much of a word a mark must cover to replace it.
HOLE, COVERED = 0.01, 0.5
_DATED = re.compile(RANGE_RUN.strip("^$"), re.ASCII)


def merged_boxes(rows: DataFrame, page: list[str], width: Column, height: Column) -> DataFrame:
    """Rows (page, seq, box) of rows (page, source, seq, box): see _words_of_page()."""
    kinds = ", ".join(f"`{p}` {rows.schema[p].dataType.simpleString()}" for p in page)
    schema = f"{kinds}, seq int, box {rows.schema['box'].dataType.simpleString()}"

    def run(t: pa.Table) -> pa.Table:
        at = pa.array(_words_of_page(t))
        of = {p: t.column(p).take(at) for p in page}
        return pa.table(of | {"seq": pa.array(np.arange(len(at), dtype=np.int32)), "box": t.column("box").take(at)})

    return _given(rows, page, width, height).groupBy(*page).applyInArrow(run, schema)


def merged_text(rows: DataFrame, page: list[str], width: Column, height: Column, joint: str = " ") -> DataFrame:
    """Rows (page, text): page_text() of merged_boxes(); no box leaves the kernel."""
    schema = ", ".join([*(f"`{p}` {rows.schema[p].dataType.simpleString()}" for p in page), "text string"])

    def run(t: pa.Table) -> pa.Table:
        at = _words_of_page(t)
        texts = pc.fill_null(_field(t, "text").take(pa.array(at)), "")
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), texts), joint)
        return pa.table({p: t.column(p).slice(0, 1) for p in page} | {"text": text}).slice(0, min(1, len(at)))

    return _given(rows, page, width, height).groupBy(*page).applyInArrow(run, schema)


def _given(rows: DataFrame, page: list[str], width: Column, height: Column) -> DataFrame:
    """What the kernel needs; what hangs on characters is found by the same Column functions as elsewhere."""
    text = F.col("box")["text"]
    known = F.coalesce(text, F.lit(""))
    return rows.select(
        *page,
        "source",
        F.col("seq").cast("long").alias("seq"),
        "box",
        T.box_type(known).cast("byte").alias("_type"),
        T.is_word(known).alias("_word"),
        F.coalesce(F.length(T.stripped(text)) != 1, F.lit(False)).alias("_long"),
        known.contains("/").alias("_slash"),
        width.cast("double").alias("_width"),
        height.cast("double").alias("_height"),
    )


def _field(t: pa.Table, name: str) -> pa.Array:
    return pc.struct_field(t.column("box").combine_chunks(), name)


def _words_of_page(t: pa.Table) -> np.ndarray:
    """Places of the rows of a page that stay, in their order.

    The first source loses columns of digits and broken date ranges; the second gives the boxes that nothing of the first
    overlaps; marks replace what they cover by half; codes come last. Each is put in by reading order, and what is there
    keeps its order.
    """
    source, seq, kind, word = (t.column(c).to_numpy() for c in ("source", "seq", "_type", "_word"))
    width, height = (float(t.column(c)[0].as_py()) for c in ("_width", "_height"))
    box = t.column("box").combine_chunks()
    q = {c: pc.struct_field(box, c).to_numpy(zero_copy_only=False) for c in G.CORNERS}
    hulls = np.stack([f.reduce([q[c] for c in cs]) for cs in (G.XS, G.YS) for f in (np.fmin, np.fmax)])
    m = _measures(q, width, height)
    first, second, marks, codes = (_in_order(np.flatnonzero(source == k), seq) for k in (FIRST, SECOND, MARKS, CODES))

    if len(first):
        high = np.abs(q["dy"] - q["ay"])[first]
        known = high[~np.isnan(high)]
        middle = float(np.median(known)) if len(known) else np.nan
        odd = (high > middle * TALL) & (np.abs(q["cx"] - q["dx"])[first] * (width / height) < high) & t.column("_long").to_numpy()[first]
        first = first[~odd]
    if t.column("_slash").to_numpy()[first].any():
        texts = [(x or "").replace(" ", "") for x in pc.struct_field(box, "text").take(pa.array(first)).to_pylist()]
        if _DATED.search("".join(texts)):
            first = first[~np.isin(seq[first], seq[first[np.array(date_run_places(texts), np.int64)]])]

    def free(of: np.ndarray, others: np.ndarray, threshold: float, keys: np.ndarray) -> np.ndarray:
        """Which of these boxes none of the others overlaps by more than threshold; boxes with one key go together."""
        if not len(of) or not len(others):
            return of
        i, _, own, other = pairs_of_page(hulls[:, of], hulls[:, others])
        return of[~np.isin(keys, keys[i[(own > threshold) | (other > threshold)]])]

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(b):
            return a
        both = np.concatenate([a, b])
        words = word[both]
        median = float(np.median(m["high"][both[words]])) if words.sum() > RELIABLE else None
        rtl = bool((kind[both] == 1).sum() > (kind[both] == 0).sum())
        return both[merged_places(len(a), {k: v[both] for k, v in m.items() if k != "high"}, median, rtl)]

    words = merged(first, free(second, first, HOLE, seq[second]))
    words = merged(free(words, marks, COVERED, np.arange(len(words))), marks)
    return merged(words, codes)


def _in_order(of: np.ndarray, seq: np.ndarray) -> np.ndarray:
    return of[np.argsort(seq[of], kind="stable")]


def _measures(q: dict[str, np.ndarray], width: float, height: float) -> dict[str, np.ndarray]:
    """ordering.measured() of a page's corners."""

    def within(side: float, a: str, b: str) -> np.ndarray:
        middle = (q[a] + q[b]) / 2
        return max(LEAST_SIDE, side) * np.where(np.isnan(middle), 1.0, np.clip(middle, 0.0, 1.0))

    left, right, top = within(width, "ax", "dx"), within(width, "bx", "cx"), within(height, "ay", "by")
    bottom = np.maximum(top + 1, within(height, "dy", "cy"))
    x, int_top = (left + right) / 2, np.rint(top).astype(np.int64)
    return {
        "x": x,
        "x_center": x - width / 2,
        "y": (top + bottom) / 2,
        "top": int_top,
        "height": np.maximum(1, np.rint(bottom).astype(np.int64) - int_top),
        "wide": np.maximum(1.0, right - left),
        "high": np.maximum(1.0, bottom - top),
    }
