"""Order-preserving merge of two sequences of boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.keys import on_page
from pagewright.operators.ordering import page_lines, reading_order
from pagewright.sources.tables import materialised


def merge_order(rows: DataFrame, page: list[str], from_b: str = "from_b", a_position: str = "a_position", sorted_position: str = "sorted_position", out: str = "position") -> DataFrame:
    """Positions of a merge that keeps the order of the rows of a.

    Every run of rows of b follows the row of a that comes before it in the common order; a run in front of all goes
    first. a_position is null for rows of b.
    """
    before = Window.partitionBy(*page).orderBy(sorted_position).rowsBetween(Window.unboundedPreceding, 0)
    anchored = rows.withColumn("_anchor", F.coalesce(F.last(a_position, ignorenulls=True).over(before), F.lit(-1)))
    order = Window.partitionBy(*page).orderBy("_anchor", F.col(from_b), sorted_position)
    return anchored.withColumn(out, F.row_number().over(order) - 1).drop("_anchor")


def merged_places(n: int, measures: dict[str, np.ndarray], median: float | None, rtl: bool) -> np.ndarray:
    """merge_boxes() of one page: the order of its boxes, of which the first n keep theirs. measures: arguments of page_lines()."""
    _, rank, _ = page_lines(**measures, median=median, rtl=rtl)
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    last = np.maximum.accumulate(np.where(order < n, np.arange(len(order)), -1))  # the place of the last row of a so far
    anchor = np.empty(len(rank), np.int64)
    anchor[order] = np.where(last < 0, -1, order[last])
    return np.lexsort((rank, np.arange(len(rank)) >= n, anchor))


def merge_boxes(a: DataFrame, b: DataFrame, page: list[str], width: Column, height: Column, seq: str = "seq") -> DataFrame:
    """a with b put in, in reading order but with the order of a kept; seq is renumbered. Other columns move along."""
    both = a.withColumn("from_b", F.lit(False)).unionByName(b.withColumn("from_b", F.lit(True)), allowMissingColumns=True)
    numbered = Window.partitionBy(*page).orderBy("from_b", seq)
    both = materialised(both.withColumn("_n", F.row_number().over(numbered)))
    order = reading_order(both, page, width, height, key="_n").select(*page, "_n", F.col("position").alias("_sorted"))
    both = on_page(both, order, [*page, "_n"]).withColumn("_a", F.when(~F.col("from_b"), F.col("_n")))
    return merge_order(both, page, "from_b", "_a", "_sorted", seq).drop("_n", "_a", "_sorted")


def page_text(boxes: DataFrame, page: list[str], seq: str = "seq", box: str = "box", joint: str = " ") -> DataFrame:
    """Rows (page, text): the words of a page in order."""
    words = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.coalesce(F.col(box)["text"], F.lit("")).alias("t")))), lambda w: w["t"])
    return boxes.groupBy(*page).agg(F.array_join(words, joint).alias("text"))
