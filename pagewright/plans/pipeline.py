"""Whole plans: one source's reading of pages, and two sources merged."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.operators.cleaning import split_date_ranges
from pagewright.operators.merging import merge_boxes
from pagewright.operators.samples import aggregate_samples
from pagewright.operators.sheets import CODES, FIRST, MARKS, SECOND, merged_boxes
from pagewright.sources.engines import COMBINED_SIZE, SOURCES

#: Fixed value: confidence of merged readings.
MERGED_CONFIDENCE = 0.9


@dataclass(frozen=True)
class Options:
    """Options of a reading. The combined plan has its own way with the last four and refuses other values of them."""

    max_size: int | None = None
    barcodes: bool = False
    checkboxes: bool = False
    samples: int = 1
    auto_rotate: bool = False
    correct_tilt: bool = True

    def for_source(self, source: str) -> Options:
        if self.checkboxes:
            raise ValueError("only the combined plan reads checkboxes")
        return replace(self, max_size=self.max_size or SOURCES[source].max_size)

    def for_combined(self) -> Options:
        if self.samples != 1 or self.auto_rotate or not self.correct_tilt:
            raise ValueError("the combined plan sets samples, rotation and tilt itself")
        return replace(self, max_size=self.max_size or COMBINED_SIZE)


def turned(boxes: DataFrame, rotation: DataFrame, page: list[str], box: str = "box") -> DataFrame:
    """Boxes turned by their page's rotation."""
    turn = rotation.select(*page, F.col("rotation").alias("_turn"))
    return boxes.join(turn, page, "left").withColumn(box, G.rotated(F.col(box), F.coalesce("_turn", F.lit(0)))).drop("_turn")


def _renumbered(boxes: DataFrame) -> DataFrame:
    """seq and part as one number."""
    return boxes.withColumn("seq", F.col("seq") * 4 + F.col("part")).drop("part")


def single_source(readings: DataFrame, page: list[str], width: Column, height: Column, rotation: DataFrame | None = None, barcodes: DataFrame | None = None) -> DataFrame:
    """Rows (page, seq, box, confidence): one or two readings (sample_id) to the final words of each page.

    Readings are merged, turned upright where rotation is given, date ranges are split, and barcodes, turned in the same
    way, are put in by reading order.
    """
    boxes = readings.withColumn("box", G.to_normalised(F.col("box"), width, height))
    boxes = aggregate_samples(boxes.withColumn("box_id", F.col("sample_id") * (1 << 40) + F.col("seq")), page)
    boxes = boxes.withColumn("seq", F.when(F.col("added"), F.lit(1 << 40)).otherwise(0) + F.col("seq")).select(*page, "seq", "box", "confidence")
    if rotation is not None:
        boxes = turned(boxes, rotation, page)
        barcodes = barcodes if barcodes is None else turned(barcodes, rotation, page)
    boxes = _renumbered(split_date_ranges(boxes))
    return boxes if barcodes is None else merge_boxes(boxes, barcodes.select(*page, "seq", "box", "confidence"), page, width, height)


def two_sources(
    first: DataFrame, second: DataFrame, page: list[str], width: Column, height: Column, rotation: DataFrame | None = None, checkboxes: DataFrame | None = None, barcodes: DataFrame | None = None
) -> DataFrame:
    """Rows (page, seq, box, confidence): the first source's words, holes filled by the second's.

    The second source, checkboxes and barcodes are turned by the first's rotation. The first loses columns of digits and
    broken date ranges; the second gives the boxes that nothing of the first overlaps; checkboxes replace what they
    cover by half. Everything is merged in reading order with the order of the first kept. A page is one group of one table
    of all sources, so one exchange by page serves all steps.
    """
    cut = lambda df, source: df.select(*page, F.lit(source).alias("source"), "seq", "box")
    others = [(x, k) for x, k in ((second, SECOND), (checkboxes, MARKS), (barcodes, CODES)) if x is not None]
    if rotation is not None:
        others = [(turned(x, rotation, page), k) for x, k in others]
    rows = reduce(DataFrame.unionByName, [cut(x, k) for x, k in [(first, FIRST), *others]])
    return merged_boxes(parted(rows), page, width, height).withColumn("confidence", F.lit(MERGED_CONFIDENCE))


def parted(rows: DataFrame) -> DataFrame:
    """Rows of all sources (source, seq, box) with the date ranges of the second split."""
    of = F.col("source") == SECOND
    return split_date_ranges(rows, within=of).withColumn("seq", F.when(of, F.col("seq") * 4 + F.col("part")).otherwise(F.col("seq"))).drop("part")
