"""The merge of several sources as one kernel of a page equals its steps one by one, and neither writes nor moves boxes."""

import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from pagewright.operators import cleaning, merging, ordering, overlap
from pagewright.plans import pipeline
from pagewright.plans.layout import rectangle
from pagewright.plans.queries import QUERIES
from pagewright.sources import tables


def test_two_source_merge_writes_and_moves_no_boxes(spark, data):
    before = len(tables._written.get(spark.sparkContext.applicationId, []))
    plan = QUERIES["two_source_merge"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert len(tables._written.get(spark.sparkContext.applicationId, [])) == before
    assert len(re.findall("Exchange (?:hash|range|round|Round|Single)", plan)) == 1  # of the texts


def test_merge_of_sources_equals_its_steps(spark):
    rng = np.random.default_rng(7)
    words = ["ab", "cde", "7", "12", "1/2/2020", "-3/4/2021", "1/2/2020 - 3/4/2021", "שלום", "", None]
    rows = []
    for page in (0, 1, None):
        for source, n in enumerate((60, 60, 6, 4)):
            for k in range(n):
                w, h = (2, 40) if source == 0 and k % 17 == 3 else (int(rng.integers(4, 16)), 4)
                rows.append((page, source, k, float(rng.integers(0, 100)) / 128, float(rng.integers(0, 20)) * 5 / 128, w / 128, h / 128, words[int(rng.integers(len(words)))]))
    df = spark.createDataFrame(rows, "p int, source int, seq int, x double, y double, w double, h double, t string")
    df = df.select("p", "source", "seq", rectangle(F.col("x"), F.col("y"), F.expr("x + w"), F.expr("y + h"), F.col("t")).alias("box"))
    first, second, marks, codes = (df.where(F.col("source") == k).drop("source") for k in range(4))
    page, width, height = ["p"], F.lit(1024), F.lit(512)
    got = pipeline.two_sources(first, second, page, width, height, checkboxes=marks, barcodes=codes)

    cut = cleaning.split_date_ranges(second).withColumn("seq", F.col("seq") * 4 + F.col("part")).drop("part")
    kept = cleaning.without_date_runs(cleaning.without_columns_of_digits(first, page, width / height), page)
    keyed = lambda x: x.withColumn("box_id", F.col("seq"))
    steps = merging.merge_boxes(kept, overlap.without_overlap(keyed(cut), keyed(kept), page, 0.01).drop("box_id"), page, width, height).drop("from_b")
    steps = merging.merge_boxes(overlap.without_overlap(keyed(steps), keyed(marks), page, 0.5).drop("box_id"), marks, page, width, height).drop("from_b")
    steps = merging.merge_boxes(steps, codes, page, width, height).drop("from_b")
    of = lambda x: sorted((str(r.p), r.seq, tuple(r.box)) for r in x.select("p", "seq", "box").collect())
    assert len(of(steps)) > 200 and len(of(steps)) < len(rows)
    assert of(got) == of(steps)


@pytest.mark.parametrize("most", [3, 40])
def test_gains_by_height_equal_those_box_by_box(most):
    rng = np.random.default_rng(most)
    n = 500
    x, top, height, weight = rng.integers(-400, 400, n) / 2, rng.integers(0, 300, n), rng.integers(1, most, n), rng.integers(1, 50, n).astype(float)
    gains, zero, best = ordering._profile(x, top, height, weight)
    want = np.zeros_like(gains)
    for k, f in enumerate(ordering.TILT_FRACTIONS):
        for b in range(n):
            for step in range(height[b] + 1):
                half = height[b] / 2
                want[k, zero + top[b] + int(np.trunc(f * x[b])) + step] += (1 - ((step - half) / max(0.5, half)) ** 2) * weight[b]
    assert np.allclose(gains, want) and best == int(np.argmax((want**2).sum(1)))
