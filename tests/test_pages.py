"""Plans that work page by page: rows do not move again, and kernels of a page equal brute force."""

import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.operators import cleaning, overlap, samples
from pagewright.plans.layout import boxes, boxes_by_page
from pagewright.plans.queries import QUERIES
from pagewright.sources import pages as P
from pagewright.sources import responses


def exchanges(df) -> int:
    """One deals out the texts, one brings sums of pages together; words are in neither."""
    return len(re.findall("Exchange (?:hash|range|round|Round|Single)", df._jdf.queryExecution().executedPlan().toString()))


def test_boxes_by_page_are_the_boxes(spark, data):
    a, b = boxes(spark, data), boxes_by_page(spark, data)
    assert a.dtypes == b.dtypes
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_pairs_of_a_page(seed):
    rng = np.random.default_rng(seed)
    size = lambda n: (at := rng.integers(0, 40, (2, n)) / 16, rng.integers(0, 24, (2, n)) / (8 if seed % 2 else 64))
    hulls = lambda n: (lambda at, by: np.stack([at[0], at[0] + by[0], at[1], at[1] + by[1]]))(*size(n))
    a, b = hulls(60), hulls(50)
    a[0, 3] = np.nan

    def brute(a, b):
        for i, p in enumerate(a.T):
            for j, q in enumerate(b.T):
                if p[0] < q[1] and q[0] < p[1] and p[2] < q[3] and q[2] < p[3] and p[0] < p[1] and p[2] < p[3] and q[0] < q[1] and q[2] < q[3]:
                    common = (min(p[1], q[1]) - max(p[0], q[0])) * (min(p[3], q[3]) - max(p[2], q[2]))
                    yield i, j, common / ((p[1] - p[0]) * (p[3] - p[2])), common / ((q[1] - q[0]) * (q[3] - q[2]))

    rows = lambda x: sorted(zip(*(c.tolist() for c in x)))
    assert rows(overlap.pairs_of_page(a, b)) == sorted(brute(a, b))
    assert rows(overlap.pairs_of_page(a)) == sorted(brute(a, a))
    once = [(min(i, j), max(i, j)) for i, j, *_ in rows(overlap.pairs_of_page(a, once=True))]
    assert sorted(once) == sorted((i, j) for i, j, *_ in brute(a, a) if i < j)
    overlap.CANDIDATES, before = 7, overlap.CANDIDATES
    assert rows(overlap.pairs_of_page(a, b)) == sorted(brute(a, b))
    overlap.CANDIDATES = before


@pytest.mark.parametrize("name", ["group_overlaps", "add_missing_boxes", "single_source_page"])
def test_words_are_not_moved(spark, data, name):
    assert exchanges(QUERIES[name](spark, data)) <= 2


@pytest.mark.parametrize("seed", range(3))
def test_samples_equal_rules_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for page in (0, 1, None):
        for sample in range(2 if page != 1 else 1):
            for k in range(30):
                x, y, w, h = *(rng.integers(0, 12, 2) / 16), *(rng.integers(1, 5, 2) / 16)
                rows.append((page, sample, sample * 1000 + k, float(rng.integers(0, 4)) if page is None or k else None, float(x), float(y), float(w), float(h)))
    df = spark.createDataFrame(rows, "page int, sample_id int, box_id long, confidence double, x double, y double, w double, h double")
    df = df.select("page", "sample_id", "box_id", "confidence", G.raw_box({"ax": F.col("x"), "ay": F.col("y"), "bx": F.expr("x + w"), "by": F.col("y"), "cx": F.expr("x + w"), "cy": F.expr("y + h"), "dx": F.col("x"), "dy": F.expr("y + h")}, F.lit(False), F.lit("a"), F.lit(None)).alias("box"))
    got = sorted((str(r.page), r.box_id, r.added) for r in samples.aggregate_samples(df, ["page"]).collect())

    def common(p, q):
        return max(0, min(p[4] + p[6], q[4] + q[6]) - max(p[4], q[4])) * max(0, min(p[5] + p[7], q[5] + q[7]) - max(p[5], q[5]))

    covers = lambda p, q: common(p, q) / (p[6] * p[7])  # noqa: E731 - the share of p that q covers
    want = []
    for page in (0, 1, None):
        readings = [[r for r in rows if r[0] == page and r[1] == s] for s in (0, 1)]
        score = [0 if not x or any(r[3] is None for r in x) else sum(r[3] for r in x) / len(x) for x in readings]
        group = {}
        for r in readings[0] + readings[1]:
            met = [p[2] for p in readings[0] if r[1] == 1 and covers(p, r) > 0.1 and covers(r, p) > 0.1]
            group[r[2]] = min(met, default=r[2])
        best = int(bool(readings[1]) and score[1] > score[0])
        out = list(readings[best])
        for r in readings[1 - best]:
            if list(group.values()).count(group[r[2]]) == 1 and not any(covers(r, p) >= 0.5 for p in out):
                out.append(r)
        want += [(str(page), r[2], r[1] != best) for r in out]
    assert got == sorted(want)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_runs_of_many_pages_go_together(spark, data):
    assert "FlatMapGroups" not in plan(QUERIES["date_run_filter"](spark, data)) and "Window" not in plan(QUERIES["date_run_filter"](spark, data))
    rows = [(p, k, t) for p, ts in ((1, ["a", "1/2/2020", "-3/4/2021", "b"]), (None, ["1/2/", "2020-", "3/4/20", "21", "1/2/2020-3/4/2021"]), (3, ["1/2/2020-3/4/2021", None])) for k, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "page int, seq int, text string").withColumn("box", F.struct("text"))
    kept = sorted((str(r.page), r.seq) for r in cleaning.without_date_runs(df, ["page"]).collect())
    # the last of page null joins no run, and on page 3 the range with the missing text behind it is one
    assert kept == [("1", 0), ("1", 3), ("None", 4)]


def test_equal_marks_are_found_by_order(spark, data):
    assert "array_distinct" not in plan(QUERIES["response_flatten_marks"](spark, data))
    quad = lambda x: [(float(x), 0.0), (x + 1.0, 0.0), (x + 1.0, 1.0), (float(x), 1.0)]
    marks = [("filled_checkbox", 0.5, quad(0)), ("filled_checkbox", None, quad(0)), ("other", 0.5, quad(0)), ("unfilled_checkbox", 0.5, quad(1))]
    df = spark.createDataFrame([(1, marks * 3 + marks[1::-1])], f"page int, response {responses.MARKS}")
    got = [(r.seq, r.box.text, r.confidence) for r in responses.flatten_marks(df, ["page"]).orderBy("seq").collect()]
    assert [r[0] for r in got] == [0, 1, 2] and {r[1:] for r in got[:2]} == {("☑", 0.5), ("☑", None)} and got[2][1:] == ("☐", 0.5)


@pytest.mark.parametrize("name", ["corrected_tilt", "labelstudio_import_pivot", "rotation_from_deltas", "response_flatten_tree", "response_flatten_marks"])
def test_neither_words_nor_images_are_moved(spark, data, name):
    df = QUERIES[name](spark, data)
    assert "_tilted_page" not in plan(df)
    assert exchanges(df) == plan(df).count("REPARTITION_BY_NUM")


def test_opaque_upright_boxes_are_drawn_at_one_go(monkeypatch):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (60, 90), np.uint8)
    low = rng.uniform(-5, 80, (200, 2))
    high = low + rng.uniform(0.1, 30, (200, 2))
    quads = [[a, b, c, b, c, d, a, d] for (a, b), (c, d) in zip(low.tolist(), high.tolist())]
    got = P.drawn(image, quads, None, fill="#10ff20", opacity=1.0)
    assert (P.drawn(image, [], None, fill="#10ff20", opacity=1.0) != got).any()
    calls = []
    monkeypatch.setattr(P, "_upright", lambda p: calls.append(len(p)))  # one box after the other
    assert (P.drawn(image, quads, None, fill="#10ff20", opacity=1.0) == got).all() and calls == [200]


def test_drawn_boxes_holds_one_image_at_a_time(spark, data):
    assert "Join" not in QUERIES["drawn_boxes"](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_tilts_are_scanned_together(spark, data):
    assert exchanges(QUERIES["tilt_angle"](spark, data)) == 1
    rng = np.random.default_rng(5)
    x, y, weight = rng.uniform(-500, 500, 3000), rng.integers(-20, 20, 3000) * 10 + rng.random(3000), rng.integers(1, 256, 3000).astype(float)
    angles = np.arange(-90, 90, 0.25)
    one_by_one = np.array([P._edges(x, y, weight, a) for a in angles])
    together = P._scan(x, y, weight, angles)
    assert np.argmax(together) == np.argmax(one_by_one) == 360
    assert np.abs(together / one_by_one - 1).max() < 0.2


@pytest.mark.parametrize(("n_lines", "words", "degrees"), [(60, [(0, 40), (48, 88)], -2.5), (34, [(0, 56), (64, 96)], -1.0), (60, [(0, 40), (48, 88)], -3.0), (8, [(0, 1000)], 3.0)])
def test_short_lines_tell_their_tilt(n_lines, words, degrees):
    from pagewright.plans import queries as Q

    rects = [((x0 * 4096 + 8 * k) * 4096 + x1) * 4096 + 8 * k + 4 for k in range(n_lines) for x0, x1 in words]
    page = Q._tilted(np.array(rects), degrees)
    assert abs(P.find_tilt(page) - degrees) <= 0.1
    upright, tilt = P.corrected(page)
    assert abs(tilt - degrees) <= 0.1 and abs(P.find_tilt(upright)) <= 0.2


@pytest.mark.parametrize("shape", [(50, 80), (81, 33), (40, 60, 3)])
def test_rotated_takes_the_nearest_pixel(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    image[:7] = 255  # nothing is drawn there
    h, w = shape[:2]
    for degrees in (0, 90, 180, -90, 1.5, 33.3):
        got = P.rotated(image, degrees)
        a, (nh, nw) = np.radians(degrees), got.shape[:2]
        y, x = np.mgrid[:nh, :nw] + 0.5
        x, y = x - nw / 2, y - nh / 2
        u, v = np.floor(x * np.cos(a) - y * np.sin(a) + w / 2).astype(int), np.floor(x * np.sin(a) + y * np.cos(a) + h / 2).astype(int)
        inside = (u >= 0) & (u < w) & (v >= 0) & (v < h)
        want = np.full(got.shape, 255, np.uint8)
        want[inside] = image[v[inside], u[inside]]
        assert (got != want).mean() < 0.001
