import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import angles
from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators import cleaning, merging, ordering, overlap, samples
from pagewright.plans import pipeline
from pagewright.plans.layout import rectangle
from pagewright.sources import cache, engines
from pagewright.sources import pages as P

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["box_canonical_corners", "box_rotate", "box_split", "labelstudio_import_pivot", "engine_anti_join", "sample_claim_groups", "merge_order", "reading_order", "median_height_filter", "date_range_split", "date_run_filter", "bidi_fix", "label_palette", "brightness_hex", "tilt_distance", "response_flatten_tree", "rotation_from_deltas", "response_flatten_marks", "cache_hits_and_misses", "two_source_merge", "single_source_page", "add_missing_boxes", "group_overlaps", "quad_overlap_share", "box_augment", "writing_direction", "reading_order_both_ways", "median_char_width", "corrected_tilt", "tilt_angle", "drawn_boxes"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, data, name):
    from pagewright.plans.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got, want = QUERIES[name](spark, data), db.execute(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    rows = lambda rs: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rs)
    assert rows(got.select(*names).collect()) == rows([r[k] for k in order] for r in want.fetchall())


def values(spark, kind, rows, body):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, v {kind}")
    return [r.out for r in df.select("k", body(F.col("v")).alias("out")).orderBy("k").collect()]


def test_angles(spark):
    assert values(spark, "double", [0.0, 44.9, 45.0, 89.0, 135.0, 269.0, 315.0, 359.0, -44.0, -46.0, 405.0, 721.0], angles.quarter_turn) == [0, 0, 90, 90, 180, 270, 0, 0, 0, 270, 90, 0]
    assert values(spark, "double", [0.0, 1.0, -1.0, 44.0, 46.0, 89.0, 91.0, 180.0, 181.0, 270.0, 359.0], angles.off_quarter) == [0, 1, -1, 44, -44, -1, 1, 0, 1, 0, -1]


def test_text(spark):
    assert values(spark, "string", ["123-4323/77", "abc", "12", "", "a1b22c"], T.flipped_number_blocks) == ["77-4323/123", "abc", "12", "", "a22b1c"]
    assert values(spark, "string", ["a=b", "a=b,c=d", ""], T.override_map) == [{"a": "b"}, {"a": "b", "c": "d"}, {}]
    texts = ["1", "Wort", "שלום", "%", "-", "", "٣", "a1", "日本", "²", "१", "é", "±", "ʰ1", "½", "𐤀", "۴", "①", "\u0301", "a" * 5 + "ש"]
    import unicodedata

    want = [min((T.BIDI_CODES.get(unicodedata.bidirectional(c), 5) for c in t), default=0) for t in texts]
    assert values(spark, "string", texts, T.box_type) == want


@pytest.mark.parametrize("text", ["01/02/2020 - 03/04/2021", "1/2/2020-3/4/2021", " 01.02.2020 - 03.04.2021 ", "01 / 02 / 2020 - 03 / 04 / 2021"])
def test_date_ranges_split_in_three(spark, text):
    df = spark.range(1).select(F.lit(0).alias("seq"), rectangle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.5), F.lit(text)).alias("box"))
    rows = cleaning.split_date_ranges(df).orderBy("part").collect()
    first, second = text.split("-")
    assert [r.box.text for r in rows] == [first.strip(), "-", second.strip()]
    assert [round(r.box.bx, 6) for r in rows] == [0.49, 0.5257, 1.0]


def test_merge_keeps_order(spark):
    golden = [([1, 2, 3], [], [1, 2, 3]), ([1, 3], [2, 4], [1, 2, 3, 4]), ([3, 1], [2], [1, 2, 3]), ([1, 2], [7, 8], [7, 8, 1, 2])]
    want = [[1, 2, 3], [1, 2, 3, 4], [3, 1, 2], [7, 8, 1, 2]]
    rows = [(k, x, x in b, a.index(x) if x in a else None, s.index(x)) for k, (a, b, s) in enumerate(golden) for x in s]
    df = spark.createDataFrame(rows, "p int, x int, from_b boolean, a_position int, sorted_position int")
    out = merging.merge_order(df, ["p"]).orderBy("p", "position").collect()
    assert [[r.x for r in out if r.p == k] for k in range(len(golden))] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=8, max_size=8), st.lists(st.floats(0, 1), min_size=8, max_size=8))
def test_shares_are_shares(a, b):
    s = G.quad_share(np.array([a, b]), np.array([b, a]))
    assert (s >= 0).all() and (s <= 1).all()


def test_shares_of_known_shapes():
    unit = np.array([0, 0, 1, 0, 1, 1, 0, 1.0])
    others = [unit, unit + np.array([0.5, 0] * 4), unit + np.array([1, 0] * 4), unit * 0.5, np.array([0.5, 0, 1, 0.5, 0.5, 1, 0, 0.5])]
    assert np.allclose(G.quad_share(np.array([unit] * 5), np.array(others)), [1, 0.5, 0, 0.25, 0.5])


def test_four_turns_are_none(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(y), float(min(w, 1 - x)), float(min(h, 1 - y))) for x, y, w, h in rng.random((100, 4)) * [0.9, 0.9, 1, 1] + [0, 0, 0.01, 0.01]]
    df = spark.createDataFrame(rows, "x double, y double, w double, h double").select(G.from_xywh(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"))
    turned = F.col("box")
    for _ in range(4):
        turned = G.rotated(turned, F.lit(90))
    for r in df.select(G.floats(F.col("box")).alias("a"), G.floats(turned).alias("b")).collect():
        assert np.allclose(r.a, r.b, atol=0.01)


def page(spark, rows):
    """rows: (seq, x0, y0, x1, y1, sample)."""
    df = spark.createDataFrame(rows, "seq int, x0 double, y0 double, x1 double, y1 double, sample_id int")
    box = rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("seq").cast("string"))
    return df.select(F.lit(0).alias("p"), F.col("seq").alias("box_id"), "seq", "sample_id", F.lit(0.5 + 0.0).alias("confidence"), box.alias("box"))


def test_groups_and_samples(spark):
    df = page(spark, [(0, 0.0, 0.0, 0.2, 0.1, 0), (1, 0.5, 0.5, 0.7, 0.6, 0), (2, 0.01, 0.0, 0.21, 0.1, 1), (3, 0.8, 0.8, 0.9, 0.9, 1), (4, 0.8, 0.8, 0.9, 0.89, 1)])
    groups = {r.box_id: r.group_key for r in samples.claims(df, ["p"]).collect()}
    assert groups == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
    out = samples.aggregate_samples(df, ["p"]).collect()
    assert sorted((r.box_id, r.added) for r in out) == [(0, False), (1, False), (3, True)]
    seeds = {(r.seed, r.box_id) for r in samples.group_overlaps(df, ["p"], 0.5).collect()}
    assert seeds == {(0, 0), (0, 2), (1, 1), (3, 3), (3, 4)}
    with pytest.raises(Exception, match="two readings"):
        samples.aggregate_samples(df.withColumn("sample_id", F.lit(2)), ["p"]).collect()


def test_overlap_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, *map(float, (x, y, x + w, y + h)), 0) for k, (x, y, w, h) in enumerate(rng.random((80, 4)) * [0.8, 0.8, 0.2, 0.2] + [0, 0, 0.001, 0.001])]
    df = page(spark, rows)
    got = {(r.l_box_id, r.r_box_id) for r in overlap.overlap_self_join(df, ["p"], 0.1).collect()}
    area = lambda r: (r[3] - r[1]) * (r[4] - r[2])
    common = lambda a, b: max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))
    assert got == {(a[0], b[0]) for a in rows for b in rows if a != b and (common(a, b) > 0.1 * area(a) or common(a, b) > 0.1 * area(b))}


def test_order_is_a_permutation_of_lines(spark):
    rows = [(k, x / 8, y / 8, x / 8 + 0.1, y / 8 + 0.05, 0) for k, (y, x) in enumerate((y, x) for y in range(5) for x in range(6))]
    rng = np.random.default_rng(0)
    mixed = [(int(k), *r[1:]) for k, r in zip(rng.permutation(len(rows)), rows)]
    out = ordering.reading_order(page(spark, mixed), ["p"], F.lit(800), F.lit(800), key="seq").orderBy("position").collect()
    assert [r.seq for r in out] == [r[0] for r in mixed] and [r.line_id for r in out] == [k // 6 for k in range(30)]


def test_two_sources(spark):
    first = page(spark, [(0, 0.0, 0.0, 0.2, 0.05, 0), (1, 0.5, 0.0, 0.7, 0.05, 0)])
    second = page(spark, [(0, 0.0, 0.0, 0.2, 0.05, 0), (7, 0.3, 0.0, 0.4, 0.05, 0), (8, 0.0, 0.5, 0.1, 0.55, 0)])
    out = merging.page_text(pipeline.two_sources(first, second, ["p"], F.lit(800), F.lit(800)), ["p"]).collect()
    assert out[0].text == "0 7 1 8"


def test_sources(spark, tmp_path, monkeypatch):
    monkeypatch.delenv(engines.ENV_SOURCE, raising=False)
    assert engines.select_source() == "google" and engines.select_source("AWS") == "aws"
    monkeypatch.setenv(engines.ENV_MAPPING, "google=azure,azure=aws")
    assert engines.select_source() == "azure"
    with pytest.raises(engines.UnknownSource):
        engines.select_source("none")
    with pytest.raises(ValueError):
        engines.parsed_overrides("a=b=c")
    calls = []
    retry = engines.Retry(3, 1.0, 2.0)
    with pytest.raises(RuntimeError):
        retry(lambda: (_ for _ in ()).throw(RuntimeError()), calls.append)
    assert calls == [1.0, 2.0]

    def client():
        return lambda content: [{"quad": [[0, 0], [9, 0], [9, 5], [0, 5]], "text": bytes(content).decode(), "score": 0.5}]

    pages = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"y")), (3, bytearray(b"x"))], "p int, content binary")
    compute = lambda df: engines.recognise(df, "easyocr", client)
    for _ in range(2):
        got = cache.cached(spark, pages, "easyocr", compute, str(tmp_path / "cache"))
        flat = engines.SOURCES["easyocr"].flatten(got, ["p"]).orderBy("p").collect()
        assert [r.box.text for r in flat] == ["x", "y", "x"]
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_images(spark, tmp_path):
    page_ = np.full((300, 400), 255, np.uint8)
    for y in range(20, 280, 20):
        for x in range(20, 380, 40):
            page_[y : y + 8, x : x + 30] = 0
    for degrees in (0.0, 2.5, -4.0):
        assert abs(P.find_tilt(P.rotated(page_, degrees)) - P.find_tilt(page_)) == pytest.approx(abs(degrees), abs=0.35)
    assert P.find_tilt(np.full((50, 50), 255, np.uint8)) == 0
    assert (P.turned(P.turned(page_, 90), 270) == page_).all()
    (tmp_path / "a.png").write_bytes(P.png(page_))
    (tmp_path / "b.png").write_bytes(b"none")
    rows = P.read_images(spark, f"file://{tmp_path}").collect()
    assert len(rows) == 1 and (P.grey(P.as_array(rows[0].pixels, rows[0].width, rows[0].height, rows[0].channels)) == page_).all()


def test_drawing():
    white = np.full((40, 60), 255, np.uint8)
    out = P.drawn(white, [[10, 10, 30, 10, 30, 20, 10, 20]], stroke="#ff0000", width=2, fill="#0000ff", opacity=0.5)
    assert out.shape == (40, 60, 3) and (white == 255).all()
    assert out[15, 20].tolist() == [255, 128, 128] and out[10, 20].tolist() == [0, 0, 255] and out[25, 20].tolist() == [255] * 3
    assert (P.drawn(white, [[-5, -5, 5, -5, 5, 5, -5, 5]], stroke=None, fill="#000000", opacity=1)[:5, :5] == 0).all()
    assert (P.drawn(out, [], None) == out).all()


@pytest.mark.parametrize("degrees", [0.0, 0.7, 1.9, 3.3, 4.6, 6.0, 7.7, 9.0, -2.2])
def test_tilt_is_found_and_corrected(degrees):
    rng = np.random.default_rng(2)
    page_ = np.full((900, 700), 255, np.uint8)
    for y in range(60, 840, 24):
        x = 50
        while x < 600:
            n = int(rng.integers(2, 9)) * 7
            page_[y : y + 9, x : x + n] = 0
            x += n + 9
    image = P.rotated(page_, degrees)
    assert P.find_tilt(image) == pytest.approx(degrees, abs=0.1)
    up, tilt = P.corrected(image)
    assert tilt == pytest.approx(degrees, abs=0.1) and abs(P.find_tilt(up)) <= 0.2  # the nearest pixel moves lines by up to one
    assert P.corrected(P.rotated(page_, 12.0))[1] == 0


def test_image_kernels():
    image = np.array([[0, 127, 128, 255]], np.uint8)
    assert P.binarised(image).tolist() == [[0, 0, 255, 255]]
    assert P.whitened(image, 0.5).tolist() == [[127, 191, 191, 255]]
    assert P.at_least(100, 300, 150) == (150, 450) and P.at_least(100, 300, 50) == (100, 300)


def test_samples_are_read_at_their_sizes(spark):
    def client():
        return lambda content: [{"quad": [[0, 0], [9, 0], [9, 5], [0, 5]], "text": str(len(content)), "score": 0.5}]

    pages = spark.createDataFrame([(1, bytearray(b"x" * 1200), 40, 30, 1)], "p int, pixels binary, width int, height int, channels int")
    readings = engines.recognise(P.sample_pages(pages, 2), "easyocr", client, content="pixels")
    got = engines.SOURCES["easyocr"].flatten(readings, ["p", "sample_id"]).orderBy("sample_id").collect()
    assert [r.box.text for r in got] == ["1200", str(33 * 25)]


def test_settings_retries_and_polls(monkeypatch):
    monkeypatch.setenv("SOME_KEY", "env")
    assert engines.setting("given", "SOME_KEY") == "given" and engines.setting(None, "SOME_KEY", {"k": "file"}, "k") == "env"
    monkeypatch.delenv("SOME_KEY")
    assert engines.setting(None, "SOME_KEY", {"k": "file"}, "k") == "file"
    with pytest.raises(ValueError):
        engines.setting(None, "SOME_KEY")
    answers, waits = iter([None, None, "done"]), []
    assert engines.Poll()(lambda: next(answers), lambda a: a is not None, waits.append) == "done" and waits == [0.1, 0.1]
    with pytest.raises(TimeoutError):
        engines.Poll(1.0, 2.0)(lambda: None, lambda a: a is not None, waits.append)
    monkeypatch.setenv(cache.ENV, "/c")
    assert cache.cache_path() == "/c" and cache.cache_path("/d") == "/d" and cache.cache_path(cache.DISABLED) is None


def test_options_are_checked():
    assert pipeline.Options().for_source("google").max_size == 1024 and pipeline.Options().for_combined().max_size == engines.COMBINED_SIZE
    with pytest.raises(ValueError):
        pipeline.Options(checkboxes=True).for_source("google")
    for wrong in ({"samples": 2}, {"auto_rotate": True}, {"correct_tilt": False}):
        with pytest.raises(ValueError):
            pipeline.Options(**wrong).for_combined()


def test_null_pages_are_pages(spark):
    df = page(spark, [(k, 0.1 * k, 0.1, 0.1 * k + 0.05, 0.15, 0) for k in range(6)]).withColumn("p", F.lit(None).cast("int"))
    order = ordering.reading_order(df, ["p"], F.lit(1000), F.lit(1000))
    assert [r.position for r in order.orderBy("box_id").collect()] == list(range(6))
    assert cleaning.without_columns_of_digits(df, ["p"], F.lit(1.0)).count() == 6
    assert samples.aggregate_samples(df, ["p"]).count() == 6
    assert merging.merge_boxes(df.where("seq < 3").select("p", "seq", "box"), df.where("seq >= 3").select("p", "seq", "box"), ["p"], F.lit(1000), F.lit(1000)).count() == 6


def test_a_long_line_takes_time_in_proportion(spark):
    import time

    from pagewright.plans import layout

    docs = spark.createDataFrame([(1, "ab " * 200_000, "en"), (2, None, "en"), (3, "", "en"), (4, "a  b\n c", "en")], "doc_id long, text string, lang string")
    began = time.time()
    rows = layout.words(docs)
    assert rows.where("doc_id = 1").agg(F.max("off"), F.count("*")).first()[:] == (3 * 199_999, 200_000)
    assert time.time() - began < 20
    assert [(r.line_no, r.word_no, r.text, r.off) for r in rows.where("doc_id > 1").orderBy("line_no", "word_no").collect()] == [(0, 0, "a", 0), (0, 2, "b", 2), (1, 1, "c", 0)]


def test_exact_shares_are_those_of_the_join(spark, data):
    from pagewright.plans.layout import PAGE, both_sources, boxes
    from pagewright.plans.queries import QUERIES

    both = both_sources(boxes(spark, data).where("doc_id < 12"))
    both = both.withColumn("box", G.with_corners(F.col("box"), {c: F.col("box")[c] + F.col("sample_id") * (1 / 512 if c in ("ax", "bx") else 0) for c in G.CORNERS}))
    sides = [both.where(F.col("sample_id") == k) for k in (0, 1)]
    rows = lambda df: {tuple(r[c] for c in (*PAGE, "l_box_id", "r_box_id")): (round(r.l_share, 9), round(r.r_share, 9)) for r in df.collect()}
    assert rows(overlap.exact_shares(both, PAGE, 0.01)) == rows(overlap.overlap_join(*sides, PAGE, 0.01, exact=True))
    assert "Join" not in QUERIES["quad_overlap_share"](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_boxes_in_order_stay_and_others_are_sorted(spark):
    odd = [0.0, -0.0, -0.25, 0.25, 0.5, 1.0, float("nan"), None]
    rng = np.random.default_rng(2)
    rows = [[odd[k] for k in rng.integers(0, len(odd), 8)] for _ in range(300)] + [[0.1, 0.1, 0.5, 0.1, 0.5, 0.2, 0.1, 0.2], [0.1, 0.1, 0.5, 0.1, 0.5, 0.1, 0.1, 0.1]]
    rows += [[float(v) for v in rng.random(8)] for _ in range(300)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{c} double" for c in G.CORNERS))
    box = G.raw_box({c: F.col(c) for c in G.CORNERS}, F.lit(True), F.lit("a"), F.lit(None))
    # strict sorts each box; none of these is out of range in pixels
    got = df.select("k", G.normalised(box).alias("a"), G.normalised(box, strict=True).alias("b")).orderBy("k").collect()
    shown = lambda b: [str(x + 0.0) if isinstance(x, float) else x for x in b]
    assert [shown(r.a) for r in got] == [shown(r.b) for r in got]


def test_trees_are_put_together_from_arrays(spark):
    import pyarrow as pa

    from pagewright.plans.queries import tree_arrays
    from pagewright.sources import responses

    word = lambda line, k, text, x0, x1: {"line_no": line, "word_no": k, "text": text, "confidence": 0.5, "lang": "de", "x0": x0, "y0": 8 * line, "x1": x1, "y1": 8 * line + 4}
    pages = [[word(1, 0, "ab", 0, 16), word(0, 1, "é𐤀", 24, 40), word(0, 0, "c", 0, 8)], [], [word(3, 0, "xyz", 0, 24)]]
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("word_no", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()), ("lang", pa.string()), *[(c, pa.int32()) for c in ("x0", "y0", "x1", "y1")]]))
    got = tree_arrays(pa.array([[], *pages], kind).slice(1), pa.array([False, False, False, True]).slice(1)).to_pylist()
    lines = lambda p: [["".join(s["text"] for s in w["symbols"]) for w in b["paragraphs"][0]["words"]] for b in p[0]["blocks"]]
    assert [lines(p) for p in got] == [[["c", "é𐤀"], ["ab"]], [], [["xyz"]]]
    first, last = got[0][0]["blocks"][0]["paragraphs"][0]["words"][1], got[2][0]["blocks"][0]["paragraphs"][0]["words"][0]
    at = lambda s: [(v["x"], v["y"]) for v in s["vertices"]]
    assert at(first) == [(24, 0), (40, 0), (40, 4), (24, 4)] and [at(s) for s in first["symbols"]] == [[(24, 0), (26, 0), (26, 4), (24, 4)], [(26, 0), (28, 0), (28, 4), (26, 4)]]
    assert [at(s)[0] for s in last["symbols"]] == [(22, 24), (20, 24), (18, 24)] and last["languages"] == ["he"]
    df = spark.createDataFrame([(None, got[0]), (1, got[2])], f"page int, response {responses.TREE}")
    assert sorted((str(r.page), r.rotation) for r in responses.tree_rotation(df, ["page"]).collect()) == [("1", 0), ("None", 0)]
    assert "from_json" not in plan_of(df) and "Join" not in plan_of(responses.tree_rotation(df, ["page"]))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_crowded_page_come_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 90, 3000) / 128, rng.integers(0, 3, 3000) / 64
    left = np.stack([x, x + 12 / 128, y, y + 1 / 128])
    monkeypatch.setattr(overlap, "CANDIDATES", 20_000)
    monkeypatch.setattr(overlap, "PAIRS", 1000)
    parts = list(overlap.pieces(overlap.pairs_by_part(left, left[:, ::-1])))
    assert len(parts) > 500 and max(len(i) for i, _ in parts) <= 1000
    i, j, _, _ = overlap.pairs_of_page(left, left[:, ::-1])
    assert (np.concatenate([p[0] for p in parts]) == i).all() and (np.concatenate([p[1] for p in parts]) == j).all()
    k = 2999 - j
    met = (np.abs(x[:, None] - x) < 12 / 128) & (y[:, None] == y)
    assert len(set(zip(i.tolist(), k.tolist()))) == len(i) == met.sum()
