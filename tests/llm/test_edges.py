"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns; and more brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from pagewright.llm import decontamination, histogram_sort, near_dedup, packing, passages, perspectives, shared, token_prefixes, topk_search, toxic_spans, url_filters

BYTES, RANKS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
#: Names that operators use for their own columns.
CLASHES = "id h key n row cluster block words seed other size shard slot part k1 o1 start spans _spans _doc _d n_hit items node component root probe component_id kept score rank conv speaker tie digest perspective host path rule verdict links tokens".split()
_rng = random.Random(3)
PASSAGE = " ".join(f"w{_rng.randrange(10**6)}" for _ in range(60))
DOCS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (5, f"{PASSAGE} one"), (6, f"two {PASSAGE}"), (6, f"two {PASSAGE}"), (7, f"{PASSAGE} one"),
    (None, PASSAGE), (None, None), (8, " ".join(f"v{_rng.randrange(3000)}" for _ in range(60_000))), (9, "日本 é ß \u0000 x"), (10, "word " * 4000),
]


def with_clashes(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in df.columns])


def documents(spark, rows=DOCS):
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")))


def benchmark(spark, rows=((1, "a"), (None, "one"), (2, None), (3, ""), (4, PASSAGE))):
    return with_clashes(spark.createDataFrame(list(rows), "item_id long, text string"))


def labels(spark, rows=((1, 1), (4, 0), (4, 0), (5, 1), (6, None), (None, 1), (8, 0))):
    return with_clashes(spark.createDataFrame(list(rows), "doc_id long, toxic int"))


def vectors(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


PAGES = [(1, None, None), (2, "", ""), (3, "http://h.org/" + "p" * 100_000, "<a>" * 50_000), (4, "HTTP://X.com?#", None), (4, "HTTP://X.com?#", None), (None, "http://a.com/en/", None), (5, "://", None), (6, "no url", "<link")]
TURNS = [(1, None, None, None), (1, 0, "", "a"), (1, 0, "", "a"), (None, 2, "b", None), (2, 1, "system", "x"), (3, 1, "u", "long " * 50_000), (3, 1, "u", ""), (3, 1, "w", "<|im_end|>")]
VECTORS = [(0, None), (50, []), (100, [1.0, None]), (100, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [float("inf"), 0.0]), (None, [1.0, 1.0]), (150, [0.0, 0.0]), (200, [1.0])]


def document_operators(spark, docs):
    field = toxic_spans.train(docs, labels(spark))
    return {
        "shards": histogram_sort.digest(docs, shards=3),
        "spans": decontamination.digest(decontamination.contaminated_spans(docs, benchmark(spark))),
        "counts": token_prefixes.token_prefixes(docs, PIECES),
        "near": near_dedup.near_duplicates(docs),
        "toxic": toxic_spans.digest(toxic_spans.toxic_spans(docs, field)),
    }


def test_one_row_for_each_document(spark):
    docs = documents(spark)
    for name, out in document_operators(spark, docs).items():
        ids = [r[0] for r in out.select(out.columns[0]).collect()]
        assert sorted(ids, key=str) == sorted((d for d, _ in DOCS), key=str), name
    for name, out in document_operators(spark, docs.limit(0)).items():
        assert out.count() == 0, name


def test_results_on_odd_documents(spark):
    docs = documents(spark)
    near = {(r.doc, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert near[5, 57] == (5, True) and near[6, 57] == near[7, 57] == (5, False) and near[1, 0] == (1, True) and near[4, 1] == (4, True)
    found = {(r.doc, r.start, r.end, r.other) for r in passages.repeated_passages(docs).where("doc <> other").collect()}
    assert {(6, 1, 61, 5), (7, 0, 61, 5)} == found
    packed = packing.pack(docs, BYTES, RANKS, size=256, windows=3)
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("doc_id in (1, 2, 3, 5) and n <> t").count() == 0
    assert packing.pack(docs.limit(0), BYTES, RANKS).count() == passages.repeated_passages(docs.limit(0)).count() == 0
    hit = {r.id: r.n_hit for r in decontamination.contaminated_spans(docs, benchmark(spark)).where("id is not null").collect()}
    assert hit[4] == 1 and hit[5] == hit[6] == 60 and hit[1] == hit[2] == hit[10] == 0


def test_urls_turns_and_vectors(spark):
    rules = [("allow", "com", "/"), ("block", "h.org", "/p")]
    pages = with_clashes(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    got = sorted(((r.id, r.host, r.path[:3], r.verdict) for r in url_filters.judge_urls(pages, rules).collect()), key=str)
    want = [(1, "", "", "allow"), (2, "", "", "allow"), (3, "h.org", "/pp", "block"), (4, "x.com", "", "allow"), (4, "x.com", "", "allow"), (5, "", "", "allow"), (6, "", "", "allow"), (None, "a.com", "/en", "allow")]
    assert got == sorted(want, key=str) and url_filters.judge_urls(pages.limit(0), rules).count() == 0

    turns = with_clashes(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    out = perspectives.rotate_perspectives(turns)
    seen = sorted(((r.conv_id, r.perspective, r.n) for r in out.groupBy("conv_id", "perspective").agg(F.count("*").alias("n")).collect()), key=str)
    assert seen == sorted([(1, "unknown", 3), (None, "b", 1), (3, "u", 3), (3, "w", 3)], key=str)
    assert perspectives.rotate_perspectives(turns.limit(0)).count() == 0

    top = topk_search.exact_top_k(vectors(spark, VECTORS))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top.collect())
    ones = [(1, 256 * 256 * 5), (1, 256 * 256 * 5), (150, 0)]
    assert [x for x in got if x[0] == 100] == [(100, k + 1, *x) for k, x in enumerate(ones)]
    assert [x[2:] for x in got if x[0] == 150] == [(1, 0), (1, 0), (100, 0), (100, 0)] and not [x for x in got if x[0] == 200]
    assert topk_search.exact_top_k(vectors(spark, [(50, None)])).count() == 0


def test_pipeline_stages_on_odd_documents(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    source = spark.read.parquet(f"{data}/documents.parquet")
    docs = documents(spark).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text"))
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, source.limit(0), data).count() == 0
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert {1, 2, 3, 5, 9} - set(ids) <= {3} and None in ids, name
        assert out.where("doc_id = 1").first().text is None
        if name == "near_duplicates":
            assert sorted(i for i in ids if i) == [1, 2, 3, 4, 5, 8, 9, 10]
        if name == "repeated_passages":
            kept = {r.doc_id: r.text for r in out.where("doc_id in (5, 6)").collect()}
            assert kept[5] == DOCS[5][1] and kept[6].strip() == "two" and 7 not in ids
    assert pipeline.STAGES[-1][1](spark, docs, data).count() > 0


def test_passages_equal_brute_force(spark):
    """All exact passages are covered, and every row is what it says."""
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    shared_ = [new(rng.randint(50, 120)) for _ in range(12)]
    rows = []
    for k in range(60):
        w = new(rng.randint(0, 80))
        for p in rng.sample(shared_, rng.randint(0, 3)):
            q = [x if rng.random() > 0.04 else new(1)[0] for x in p] if rng.random() < 0.4 else p
            w += q + new(rng.randint(0, 60))
        rows.append((k, " ".join(w)))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = {k: t.split() for k, t in rows}
    covered = {k: set() for k in words}
    for r in found:
        a, b = words[r.doc][r.start : r.end], words[r.other][r.other_start : r.other_end]
        row = np.zeros(len(b) + 1, np.int64)
        for x in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + np.array([x == y for y in b])))
        assert r.end - r.start >= 50 and r.other <= r.doc and 0.8 * max(len(a), len(b)) <= r.matched <= row[-1]
        covered[r.doc] |= set(range(r.start, r.end))
    first = {}
    for k, w in words.items():
        runs = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        for i, run in enumerate(runs):
            if first.setdefault(run, k) != k:
                assert set(range(i, i + 50)) <= covered[k], (k, i)


def near_copies(n, size, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**5)}" for _ in range(size)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(size - 4)} for _, t in rows]
    return rows, sets


def lowest(sets, percent):
    """The smallest number that links reach, from all pairs."""
    places = {}
    for k, s in enumerate(sets):
        for x in s:
            places.setdefault(x, []).append(k)
    common = np.zeros((len(sets), len(sets)), np.int32)
    for ks in places.values():
        common[np.ix_(ks, ks)] += 1
    size = np.array([len(s) for s in sets])
    link = 100 * common >= percent * (size[:, None] + size[None] - common)
    low, seen = np.arange(len(sets)), np.zeros(len(sets), bool)
    for k in range(len(sets)):
        todo = [] if seen[k] else [k]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(link[x] & ~seen)
            seen[new], low[new] = True, k
            todo += new.tolist()
    return low


@pytest.mark.parametrize(("n", "percent", "small"), [(2100, 85, False), (260, 85, True), (260, 80, True)])
def test_large_groups_of_near_copies_equal_brute_force(spark, monkeypatch, n, percent, small):
    """Copies alike by 0.7 to 0.9, in many components; with small blocks all ways through nodes and clusters are taken."""
    if small:
        for name, value in (("NODE", 8), ("BLOCK", 16), ("SETS", 1500)):
            monkeypatch.setattr(near_dedup, name, value)
    rows, sets = near_copies(n, 120, (1, 2, 2) if percent == 85 else (3, 3, 4), n)
    low = lowest(sets, percent)
    assert len(set(low.tolist())) > 1
    got = {r.doc: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    right = sum(got[k] == low[k] for k in range(n))
    assert right == n if not small else right >= 0.99 * n


def test_scores_equal_a_word_by_word_field(spark):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) + (" vilely nasty" if k % 3 == 0 else "")) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = toxic_spans.train(docs, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, toxic int"))
    for r in toxic_spans.toxic_spans(docs, field).collect()[:60]:
        raw = rows[r.id][1].encode()
        f, _, _, bounds = toxic_spans.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        e = field.weights[f].sum(1) + field.bias
        step = np.exp(field.transition)
        ahead, back = [], []
        v = np.ones(2)
        for t, x in enumerate(e):
            v = (v if t == 0 else v @ step) * np.array([1.0, np.exp(np.clip(x, -30, 30))])
            v /= v.sum()
            ahead.append(v)
        z = np.ones(2)
        for x in e[::-1]:
            back.append(z)
            z = step @ (np.array([1.0, np.exp(np.clip(x, -30, 30))]) * z)
            z /= z.sum()
        p = np.array([a[1] * b[1] / (a @ b) for a, b in zip(ahead, back[::-1])])
        assert r.score == pytest.approx(float(field.scores(p, bounds)[0]), abs=1e-6)
        assert sum(s.end - s.start for s in r.spans) == int((p >= 0.5).sum())


def test_tables_are_released(spark):
    import os

    top = shared.shared_dir(spark).removeprefix("file://")
    near_dedup.near_duplicates(documents(spark)).collect()
    passages.repeated_passages(documents(spark)).collect()
    shared.release(spark)
    assert not [d for d in os.listdir(top) if d.startswith(("near-", "passages-", "shards-", "topk-"))]


def test_the_third_stage_cuts_passages_behind_other_holders(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one, two = new(30), new(30)
    parts = [[one], [two], [one[:29], new(2), two[1:]], [one], [two], [one[:29], new(2), two[1:]]]
    rows = [(k, " ".join(w for p in (new(40), *ps, new(40)) for w in p)) for k, ps in enumerate(parts)]
    out = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), data).collect()}
    words = rows[5][1].split()
    assert out == dict(rows[:5]) | {5: out[5]} and out[5].split() == words[:40] + words[100:]
