import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from pagewright.llm import decontamination, histogram_sort, near_dedup, packing, passages, perspectives, token_prefixes, topk_search, toxic_spans, url_filters
from pagewright.llm.shared import Workspace, connected_components, word_hashes

SCHEMA = "doc_id long, text string, lang string, id string, key string"
LONG = "word " * 3000
ODD = [(1, None, "en", "x", "k"), (2, "", None, None, None), (3, " \n\t", "en", "x", "k"), (4, "a", "en", "x", "k"), (4, "a", "en", "x", "k"), (None, "a b", "en", "x", "k"), (5, LONG, "en", "x", "k"), (6, "Ä " * 40, "de", "x", "k")]
BYTES, RANKS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def documents(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def texts(seed=0, n=40):
    rng = random.Random(seed)
    words = ["the", "of", "and"] + ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(60, 260))) for _ in range(n)]


# ---------------------------------------------------------------- shared


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(7, k) for k in range(200, 260)] + [(None, 3), (9, 9)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = connected_components(spark, spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root if any(x in e and e[0] != e[1] and None not in e for e in edges)}


def test_word_hashes_see_words_alone():
    raw = np.frombuffer("Ab c\td\nAB".encode() + b" c d", np.uint8)
    h, s, e, first = word_hashes(raw, np.array([0, 9, len(raw)]))
    assert h[0] == h[3] and h[1] == h[4] and h[2] == h[5] and first.tolist() == [0, 4, 6]
    assert bytes(raw[s[3] : e[3]]) == b"AB"


# ---------------------------------------------------------------- 7


def test_prefix_counts_equal_encoding(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(1)
    alphabet = "ab the ing  \n\t.,'\"<s>/0x1é▁ß日😀()-=_hello world token"
    count = token_prefixes.counter(PIECES)
    for _ in range(150):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        deltas = count(t)
        assert [token_prefixes.tokens_of_prefix(deltas, k) for k in range(len(t) + 1)] == [len(sp.encode(t[:k])) for k in range(len(t) + 1)]
        cut = token_prefixes.cut_for_budget(deltas, 5)
        assert len(sp.encode(t[:cut])) <= 5 and all(len(sp.encode(t[:k])) > 5 for k in range(cut + 1, len(t) + 1))
    rows = token_prefixes.token_prefixes(documents(spark), PIECES).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted((len((t or "").encode()), len(sp.encode(t or ""))) for _, t, *_ in ODD)
    assert token_prefixes.token_prefixes(documents(spark, []), PIECES).count() == 0


# ---------------------------------------------------------------- 5


def test_packing_is_a_partition(spark):
    rows = [(k + 100, t, "en", "x", "k") for k, t in enumerate(texts(3, 60))] + ODD[:3] + [(99, "a <|endoftext|> b", "en", "x", "k"), (98, LONG, "en", "x", "k")]
    out = packing.pack(documents(spark, rows).repartition(3), BYTES, RANKS, size=256, windows=4).collect()
    encode = packing.ByteTokenizer(BYTES)
    want = {}
    for d, t, *_ in rows:
        want[d] = [*encode(t or ""), 1]
    pieces, sequences = {}, {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        pieces.setdefault(r.doc_id, []).append((r.start, ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: [i for _, ids in sorted(ps) for i in ids] for d, ps in pieces.items()} == want
    lengths = []
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        lengths.append(sum(n for _, n in s))
    assert max(lengths) <= 256 and sum(n < 256 for n in lengths) <= 1
    d = packing.digest(packing.pack(documents(spark, ODD[:1]), BYTES, RANKS)).collect()
    assert [(r.doc_id, r.length, r.ids_crc32) for r in d] == [(1, 1, zlib.crc32(b"\1\0\0\0"))]
    assert packing.pack(documents(spark, []), BYTES, RANKS).count() == 0


def test_both_tokenizers_agree():
    fast, slow = packing.ByteTokenizer(BYTES, RANKS), packing.ByteTokenizer(BYTES)
    rng = random.Random(2)
    for _ in range(400):
        t = "".join(rng.choice("ab I'll  1,2\n\té ßĀ…—“x”<|>endoftext") for _ in range(rng.randint(0, 40)))
        assert fast(t) == slow(t)


# ---------------------------------------------------------------- 4


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for k in range(6)] + [(7, None), (None, "a b"), (0, "c c c")]
    docs = [(k, " ".join(rng.choice("abcD") for _ in range(rng.randint(0, 60))), "en", "x", "k") for k in range(30)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for i, t in items:
        w = (t or "").split() if i is not None else []
        n = min(4, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))

    def brute(t):
        w = (t or "").lower().split()
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    found |= g
                    hit |= set(range(k, k + n))
        return len(w), len(hit), sorted(found)

    want = sorted(brute(t) for _, t, *_ in docs)
    for block in (2_000_000, 3):  # in one automaton, and in several
        got = decontamination.contaminated_spans(documents(spark, docs), bench, 4, block_words=block).collect()
        assert sorted((r.n_words, r.n_hit, r.items) for r in got) == want
    cleaned = []
    for block in (2_000_000, 3):
        clean = decontamination.remove_contamination(documents(spark, docs), bench, 4, max_coverage=0.4, block_words=block)
        assert clean.columns == documents(spark).columns
        cleaned.append(sorted(clean.collect(), key=str))
    assert cleaned[0] == cleaned[1] and len(cleaned[0]) == sum(1 for _, t, *_ in docs if brute(t)[1] <= 0.4 * brute(t)[0] or not brute(t)[1])
    assert decontamination.contaminated_spans(documents(spark, []), bench).count() == 0
    assert decontamination.contaminated_spans(documents(spark), bench.limit(0)).where("n_hit > 0").count() == 0


# ---------------------------------------------------------------- 3


def test_shards_are_even_and_gapless(spark):
    rows = [(k + 100, "same text " * 5 if k % 3 == 0 else f"text {k} " * (k % 17), "en", "x", "k") for k in range(600)] + ODD
    out = histogram_sort.digest(documents(spark, rows), shards=6).collect()
    assert sorted(r.size for r in out) == sorted(len((t or "").encode()) + 8 for _, t, *_ in rows)
    total = sum(r.size for r in out)
    for s in range(6):
        mine = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        # a row is not cut: a shard misses its share by the tolerance and by one row at either end
        assert abs(sum(r.size for r in mine) - total / 6) <= 0.01 * total / 6 + max(r.size for r in out)
    assert {r.text_crc32 for r in out if r.doc_id == 6} == {zlib.crc32(("Ä " * 40).encode())}
    assert histogram_sort.digest(documents(spark, [])).count() == 0


def test_shards_of_small_and_of_repeated_rows_are_even(spark):
    rng = random.Random(1)
    rows = [(k, f"row {rng.randrange(10**6)}", "en", "x", "k") for k in range(300)] + [(7, "one and the same row", "en", "x", "k")] * 300
    for given in (rows, rows[300:]):
        out = histogram_sort.digest(documents(spark, given), shards=6, tolerance=0.01).collect()
        assert len(out) == len(given)
        sizes = [sum(r.size for r in out if r.shard == s) for s in range(6)]
        assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 6 + 2 * max(r.size for r in out)
        for s in range(6):
            assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


# ---------------------------------------------------------------- 2


def test_urls(spark):
    rows = [
        (1, "http://A.example.net/fr/x", None),
        (2, "https://www.mirror.org/p/", '<link rel="canonical" href="http://a.example.net/fr/x">'),
        (3, "https://m.mirror.org/p?utm_source=f#t", ""),
        (4, "https://other.org/", '<meta http-equiv="refresh" content="0; url=https://mirror.org/p">'),
        (5, "http://good.com/", '<link rel=canonical href=http://mirror.org/p>'),
        (6, None, None),
        (7, "no url", "<link rel='canonical' href='http://a.example.net/fr/x'>"),
        (8, "http://example.com/en/1", None),
        (9, "http://x.www.example.com/en/1", None),
        (10, "http://b.com", None),
        (11, "https://alone.org/p", None),
    ]
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict, r.because) for r in url_filters.judge_urls(pages, rules).collect()}
    assert got[1] == ("a.example.net", "/fr/x", "net/fr/", "block", "rule")
    assert got[2][3:] == got[3][3:] == got[4][3:] == ("block", "alias")
    assert got[5][2:] == ("com/", "allow", "rule") and got[6] == got[7] == ("", "", None, "allow", "default")
    assert got[8][2:4] == ("example.com/en/", "block") and got[9][2:4] == ("www.example.com/en/", "allow")
    assert got[10] == ("b.com", "", None, "allow", "default") and got[11][3:] == ("allow", "default")
    many = rules + [("block", f"h{k}.org", "/") for k in range(url_filters.INLINE_RULES)]
    again = {r.id: (r.host, r.path, r.rule, r.verdict, r.because) for r in url_filters.judge_urls(pages, many).collect()}
    assert again == got
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0


def test_equal_rules_have_the_same_verdict_in_both_forms(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x/1"), (2, "http://b.org/x/1")], "page_id long, url string")
    rules = [("block", "a.org", "/x/"), ("allow", "a.org", "/x/"), ("allow", "org", "/x/"), ("block", "b.org", "/x/")]
    many = rules + [("block", f"h{k}.org", "/") for k in range(url_filters.INLINE_RULES)]
    for given in (rules, many):
        got = {r.id: (r.rule, r.verdict) for r in url_filters.judge_urls(pages, given, html_col=None).collect()}
        assert got == {1: ("a.org/x/", "allow"), 2: ("b.org/x/", "block")}


# ---------------------------------------------------------------- 6


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), [float(x) for x in rng.integers(-3, 4, 6) / 8]) for k in range(400)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [0.5, 0.5]), (500, [0.0] * 6), (None, [1.0] * 6), (50, [0.25] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    fine = [(i, np.floor(np.array(v) * 256)) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any()]
    got = {}
    for r in topk_search.exact_top_k(df, query_block=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = {}
    for i, v in fine:
        if i % 50 == 0:
            queries.setdefault(i, []).append(v)
    for i, vs in queries.items():
        options = [[(k + 1, j, s) for k, (s, j) in enumerate((-a, b) for a, b in sorted((-int(v @ w), j) for j, w in fine if j != i and len(w) == len(v))[:5])] for v in vs]
        assert sorted(got.get(i, [])) in options
    assert topk_search.exact_top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [1.0, 0.5])
def test_threshold_stops_early_and_scores_nothing_twice(spread):
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(4000, 16)) * spread ** np.arange(16)).astype(np.int64)
    q, best = x[:20], topk_search.Best(20, 5)
    scored = read = 0
    for at in range(0, 4000, 1000):  # blocks, as a task meets them
        found = topk_search.threshold_search(topk_search.Lists(np.arange(at, at + 1000), x[at : at + 1000]), np.arange(20), q, best)
        read, scored = read + found[0], scored + found[1]
    for r in range(20):
        want = sorted((-int(x[r] @ x[i]), i) for i in range(4000) if i != r)[:5]
        assert best.found[r] == want
    assert scored <= 20 * 3999  # nothing is scored twice
    if spread < 1:  # a few dimensions decide
        assert scored < 0.5 * 20 * 4000 and read < 0.5 * 20 * 4000 * 16


def test_huge_components_are_exact():
    x = np.array([[2**40, 1], [2**40, 2], [2**40 - 1, 5]])
    best = topk_search.Best(1, 2)
    topk_search.threshold_search(topk_search.Lists(np.arange(3), x), np.array([9]), np.array([[2**20, 1]]), best)
    assert best.found[0] == [(-(2**60 + 2), 1), (-(2**60 + 1), 0)]
    with pytest.raises(OverflowError):
        topk_search.threshold_search(topk_search.Lists(np.arange(3), x), np.array([9]), np.array([[2**40, 1]]), topk_search.Best(1, 2))


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    rng = random.Random(4)
    base = texts(7, 25)
    rows = list(base)
    for t in base[:12]:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "changed"
            rows.append(" ".join(w).upper() if rng.random() < 0.3 else "  ".join(w))
    rows += [base[0]] * 3 + ["a b", "A  b", "a b c d e", "", None]
    docs = [(k, t, "en", "x", "k") for k, t in enumerate(rows)]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in rows]
    low = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
        if all(low[low[i]] == low[i] for i in range(len(rows))):
            break
    got = {r.doc: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, docs), percent).collect()}
    assert got == {i: (len(sets[i]), low[i], low[i] == i) for i in range(len(rows))}
    if percent == 80:
        kept = near_dedup.keep_one(documents(spark, docs), percent)
        assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(rows)) if low[i] == i] and kept.columns == documents(spark).columns


def test_near_duplicates_of_odd_rows(spark):
    got = near_dedup.near_duplicates(documents(spark), 80).collect()
    assert len(got) == len(ODD) and all(r.kept for r in got)
    assert near_dedup.keep_one(documents(spark)).count() == len(ODD) - 1
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


# ---------------------------------------------------------------- 1


def test_passages_are_found_and_cut(spark):
    base = texts(11, 30)
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(70))
    fuzzy = passage.split()
    fuzzy[30] = "other"
    del fuzzy[50]
    rows = [(k, t, "en", "x", "k") for k, t in enumerate(base)]
    rows[3] = (3, f"{base[3]}\n{passage} end of it", "en", "x", "k")
    rows[12] = (12, f"{base[12]} {passage}", "en", "x", "k")
    rows[20] = (20, f"{' '.join(fuzzy)} {base[20]}", "en", "x", "k")
    docs = documents(spark, rows + [(40, None, "en", "x", "k"), (41, "", "en", "x", "k"), (None, passage, "en", "x", "k"), (42, passage, "en", "x", "k")])
    found = passages.repeated_passages(docs)
    got = {(r.doc, r.other, r.end - r.start) for r in found.collect()}
    assert got == {(12, 3, 70), (20, 3, 69), (42, 3, 70)}
    cut = {r.doc_id: r.text for r in passages.cut_passages(docs, found).collect()}
    assert cut[12].strip() == base[12] and cut[20].strip() == base[20] and 42 not in cut and cut[3] == rows[3][1] and cut[None] == passage
    assert passages.repeated_passages(documents(spark, [])).count() == 0
    assert passages.repeated_passages(documents(spark)).where("doc <> other").count() == 0


def test_chains_beat_single_segments():
    rng = np.random.default_rng(0)
    p = rng.integers(0, 60000, 90).astype("<u2")
    q = p.copy()
    q[[20, 45, 60]] = 7
    a = np.concatenate([rng.integers(0, 60000, 40), p]).astype("<u2")
    assert passages.shared_passages(q, a, 50, 0.8) == [(0, 90, 40, 130, 87)]
    assert passages.shared_passages(q, rng.integers(0, 60000, 200).astype("<u2"), 50, 0.8) == []


# ---------------------------------------------------------------- 9


def test_parts_of_a_chain_that_is_not_alike():
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(0, 60000, n).astype("<u2")
    head, foot, line = new(60), new(60), new(120)
    found = passages.shared_passages(np.concatenate([head, new(60), foot]), np.concatenate([head, new(60), foot]), 50, 0.8)
    assert sorted(found) == [(0, 60, 0, 60, 60), (120, 180, 120, 180, 60)]
    found = passages.shared_passages(line, np.concatenate([line[:60], new(40), line[60:]]), 50, 0.8)
    assert sorted(found) == [(0, 60, 0, 60, 60), (60, 120, 100, 160, 60)]
    # the best range crosses the wider of two gaps
    a, b, c = new(30), new(30), new(8)
    q, r = (np.concatenate([a, new(14), b, new(13), c]) for _ in range(2))
    assert passages.shared_passages(q, r, 50, 0.8) == [(0, 74, 0, 74, 60)]


def test_passages_that_stand_twice_are_found_twice(spark):
    rng = random.Random(9)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p, own = new(60), new(45)
    docs = spark.createDataFrame([(1, f"{p} {new(40)}"), (2, f"{p} {own} {p}")], "doc_id long, text string")
    found = passages.repeated_passages(docs).where("doc <> other")
    assert sorted((r.start, r.end) for r in found.collect()) == [(0, 60), (105, 165)]
    assert passages.cut_passages(docs, found).where("doc_id = 2").first().text.split() == own.split()


def test_frequent_lines_do_not_hide_passages(spark):
    rng = random.Random(10)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(0, 80, 4):
        one, two = new(30), new(30)
        rows += [(k, f"{new(40)} {one} {new(40)}"), (k + 1, f"{new(40)} {two} {new(40)}")]
        rows += [(k + 2, f"{new(40)} {one} {two} {new(40)}"), (k + 3, f"{new(50)} {one} {two} {new(40)}")]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("doc <> other")
    got = {(r.doc, r.other, r.start, r.end) for r in found.collect()}
    assert {(k + 3, k + 2, 50, 110) for k in range(0, 80, 4)} <= got


def test_edited_passages_are_found_behind_other_holders(spark):
    """Its lines stand in earlier and later texts each, so the passage's holder is neither the first nor the one before."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    text = lambda *parts: " ".join(w for p in parts for w in p)
    rows, wanted = [], set()
    for k in range(0, 200, 10):
        one, two = new(30), new(30)
        edited = lambda: text(new(40), one[:29], new(2), two[1:], new(40))
        alone = [text(new(40), one, new(40)), text(new(40), two, new(40))]
        rows += [(k + i, t) for i, t in enumerate([*alone, edited(), text(new(40), one, new(40)), text(new(40), two, new(40)), edited()])]
        wanted.add((k + 5, k + 2, 40, 100))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("doc <> other")
    assert {(r.doc, r.other, r.start, r.end) for r in found.collect()} == wanted


def test_holders_behind_others_with_the_same_sides_are_found(spark):
    """All pieces of 40 words of the passage stand in earlier and later texts; only one earlier text has it as a whole."""
    rng = random.Random(13)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, p, q, one, two, three = (new(20) for _ in range(7))
    edited = [*two[:10], "edited", *two[11:]]
    parts = [[a, one], [p, one], [one, two], [two, three], [three, q], [three, b]]
    parts = [*parts, [p, one, two, three, q], *parts, [a, one, edited, three, b]]
    rows = [(k, " ".join(w for x in (new(40), *ps, new(40)) for w in x)) for k, ps in enumerate(parts)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("doc <> other")
    assert {(r.doc, r.other, r.start, r.end) for r in found.collect()} == {(13, 6, 60, 120)}


def test_a_frequent_line_makes_no_pair_of_each_two_texts(spark, monkeypatch):
    rng = random.Random(14)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, pairs, write = new(25), [], passages.Workspace.table

    def counted(self, df, *args, **kwargs):
        out = write(self, df, *args, **kwargs)
        if df.columns == ["doc", "other"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(passages.Workspace, "table", counted)
    rows = [(k, " ".join(new(60) + line + new(60))) for k in range(100)]
    assert passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert sum(pairs) <= 300


def test_a_passage_goes_on_beyond_a_wide_gap(spark):
    """The line in front is no passage, but with the long one behind its gap it is; another text is that one's first holder."""
    rng = random.Random(15)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, long = new(25), new(400)
    rows = [new(30) + long, new(30) + line + new(30), new(30) + line + new(1) + long, new(40) + line + new(30), new(40) + long, new(50) + line + new(72) + long]
    found = passages.repeated_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")).where("doc <> other")
    assert (5, 2, 50, 547) in {(r.doc, r.other, r.start, r.end) for r in found.collect()}


@pytest.mark.parametrize("every", [7, 10])
def test_passages_with_even_edits_are_found(spark, every):
    rng = random.Random(every)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(0, 200, 2):
        p = new(70)
        q = [new(1)[0] if at % every == every - 1 else w for at, w in enumerate(p)]
        rows += [(k, " ".join(new(40) + p + new(40))), (k + 1, " ".join(new(50) + q + new(30)))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("doc <> other")
    got = {r.doc for r in found.collect() if r.other == r.doc - 1 and r.start <= 56 and r.end >= 114}
    assert len(got) >= 98


def test_long_gaps_are_aligned_as_short_ones():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, 1100).astype("<u2"), rng.integers(0, 300, 1100).astype("<u2")
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == w)))
    assert passages._common(a, b) == row[-1]
    assert passages._common(np.arange(2000), np.arange(2000)[::-1]) == 1


def test_perspectives(spark):
    rows = [(1, 1, "b", "hi <|im_start|>"), (1, 0, "system", "be"), (1, 2, "a", None), (1, 2, None, "x"), (None, 0, "a", "lost"), (2, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = perspectives.rotate_perspectives(df)
    whole = {(r.conv_id, r.perspective): (r.dialogue, [d[1] for d in r.loss_spans], r.dialogue[r.loss_spans[0][0] : r.loss_spans[0][1]]) for r in perspectives.dialogues(out).collect()}
    cut = {}
    for r in perspectives.dialogues(out, 2).orderBy("part").collect():
        cut[r.conv_id, r.perspective] = cut.get((r.conv_id, r.perspective), "") + r.dialogue
    assert cut == {k: v[0] for k, v in whole.items()}
    assert set(whole) == {(1, "a"), (1, "b"), (1, "unknown"), (None, "a")}
    text, _, loss = whole[1, "b"]
    assert text == "<|im_start|>system\nbe<|im_end|>\n<|im_start|>assistant\nhi <\\|im_start|><|im_end|>\n<|im_start|>user name=a\n<|im_end|>\n<|im_start|>user name=unknown\nx<|im_end|>\n"
    assert loss == "hi <\\|im_start|><|im_end|>\n"
    assert perspectives.rotate_perspectives(df.limit(0)).count() == 0


def test_order_of_ties_does_not_depend_on_partitions(spark):
    rows = [(1, 0, "a", f"t{k:02}") for k in range(12)] + [(1, 0, "a", "t03")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [[r.rendered for r in perspectives.rotate_perspectives(df.repartition(n), partitions=n).orderBy("seq").collect()] for n in (1, 4, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 15


# ---------------------------------------------------------------- 10


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, tr = rng.normal(size=6) * 2, rng.normal(size=(2, 2))
    b = np.array([0, 2, 6])
    p, joint = toxic_spans.marginals(e, toxic_spans._firsts(6, b), tr)
    pairs = np.zeros((2, 2))
    for s, z in zip(b[:-1], b[1:]):
        total, m, j = 0, np.zeros(z - s), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=int(z - s)):
            w = np.exp(sum(e[s + t] * y for t, y in enumerate(ys)) + sum(tr[a, c] for a, c in zip(ys, ys[1:])))
            total, m = total + w, m + w * np.array(ys)
            for a, c in zip(ys, ys[1:]):
                j[a, c] += w
        assert np.allclose(m / total, p[s:z])
        pairs += j / total
    assert np.allclose(joint, pairs)


def test_toxic_documents_are_told(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k, t in enumerate(texts(21, 600)):
        bad = k % 5 == 0
        w = t.split()
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vileness", "vilely", "nastyone", "Nasty"]))
        rows.append((k, " ".join(w), "en", "x", "k"))
        labels.append((k, int(bad)))
    docs, marks = documents(spark, rows + [(900, None, "en", "x", "k"), (901, "", "en", "x", "k")]), spark.createDataFrame([*labels, (None, 1), (902, None)], "doc_id long, toxic int")
    field = toxic_spans.train(docs, marks)
    out = {r.id: r for r in toxic_spans.toxic_spans(docs, field).collect()}
    held = {r.doc_id for r in docs.where(toxic_spans.held_out()).collect()}
    assert held == {k for k in [*range(600), 900, 901] if zlib.crc32(str(k).encode()) % 3 == 1}
    right = sum((out[k].score >= 0.7) == bool(y) for k, y in labels if k in held)
    assert right >= 0.97 * sum(k in held for k, _ in labels)
    assert out[900].score == out[901].score < 0.5
    text = rows[0][1].encode()
    assert {text[s.byte_start : s.byte_end].decode().lower() for s in out[0].spans} <= {"vileness", "vilely", "nastyone", "nasty", "vileness vilely"} | {w for s in out[0].spans for w in [text[s.byte_start : s.byte_end].decode().lower()] if " " in w}
    kept = toxic_spans.without_toxic(docs, field)
    assert kept.count() == sum(r.score < 0.7 for r in out.values()) and kept.columns == docs.columns
    nothing = toxic_spans.train(docs, marks.limit(0))
    assert toxic_spans.toxic_spans(documents(spark), nothing).count() == len(ODD)


def labelled(spark, word_of):
    """Documents 0 to 399, every second toxic by a word of its own kind."""
    rng, rows = random.Random(5), []
    for k, t in enumerate(texts(22, 400)):
        w = t.split()
        for _ in range(4 if k % 2 == 0 else 0):
            w.insert(rng.randrange(len(w)), word_of(k))
        rows.append((k, " ".join(w), "en", "x", "k"))
    return rows, spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(400)], "doc_id long, toxic int")


def test_one_long_text_does_not_shut_out_the_rest(spark):
    rows, marks = labelled(spark, lambda k: "vileness")
    first = marks.where("toxic = 1").where(~toxic_spans.held_out()).orderBy(F.xxhash64("doc_id", F.lit(3))).first().doc_id
    rows[first] = (first, "pad " * (toxic_spans.TRAIN_BYTES // 8 + 1), "en", "x", "k")
    docs = documents(spark, rows)
    out = {r.id: r.score for r in toxic_spans.toxic_spans(docs.where(F.col("doc_id") != first), toxic_spans.train(docs, marks)).collect()}
    assert sum((s >= 0.7) == (k % 2 == 0) for k, s in out.items()) >= 0.97 * len(out)


def test_field_is_fitted_across_all_ids(spark):
    rows, marks = labelled(spark, lambda k: "vileness" if k < 200 else "nastyone")
    docs = documents(spark, rows)
    out = toxic_spans.toxic_spans(docs, toxic_spans.train(docs, marks, n_field=40)).where("id % 2 = 0").collect()
    assert sum(r.highest >= 0.5 for r in out) >= 0.97 * len(out)


def test_conflicting_labels_and_repeated_rows_are_not_learned_twice(spark):
    rows, marks = labelled(spark, lambda k: "vileness")
    field = toxic_spans.train(documents(spark, rows), marks)
    more = marks.unionByName(spark.createDataFrame([(900, 0), (900, 1)], marks.schema)).unionByName(marks)
    again = toxic_spans.train(documents(spark, rows * 2 + [(900, "vileness " * 9, "en", "x", "k")]), more)
    assert np.array_equal(field.weights, again.weights) and np.array_equal(field.document, again.document)


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        docs = Workspace(spark, "stage").table(out)
        assert 0.5 * before < docs.count() <= before
    out = pipeline.run(spark, data)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == ids
    assert out.select(F.sum("length")).first()[0] == out.dropDuplicates(["doc_id"]).select(F.sum("doc_tokens")).first()[0]


def test_seeds_meet_in_arrays_and_rounds_move_their_own_texts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(d), int(s), int(a)) for d in rng.permutation(40) for s in rng.choice(60, 12, replace=False) for a in [rng.integers(0, 1 << 62) if rng.random() < 0.5 else s]]
    arrays = lambda rs: tuple(np.array([r[k] for r in rs], t).tobytes() for k, t in ((1, "<i8"), (0, "<i8"), (2, "<u8")))
    got = passages._held(pa.table([[a[k] for a in (arrays(rows[:200]), arrays(rows[200:]))] for k in range(3)], names=["seeds", "docs", "around"]))
    two = lambda x: [x >> 2 * k & 3 for k in range(32)]  # noqa: E731 - sixteen words of two bits on each side
    like = lambda a, b: any(sum(p == q for p, q in zip(two(a)[k : k + 16], two(b)[k : k + 16])) >= passages.ALIKE for k in (0, 16))
    want = []
    for seed in {s for _, s, _ in rows}:
        held = sorted((d, a) for d, s, a in rows if s == seed)
        for k, (doc, around) in list(enumerate(held))[1:]:
            (one, x), (before, y) = held[0], held[k - 1]
            first, second = like(around, x), like(around, y)
            want.append((seed, doc, one, before if second and not first else one, first or second, before > one, k + 1 < len(held)))
    assert sorted(tuple(r.values()) for r in got.to_pylist()) == sorted(want)
    assert passages._held(pa.table([pa.array([], pa.binary())] * 3, names=["seeds", "docs", "around"])).num_rows == 0

    plans, write = [], passages.Workspace.table

    def table(self, df, *args):
        plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(self, df, *args)

    monkeypatch.setattr(passages.Workspace, "table", table)
    passages.repeated_passages(documents(spark)).collect()
    assert [p for c, p in plans if c[:3] == ["seed", "doc", "one"] and "Window" not in p]

    seqs = spark.createDataFrame([(k, 0, b"") for k in range(5)], "doc long, h long, words binary")
    few = passages.texts_of(spark.createDataFrame([(3, 1), (3, 0)], "doc long, other long"), seqs)
    assert sorted(r.doc for r in few.collect()) == [0, 1, 3]
    monkeypatch.setattr(passages, "SENT_ROWS", 2)
    assert passages.texts_of(spark.createDataFrame([(3, 1), (3, 0)], "doc long, other long"), seqs).count() == 5


def test_seeds_of_many_texts_at_once_and_their_places(spark):
    rng = np.random.default_rng(11)
    texts = [rng.integers(0, 40 if n % 3 else 60000, n).astype("<u2") for n in (0, 3, 5, 7, 8, 9, 60, 200, 4, 300)]
    want = []
    for t, words in enumerate(texts):
        x = passages.kmers(words)
        seeds, first = np.unique(x[low := passages.minimizers(x)], return_index=True)
        ends = passages.mix(np.arange(2 * passages.ASIDE, dtype=np.uint64) + words.sum(dtype=np.uint64))
        side = [int(w) & 3 for w in [*ends[: passages.ASIDE], *words, *ends[passages.ASIDE :]]]
        for seed, at in zip(seeds.tolist(), low[first].tolist()):
            around = side[at : at + passages.ASIDE] + side[at + passages.ASIDE + passages.K : at + 2 * passages.ASIDE + passages.K]
            want.append((t, seed, at, sum(w << 2 * k for k, w in enumerate(around))))
    assert sorted(zip(*(c.tolist() for c in passages.seeds_of(texts)))) == sorted(want)

    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([t.tobytes() for t in texts])], ["doc", "words"])
    rows = pa.Table.from_batches(passages._seeds(3)(iter([batch, batch.set_column(0, "doc", pa.array(range(100, 100 + len(texts))))])))
    held = [r for k in range(3) for r in passages._met(3)(rows.filter(pc.equal(rows["bucket"], k))).to_pylist()]
    places = {(t, seed % (1 << 64)): at for t, seed, at, _ in want}
    assert {(r["doc"], r["seed"] % (1 << 64)): r["place"] for r in held if r["doc"] >= 100} == {(t + 100, s): at for (t, s), at in places.items()}

    late = spark.createDataFrame([(1, 7, 10), (2, 7, 96), (3, 8, 10), (4, 7, 60)], "seed long, doc long, place int")
    found = spark.createDataFrame([(7, 3, 0, 50), (7, 3, 60, 100), (8, 8, 0, 90)], "doc long, other long, start long, end long")
    opened = passages.open_seeds(late, [found])  # a seed that reaches beyond a passage is open, and passages within one text don't count
    assert sorted(r.seed for r in opened.collect()) == [2, 3]


def test_copies_are_aligned_without_chains(monkeypatch):
    text = np.random.default_rng(2).integers(0, 30, 400).astype("<u2")
    want = passages.shared_passages(text, text, 50, 0.8)
    monkeypatch.setattr(passages, "shared_passages", lambda *a: pytest.fail("a copy was chained"))
    raw = pa.array([text.tobytes()])
    batch = pa.record_batch([pa.array([2]), pa.array([9]), pa.array([1]), raw, raw], ["doc", "h", "other", "q", "r"])
    (out,) = passages._aligned(50, 0.8)(iter([batch]))
    assert [tuple(r[c] for c in ("start", "end", "other_start", "other_end", "matched")) for r in out.to_pylist()] == want


def test_pairs_are_aligned_many_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    new = lambda n, of=60000: rng.integers(0, of, n).astype("<u2")

    def brute_segments(q, r):
        x, y = (passages.kmers(t).tolist() for t in (q, r))
        meet = {}
        for i, k in enumerate(x):
            if k in y:
                places = [j for j, other in enumerate(y) if other == k]
                meet[i] = places[min(x[:i].count(k), len(places) - 1)]
        out = []
        for i, j in meet.items():
            if meet.get(i - 1) != j - 1:
                n = next(n for n in range(1, len(x) + 1) if meet.get(i + n) != j + n)
                out.append([i, j, n - 1 + passages.K])
        return sorted(out)

    def brute_chains(rows, least):
        left, out = list(range(len(rows))), []
        while left:
            score, before = {}, {}
            for k in left:
                q, r, n = rows[k]
                ends = [(rows[c][0] + rows[c][2], rows[c][1] + rows[c][2], c) for c in left if rows[c][0] + rows[c][2] <= q and rows[c][1] + rows[c][2] <= r]
                value, c = max(((score[c] + passages.GAP * (qe + re), c) for qe, re, c in ends), default=(float("-inf"), -1))
                gain = value - passages.GAP * (q + r)
                score[k], before[k] = (n + gain, c) if gain > 0 else (n, -1)
            best = max(score, key=lambda k: (score[k], -k))
            if score[best] < least:
                break
            chain = [best]
            while before[chain[-1]] >= 0:
                chain.append(before[chain[-1]])
            left = [k for k in left if k not in chain]
            out.append(chain[::-1])
        return out

    base = new(200)
    others = [new(150, 3), np.concatenate([base[90:150], base[:70], base[150:]]), new(3), new(120, 4), np.concatenate([base[k : k + 25] for k in range(175, -1, -25)])]
    texts = [new(120, 3), base, base[:2], new(150, 4), base, new(90, 3), new(0)]
    which = np.array([0, 1, 2, 3, 4, 0, 1])
    segs = passages.segments(texts, others, which)
    assert [s.tolist() for s in segs] == [brute_segments(q, others[k]) for q, k in zip(texts, which)]
    assert all(passages.chains(s, least) == brute_chains(s.tolist(), least) for s in segs for least in (5, 10))

    # scores are found anew only where a chain took something of the next one
    trees, tree = [], passages.Fenwick
    monkeypatch.setattr(passages, "Fenwick", lambda n: trees.append(n) or tree(n))
    assert len(passages.chains(segs[4], 10)) == 8 and len(trees) == 1

    # k-mers and places of many texts are found at once, whatever is asked of each
    calls, kmers = [], passages.kmers
    monkeypatch.setattr(passages, "kmers", lambda *a: calls.append(len(a[0])) or kmers(*a))
    own = [np.concatenate([new(40), base[k : k + 80], new(20)]) for k in range(0, 120, 3)]
    raw = [t.tobytes() for t in own]
    batch = pa.record_batch([list(range(1, 41)), [0] * 40, [0] * 40, pa.array(raw), pa.array([base.tobytes()] * 40)], ["doc", "h", "other", "q", "r"])
    got = [tuple(r[c] for c in ("start", "end", "other_start", "other_end", "matched")) for out in passages._aligned(50, 0.8)(iter([batch])) for r in out.to_pylist()]
    assert got == [(40, 120, k, k + 80, 80) for k in range(0, 120, 3)]
    assert len(calls) == 2
    calls.clear()
    batch = pa.record_batch([pa.array(range(40)), pa.array(raw)], ["doc", "words"])
    got = {(r["doc"], r["seed"]) for out in passages._long_seeds(50)(iter([batch])) for r in out.to_pylist()}
    assert len(calls) == 1
    long = [kmers(t, 31).view(np.int64) for t in own]
    assert got == {(d, int(x[k : k + 20][np.argmin(x[k : k + 20].view(np.uint64))])) for d, x in enumerate(long) for k in range(len(x) - 19)}
    asked = [kmers(t)[[3, 50, 70]].view(np.int64).tolist() + [5] for t in own]
    calls.clear()
    batch = batch.append_column("seeds", pa.array(asked)).append_column("kin", pa.array([[d] for d in range(40)]))
    got = {(r["doc"], r["seed"]): r["sides"] for out in passages._sides(iter([batch])) for r in out.to_pylist()}
    assert len(calls) == 1
    for d, t in enumerate(own):
        x = kmers(t)
        low = passages.minimizers(x)
        for seed in asked[d]:
            at = [k for k in low.tolist() if x[k].view(np.int64) == seed]
            assert ((d, seed) in got) == bool(at)
            if at:
                n = min(at[0], passages.WIDE)
                assert got[d, seed][:n] == t[at[0] - n : at[0]][::-1].astype(np.uint8).tobytes()
                after = t[at[0] + passages.K :][: passages.WIDE].astype(np.uint8).tobytes()
                assert got[d, seed][passages.WIDE :][: len(after)] == after
