"""Fuzzy passages that documents share, by collinear chaining of k-mer seeds.

Minimizers, a spread-out part of the k-mers of words, meet in groups by seed. Each document is paired with the first
holder of a seed, or else the one before it, where the words around the seed are alike. What is long enough and exact is
paired by whole runs of that length as well, so no frequent line hides it. Seeds that are then in no passage are compared
with all other holders, one partner after the other until they are in one. For a pair, all common k-mers become maximal exact segments. Segments that are in
order in both texts are chained for the best sum of lengths less gap costs, with a Fenwick tree that holds the best
chain up to each position of the other text. Chains are aligned word by word across their gaps and beyond their ends.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import OWN, SENT_ROWS, Workspace, arrow_batches, mix, pieces, powers, release_memory, sent_if_small, session_set, word_hashes

K, WINDOW = 5, 4  # a common run of K + WINDOW - 1 words has a common seed
LONG_WINDOW = 20  # seeds of exact passages: smallest hashes of so many long k-mers
ASIDE, ALIKE = 16, 11  # words on either side of a seed that go with it, two bits each, and how many of a side must agree
WIDE, BEYOND = 64, 0.2  # words on either side of a seed in which a passage may begin or end; how much less identity it may have there if it goes on
BLOCK = 1024  # documents of a seed whose sides are compared at once with twice as many of its holders
SEEDS = 1 << 20  # seeds of texts that are sorted at once
TOGETHER = 1 << 16  # words of texts whose seeds are found at once
TAG = np.uint64(0x9E3779B97F4A7C15)  # times the number of a text, to tell hashes of many texts apart
#: Whether what is joined by seed and doc must be dealt by both, and may not stay where it lies by seed.
BY_SEED = "spark.sql.requireAllClusterKeysForCoPartition"
MANY = 6  # seeds in common that make a pair without like words beside any of them
GAP = 0.25  # what a skipped word costs, in matched words
SKIP, AGAIN = 3, 3  # beyond an end: so many words are skipped where so many equal words follow
STEPS = sorted(((a, b) for a in range(SKIP + 1) for b in range(SKIP + 1) if a + b), key=lambda x: (x[0] + x[1], abs(x[0] - x[1])))
SCHEMA = "doc long, h long, start long, end long, other long, other_start long, other_end long, matched long, identity double"


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the runs of k words, from 16-bit fingerprints of words."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    power, inverse = powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse[: len(words) - k + 1])


def _in_order(x: np.ndarray) -> np.ndarray:
    """The places of hashes by size, equal ones as they stand. Few are equal, so only those take a stable sort."""
    order = np.argsort(x)
    again = x[order[1:]] == x[order[:-1]]
    if again.any():
        ties = np.flatnonzero(np.append(again, False) | np.append(False, again))
        order[ties] = order[ties][np.lexsort((order[ties], x[order[ties]]))]
    return order


def minimizers(x: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Where x is the smallest of some window."""
    if len(x) <= window:
        return np.flatnonzero(x == x.min()) if len(x) else np.empty(0, np.int64)
    low = _sliding_min(x, window)
    is_low = np.zeros(len(x), bool)
    for k in range(window):
        is_low[k : len(low) + k] |= x[k : len(low) + k] == low
    return np.flatnonzero(is_low)


def _sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    size, m = 1, x
    while 2 * size <= window:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    rest = window - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, off in pieces(batches, "text"):
        h, _, _, first = word_hashes(data, off)
        fp = (h >> np.uint64(48)).astype("<u2")
        words, x, of = [fp[a:z].tobytes() for a, z in zip(first[:-1], first[1:])], kmers(fp), np.repeat(np.arange(len(first) - 1), np.diff(first))
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            x[a : max(a, z - K + 1)].sort()  # the k-mers of a text in order
        own = of[: len(x)] == of[K - 1 :] if len(x) else np.empty(0, bool)
        again = own[1:] & own[:-1] & (x[1:] == x[:-1]) & (of[1 : len(x)] == of[: max(len(x) - 1, 0)])
        repeats = np.bincount(of[1 : len(x)][again], minlength=len(words)) >= K
        yield pa.record_batch([part.column(0), part.column(1), pa.array(words, pa.binary()), pa.array(repeats)], ["doc", "h", "words", "repeats"])
    release_memory()


def _seeds(buckets: int):
    """The distinct seeds of each text at their first place, with the words around it, as arrays: one row for each bucket of seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), [np.frombuffer(raw.as_buffer(), "<u2") for raw in batch.column(1)]
            first = np.cumsum([0, *map(len, texts)])
            found, at = [seeds_of(texts[:0])], 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(first, first[at] + TOGETHER, "right")) - 1)
                found.append((lambda of, *rest: (of + at, *rest))(*seeds_of(texts[at:to])))
                at = to
            of, seeds, places, around = (np.concatenate(c) for c in zip(*found))
            bucket = (seeds % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            used, since = np.unique(bucket[order], return_index=True)
            columns = [x[order] for x in (seeds // np.uint64(buckets), docs[of], around, places)]
            cuts = list(zip(since.tolist(), [*since[1:].tolist(), len(order)]))
            yield pa.record_batch([pa.array(used, pa.int32()), *(pa.array([planes(c[a:z]) for a, z in cuts], pa.binary()) for c in columns)], ["bucket", "seeds", "docs", "around", "places"])
        release_memory()

    return run


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: what is alike in them takes no room when compressed."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _met(buckets: int):
    """_held() of what _seeds() gives."""

    def run(rows: pa.Table) -> pa.Table:
        def whole(name: str, size: int) -> list[bytes]:
            return [np.frombuffer(c, np.uint8).reshape(size, -1).T.tobytes() for c in rows.column(name).to_pylist()]

        bucket = np.uint64(rows.column("bucket")[0].as_py())
        seeds = [(np.frombuffer(c, np.uint64) * np.uint64(buckets) + bucket).tobytes() for c in whole("seeds", 8)]
        return _held(pa.table({"seeds": seeds, "docs": whole("docs", 8), "around": whole("around", 8), "places": whole("places", 4)}))

    return run


def _minimizers_of(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """All words, how many each text has, its first one, the k-mers at all words, and where these are minimizers, and of which text; all texts at once."""
    words = np.concatenate([np.empty(0, np.uint16), *texts])
    x, size = kmers(words), np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    is_low = np.zeros(len(x), bool)
    if len(x) > WINDOW:
        low = _sliding_min(x, WINDOW)
        within = np.ones(len(low), bool)  # windows that lie in one text
        beyond = ((first + size)[:, None] - np.arange(1, K + WINDOW - 1)).ravel()
        within[beyond[(beyond >= 0) & (beyond < len(low))]] = False
        for k in range(WINDOW):
            is_low[k : len(low) + k] |= within & (x[k : len(low) + k] == low)
    for t in np.flatnonzero((size >= K) & (size < K + WINDOW)).tolist():  # with no more than one window
        is_low[first[t] + minimizers(kmers(texts[t]))] = True
    at = np.flatnonzero(is_low)
    return words, size, first, x, at, np.repeat(np.arange(len(texts)), size)[at]


def seeds_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which text, seed, its first place there, the words around it) of the distinct seeds of each text; all texts at once."""
    words, size, first, x, at, of = _minimizers_of(texts)
    order = _in_order(x[at])
    again = (x[at[order[1:]]] == x[at[order[:-1]]]) & (of[order[1:]] == of[order[:-1]])
    kept = np.ones(len(at), bool)
    kept[order[1:][again]] = False
    at, of = at[kept], of[kept]
    # beyond both ends of a text stands what agrees with nothing but by chance
    sums = np.append(np.uint64(0), np.cumsum(words, dtype=np.uint64))
    ends = mix(np.arange(2 * ASIDE, dtype=np.uint64) + (sums[first + size] - sums[first])[:, None])
    begin = first + 2 * ASIDE * np.arange(len(texts))
    side = np.empty(len(words) + 2 * ASIDE * len(texts), np.uint64)
    side[np.arange(len(words)) + ASIDE + np.repeat(begin - first, size)] = words
    side[begin[:, None] + np.arange(ASIDE)] = ends[:, :ASIDE]
    side[(begin + size)[:, None] + np.arange(ASIDE, 2 * ASIDE)] = ends[:, ASIDE:]
    side &= np.uint64(3)
    n = 1
    while n < ASIDE:
        side = side[:-n] | side[n:] << np.uint64(2 * n)
        n *= 2
    place = at + (begin - first)[of]
    return of, x[at], (at - first[of]).astype(np.uint32), side[place] | side[place + ASIDE + K] << np.uint64(2 * ASIDE)


def _held(rows: pa.Table) -> pa.Table:
    """Of all seeds of a bucket, the holders behind the first one: with the first, the partner of the two, whether the words
    around are alike, whether there are others between them, whether more come behind, and the seed's place in the holder."""
    kinds = {"seeds": np.int64, "docs": np.int64, "around": np.uint64, "places": np.uint32}
    seed, doc, around, *places = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in kinds.items() if c in rows.column_names)
    order = np.argsort(seed)
    again = seed[order[1:]] == seed[order[:-1]]
    order = order[np.append(again, False)[: len(seed)] | np.append(False, again)[: len(seed)]]  # most seeds have one holder
    order = order[np.lexsort((doc[order], seed[order]))]
    seed, doc, around, *places = (x[order] for x in (seed, doc, around, *places))
    new = np.append(True, seed[1:] != seed[:-1])[: len(seed)]
    at = np.flatnonzero(~new)
    one, two = np.maximum.accumulate(np.where(new, np.arange(len(seed)), 0))[at], at - 1
    first = _alike(around[at], around[one])
    alike = first | _alike(around[at], around[two])
    columns = [seed[at], doc[at], doc[one], doc[np.where(alike & ~first, two, one)], alike, doc[two] > doc[one], ~np.append(new, True)[at + 1], *(x[at].astype(np.int32) for x in places)]
    return pa.table(columns, names=["seed", "doc", "one", "other", "alike", "third", "more", "place"][: len(columns)])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ALIKE of the two-bit words on one side of a seed agree."""
    differ = a ^ b
    differ |= differ >> np.uint64(1)
    return np.logical_or(*(np.bitwise_count(differ & np.uint64(0x55555555 << k)) <= ASIDE - ALIKE for k in (0, 32)))


def _long_seeds(words: int):
    """The distinct long seeds of each text; texts have so many words or more."""

    def found(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [np.frombuffer(raw.as_buffer(), "<u2") for raw in part.column(1)]
        size = np.array([len(t) for t in texts], np.int64)
        least = _sliding_min(kmers(np.concatenate(texts), max(words - LONG_WINDOW + 1, 1)), min(LONG_WINDOW, words))
        of = np.repeat(np.arange(len(texts)), size)[: len(least)]
        at = np.flatnonzero(np.arange(len(least)) + words <= np.cumsum(size)[of])  # windows that lie in one text
        at = at[np.append(True, (np.diff(least[at]) != 0) | (np.diff(of[at]) != 0))[: len(at)]]
        _, once = np.unique(least[at] + of[at].astype(np.uint64) * TAG, return_index=True)
        at = at[once]
        return pa.record_batch([pa.array(least[at].view(np.int64)), part.column(0).take(pa.array(of[at]))], ["seed", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _some_rows(batch, 1):
                yield found(part)
        release_memory()

    return run


def _runs(words: int):
    """Hashes of all runs of so many words around the given long seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, found, counts = batch.column(0), [], []
            for raw, seeds in zip(batch.column(1), batch.column(2)):
                fp, seeds = np.frombuffer(raw.as_buffer(), "<u2"), seeds.values.to_numpy(zero_copy_only=False).view(np.uint64)
                least = _sliding_min(kmers(fp, max(words - LONG_WINDOW + 1, 1)), min(LONG_WINDOW, words))
                found.append(np.unique(kmers(fp, words)[np.isin(least, seeds)]))
                counts.append(len(found[-1]))
            runs = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield pa.record_batch([pa.array(runs.view(np.int64)), docs.take(pa.array(np.repeat(np.arange(len(counts)), counts)))], ["seed", "doc"])
        release_memory()

    return run


def _places(texts: list[np.ndarray], of: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the seeds, each asked of a text, that text has, their first places there)."""
    _, _, first, x, at, text = _minimizers_of(texts)
    own, asked = x[at] + text.astype(np.uint64) * TAG, seeds.view(np.uint64) + of.astype(np.uint64) * TAG
    low = _may_be_in(asked, own)
    order = low[_in_order(own[low])]
    k = np.searchsorted(own[order], asked)
    has = np.flatnonzero(k < len(order))
    has = has[own[order[k[has]]] == asked[has]]
    return has, at[order[k[has]]] - first[of[has]]


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The WIDE words on either side of the given seeds of each text, a byte each: first those before, then those behind, the nearest first."""

    def found(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [np.frombuffer(raw.as_buffer(), "<u2") for raw in part.column(1)]
        of = np.repeat(np.arange(len(texts)), part.column(2).value_lengths().to_numpy())
        seeds = part.column(2).flatten().to_numpy()
        has, at = _places(texts, of, seeds)
        of, n, every = of[has], len(has), np.arange(2 * WIDE, dtype=np.uint64)
        wide = []  # beyond both ends of a text stands what agrees with nothing but by chance
        for words in texts:
            ends = mix(every + words.sum(dtype=np.uint64)).astype(np.uint8)
            wide += [ends[:WIDE], words.astype(np.uint8), ends[WIDE:]]
        begin = np.cumsum([0, *(len(t) + 2 * WIDE for t in texts)])
        every = np.concatenate([np.arange(WIDE)[::-1], WIDE + K + np.arange(WIDE)])
        sides = np.concatenate([np.empty(0, np.uint8), *wide])[(begin[of] + at)[:, None] + every]
        sides = pa.Array.from_buffers(pa.binary(2 * WIDE), n, [None, pa.py_buffer(np.ascontiguousarray(sides))]).cast(pa.binary())
        of = pa.array(of)
        return pa.record_batch([pa.array(seeds[has]), part.column(0).take(of), sides, part.column(3).take(of)], ["seed", "doc", "sides", "kin"])

    for batch in batches:
        for part in _some_rows(batch, 1):
            yield found(part)
    release_memory()


def _some_rows(batch: pa.RecordBatch, *texts: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about TOGETHER words in each of the columns of texts, or one row."""
    size = np.cumsum([0, *(sum(len(t.as_buffer()) for t in row) // 2 for row in zip(*(batch.column(k) for k in texts)))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + len(texts) * TOGETHER, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _in_common(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of rows of WIDE words, a[i] and b[j]: what the first n words of one have in common with the other in order, for n from 0 to WIDE."""
    used, j = np.unique(j, return_inverse=True)
    places = np.zeros((len(used), 256), np.uint64)  # of each word in b
    every = np.arange(len(used))
    for k in range(WIDE):
        places[every, b[used, k]] |= np.uint64(1 << k)
    row = np.full(len(i), ~np.uint64(0))
    out = np.zeros((WIDE + 1, len(i)), np.float32)
    for k in range(WIDE):
        held = row & places[j, a[i, k]]
        row = row + held | row - held
        out[k + 1] = WIDE - np.bitwise_count(row).astype(np.float32)
    return out


def may_hold_passage(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, words: int, identity: float) -> np.ndarray:
    """Whether a passage of so many words may lie around a seed; a and b are what _sides() gives of its holders, i and j their pairs.

    True wherever the words from some place before the seed to some place behind it, WIDE away at most, are enough and have
    the identity in common with the other's. A passage that goes on beyond may have less of it here, down to BEYOND.
    """
    if not len(i):
        return np.zeros(0, bool)
    n = np.arange(WIDE + 1, dtype=np.float32)[:, None]
    before, behind = (_in_common(a[:, k : k + WIDE], b[:, k : k + WIDE], i, j) for k in (0, WIDE))
    x, y = before - identity * n, behind - identity * n
    y = np.maximum.accumulate(y[::-1])[::-1]  # the best of so many words or more
    least = np.clip(words - K - np.arange(WIDE + 1), 0, WIDE)
    fine = (x + y[least]).max(0) >= -K * (1 - identity) - 1e-3
    far = identity - BEYOND
    x, y = before - far * n, behind - far * n
    return fine | (np.maximum(x[-1] + y.max(0), y[-1] + x.max(0)) >= -K * (1 - far) - 1e-3)


def _next_holders(words: int, identity: float, most: int):
    """Rows (doc, seed, other, more): the first holders of a seed, so many, that may have a passage with doc around it or are
    of its kin, and whether others that look like it come behind. A row of the input has many documents, and many earlier
    holders, of one seed."""
    place = np.uint32(4) ** np.arange(ASIDE, dtype=np.uint32)

    class Held:
        """The holders of all seeds of a batch, which come in the order of their ids: first says where those of each seed begin."""

        def __init__(self, column: pa.ListArray):
            holders, self.first = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
            self.doc, sides = holders.field(0).to_numpy(), holders.field(1).cast(pa.large_binary())
            data, at = np.frombuffer(sides.buffers()[2] or b"", np.uint8), np.frombuffer(sides.buffers()[1], np.int64)[sides.offset]
            self.sides = data[at : at + 2 * WIDE * len(sides)].reshape(-1, 2 * WIDE)
            self.packed = [((self.sides[:, k : k + ASIDE] & 3).astype(np.uint32) * place).sum(1, dtype=np.uint32) for k in (0, WIDE)]
            self.lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in map(holders.field, range(2, holders.type.num_fields))]

        def listed(self, k: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
            """(holder, value) of the lists of holders from lo to hi."""
            at, values = self.lists[k]
            return np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])), values[at[lo] : at[hi]]

    def shown(of: np.ndarray, at: np.ndarray, n: int, ids: np.ndarray) -> np.ndarray:
        held, out = np.isin(at, ids), np.zeros((n, len(ids)), np.float32)
        out[of[held], np.searchsorted(ids, at[held])] = 1
        return out

    def candidates(rows: Held, firsts: Held, seed: int) -> tuple[np.ndarray, ...]:
        """(place in rows, place in firsts) of the holders of a seed that are like, and whether they are kin."""
        (lo, hi), (since, end) = (h.first[seed : seed + 2].tolist() for h in (rows, firsts))
        doc, other, alike = rows.doc[lo:hi], firsts.doc[since:end], []
        for k in range(0, len(doc), 64):
            n = int(np.searchsorted(other, doc[min(k + 64, len(doc)) - 1]))  # only earlier holders count
            like = np.zeros((len(doc[k : k + 64]), n), bool)
            for u, v in zip(rows.packed, firsts.packed):
                # two bits of each word tell most of them apart
                differ = u[lo + k : min(lo + k + 64, hi), None] ^ v[since : since + n]
                like |= np.bitwise_count((differ | differ >> np.uint32(1)) & np.uint32(0x55555555)) <= ASIDE - ALIKE
            if like.any():
                like &= doc[k : k + 64, None] > other[:n]
                i, j = np.nonzero(like)
                a, b = rows.sides[lo + k + i], firsts.sides[since + j]
                fine = ((a[:, :ASIDE] == b[:, :ASIDE]).sum(1) >= ALIKE) | ((a[:, WIDE : WIDE + ASIDE] == b[:, WIDE : WIDE + ASIDE]).sum(1) >= ALIKE)
                if fine.any():
                    alike.append((i[fine] + k, j[fine]))
        if not alike:
            return ()
        i, j = (np.concatenate(c) for c in zip(*alike))
        tried_by, tried = rows.listed(1, lo, hi)
        at = np.minimum(np.searchsorted(other, tried), len(other) - 1)
        new = ~np.isin(i * len(other) + j, (tried_by * len(other) + at)[other[at] == tried])
        i, j = i[new], j[new]
        (kin_by, kin), (kin_of_by, kin_of) = rows.listed(0, lo, hi), firsts.listed(0, since, end)
        ids = np.intersect1d(kin, kin_of)
        kin, kin_of = shown(kin_by, kin, hi - lo, ids), shown(kin_of_by, kin_of, end - since, ids)
        akin, cuts = np.empty(len(i), bool), np.searchsorted(i, np.arange(0, hi - lo + 64, 64))
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            if z > a:
                akin[a:z] = (kin[64 * k : 64 * k + 64] @ kin_of.T > 0)[i[a:z] - 64 * k, j[a:z]]
        return i + lo, j + since, akin

    def chosen(seeds: np.ndarray, rows: Held, firsts: Held, found: list[tuple]) -> tuple[np.ndarray, ...]:
        """Of some seeds' candidates(), the rows of the result. All go on by turns, more of each in each turn, until enough are found."""
        i, j, akin = (np.concatenate(c) for c in zip(*found))
        used, i = np.unique(i, return_inverse=True)
        doc, a, other, b = rows.doc[used], rows.sides[used], firsts.doc, firsts.sides
        seed = seeds[np.searchsorted(rows.first, used, "right") - 1]
        at, end = np.searchsorted(i, np.arange(len(doc))), np.searchsorted(i, np.arange(len(doc)), "right")
        turn, wanted, hits = most, np.full(len(doc), most), [np.empty(0, np.int64)]
        while (left := np.flatnonzero(at < end)).size:
            n = np.minimum(end[left] - at[left], turn)
            c = np.repeat(at[left] - np.cumsum(n) + n, n) + np.arange(n.sum())
            hit = c[np.concatenate([may_hold_passage(a, b, i[c[t : t + 4096]], j[c[t : t + 4096]], words, identity) for t in range(0, len(c), 4096)]) | akin[c]]
            hit = hit[np.arange(len(hit)) - np.searchsorted(i[hit], i[hit]) < wanted[i[hit]]]
            hits.append(hit)
            at[left] += n
            wanted -= np.bincount(i[hit], minlength=len(wanted))
            at[wanted == 0] = end[wanted == 0]
            turn *= 4
        hit = np.concatenate(hits)
        return doc[i[hit]], seed[i[hit]], other[j[hit]], hit + 1 < end[i[hit]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for batch in batches:
            out, found = [(none, none, none, none.astype(bool))], []
            seeds, rows, firsts = batch.column(0).to_numpy(), Held(batch.column(1)), Held(batch.column(2))
            for seed in range(len(seeds)):
                if group := candidates(rows, firsts, seed):
                    found.append(group)
                if sum(len(g[0]) for g in found[-1:]) >= 1 << 16:
                    out.append(chosen(seeds, rows, firsts, found))
                    found = []
            if found:
                out.append(chosen(seeds, rows, firsts, found))
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], ["doc", "seed", "other", "more"])
        release_memory()

    return run


def segments(texts: list[np.ndarray], others: list[np.ndarray], which: np.ndarray) -> list[np.ndarray]:
    """For each text q and others[which] = r, rows (start in q, start in r, words) of maximal runs of common k-mers; all of one diagonal.

    The j-th occurrence of a k-mer in q meets the j-th in r, or the last where r has fewer, so their number stays linear.
    All pairs are met at once.
    """
    (x, of, at), (y, of_y, at_y) = (_places_of_kmers(t) for t in (texts, others))
    of_r = which[of]
    x, y = (k + n.astype(np.uint64) * TAG for k, n in ((x, of_r), (y, of_y)))  # k-mers of unlike r differ
    common = _may_be_in(x, y)
    some = _may_be_in(y[common], x)
    order = common[_in_order(y[common])]
    y, at_y = y[order], at_y[order]
    lo = np.searchsorted(y, x[some])
    fine = y[np.minimum(lo, len(y) - 1)] == x[some] if len(y) else np.zeros(len(some), bool)
    some, lo = some[fine], lo[fine]
    x, of, i = x[some], of[some], at[some]
    if not len(i):
        return _runs_of_places(of, i, i, len(texts))
    x = x + of.astype(np.uint64) * TAG
    order = _in_order(x)
    new = np.append(True, np.diff(x[order]) != 0)
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    new = np.diff(y) != 0
    last = np.append(np.flatnonzero(new), len(y) - 1)[np.append(0, np.cumsum(new))[lo]]  # of each k-mer of r
    j = at_y[np.minimum(lo + rank, last)]
    return _runs_of_places(of, i, j, len(texts))


def _may_be_in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of all of y that is in x, and by chance of a little more; both are hashes."""
    bits = max(16, min(24, len(x).bit_length() + 4))
    held, low = np.zeros(1 << bits, bool), np.uint64((1 << bits) - 1)
    held[x & low] = True
    return np.flatnonzero(held[y & low])


def segments_within(q: np.ndarray) -> np.ndarray:
    """The same of a text with itself, where an occurrence meets the one before it."""
    x = kmers(q)
    b = _in_order(x)
    at = np.flatnonzero(x[b[1:]] == x[b[:-1]])
    return _runs_of_places(np.zeros(len(at), np.int64), b[at + 1], b[at], 1)[0]


def _places_of_kmers(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer, which text, place there) of all k-mers of texts."""
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(texts)), np.maximum(size - K + 1, 0))
    at = np.arange(len(of)) - np.repeat(np.cumsum(np.maximum(size - K + 1, 0)) - np.maximum(size - K + 1, 0), np.maximum(size - K + 1, 0))
    return kmers(np.concatenate([np.empty(0, np.uint16), *texts]))[first[of] + at], of, at


def _runs_of_places(of: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> list[np.ndarray]:
    """The segments of each of n pairs, from the places at which its k-mers meet."""
    if not len(i):
        return [np.empty((0, 3), np.int64)] * n
    aside, long = i - j - (i - j).min(), int(i.max()) + 1
    order = np.argsort((of * (int(aside.max()) + 1) + aside) * long + i)  # a place in q is there once
    of, i, j = of[order], i[order], j[order]
    breaks = np.flatnonzero((np.diff(i) != 1) | (np.diff(i - j) != 0) | (np.diff(of) != 0))
    s, e = np.append(0, breaks + 1), np.append(breaks, len(i) - 1)
    order = np.argsort(of[s] * long + i[s])
    s, e = s[order], e[order]
    out, cuts = np.column_stack([i[s], j[s], i[e] - i[s] + K]), np.searchsorted(of[s], np.arange(n + 1)).tolist()
    return [out[a:z] for a, z in zip(cuts, cuts[1:])]


class Fenwick:
    """Prefix maxima of (value, index) over positions."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        best, n = self.best, len(self.best)
        at += 1
        while at < n:
            if value > best[at]:
                best[at] = value
            at += at & -at

    def get(self, to: int) -> tuple[float, int]:
        """The largest at positions below to."""
        best = self.best
        out = best[0]
        while to > 0:
            if best[to] > out:
                out = best[to]
            to -= to & -to
        return out


def chains(seg: np.ndarray, least: float) -> list[list[int]]:
    """Disjoint chains of segments, best first, whose score is at least `least`; segments come in the order of their starts.

    Without a chain the scores of others can only fall. So the best of what is left is the best still where all of its chain
    is left, and only where some of it is gone are scores found anew.
    """
    if len(seg) == 1:
        return [[0]] if seg[0, 2] >= least else []
    rows = seg.tolist()
    ends = sorted({r + n for _, r, n in rows})
    place = {e: k for k, e in enumerate(ends)}
    below = [bisect_right(ends, r) for _, r, _ in rows]
    closes = [q + n for q, _, n in rows]
    left, out = list(range(len(rows))), []
    while left:
        tree = Fenwick(len(ends))
        score, before = {}, {}
        closing = sorted(left, key=closes.__getitem__)
        done = 0
        for k in left:
            q, r, n = rows[k]
            while closes[c := closing[done]] <= q:
                re = rows[c][1] + rows[c][2]
                tree.put(place[re], (score[c] + GAP * (closes[c] + re), c))
                done += 1
            value, c = tree.get(below[k])
            gain = value - GAP * (q + r)
            score[k], before[k] = (n + gain, c) if gain > 0 else (n, -1)
        gone: set[int] = set()
        for best in sorted((k for k in left if score[k] >= least), key=lambda k: (-score[k], k)):
            if best in gone:
                continue
            chain = [best]
            while (k := before[chain[-1]]) >= 0 and k not in gone:
                chain.append(k)
            if k >= 0:
                break
            gone.update(chain)
            out.append(chain[::-1])
        else:
            break
        left = [k for k in left if k not in gone]
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that an optimal alignment of two gaps has in common, however long they are; a row of the table is one integer."""
    if not len(a) or not len(b):
        return 0
    if len(a) == 1 or len(b) == 1:
        return int(not set(a.tolist()).isdisjoint(b.tolist()))
    at: dict[int, int] = {}
    for k, w in enumerate(b.tolist()):
        at[w] = at.get(w, 0) | 1 << k
    row = full = (1 << len(b)) - 1
    for w in a.tolist():
        if held := row & at.get(w, 0):
            row = (row + held | row - held) & full
    return len(b) - row.bit_count()


def _beyond(q: np.ndarray, r: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start in q, start in r, words) by which an alignment goes on from the front of both."""
    i = j = 0
    out = []
    x, y, size = q.tobytes(), r.tobytes(), q.itemsize  # slices of bytes are compared at once
    few = AGAIN * size
    while True:
        n = min(len(q) - i, len(r) - j)
        if n > 0 and x[i * size : (i + 1) * size] == y[j * size : (j + 1) * size]:
            run = int(np.argmax(np.append(q[i : i + n] != r[j : j + n], True)))
            out.append((i, j, run))
            i, j = i + run, j + run
        for a, b in STEPS:
            u, v = x[(i + a) * size : (i + a) * size + few], y[(j + b) * size : (j + b) * size + few]
            if u == v and len(u) == few:
                i, j = i + a, j + b
                break
        else:
            return out


def _before(q: np.ndarray, r: np.ndarray) -> list[tuple[int, int, int]]:
    """The same from the end of both backwards, in the order of the texts."""
    return [(len(q) - i - n, len(r) - j - n, n) for i, j, n in reversed(_beyond(q[::-1], r[::-1]))]


def _parts(q: np.ndarray, r: np.ndarray, rows: list[list[int]], gaps: list[int], words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """Ranges of a chain that as a whole is not alike enough: the one with most words in common, then those on its sides.

    Gaps are entered from both sides as far as an alignment goes on. A range may start and end at any run, but what is in
    common in the middle of a gap counts only for ranges that hold all of the gap.
    """
    p, o, _ = rows[0]
    runs = [(i, j, n, 0, True, False) for i, j, n in _before(q[:p], r[:o])]
    for k, (a, b, n) in enumerate(rows):
        middle = 0
        if k:
            x, y = q[p:a], r[o:b]
            ahead = _beyond(x, y)
            i, j = (ahead[-1][0] + ahead[-1][2], ahead[-1][1] + ahead[-1][2]) if ahead else (0, 0)
            back = [(i + u, j + v, m) for u, v, m in _before(x[i:], y[j:])]
            runs += [(p + u, o + v, m, 0, False, True) for u, v, m in ahead]
            middle = gaps[k - 1] - sum(m for *_, m in ahead + back)
            for u, v, m in back:
                runs.append((p + u, o + v, m, middle, True, False))
                middle = 0
        runs.append((a, b, n, middle, True, True))
        p, o = a + n, b + n
    runs += [(p + i, o + j, n, 0, False, True) for i, j, n in _beyond(q[p:], r[o:])]
    s, t, n, between, opens, closes = (np.array(x) for x in zip(*runs))
    sums, ends, other_ends = np.cumsum(n + between), s + n, t + n
    out, todo = [], [(0, len(runs))]
    while todo:
        lo, hi = todo.pop()
        best = (0, 0, 0)
        for k in range(lo, hi):
            if ends[hi - 1] - s[k] < words:
                break
            if opens[k]:
                matched = sums[k:hi] - sums[k] + n[k]
                size = ends[k:hi] - s[k]
                fine = closes[k:hi] & (size >= words) & (matched >= identity * np.maximum(size, other_ends[k:hi] - t[k]))
                if fine.any():
                    z = int(np.flatnonzero(fine)[-1])
                    best = max(best, (int(matched[z]), -k, k + z + 1))
        if best[0]:
            m, k, z = best[0], -best[1], best[2]
            out.append((int(s[k]), int(ends[z - 1]), int(t[k]), int(other_ends[z - 1]), m))
            todo += [(lo, k), (z, hi)]
    return out


def shared_passages(q: np.ndarray, r: np.ndarray, words: int, identity: float, same: bool = False, seg: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
    """(start, end, other start, other end, words in common) of passages of q that r has as well, at least so long.

    A chain that is not alike enough as a whole gives its parts that are. seg: their segments, where they are known.
    """
    if seg is None:
        seg = segments_within(q) if same else segments([q], [r], np.zeros(1, np.int64))[0]
    out: list[tuple[int, int, int, int, int]] = []
    for chain in chains(seg, 2 * K if words > 2 * K else K):
        rows = seg[chain].tolist()
        (start, other, _), (p, o, m) = rows[0], rows[-1]
        end, other_end = p + m, o + m
        if (i := _before(q[:start], r[:other])):
            start, other = i[0][:2]
        if (j := _beyond(q[end:], r[other_end:])):
            end, other_end = end + j[-1][0] + j[-1][2], other_end + j[-1][1] + j[-1][2]
        if end - start < words:
            continue
        gaps = [_common(q[p + m : a], r[o + m : b]) for (p, o, m), (a, b, _) in zip(rows, rows[1:])]
        matched = sum(gaps) + sum(n for *_, n in i + rows + j)
        whole = matched >= identity * max(end - start, other_end - other)
        for found in [(start, end, other, other_end, matched)] if whole else _parts(q, r, rows, gaps, words, identity):
            if not any(a <= found[0] and found[1] <= z for a, z, *_ in out):  # what a better chain left over, extended to the same range
                out.append(found)
    return out


def _aligned(words: int, identity: float):
    names = ["doc", "h", "start", "end", "other", "other_start", "other_end", "matched", "identity"]

    def found(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[] for _ in names]
        doc, h, other = (part.column(k).to_pylist() for k in range(3))
        raw, texts, which, unlike = None, [], [], []
        qs, rs = ([np.frombuffer(c.as_buffer(), "<u2") for c in part.column(k)] for k in (3, 4))
        for k, (q, r) in enumerate(zip(qs, rs)):
            if doc[k] != other[k] and not (len(q) >= max(words, K) and np.array_equal(q, r)):
                if not unlike or other[k] != other[unlike[-1]] or not np.array_equal(r, texts[-1]):  # rows of one holder come one after the other
                    texts.append(r)
                unlike.append(k)
                which.append(len(texts) - 1)
        segs = dict(zip(unlike, segments([qs[k] for k in unlike], texts, np.array(which, np.int64))))
        for k, (q, r) in enumerate(zip(qs, rs)):
            copy = doc[k] != other[k] and k not in segs
            for s, e, os, oe, m in [(0, len(q), 0, len(q), len(q))] if copy else shared_passages(q, r, words, identity, doc[k] == other[k], segs.get(k)):
                for column, value in zip(rows, (doc[k], h[k], s, e, other[k], os, oe, m, m / max(e - s, oe - os))):
                    column.append(value)
        return pa.record_batch([pa.array(x, pa.float64() if n == "identity" else pa.int64()) for n, x in zip(names, rows)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _some_rows(batch, 3, 4):
                yield found(part)
        release_memory()

    return run


def repeated_passages(docs: DataFrame, words: int = 50, identity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, h, start, end, other, other_start, other_end, matched, identity): passages that an earlier text has.

    A passage is a range of at least `words` words of doc, by position, that aligns with a range of other with at least
    `identity` of the longer range in common. other is the smallest id that holds the seeds, so the first holder of a
    passage has no row for it; a passage that repeats inside one document has that document as other. h is the hash of
    the text. Words are parted by blanks and compared with A-Z lower-cased.

    Every document is paired with the first holder of each of its seeds, or the one before it where only that has like
    words around the seed, or with which it shares MANY seeds; every exact run of `words` words is paired with its first
    holder. Where that leaves a seed in no passage, the earlier holders with like words beside it and enough in common around it
    become partners, one after the other until the seed is in a passage or none is left (next_holders()). Recall is in the README. Texts of any length are aligned as a whole. Rows with
    equal ids are not compared with each other; repeated rows have the same passages, once each. Rows without id, text or
    enough words have none.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "passages")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    with arrow_batches(spark, 1000):
        known = source.where("doc is not null and text is not null")
        seqs = ws.table(known.mapInArrow(_sequences, "doc long, h long, words binary, repeats boolean").where(F.octet_length("words") >= 2 * words))
        # exact passages first, so that their tables are gone before the seeds go out: two holders of a long seed are a
        # pair; where there are more, first holders of runs of all words
        long = ws.table(seqs.select("doc", "words").mapInArrow(_long_seeds(words), "seed long, doc long"))
        shared = long.groupBy("seed").agg(F.min("doc").alias("other"), F.max("doc").alias("doc"), F.count("*").alias("n")).where("other < doc")
        shared = ws.table(shared)
        frequent = long.join(shared.where("n > 2").select("seed"), "seed").groupBy("doc").agg(F.collect_set("seed").alias("seeds"))
        runs = ws.table(seqs.select("doc", "words").join(frequent, "doc").mapInArrow(_runs(words), "seed long, doc long"))
        first = runs.groupBy("seed").agg(F.min("doc").alias("other"), F.max("doc").alias("last")).where("other < last").select("seed", "other")
        exact = runs.join(first, "seed").where("doc > other").select("doc", "other").unionByName(shared.where("n = 2").select("doc", "other"))
        exact = ws.table(exact.distinct())
        ws.drop(long, shared, runs)
        # seeds meet in buckets of at most about SEEDS, which are arrays: as rows they would take most of the time and room
        n_words = seqs.agg(F.sum(F.octet_length("words"))).first()[0] or 0
        buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // (WINDOW + 1) // SEEDS)
        seeds = seqs.select("doc", "words").mapInArrow(_seeds(buckets), "bucket int, seeds binary, docs binary, around binary, places binary")
        held = ws.table(seeds.groupBy("bucket").applyInArrow(_met(buckets), "seed long, doc long, one long, other long, alike boolean, third boolean, more boolean, place int"))
        pairs = held.select("doc", "other", "alike").where("doc > other")
        pairs = pairs.groupBy("doc", "other").agg(F.max("alike").alias("alike"), F.count("*").alias("n")).where(f"alike or n >= {MANY}").select("doc", "other")
        pairs = ws.table(pairs.unionByName(exact).unionByName(seqs.where("repeats").select("doc", F.col("doc").alias("other"))).distinct())

        def aligned(pairs: DataFrame, texts: DataFrame = seqs) -> DataFrame:
            # the words of a holder go out once and meet those of all its documents; merge joins, so that the plan is the
            # same at every size and adaptive execution splits a hot holder
            own = pairs.hint("merge").join(texts.select("doc", "h", F.col("words").alias("q")), "doc")
            both = own.hint("merge").join(texts.select(F.col("doc").alias("other"), F.col("words").alias("r")), "other")
            return ws.table(both.select("doc", "h", "other", "q", "r").mapInArrow(_aligned(words, identity), SCHEMA))

        found = [aligned(pairs)]
        late = held.where("third").select("seed", "doc", "place")
        sides, tried, most = None, [pairs], 1
        while True:
            opened = ws.table(open_seeds(late, found))
            if sides is None:
                sides = ws.table(sides_of_seeds(held, opened, found[0], seqs))
                ws.drop(held)
            with arrow_batches(spark, 100), session_set(spark, BY_SEED, "false"):
                ahead = next_holders(sides, opened.drop("place"), reduce(DataFrame.unionByName, tried), words, identity, most)
                ahead = ws.table(ahead)
            tried.append(ws.table(ahead.select("doc", "other").distinct()))
            if tried[-1].isEmpty():
                break
            found.append(aligned(tried[-1], texts_of(tried[-1], seqs)))
            late, most = opened.join(ahead.where("more").select("seed", "doc"), ["seed", "doc"], "left_semi"), 8 * most
            if late.isEmpty():
                break
        ws.drop_but(*found)
        return reduce(DataFrame.unionByName, found)


def texts_of(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """The rows of seqs that pairs, a written table, are about, as long as these are few enough to be sent."""
    if pairs.limit(SENT_ROWS // 2 + 1).count() > SENT_ROWS // 2:
        return seqs
    return seqs.join(F.broadcast(pairs.select(F.explode(F.array("doc", "other")).alias("doc")).distinct()), "doc", "left_semi")


def open_seeds(late: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The rows (seed, doc, place) of late whose seed is in no passage found. Places tell, so no text is moved."""
    ranges = reduce(DataFrame.unionByName, found).where("doc <> other").groupBy("doc").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    inside = F.exists("ranges", lambda r: (F.col("place") >= r["start"]) & (F.col("place") + K <= r["end"]))
    late = late.join(ranges, "doc", "left").where(~F.coalesce(inside, F.lit(False)))
    return late.select("seed", "doc", "place").dropDuplicates(["seed", "doc"])


def sides_of_seeds(held: DataFrame, opened: DataFrame, found: DataFrame, seqs: DataFrame) -> DataFrame:
    """Rows (seed, doc, sides, kin) for all holders of the seeds in opened; kin is doc and the holders of its passages found.

    Only seeds with three holders or more are asked for.
    """
    group = held.where("third or more").join(opened.select("seed").distinct(), "seed", "left_semi")
    group = group.select("seed", "doc").unionByName(group.select("seed", F.col("one").alias("doc"))).groupBy("doc").agg(F.collect_set("seed").alias("seeds"))
    kin = found.where("doc <> other").groupBy("doc").agg(F.collect_set("other").alias("kin"))
    group = seqs.select("doc", "words").join(group, "doc").join(kin, "doc", "left")
    group = group.select("doc", "words", "seeds", F.array_sort(F.array_union(F.array("doc"), F.coalesce("kin", F.array().cast("array<bigint>")))))
    return group.mapInArrow(_sides, "seed long, doc long, sides binary, kin array<long>")


def next_holders(sides: DataFrame, opened: DataFrame, tried: DataFrame, words: int, identity: float, most: int) -> DataFrame:
    """Rows (doc, seed, other, more): for each open seed the earliest holders not yet tried, so many, that may have a passage
    with doc there. Those that have passages of the same holder as doc, or of each other, may have a longer one with a gap
    beyond WIDE words, and go out without a look at the words around.

    Of a seed's candidates only one goes out at first, so rows do not grow with the square of its holders; while the seed
    stays open the next ones follow (more), each time eight times as many. Holders with the same kin and words on both sides are one class, and the first of them
    stands for it. The sides of a seed meet in blocks, so that a frequent seed is spread.
    """
    if most > 1:  # at first all seeds are open
        sides = sides.join(sent_if_small(opened.select("seed").distinct()), "seed", "left_semi")
    # the words around seeds are wide, so they are dealt out once, by seed, and classes, blocks and joins find them there
    sides = sides.where("seed is not null and doc is not null").repartition("seed")  # joins would ask for it, and then deal out their own
    firsts = sides.groupBy("seed", "sides", "kin").agg(F.min("doc").alias("doc"))
    known = tried.join(opened.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.collect_set("other").alias("tried"))
    known = opened.join(known, "doc", "left").withColumn("tried", F.coalesce("tried", F.array().cast("array<bigint>"))).repartition("seed")
    rows = sides.join(known, ["seed", "doc"])

    def blocks(t: DataFrame, n: int, name: str, *columns: str) -> DataFrame:
        t = t.withColumn("block", F.floor(F.row_number().over(Window.partitionBy("seed").orderBy("doc")) / n))
        return t.groupBy("seed", "block").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name)).drop("block")

    both = blocks(rows, BLOCK, "rows", "doc", "sides", "kin", "tried").hint("merge").join(blocks(firsts, 2 * BLOCK, "firsts", "doc", "sides", "kin"), "seed")
    out = both.select("seed", "rows", "firsts").mapInArrow(_next_holders(words, identity, most), "doc long, seed long, other long, more boolean")
    one = Window.partitionBy("doc", "seed")
    out = out.withColumns({"n": F.row_number().over(one.orderBy("other")), "more": F.max("more").over(one) | (F.count("*").over(one) > most)})
    return out.where(F.col("n") <= most).drop("n")


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages that an earlier text has; rows of which nothing but blanks is left go.

    Columns and untouched rows stay as they are, rows without id or text among them; repeated rows are cut alike.
    """
    schema, at = docs.schema, docs.columns.index(text_col)
    doc, key, cuts = (f"{OWN}{c}" for c in ("doc", "hash", "spans"))
    spans = passages.groupBy("doc", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cuts)).withColumnsRenamed({"doc": doc, "h": key})
    spans = Workspace(docs.sparkSession, "spans").table(spans)
    marked = docs.join(sent_if_small(spans), (F.col(id_col).cast("long") == F.col(doc)) & (F.xxhash64(text_col) == F.col(key)), "left").drop(doc, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, keep = [], []
            for text, spans in zip(batch.column(at), batch.column(len(schema))):
                text, spans = text.as_py(), spans.as_py()
                keep.append(True)
                if spans:
                    raw = text.encode("utf-8")
                    _, starts, ends, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    kept, end = [], 0
                    for s in spans:
                        a, z = int(starts[s["start"]]), int(ends[s["end"] - 1])
                        kept.append(raw[end : max(a, end)])
                        end = max(end, z)
                    text = b"".join([*kept, raw[end:]]).decode("utf-8")
                    keep[-1] = bool(text.strip(" \t\n\v\f\r"))
                new.append(text)
            columns = [pa.array(new, batch.schema.field(k).type) if k == at else batch.column(k) for k in range(len(schema))]
            yield pa.record_batch(columns, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))
        release_memory()

    untouched = marked.where(F.col(cuts).isNull()).drop(cuts)
    return untouched.unionByName(marked.where(F.col(cuts).isNotNull()).mapInArrow(run, schema))
