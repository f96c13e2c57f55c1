"""Toxic spans by a linear-chain conditional random field with two labels, clean and toxic.

Training: documents labelled toxic or not give, for every feature of a word (the word, its first and last bytes), how
much more often toxic documents hold it. Words of toxic documents with a telling feature are the labelled toxic tokens,
all words of clean documents are labelled clean, and the field is fitted to these labels. Tagging: forward-backward
marginals of every word of a text; runs of likely words are the spans, and the marginals aggregate to the text's score.
Only the text is an input.

The two recursions run over all words of many documents at once: a word's transfer matrix maps the state before it to
the state behind it, chunks of words are multiplied up side by side, and a document's first word forgets what came
before it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontamination import WORD_BYTES
from .shared import _BYTE, LOWER, powers, mix, pieces, release_memory

BUCKETS_BITS = 20
HEADS, TAILS = (3, 4, 5, 6), (4,)
CHUNK = 128
#: At most so many labelled documents of either kind, and so many bytes of text, are used for training: those with the
#: smallest hashed ids. One task fits the field, so this bounds its memory.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 1200, 2000, 10 << 20
#: Longer texts are taken after all others, so that none of them shuts out those behind it.
LONG_BYTES = TRAIN_BYTES // 100
#: The field's weights are fitted to so many of either kind.
FIELD_DOCUMENTS = 400
SCHEMA = "id long, n_words long, score double, expected double, highest double, spans array<struct<start: long, end: long, byte_start: long, byte_end: long, marginal: double>>"


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features: words x kinds, start byte, end byte, first word of each document)."""
    n = len(data)
    kinds = 1 + len(HEADS) + len(TAILS)
    if n == 0:
        return np.empty((0, kinds), np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    b = LOWER[data]
    # À to Þ as well: in UTF-8 the second byte behind C3
    b[1:][(b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)] += 0x20
    w = WORD_BYTES[b]
    cut = off[(off > 0) & (off < n)]
    before = np.concatenate([[False], w[:-1]])
    before[cut] = False
    after = np.concatenate([w[1:], [False]])
    after[cut - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    power, inverse = powers(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * power)])
    out = np.empty((len(starts), kinds), np.int32)

    def put(kind: int, a: np.ndarray, z: np.ndarray) -> None:
        h = mix((sums[z] - sums[a]) * inverse[a] + np.uint64(kind * 0x9E37 + 1))
        out[:, kind] = (h >> np.uint64(64 - BUCKETS_BITS)).astype(np.int32)

    put(0, starts, ends)
    for k, size in enumerate(HEADS, 1):
        put(k, starts, np.minimum(starts + size, ends))
    for k, size in enumerate(TAILS, 1 + len(HEADS)):
        put(k, np.maximum(ends - size, starts), ends)
    return out, starts, ends, np.searchsorted(starts, off).astype(np.int64)


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """P(toxic) of every word, and with pairs summed P(label of a word, label of the next) as a 2 x 2 table.

    emission: log weight of toxic against clean. first marks first words of documents. transition: 2 x 2 log weights.
    """
    n = len(emission)
    if n == 0:
        return np.empty(0), np.zeros((2, 2))
    c = -(-n // CHUNK)
    e = np.zeros((c * CHUNK, 2))
    x = np.clip(emission, -30, 30)
    e[:n, 1] = x
    e = np.exp(e - e.max(1, keepdims=True))
    m = e[:, None, :] * np.exp(transition)[None]
    start = np.zeros(c * CHUNK, bool)
    start[:n] = first
    m[start] = e[start][:, None, :]
    m[n:] = np.eye(2)
    m = m.reshape(c, CHUNK, 2, 2)

    def vector_scan(whole: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The vector in front of each chunk, from the left."""
        out, a, b = np.empty((len(whole), 2)), float(v[0]), float(v[1])
        for k, (p, q, r, s) in enumerate(whole.reshape(-1, 4).tolist()):
            out[k] = a, b
            a, b = a * p + b * r, a * q + b * s
            z = a + b
            a, b = a / z, b / z
        return out

    whole = np.broadcast_to(np.eye(2), (c, 2, 2)).copy()
    for t in range(CHUNK):
        whole = whole @ m[:, t]
        whole /= whole.sum((1, 2), keepdims=True)
    alpha, beta = np.empty((c, CHUNK, 2)), np.empty((c, CHUNK, 2))
    a = vector_scan(whole, np.array([0.5, 0.5]))
    for t in range(CHUNK):
        a = a[:, :1] * m[:, t, 0] + a[:, 1:] * m[:, t, 1]
        a /= a.sum(1, keepdims=True)
        alpha[:, t] = a
    z = vector_scan(whole[::-1].transpose(0, 2, 1), np.array([0.5, 0.5]))[::-1]
    for t in range(CHUNK - 1, -1, -1):
        beta[:, t] = z
        z = z[:, :1] * m[:, t, :, 0] + z[:, 1:] * m[:, t, :, 1]
        z /= z.sum(1, keepdims=True)
    alpha, beta = alpha.reshape(-1, 2)[:n], beta.reshape(-1, 2)[:n]
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    if not pairs:
        return p[:, 1], None
    inner = np.flatnonzero(~first[1:]) + 1
    joint = alpha[inner - 1][:, :, None] * (m.reshape(-1, 2, 2)[inner] * beta[inner][:, None, :])
    joint /= joint.sum((1, 2), keepdims=True)
    return p[:, 1], joint.sum(0)


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(p, 1e-9, 1 - 1e-9))


def aggregates(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each document: log odds of its likeliest word, log of the expected number of toxic words, and of their share."""
    k = len(bounds) - 1
    out = np.empty((k, 3))
    sums = np.concatenate([[0], np.cumsum(p)])
    total = np.maximum(sums[bounds[1:]] - sums[bounds[:-1]], 1e-9)
    words = np.maximum(np.diff(bounds), 1)
    some = np.diff(bounds) > 0
    high = np.full(k, 1e-9)
    if some.any():
        high[some] = np.maximum.reduceat(p, bounds[:-1][some])
    out[:, 0], out[:, 1], out[:, 2] = _logit(high) / 5, np.log(np.maximum(total, 1e-3)), np.log(np.maximum(total / words, 1e-6))
    return out


@dataclass
class Field:
    """Fitted weights: of feature buckets, of the bias, of transitions, and of the document score."""

    weights: np.ndarray
    bias: float
    transition: np.ndarray
    document: np.ndarray

    def packed(self) -> tuple:
        used = np.flatnonzero(self.weights)
        return used.astype(np.int32), self.weights[used], self.bias, self.transition, self.document

    @classmethod
    def unpacked(cls, parts: tuple) -> Field:
        weights = np.zeros(1 << BUCKETS_BITS, np.float32)
        weights[parts[0]] = parts[1]
        return cls(weights, *parts[2:])

    def words(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        emission = self.weights[f].sum(1) + self.bias
        return marginals(emission, first, self.transition, False)[0]

    def scores(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        a = aggregates(p, bounds)
        return 1 / (1 + np.exp(-np.clip(a @ self.document[:-1] + self.document[-1], -30, 30)))


def _firsts(n: int, bounds: np.ndarray) -> np.ndarray:
    first = np.zeros(n, bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    return first


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 20, n_field: int = FIELD_DOCUMENTS) -> Field:
    """Fits the field to labelled documents. Without toxic or without clean documents every score is their share.

    The weights are fitted to the first n_field of either kind, the scores of documents to all.
    """
    # a part at a time: features of all bytes at once would take many times their size
    found = [np.empty((0, 1 + len(HEADS) + len(TAILS)), np.int32)]
    counts = [np.zeros(1, np.int64)]
    for _, data, off in pieces(iter([pa.record_batch([pa.array(texts, pa.string())], ["text"])]), "text"):
        part, _, _, ends = features(data, off)
        found.append(part)
        counts.append(np.diff(ends))
    f, bounds = np.concatenate(found), np.cumsum(np.concatenate(counts))
    del found
    size = 1 << BUCKETS_BITS
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    prior = np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))])
    nothing = Field(np.zeros(size, np.float32), -20.0, np.zeros((2, 2)), prior)
    if not len(f) or toxic.all() or not toxic.any():
        return nothing
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # documents of either kind that hold a feature
    n1, n0 = toxic.sum(), (~toxic).sum()
    held = np.zeros((2, size))
    for kind in range(f.shape[1]):
        pairs = np.unique(doc * np.int64(size) + f[:, kind])
        d, b = pairs // size, pairs % size
        for y in (0, 1):
            held[y] += np.bincount(b[toxic[d] == y], minlength=size)
    odds = np.log((held[1] + 0.1) / (n1 + 0.2)) - np.log((held[0] + 0.1) / (n0 + 0.2))
    # telling: more often than chance explains, and by a wide ratio
    expected = held.sum(0) * n1 / (n0 + n1)
    telling = (odds > 2.0) & (held[1] - expected > 4 * np.sqrt(expected + 0.25)) & (held[1] >= 4)
    y = telling[f].any(1) & toxic[doc]
    if not y.any():
        return nothing
    # the field itself is fitted to some of the documents; their scores to all
    whole, whole_bounds, whole_toxic = f, bounds, toxic
    chosen = np.sort(np.concatenate([np.flatnonzero(toxic)[:n_field], np.flatnonzero(~toxic)[:n_field]]))
    keep = np.isin(doc, chosen)
    f, y = f[keep], y[keep]
    bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[chosen])])
    first = _firsts(len(f), bounds)
    used = np.unique(f)
    at = np.stack([np.searchsorted(used, f[:, kind]).astype(np.int32) for kind in range(f.shape[1])], axis=1)

    def per_feature(values: np.ndarray) -> np.ndarray:
        return sum(np.bincount(at[:, kind], values, minlength=len(used)) for kind in range(at.shape[1]))

    weight, bias, transition = np.zeros(len(used)), float(np.log(y.mean() / (1 - y.mean()))), np.zeros((2, 2))
    count = per_feature(np.ones(len(at)))
    inner = ~first
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[:-1][inner[1:]].astype(int), y[1:][inner[1:]].astype(int)), 1)
    scale, moment = np.zeros(len(used)), 0.0
    for k in range(rounds):
        p, joint = marginals(sum(weight[at[:, kind]] for kind in range(at.shape[1])) + bias, first, transition)
        residual = y - p
        gradient = per_feature(residual) - 0.05 * weight
        curve = per_feature(p * (1 - p))
        scale = np.maximum(0.7 * scale, f.shape[1] * (curve + 0.02 * np.sqrt(count)) + 0.5)
        weight = np.clip(weight + gradient / scale, -12, 12)
        moment = max(0.7 * moment, (p * (1 - p)).sum() + 1)
        bias += float(np.clip(residual.sum() / moment, -0.5, 0.5))
        step = (observed - joint) / (joint + observed + 10)
        transition = np.clip(transition + 0.5 * step, -3, 3)
        transition -= transition[0, 0]
    full = np.zeros(size, np.float32)
    full[used] = weight
    field = Field(full, bias, transition, prior)
    del f, at, first
    parts = []
    for k in range(0, len(texts), 200):  # documents are independent; a part at a time keeps the task small
        b = whole_bounds[k : k + 201]
        part = whole[b[0] : b[-1]]
        parts.append(aggregates(field.words(part, _firsts(len(part), b - b[0])), b - b[0]))
    x = np.column_stack([np.concatenate(parts), np.ones(len(texts))])
    field.document = _logistic(x, whole_toxic.astype(float))
    return field


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression whose weights, but for the last, are not negative: projected Newton steps that halve."""
    pull = np.array([0.05] * (x.shape[1] - 1) + [1e-3])
    theta = np.array([1.0] * (x.shape[1] - 1) + [0.0])

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (pull * t * t).sum())

    now = loss(theta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull) + 1e-6 * np.eye(len(pull)), x.T @ (y - p) - pull * theta)
        for k in range(20):
            new = theta + step / 2**k
            new[:-1] = np.maximum(new[:-1], 0)
            if (after := loss(new)) < now - 1e-9:
                break
        else:
            break
        theta, now = new, after
    return theta


def held_out(id_col: str = "doc_id") -> Column:
    """Ids whose labels are never learned: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", n_toxic: int = TRAIN_TOXIC, n_clean: int = TRAIN_CLEAN, n_field: int = FIELD_DOCUMENTS) -> Field:
    """Fits a field on labelled documents that are not held out, at most n_toxic and n_clean of them.

    Labels join by id; null labels and ids are ignored, and so are ids with labels of both kinds. Of repeated ids the
    smallest text is learned, once. Of either kind the documents with the smallest hashed ids are
    taken, up to half of TRAIN_BYTES, so the sample does not depend on the order of rows. Texts above LONG_BYTES come
    last, the shorter ones first, so that they take only bytes that the others leave. Weights are fitted to the first
    n_field (FIELD_DOCUMENTS, 400) of either kind in the order of hashed ids, the scores of documents to the whole
    sample, n_toxic (TRAIN_TOXIC, 1200) and n_clean (TRAIN_CLEAN, 2000) documents of TRAIN_BYTES (10 MB) at most.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("toxic"))
    known = known.where(~held_out("id")).groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    known = known.withColumn("h", F.xxhash64("id", F.lit(3)))
    chosen = known.where("toxic").orderBy("h", "id").limit(n_toxic).unionByName(known.where("not toxic").orderBy("h", "id").limit(n_clean))
    chosen = [(r.id, r.toxic) for r in chosen.collect()]
    spark = docs.sparkSession
    table = spark.createDataFrame(chosen, "id long, toxic boolean")
    # the sample is bounded, so its ids can be sent to the scan
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(table), "id")
    rows = rows.groupBy("id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("id", F.lit(3))).withColumn("n", F.octet_length("text").cast("long"))
    # one kind after the other, so that each has its half of the bytes
    long = F.when(F.col("n") > LONG_BYTES, F.col("n")).otherwise(0)
    before = F.sum("n").over(Window.partitionBy("toxic").orderBy(long, "h", "id", "text").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + F.col("n") <= TRAIN_BYTES // 2)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({(r["h"], r["id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist()})
        field = fit([t for _, _, t, _ in found], np.array([y for *_, y in found], bool), n_field=n_field)
        out = pickle.dumps(field.packed())
        del found, field
        release_memory()
        yield pa.record_batch([pa.array([out], pa.binary())], ["field"])

    # the sample is bounded, so one task fits the field and the driver only passes it on
    made = rows.select("h", "id", "text", "toxic").repartition(1).mapInArrow(fitted, "field binary").first()
    return Field.unpacked(pickle.loads(made[0])) if made else fit([], np.empty(0, bool))


def toxic_spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """Rows (id, n_words, score, expected, highest, spans), one for each row of docs, in one pass without a shuffle.

    spans are runs of words whose marginal is at_least or more, by word and by byte; expected is the expected number of
    toxic words and highest the largest marginal. A null or empty text has no words and the score of a text without
    toxic words. Repeated rows are scored row by row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("marginal", pa.float64())])
        model = sent.value
        for part, data, off in pieces(batches, "text"):
            f, starts, ends, bounds = features(data, off)
            p = model.words(f, _firsts(len(f), bounds))
            score = model.scores(p, bounds)
            sums = np.concatenate([[0], np.cumsum(p)])
            high = np.zeros(part.num_rows)
            some = np.diff(bounds) > 0
            if some.any():
                high[some] = np.maximum.reduceat(p, bounds[:-1][some])
            spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
            hit = np.flatnonzero(p >= at_least)
            owner = np.searchsorted(bounds, hit, "right") - 1
            for w, k in zip(hit.tolist(), owner.tolist(), strict=True):
                at, byte = int(w - bounds[k]), int(off[k])
                if spans[k] and spans[k][-1]["end"] == at:
                    spans[k][-1] |= {"end": at + 1, "byte_end": int(ends[w]) - byte, "marginal": max(spans[k][-1]["marginal"], float(p[w]))}
                else:
                    spans[k].append({"start": at, "end": at + 1, "byte_start": int(starts[w]) - byte, "byte_end": int(ends[w]) - byte, "marginal": float(p[w])})
            yield pa.record_batch(
                [part.column(0), pa.array(np.diff(bounds)), pa.array(score), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(high), pa.array(spans, pa.list_(span))],
                ["id", "n_words", "score", "expected", "highest", "spans"],
            )
        release_memory()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, field: Field, limit: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below limit, unchanged. A null or empty text is scored as one without words.

    Repeated rows are judged alike; other columns play no part."""
    sent, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            keep = []
            texts = pa.record_batch([pc.fill_null(batch.column(at), "")], ["text"])
            for _, data, off in pieces(iter([texts]), "text"):
                f, _, _, bounds = features(data, off)
                keep.append(model.scores(model.words(f, _firsts(len(f), bounds)), bounds) < limit)
            yield batch.filter(pa.array(np.concatenate([*keep, np.empty(0, bool)])))
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def digest(scored: DataFrame, limit: float = 0.7) -> DataFrame:
    """The columns of the registered query."""
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
