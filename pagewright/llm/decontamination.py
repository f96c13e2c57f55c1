"""Benchmark decontamination by a generalised suffix automaton over the words of the benchmark's items.

Training texts stream through the automaton, which keeps the longest suffix of what was read that occurs in some item.
Where that match is at least a window long, the words of the window are hit. Words are compared lower-cased (A-Z).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, pieces, release_memory, word_hashes

#: Digits, letters and everything that is not ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
WINDOW = 10
BLOCK_WORDS = 200_000  # of items in one automaton: some 100 MB
SPANS = "array<struct<start: long, end: long, byte_start: long, byte_end: long>>"
SCHEMA = f"id long, n_words long, n_hit long, items array<string>, spans {SPANS}"


class ItemAutomaton:
    """Suffix automaton of many word sequences; every state knows its window and the items that contain it."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        vocabulary = np.unique(np.concatenate([w for _, w in items] or [np.empty(0, np.uint64)]))
        self.vocabulary, self.window = vocabulary, window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = min([window, *(len(w) for _, w in items if len(w))])
        sequences = [np.searchsorted(vocabulary, w).tolist() for _, w in items]
        for words in sequences:
            last = 0
            for c in words:
                last = self._extend(last, c)
        held = [set() for _ in self.step]
        self.names = [name for name, _ in items]
        short: dict[int, dict[int, int]] = {}
        for k, words in enumerate(sequences):
            state = 0
            for at, c in enumerate(words):
                state = self.step[state][c]
                if len(words) < window:
                    if at == len(words) - 1:
                        short.setdefault(state, {})[k] = len(words)
                elif at >= window - 1:
                    held[self._holding(state, window)].add(k)
        # what a match that stands in a state means: by the lengths that it has reached, the words hit and the items found
        self.found: list[list[tuple[int, tuple[int, ...]]]] = []
        for state in range(len(self.step)):
            found, s = [], state
            while s > 0:
                by_length: dict[int, set[int]] = {}
                if self.length[s] >= window > self.length[self.link[s]] and held[s]:
                    by_length[window] = held[s]
                for k, n in short.get(s, {}).items():
                    by_length.setdefault(n, set()).add(k)
                found += [(n, tuple(ks)) for n, ks in by_length.items()]
                s = self.link[s]
            self.found.append(found)

    def _holding(self, state: int, length: int) -> int:
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.step[copy], self.link[copy] = dict(self.step[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def match(self, words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(items found, disjoint spans [start, end) of hit words) in a document's word hashes."""
        if not len(self.vocabulary) or len(words) < self.shortest:
            return np.empty(0, np.int64), []
        ids = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == words
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        runs = edges.reshape(-1, 2)
        items: set[int] = set()
        spans: list[tuple[int, int]] = []
        step, link, length, found = self.step, self.link, self.length, self.found
        for start, end in runs[runs[:, 1] - runs[:, 0] >= self.shortest].tolist():  # an unknown word ends any match
            state = long = 0
            for at, c in enumerate(ids[start:end].tolist(), start + 1):
                while state and c not in step[state]:
                    state = link[state]
                    long = length[state]
                if c in step[state]:
                    state, long = step[state][c], long + 1
                if long >= self.shortest:
                    for n, ks in found[state]:
                        if n <= long:
                            items.update(ks)
                            if spans and at - n <= spans[-1][1]:
                                begin = at - n
                                while spans and spans[-1][1] >= begin:
                                    begin = min(begin, spans.pop()[0])
                                spans.append((begin, at))
                            else:
                                spans.append((at - n, at))
        return np.fromiter(items, np.int64, len(items)), spans


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The items, in blocks of about block_words words; a block is read when it is asked for, and an item is not cut."""
    texts = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    size = texts.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-size // (4 * block_words)))
    for k in range(n):
        rows = texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else texts
        block = []
        for item, text in rows.distinct().collect():
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            block.append((item, word_hashes(raw, np.array([0, len(raw)]), WORD_BYTES)[0]))
        block = [x for x in block if len(x[1])]
        if block or k == n - 1:
            yield block


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Rows (id, n_words, n_hit, items, spans), one for each row of docs.

    A window is ``window`` consecutive words of an item, or all words of an item that has fewer. items are the distinct
    item ids, as strings, of windows that occur; spans are disjoint ranges of hit words and of their bytes. The texts
    stream through the automaton where they lie: no shuffle. A benchmark of more words than block_words is read in
    blocks of items: an automaton is built, sent, used in a pass over docs whose findings are written, and taken back
    before the next, so neither the driver nor a worker holds more than one; the findings are then united by row. Null
    or empty texts have no words; items without id or words have no window; repeated items count once; repeated rows
    are answered row by row.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = item_blocks(benchmark, item_col, item_text_col, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return source.mapInArrow(_stream(spark.sparkContext.broadcast(ItemAutomaton(first, window))), SCHEMA)
    ws = Workspace(spark, "contamination")
    numbered = ws.table(source.withColumn("row", F.monotonically_increasing_id()))
    found = _findings(numbered, [first, second], blocks, window, ws)
    out = _with_findings(numbered, found)
    none = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast(SPANS).alias("spans")]
    out = out.select("id", F.col("text"), *[F.coalesce(F.col(f"_{name}"), none[k]).alias(name) for k, name in enumerate(("n_hit", "items", "spans"))])
    return out.mapInArrow(_counted, SCHEMA)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, off in pieces(batches, "text"):
        first = word_hashes(data, off, WORD_BYTES)[3]
        yield pa.record_batch([part.column(0), pa.array(np.diff(first), pa.int64()), *part.columns[2:]], ["id", "n_words", "n_hit", "items", "spans"])


def _findings(numbered: DataFrame, read: list, rest: Iterator, window: int, ws: Workspace) -> DataFrame:
    """Rows (row, n_hit, items, spans) of the rows (row, text) that any block hits, block by block."""
    spark, parts = numbered.sparkSession, []
    while block := read.pop(0) if read else next(rest, None):
        sent = spark.sparkContext.broadcast(ItemAutomaton(block, window))
        hits = numbered.select(F.col("row").alias("id"), "text").mapInArrow(_stream(sent), SCHEMA).where("n_hit > 0")
        parts.append(ws.table(hits.select(F.col("id").alias("row"), "items", "spans")))
        sent.destroy()
    found = reduce(DataFrame.unionByName, parts)
    found = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    out = ws.table(found.mapInArrow(_merged, f"row long, n_hit long, items array<string>, spans {SPANS}"))
    ws.drop(*parts)
    return out


def _with_findings(numbered: DataFrame, found: DataFrame) -> DataFrame:
    return numbered.join(found.withColumnsRenamed({"row": "_row", "n_hit": "_n_hit", "items": "_items", "spans": "_spans"}), F.col("row") == F.col("_row"), "left")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one row, in order and from several blocks, as disjoint ones."""
    for batch in batches:
        n_hit, spans = [], []
        for given in batch.column(2).to_pylist():
            out: list[dict] = []
            for s in given:
                if out and s["start"] <= out[-1]["end"]:
                    if s["end"] > out[-1]["end"]:
                        out[-1] |= {"end": s["end"], "byte_end": s["byte_end"]}
                else:
                    out.append(dict(s))
            spans.append(out)
            n_hit.append(sum(s["end"] - s["start"] for s in out))
        yield pa.record_batch([batch.column(0), pa.array(n_hit, pa.int64()), batch.column(1), pa.array(spans, batch.schema.field(2).type)], ["row", "n_hit", "items", "spans"])


def _stream(sent):
    """Rows (id, text) to SCHEMA, by one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64())])
        automaton = sent.value
        for part, data, off in pieces(batches, "text"):
            h, starts, ends, first = word_hashes(data, off, WORD_BYTES)
            n_hit, items, spans = [], [], []
            for k in range(part.num_rows):
                at = first[k]
                ids, found = automaton.match(h[at : first[k + 1]])
                n_hit.append(sum(e - s for s, e in found))
                items.append(sorted({automaton.names[i] for i in ids.tolist()}))
                spans.append([{"start": s, "end": e, "byte_start": int(starts[at + s] - off[k]), "byte_end": int(ends[at + e - 1] - off[k])} for s, e in found])
            yield pa.record_batch(
                [part.column(0), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(span))],
                ["id", "n_words", "n_hit", "items", "spans"],
            )

    return run


def _without(text: str, spans: list[dict]) -> str:
    raw, end, kept = text.encode("utf-8"), 0, []
    for s in spans:
        kept.append(raw[end : s["byte_start"]])
        end = s["byte_end"]
    return b"".join([*kept, raw[end:]]).decode("utf-8")


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """docs without hit spans; a document whose hit words exceed max_coverage of its words goes as a whole.

    Columns and the rows of clean documents stay as they are, null and empty texts too. The text of a cut document loses
    the bytes of every span. Repeated rows are judged row by row, and so alike.
    """
    spark = docs.sparkSession
    schema, at = docs.schema, docs.columns.index(text_col)

    def judged(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        keep, new = [], []
        for x, text in zip(found, batch.column(at).to_pylist(), strict=True):
            keep.append(not x["n_hit"] or x["n_hit"] <= max_coverage * x["n_words"])
            new.append(_without(text, x["spans"]) if x["n_hit"] and keep[-1] else text)
        out = pa.record_batch([pa.array(new, batch.schema.field(k).type) if k == at else batch.column(k) for k in range(len(schema))], schema.names)
        return out.filter(pa.array(keep, pa.bool_()))

    blocks = item_blocks(benchmark, item_col, item_text_col, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        stream = _stream(spark.sparkContext.broadcast(ItemAutomaton(first, window)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), pc.fill_null(batch.column(at), "")], ["id", "text"])
                yield judged(batch, [x for part in stream(iter([rows])) for x in part.to_pylist()])
            release_memory()

        return docs.mapInArrow(run, schema)

    ws = Workspace(spark, "contamination")
    numbered = ws.table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    hit = _with_findings(numbered, _findings(numbered, [first, second], blocks, window, ws))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(schema)
        for batch in batches:
            texts = pa.record_batch([pc.fill_null(batch.column(at), "")], ["text"])
            n_words = np.concatenate([np.diff(word_hashes(data, off, WORD_BYTES)[3]) for _, data, off in pieces(iter([texts]), "text")] or [np.empty(0, np.int64)]).tolist()
            yield judged(batch, [{"n_hit": h or 0, "n_words": w, "spans": s} for h, w, s in zip(batch.column(n).to_pylist(), n_words, batch.column(n + 1).to_pylist())])

    return hit.select("doc.*", "_n_hit", "_spans").mapInArrow(cut, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

