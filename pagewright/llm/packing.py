"""Bounded-space online packing of token sequences into windows.

Every partition keeps a fixed number of open windows. A document is cut into whole windows and a rest; the rest goes
into the window that it fits best. When it fits none, the fullest window is topped up with a cut of it and emitted. At
the end of its input a partition merges its open windows into full ones and one leftover; a second pass merges the
leftovers of many partitions in the same way. Memory is the open windows and one document, whatever the input.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, release_memory

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, leftover boolean"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
#: Characters on which both tokenizer libraries agree by their common pattern; other texts go to the slower one.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧]*")


class ByteTokenizer:
    """Ids of a byte-level BPE file of the tokenizers library, by the faster tiktoken where both give the same."""

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values()) or "(?!)")
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            # the published pattern of this vocabulary
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merged, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and PLAIN.fullmatch(text) and not self.special.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


_tokenizers: dict[tuple, ByteTokenizer] = {}


def tokenizer(path: str, ranks: str | None) -> ByteTokenizer:
    if (path, ranks) not in _tokenizers:
        _tokenizers[path, ranks] = ByteTokenizer(path, ranks)
    return _tokenizers[path, ranks]


class Packer:
    """Takes (doc, start, ids, doc_tokens) pieces; gives sequences of pieces."""

    def __init__(self, size: int, windows: int):
        self.size, self.windows = size, windows
        self.room: list[tuple[int, int]] = []  # (free tokens, window), in order
        self.open: dict[int, list[tuple]] = {}
        self.next = 0

    def _put(self, at: int, piece: tuple) -> list[tuple] | None:
        """Puts the piece into the window at this place of the order; gives the window if it is full then."""
        free, window = self.room.pop(at)
        self.open[window].append(piece)
        free -= len(piece[2])
        if free == 0:
            return self.open.pop(window)
        insort(self.room, (free, window))
        return None

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[list[tuple]]:
        at = 0
        while len(ids) - at >= self.size:
            yield [(doc, start + at, ids[at : at + self.size], total)]
            at += self.size
        while at < len(ids):
            rest = len(ids) - at
            best = bisect_left(self.room, (rest, -1))
            if best == len(self.room):
                if len(self.room) < self.windows:
                    self.open[self.next] = []
                    insort(self.room, (self.size, self.next))
                    self.next += 1
                    best = len(self.room) - 1
                else:  # none fits: the fullest is topped up and leaves
                    best, rest = 0, self.room[0][0]
            if full := self._put(best, (doc, start + at, ids[at : at + rest], total)):
                yield full
            at += rest

    def close(self) -> Iterator[list[tuple]]:
        """Merges the open windows, fullest first; the last sequence may be short."""
        left = [p for _, window in sorted(self.room) for p in self.open[window]]
        self.room, self.open = [], {}
        sequence: list[tuple] = []
        filled = 0
        for doc, start, ids, total in left:
            while len(ids):
                n = min(len(ids), self.size - filled)
                sequence.append((doc, start, ids[:n], total))
                start, ids, filled = start + n, ids[n:], filled + n
                if filled == self.size:
                    yield sequence
                    sequence, filled = [], 0
        if sequence:
            yield sequence


def _pack(pieces: Callable[[pa.RecordBatch], Iterator[tuple]], size: int, windows: int, first_id: int, last: bool):
    """last: short sequences at the end are final; else they are leftovers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_from = first_id + (TaskContext.get().partitionId() << 33)
        packer, rows, held = Packer(size, windows), [[] for _ in FIELDS], 0

        def put(sequence: list[tuple], leftover: bool) -> None:
            nonlocal ids_from
            offset = 0
            for doc, start, ids, total in sequence:
                raw = ids.astype("<u4").tobytes()
                for column, value in zip(rows, (doc, start, len(ids), total, ids_from, offset, raw, leftover), strict=True):
                    column.append(value)
                offset += len(ids)
            ids_from += 1

        def flush() -> pa.RecordBatch:
            nonlocal rows
            types = [*[pa.int64()] * 6, pa.binary(), pa.bool_()]
            batch = pa.record_batch([pa.array(x, t) for x, t in zip(rows, types, strict=True)], FIELDS)
            rows = [[] for _ in FIELDS]
            return batch

        for batch in batches:
            for piece in pieces(batch):
                for sequence in packer.add(*piece):
                    held += size
                    put(sequence, False)
                if held > 1 << 20:
                    held = 0
                    yield flush()
        for sequence in packer.close():
            put(sequence, not last and sum(len(p[2]) for p in sequence) < size)
        yield flush()
        release_memory()

    return run


def pack(
    docs: DataFrame, vocabulary: str, ranks: str | None = None, end_id: int = 1, size: int = 2048, windows: int = 64, merge: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, sequence_id, offset, ids): the pieces of all documents, where they lie.

    A document is its token ids and end_id behind them, so a null or empty text is end_id alone. ids are little-endian
    unsigned 32-bit numbers. Every id of every row of docs is in exactly one piece; repeated rows are packed as often as
    they come. Only the last sequence that merge partitions leave together can be short of size. No documents: no rows.
    The pieces are written once to the shared folder, so that merging leftovers does not encode the texts again.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")

    def encoded(batch: pa.RecordBatch) -> Iterator[tuple]:
        encode = tokenizer(vocabulary, ranks)
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.array([*encode(text.as_py()), end_id], np.uint32)
            yield doc, 0, ids, len(ids)

    def again(batch: pa.RecordBatch) -> Iterator[tuple]:
        for x in batch.to_pylist():
            yield x["doc_id"], x["start"], np.frombuffer(x["ids"], "<u4"), x["doc_tokens"]

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = ws.table(source.mapInArrow(_pack(encoded, size, windows, 0, False), SCHEMA))
    done, left = first.where("not leftover"), first.where("leftover")
    n = left.select("sequence_id").distinct().count()
    # leftovers of one partition stay together; about `merge` partitions meet in one task
    tasks = max(1, -(-n // merge))
    merged = left.select("doc_id", "start", "ids", "doc_tokens", "sequence_id").repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "doc_id", "start")
    merged = merged.mapInArrow(_pack(again, size, windows, 1 << 62, True), SCHEMA)
    return done.unionByName(merged).drop("leftover")


def digest(packed: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
