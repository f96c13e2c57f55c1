"""Exact token counts at every prefix of a text, by dynamic programming over the text.

A byte-pair encoding is valid exactly when each of its pieces encodes to itself and each pair of neighbours encodes to
that pair. So the encoding of a prefix is the encoding of a shorter prefix plus one last piece, and one pass over the
text finds the last piece and the count of every prefix. The table of counts answers how many tokens a cut text has,
and where to cut for a budget, without encoding again.

Pieces never span a boundary that no entry of the vocabulary contains, so the pass runs chunk by chunk (blanks and the
word behind them, or a run of punctuation) and keeps the results of chunks that it has met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # how the model writes a blank
CACHED_CHUNKS, CACHED_PREFIXES, CACHED_LENGTH = 500_000, 800_000, 48
SCHEMA = "id long, n_chars long, n_bytes long, n_tokens long, deltas binary"


class PrefixCounter:
    """Prefix counts under a sentencepiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.get_piece_size())
        usable = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in usable}
        self.tails = {piece[k:] for piece in self.score for k in range(len(piece))}
        self.joined = {a + b for piece in self.score for a, b in zip(piece, piece[1:])}
        self.whole = {piece: len(piece) == 1 or None for piece in self.score}
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.known: dict[str, bytes] = {}
        self.last: dict[str, str] = {}
        self.chunks = self._chunks().findall

    def _chunks(self) -> re.Pattern:
        """Cuts where no vocabulary entry goes across: before a blank, around punctuation that no entry mixes with
        letters, and before punctuation that entries only begin with."""
        marks = {chr(c) for c in range(128) if not chr(c).isalnum()}
        for piece in self.score:
            body = piece.lstrip(SPACE)
            if SPACE in body:
                raise ValueError("an entry of this vocabulary has a blank behind a word")
        while mixed := {c for piece in self.score if len(body := piece.lstrip(SPACE)) > 1 and not set(body) <= marks for c in marks & set(body)}:
            marks -= mixed
        first = {chr(c) for c in range(128) if not chr(c).isalnum()} - marks
        while inside := {b for piece in self.score for a, b in zip(piece, piece[1:]) if b in first and a not in first and a != SPACE}:
            first -= inside
        m, f = ("".join(map(re.escape, sorted(x))) for x in (marks, first))
        opening = f"[{f}]+[^{SPACE}{m}{f}]*|" if first else ""
        return re.compile(f"{SPACE}*(?:{opening}[^{SPACE}{m}{f}]+|[{m}]+)|{SPACE}+")

    def _encode(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = max((self.score.get(parts[k] + parts[k + 1], float("-inf")), -k) for k in range(len(parts) - 1))
            if best == float("-inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def _fit(self, a: str, b: str) -> bool:
        """Whether b, a piece that encodes to itself, can follow a; remembered for every pair."""
        if (whole := self.whole[b]) is None:
            whole = self.whole[b] = self._encode(b) == [b]
        if self.n_fits > 2_000_000:
            self.fits.clear()
            self.n_fits = 0
        self.n_fits += 1
        found = self.fits.setdefault(b, {})[a] = whole and (not a or self._encode(a + b) == [a, b])
        return found

    def _solve(self, part: str) -> bytes:
        """The change of the count at every character of a part that no piece reaches into or out of, as signed bytes."""
        score, tails, fits, known = self.score, self.tails, self.fits, self.last
        n = len(part)
        last, count, out = [""], [0], bytearray()
        for i in range(1, n + 1):
            prefix = part[:i] if n <= CACHED_LENGTH else None
            piece = known.get(prefix)
            if piece is None:
                k = 1
                while k < i and part[i - k - 1 : i] in tails:
                    k += 1
                while k:
                    piece = part[i - k : i]
                    if piece in score:
                        before = last[i - k]
                        fit = (of := fits.get(piece)) and of.get(before)
                        if fit is None:
                            fit = self._fit(before, piece)
                        if fit:
                            break
                    k -= 1
                if prefix:
                    known[prefix] = piece
            last.append(piece)
            c = count[i - len(piece)] + 1 if piece in score else count[i - 1] + len(piece.encode("utf-8"))
            out.append((c - count[-1]) & 255)
            count.append(c)
        return bytes(out)

    def _chunk(self, chunk: str) -> bytes:
        joined = self.joined
        cuts = [k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in joined]
        if len(self.last) > CACHED_PREFIXES:
            self.last.clear()
        if not cuts:
            return self._solve(chunk)
        return b"".join([self._solve(chunk[a:z]) for a, z in zip([0, *cuts], [*cuts, len(chunk)])])

    def __call__(self, text: str) -> bytes:
        """Signed bytes, one for each character and one in front for the dummy prefix; sums are the counts."""
        if not text:
            return b""
        chunks = self.chunks(SPACE + text.replace(" ", SPACE))
        known, out = self.known, []
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        if len(known) > CACHED_CHUNKS:
            known.clear()
        for c in chunks:
            if (d := known.get(c)) is None:
                d = self._chunk(c)
                if len(c) <= CACHED_LENGTH:
                    known[c] = d
            out.append(d)
        return b"".join(out)


_counters: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    if model not in _counters:
        _counters[model] = PrefixCounter(model)
    return _counters[model]


def prefix_counts(deltas: bytes) -> np.ndarray:
    """Tokens of text[:k] for k = 0 .. number of characters; without text only the 0."""
    if not deltas:
        return np.zeros(1, np.int64)
    counts = np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)
    counts[0] = 0
    return counts


def tokens_of_prefix(deltas: bytes, n_chars: int) -> int:
    """Exact token count of the first n_chars characters."""
    counts = prefix_counts(deltas)
    return int(counts[min(max(n_chars, 0), len(counts) - 1)])


def cut_for_budget(deltas: bytes, budget: int) -> int:
    """The most characters that can be kept so that the kept text has at most budget tokens. Counts may fall again."""
    return int(np.flatnonzero(prefix_counts(deltas) <= max(budget, 0))[-1])


def token_prefixes(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, n_bytes, n_tokens, deltas), one for each row of docs, in a single pass without a shuffle.

    deltas holds one signed byte for each character behind one for the dummy prefix; see prefix_counts. A null text counts
    as an empty one: no bytes, no tokens, empty deltas. Repeated rows and null ids are answered row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 512):
                part = texts.slice(at, 512).to_pylist()
                deltas = [count(t) for t in part]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, 512),
                        pa.array([len(t) for t in part], pa.int64()),
                        pa.array([len(t.encode("utf-8")) for t in part], pa.int64()),
                        pa.array([int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in deltas], pa.int64()),
                        pa.array(deltas, pa.binary()),
                    ],
                    ["id", "n_chars", "n_bytes", "n_tokens", "deltas"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
