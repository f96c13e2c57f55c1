"""Word boxes laid out from texts: the page tables that the registered queries work on.

Coordinates are multiples of powers of two, so that sums and products are exact in any order of evaluation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as G

PAGE = ["doc_id", "page_no"]
LINES_PER_PAGE, COLUMNS, LONGEST = 60, 96, 31
#: Size of a page in pixels: a word is 4 pixels high, lines are 8 apart.
WIDTH, HEIGHT = 1024, 512
#: Bytes of documents in a part that boxes_by_page() deals out: what is sorted of one has room in memory.
DEALT = 4_000_000


def words(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, line_no, word_no, text, off): words of a line and how many characters are before them.

    Offsets are running sums over all words of a batch that start again at each line, so lines of any length take time
    in proportion to their words and no exchange is needed.
    """
    given = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lines = pc.split_pattern(part.column(2), "\n")
                n_lines = pc.list_value_length(lines).to_numpy()
                parts = pc.split_pattern(lines.flatten(), " ")
                n_words = pc.list_value_length(parts).to_numpy()
                word = parts.flatten()
                doc = np.repeat(np.arange(part.num_rows), n_lines)
                line_no = np.arange(len(doc)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
                first = np.cumsum(n_words) - n_words
                line = np.repeat(np.arange(len(doc)), n_words)
                size = pc.utf8_length(word).to_numpy().astype(np.int64)
                taken = np.where(size > 0, size + 1, 0)  # a blank behind a blank takes no place
                before = np.cumsum(taken) - taken
                held = np.flatnonzero(size)
                line = line[held]
                columns = [
                    part.column(0).take(pa.array(doc[line])),
                    part.column(1).take(pa.array(doc[line])),
                    pa.array(line_no[line], pa.int32()),
                    pa.array(held - first[line], pa.int32()),
                    word.take(pa.array(held)),
                    pa.array(before[held] - before[first[line]], pa.int32()),
                ]
                yield pa.record_batch(columns, ["doc_id", "lang", "line_no", "word_no", "text", "off"])

    return given.mapInArrow(run, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, line_no int, word_no int, text string, off int")


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column, text: Column, label: Column | None = None) -> Column:
    c = {"ax": x0, "ay": y0, "bx": x1, "by": y0, "cx": x1, "cy": y1, "dx": x0, "dy": y1}
    return G.raw_box(c, F.lit(False), text, F.lit(None) if label is None else label)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, page_no, seq, lang, line_no, word_no, confidence, box, box_id); seq orders a page."""
    return _laid_out(words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")))


def boxes_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of boxes(), dealt by document and in the order of pages: what is grouped by page moves no more.

    The texts are dealt out, which are many times smaller than their boxes, and nothing after that hides from Spark where
    the rows of a page lie.
    """
    return _laid_out(dealt_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")))


def dealt_words(docs: DataFrame) -> DataFrame:
    """words() without Python, dealt by doc_id in parts of about DEALT bytes of input, with a column page_no."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, int(docs._jdf.queryExecution().analyzed().stats().sizeInBytes()) // DEALT)
    given = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text").repartition(parts, "doc_id").withColumn("_row", F.monotonically_increasing_id())
    lines = given.select("doc_id", "lang", "_row", F.posexplode(F.split("text", "\n")).alias("line_no", "_line"))
    page = F.floor(F.col("line_no") / LINES_PER_PAGE).cast("int").alias("page_no")
    each = lines.select("doc_id", page, "lang", "_row", "line_no", F.posexplode(F.split("_line", " ")).alias("word_no", "text")).where("text <> ''")
    before = Window.partitionBy(*PAGE, "_row", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("off", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).drop("_row")


def _laid_out(w: DataFrame) -> DataFrame:
    x0 = (F.col("off") % COLUMNS) / 128.0
    x1 = (F.col("off") % COLUMNS + F.least(F.length("text"), F.lit(LONGEST))) / 128.0
    y0 = (F.col("line_no") % LINES_PER_PAGE) / 64.0
    return w.select(
        "doc_id",
        "page_no" if "page_no" in w.columns else F.floor(F.col("line_no") / LINES_PER_PAGE).cast("int").alias("page_no"),
        ((F.col("line_no") % LINES_PER_PAGE) * 100000 + F.col("word_no")).alias("seq"),
        "lang",
        "line_no",
        "word_no",
        ((F.col("doc_id") * 31 + F.col("word_no") * 7) % 64 / 64.0).alias("confidence"),
        rectangle(x0, y0, x1, y0 + 1 / 128, F.col("text")).alias("box"),
    ).withColumn("box_id", F.col("seq"))


#: Kinds of boxes of the second source: which words (number modulo, remainder), and how far they lie lower, as a share of
#: a word's height. The shares of overlap stand just at the thresholds of the joins.
SECOND_KINDS = ((0, 7, None, 0.0), (1, 5, 0, 1.0), (2, 11, 3, 0.5), (3, 13, 4, 63 / 64), (4, 17, 5, 127 / 128))


def _second_box() -> tuple[Column, Column, Column]:
    """(kinds of a word, null for others, its box of kind k, its seq of kind k)."""
    kind = lambda k, s: F.struct(F.lit(k).alias("kind"), F.lit(float(s)).alias("s"))
    chosen = F.array(*[F.when(F.col("word_no") % m != 0 if r is None else F.col("word_no") % m == r, kind(k, s)) for k, m, r, s in SECOND_KINDS])
    b = F.col("box")
    right, down = F.lit(1 / 256), F.col("k.s") / 128
    moved = rectangle(b["ax"] + right, b["ay"] + down, b["bx"] + right, b["dy"] + down, b["text"])
    return chosen, moved, F.col("seq") * 8 + F.col("k.kind")


def second_source(first: DataFrame) -> DataFrame:
    """Another reading of the same pages: most words a little to the right, some moved down, and so on."""
    chosen, moved, seq = _second_box()
    return first.withColumn("k", F.explode(chosen)).where("k is not null").withColumns({"box": moved, "seq": seq, "kind": F.col("k.kind")}).drop("k").withColumn("box_id", F.col("seq"))


def both_sources(first: DataFrame) -> DataFrame:
    """first (sample_id 0) and its second_source() (1) in one table, where the rows of a page stay together."""
    chosen, moved, seq = _second_box()
    itself = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0.0).alias("s")))
    out = first.withColumn("k", F.explode(F.concat(itself, chosen))).where("k is not null").withColumn("sample_id", F.when(F.col("k.kind") < 0, 0).otherwise(1))
    own = F.col("sample_id") == 0
    return out.withColumns({"box": F.when(own, F.col("box")).otherwise(moved), "seq": F.when(own, F.col("seq")).otherwise(seq)}).drop("k").withColumn("box_id", F.col("seq"))


def all_sources(first: DataFrame, every: int, mark: str) -> DataFrame:
    """first (source 0), its second_source() (1) and of that again the boxes of every so many words, with mark as text (2), in
    one table, where the rows of a page stay together."""
    chosen, moved, seq = _second_box()
    itself = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0.0).alias("s")))
    of = lambda source, ks: F.transform(ks, lambda k: F.struct(F.lit(source).alias("source"), k["kind"].alias("kind"), k["s"].alias("s")))
    kinds = F.concat(of(0, itself), of(1, chosen), F.when(F.col("word_no") % every == 0, of(2, chosen)).otherwise(F.array().cast("array<struct<source:int,kind:int,s:double>>")))
    out = first.withColumn("k", F.explode(kinds)).where("k.kind is not null").withColumn("source", F.col("k.source"))
    box = F.when(F.col("source") == 0, F.col("box")).when(F.col("source") == 1, moved).otherwise(G.retext(moved, F.lit(mark)))
    return out.withColumns({"box": box, "seq": F.when(F.col("source") == 0, F.col("seq")).otherwise(seq)}).drop("k")


#: The same tables for DuckDB: words and boxes.
WORDS_SQL = """
lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no FROM documents),
parts AS (SELECT doc_id, lang, line_no, unnest(string_split(line, ' ')) AS text, unnest(generate_series(0, len(string_split(line, ' ')) - 1)) AS word_no FROM lines),
words AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM parts WHERE text <> '')"""
BOXES_SQL = (
    WORDS_SQL
    + """,
boxes AS (SELECT doc_id, CAST(floor(line_no / 60) AS INTEGER) AS page_no, (line_no % 60) * 100000 + word_no AS seq, lang, line_no, word_no, text,
  (doc_id * 31 + word_no * 7) % 64 / 64.0::DOUBLE AS confidence, (off % 96) / 128.0::DOUBLE AS x0, (off % 96 + least(length(text), 31)) / 128.0::DOUBLE AS x1,
  (line_no % 60) / 64.0::DOUBLE AS y0, (line_no % 60) / 64.0::DOUBLE + 1 / 128.0::DOUBLE AS y1 FROM words)"""
)
SECOND_SQL = (
    BOXES_SQL
    + """,
kinds(kind, m, r, s) AS (VALUES """
    + ", ".join(f"({k}, {m}, {'NULL' if r is None else r}, {float(s)!r}::DOUBLE)" for k, m, r, s in SECOND_KINDS)
    + """),
second AS (SELECT doc_id, page_no, seq * 8 + kind AS seq, kind, lang, line_no, word_no, text, confidence, x0 + 1 / 256.0::DOUBLE AS x0, x1 + 1 / 256.0::DOUBLE AS x1, y0 + s / 128 AS y0, y1 + s / 128 AS y1
  FROM boxes JOIN kinds ON CASE WHEN r IS NULL THEN word_no % m <> 0 ELSE word_no % m = r END)"""
)
