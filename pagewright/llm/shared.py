"""What several corpus operators need: tables in the shared folder, components of a graph, word hashes.

Conventions that hold for every operator of this subpackage:

* An operator selects the columns that it names and ignores all others, so extra or clashing columns never matter.
* Null texts count as texts without content unless the operator says otherwise; null ids are kept as they are.
* Intermediate tables are Parquet in the folder named by ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Begins the names of columns that operators put beside those of a caller's table.
OWN = "_pagewright_"

# ---------------------------------------------------------------- tables in the shared folder


def workers_can_import(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it by its working folder or sys.path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(":")
    if root not in known and root not in os.environ.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join([root, *filter(None, known)])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session may do without one: it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Bytes of a row group: a writer holds one in memory, and tasks that write token ids or word sequences ran out of it with
#: the default of 128 MB.
ROW_GROUP = 16 << 20


#: Shuffle files of a query are of no use once its result is written; else they stay until the driver collects garbage.
RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables of one operator call below the shared folder. A table can be dropped once nothing reads it.

    Operators drop what their result does not read. What it does read stays until release(spark) is called, as a result
    is computed when its reader asks for it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: set[str] = set()

    def table(self, df: DataFrame, codec: str = "zstd", max_records: int | None = None) -> DataFrame:
        """Writes df and reads it back: lineage ends here, and a lost executor costs no recomputation."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with session_set(self.spark, RELEASED, "true"):
            writer = df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP)
            if max_records:
                writer = writer.option("maxRecordsPerFile", max_records)
            writer.parquet(path)
        _written.setdefault(self.spark.sparkContext.applicationId, set()).add(self.root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pagewright_path = path
        self.paths.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._pagewright_path)
            self.paths.discard(t._pagewright_path)

    def drop_but(self, *tables: DataFrame) -> None:
        """Drops all tables but these."""
        for path in self.paths - {t._pagewright_path for t in tables}:
            _delete(self.spark, path)
            self.paths.discard(path)


_written: dict[str, set[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables that operators of this subpackage have written in this session: results that were not yet read go."""
    for root in _written.pop(spark.sparkContext.applicationId, set()):
        _delete(spark, root)


#: A table of at most so many narrow rows (some 50 bytes each) is sent to every executor; a larger one is exchanged.
SENT_ROWS = 500_000


def sent_if_small(table: DataFrame) -> DataFrame:
    """A hint for the join of a written table, by its counted rows."""
    return F.broadcast(table) if table.limit(SENT_ROWS + 1).count() <= SENT_ROWS else table.hint("merge")


def release_memory() -> None:
    """Gives freed memory back to the system, Arrow's and where it can the C library's: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def session_set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for the jobs that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def arrow_batches(spark: SparkSession, rows: int):
    """Jobs that run inside send at most so many rows to Python at once; for rows that hold whole texts."""
    return session_set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


# ---------------------------------------------------------------- connected components


def connected_components(spark: SparkSession, edges: DataFrame, ws: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps: each rewires every node to the smallest member of its neighbourhood
    until all members of a component hang on its smallest. A step is one aggregate with map-side combine and one join
    on the node, which adaptive execution splits where a node is hot. Edges with a null end are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = ws.table(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(e)
    if seen[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        first = ws.table(large)
        low = first.groupBy("u").agg(F.min("v").alias("m"))
        small = first.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = ws.table(small)
        now = mark(after)
        ws.drop(first, e)
        e = after
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


# ---------------------------------------------------------------- words as 64-bit hashes, many documents at once

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 2**64)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers that a worker keeps; those for longer texts are made when they are needed.
_KEPT = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = _POW
    if len(made[0]) < n:
        m = max(n, 1 << 16)
        made = [np.full(m, p, np.uint64) for p in (_P, _PI)]
        for x in made:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        if m <= _KEPT:
            _POW[:] = made
    return made[0][:n], made[1][:n]


def lower_table(is_word: np.ndarray) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


WHITE = np.ones(256, bool)
WHITE[list(BLANKS)] = False
LOWER = lower_table(WHITE)


def pieces(batches: Iterator[pa.RecordBatch], text: str, at_most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into slices of about at_most text bytes: (slice, its bytes, offsets of its rows). Texts stay whole."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        col = col.cast(pa.large_binary())
        n = len(col)
        if not n:
            continue
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + at_most, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], (off[at : to + 1] - off[at])
            at = to


def word_hashes(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of every word, with A-Z lower-cased, and each document's first word (n + 1 numbers)."""
    n = len(data)
    if n == 0:
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, np.zeros(len(off), np.int64)
    b = LOWER[data]
    w = is_word[b]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    cut = off[(off > 0) & (off < n)]
    before[cut] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after[cut - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    power, inverse = powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[b] * power, out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts])
    return h, starts, ends, np.searchsorted(starts, off).astype(np.int64)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, by its first word; runs may cross documents, which the caller leaves out."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0xD1342543DE82EF95 % 2**64
        out += h[k : len(h) - size + 1 + k] * np.uint64(factor)
    return mix(out)


def either(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
