"""Sharding by histogram sort: exact bytes below candidate key boundaries, refined until the splitters are near enough.

The sort key of a row is (hash of its text, hash of its id, number of the row in the table). Equal texts therefore lie
next to each other, and a shard boundary is put between two texts wherever that meets the tolerance. A text that fills
more than a shard is cut between its rows, by the second part of the key, and between repeated rows by the third.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

BITS = 8
KEYS = ("k1", "k2", "k3")
DEEPEST = 8 * len(KEYS) - 1
LAW = "bytes"


@dataclass
class Splitter:
    """The boundary before which target bytes should lie. It is within the keys that begin with prefix."""

    target: float
    below: int = 0  # bytes before those keys
    level: int = 0
    prefix: tuple[int, ...] = ()
    bound: tuple[int, ...] | None = None  # the first key behind the boundary, by its leading digits


def _digit(level: int) -> Column:
    """Digit number `level` of the key: 8 for each part."""
    return F.shiftrightunsigned(F.col(KEYS[level // 8]), 56 - BITS * (level % 8)).bitwiseAND(F.lit(255)).cast("int")


def _within(prefix: tuple[int, ...]) -> Column:
    """Whether a key begins with these digits: whole parts by equality, the last by its leading bits."""
    fits = F.lit(True)
    for k, key in enumerate(KEYS):
        digits = prefix[8 * k : 8 * k + 8]
        if not digits:
            break
        number = sum(d << (BITS * (len(digits) - 1 - at)) for at, d in enumerate(digits))
        whole = len(digits) == 8
        fits = fits & (F.col(key) == _signed(number) if whole else F.shiftrightunsigned(F.col(key), 64 - BITS * len(digits)) == number)
    return fits


def _ordered(key: Column) -> Column:
    return key.bitwiseXOR(F.lit(-(2**63)))


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """The shards - 1 boundaries, as leading digits of the first key of a shard.

    keys has k1, k2, k3 (unsigned order) and size. Each round counts the bytes below 256 evenly spaced probes inside each
    interval that still holds a boundary: one aggregate of at most shards * 256 rows, whatever the input.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    near = tolerance * total / shards
    open_ = [Splitter(total * k / shards) for k in range(1, shards)]
    all_ = list(open_)
    while open_:
        level = open_[0].level
        prefixes = sorted({s.prefix for s in open_})
        counts: list[dict[int, int]] = [{} for _ in prefixes]
        interval = F.coalesce(*[F.when(_within(p), F.lit(k)) for k, p in enumerate(prefixes)])
        rows = keys.select(interval.alias("interval"), _digit(level).alias("digit"), "size").where("interval is not null")
        for k, digit, size in rows.groupBy("interval", "digit").agg(F.sum("size")).collect():
            counts[k][digit] = size
        found = dict(zip(prefixes, counts))
        still = []
        for s in open_:
            at = s.below
            for digit in sorted(found[s.prefix]):
                size = found[s.prefix][digit]
                if at + size > s.target or digit == max(found[s.prefix]):
                    break
                at += size
            # the boundary is inside the interval of this digit; its two ends are the nearest probes
            low, high = s.target - at, at + size - s.target
            if level == DEEPEST or min(low, high) <= near * (level < 8) or (level >= 8 and min(low, high) <= 1):
                s.bound = (*s.prefix, digit) if low <= high else (*s.prefix, digit + 1)
            else:
                s.below, s.level, s.prefix = at, level + 1, (*s.prefix, digit)
                still.append(s)
        open_ = still
    return [s.bound for s in all_ if s.bound is not None]


def _number(bound: tuple[int, ...]) -> int:
    """The boundary as one number over all digits; digits may be 256, which carries."""
    return sum(d << (BITS * (DEEPEST - k)) for k, d in enumerate(bound))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shard_of(bounds: list[int]) -> Column:
    """How many boundaries are at or below the key: a chain of comparisons inside generated code."""
    shard, top = F.lit(0), 64 * len(KEYS)
    for x in bounds:
        if x >> top:
            continue
        parts = [F.lit(_signed((x >> (top - 64 * (k + 1))) % 2**64 ^ 2**63)) for k in range(len(KEYS))]
        behind = F.lit(True)
        for key, part in reversed(list(zip(KEYS, parts))):
            behind = (_ordered(F.col(key)) > part) | ((_ordered(F.col(key)) == part) & behind)
        shard = shard + F.when(behind, 1).otherwise(0)
    return shard


def histogram_shards(
    docs: DataFrame, shards: int = 24, tolerance: float = 0.005, id_col: str = "doc_id", text_col: str = "text", payload: dict[str, Column] | None = None, overhead: int = 8, partitions: int | None = None
) -> DataFrame:
    """Rows (id, size, shard, slot, and the payload's columns): every row of docs in the shard that its key falls into.

    size is the UTF-8 bytes of the text (a null text: none) plus overhead; shards differ from their share by at most
    tolerance where whole texts allow it, else by half a row. slot counts a shard's rows from 0 without gaps, in key
    order. payload columns travel with the one exchange; the text itself does if it is asked for as payload. Rows with
    equal ids and texts are ordered by their place in the written table, and a boundary may part them. No documents: no
    rows.

    Keys and sizes are written once to the shared folder, narrow, and the probes read only them. The exchange is by
    ranges of (shard, key), so that a shard, or a text that a third of the rows share, spreads over many tasks.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "shards")
    text, payload = F.col(text_col), payload or {}
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("k1"),
        F.xxhash64(F.col(id_col), F.lit(7)).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
        *[c.alias(f"_{name}") for name, c in payload.items()],
    )
    rows = ws.table(rows)
    bounds = sorted(map(_number, splitters(rows.select(*KEYS, "size"), shards, tolerance)))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("shard", shard_of(bounds).cast("int")).withColumns({f"o{k}": _ordered(F.col(k)) for k in KEYS})
    order = ["shard", *[f"o{k}" for k in KEYS]]
    placed = placed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = ws.table(placed.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    ws.drop(rows)
    # a shard's rows in earlier partitions: one row for each (partition, shard), at most partitions + shards in all
    runs = placed.groupBy("part", "shard").agg(F.min("row").alias("first"), F.count("*").alias("n")).collect()
    base, seen = {}, {}
    for part, shard, first, count in sorted(runs):
        base[part, shard] = seen.get(shard, 0) - first
        seen[shard] = seen.get(shard, 0) + count
    table = spark.createDataFrame([(p, s, b) for (p, s), b in base.items()], "part int, shard int, base long")
    out = placed.join(F.broadcast(table), ["part", "shard"])
    return out.select("id", "size", "shard", (F.col("row") + F.col("base")).alias("slot"), *[F.col(f"_{name}").alias(name) for name in payload])


def write_shards(docs: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Writes all columns of docs into a folder for each shard below path, in key order; slots are the column slot."""
    payload = {c: F.col(c) for c in docs.columns}
    histogram_shards(docs, shards, payload=payload, **options).select("shard", "slot", *docs.columns).write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 24, **options) -> DataFrame:
    """The columns of the registered query. The law is bytes; text_crc32 of a null text is null."""
    out = histogram_shards(docs, shards, payload={"text_crc32": F.crc32(F.col("text").cast("binary"))}, **options)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
