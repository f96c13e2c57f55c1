"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens, confirmed on full shingle sets.

Documents with the same shingle set are one class. Every class has a sketch of minwise tokens. Each of several
independent trees sends a class down a path: at a node it branches by its minwise token at a coordinate that the path
selects, so that similar sets stay together. Nodes small enough are compared exhaustively by finer sketches; a node that
is still large is compared in blocks, each with the node's leader, and then what is outside its largest component with
all of it. Nodes in which much is outside branch on, twice each, so that similar sets still meet.

As only components are wanted, a node gives no more than a spanning forest of its likely pairs. What likely pairs join is
a cluster: no link leaves it. The full sets of a cluster meet in one place, in blocks where it is large, and are compared
exactly there; again only links that join components come out. No step gives more rows than it has classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import OWN, Workspace, arrow_batches, connected_components, mix, pieces, release_memory, sent_if_small, shingles, word_hashes

TOKENS = 64
TREES = 16
FIRST_TOKENS, LEVELS = 3, 4  # tokens that choose a first node, and levels of nodes, each by one token more
NODE, BLOCK = 64, 1024  # classes of a node that are compared at once, and of a large one against what is outside its largest component
BRANCHES, DEEPER = 2, 6  # ways by which a large node with much outside its largest component branches on, and how often
SETS = 1 << 18  # elements of all sets that are compared at once; a block has at most BLOCK sets as well
BINS = 512  # of the fine sketch by which members of a node are compared
MARGIN = 0.075  # a fine sketch errs by this much, at similarities from 0.8, in a few of 100,000 pairs or fewer
_rng = np.random.default_rng(8)
_A = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64)
_SEEDS = _rng.integers(1, 2**63, TREES, dtype=np.uint64)
_STARTS = np.concatenate([_rng.permutation(TOKENS) for _ in range(-(-TREES * FIRST_TOKENS // TOKENS))])[: TREES * FIRST_TOKENS].reshape(TREES, -1)


def shingle_set(h: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a document's shingles; all words as one shingle where there are fewer than size."""
    if len(h) == 0:
        return np.empty(0, np.uint64)
    s = np.sort(shingles(h, min(size, len(h))) if len(h) >= size else mix(shingles(h, len(h)) + np.uint64(len(h))))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def sketch(s: np.ndarray) -> np.ndarray:
    low = np.full(TOKENS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, (s[at : at + 4096, None] * _A + _B).min(0))
    return (low >> np.uint64(32)).astype("<u4")


def fine_sketch(s: np.ndarray) -> np.ndarray:
    """One byte of the smallest element in each of BINS bins, 0 where a bin is empty: small sets are held as a whole."""
    out = np.zeros(BINS, np.uint8)
    x = mix(s ^ np.uint64(0xC0FFEE))
    bins = (x >> np.uint64(55)).astype(np.int64)
    order = np.lexsort((x, bins))
    first = np.concatenate([[True], np.diff(bins[order]) != 0]) if len(s) else np.empty(0, bool)
    at = order[first]
    out[bins[at]] = (mix(s[at]) % np.uint64(255)).astype(np.uint8) + 1
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) + np.uint64(len(s))], "<u8").tobytes()


def paths(sig: np.ndarray) -> np.ndarray:
    """(classes, TREES, LEVELS) node ids of sketches."""
    n = len(sig)
    out = np.empty((n, TREES, LEVELS), np.uint64)
    wide = sig.astype(np.uint64)
    row = np.arange(n)
    for t in range(TREES):
        p = np.full(n, _SEEDS[t], np.uint64)
        for c in _STARTS[t]:
            p = mix(p * np.uint64(0x9E3779B97F4A7C15) + wide[:, c] + np.uint64(1))
        out[:, t, 0] = p
        for level in range(1, LEVELS):
            c = (mix(p + np.uint64(level)) % np.uint64(TOKENS)).astype(np.int64)
            p = mix(p * np.uint64(0x9E3779B97F4A7C15) + wide[row, c] + np.uint64(1))
            out[:, t, level] = p
    return out.view(np.int64)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches, "text"):
            h, _, _, first = word_hashes(data, off)
            counts, keys, sigs, fines = [], [], [], []
            for k in range(part.num_rows):
                s = shingle_set(h[first[k] : first[k + 1]], size)
                counts.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                sigs.append(sketch(s).tobytes() if len(s) else None)
                fines.append(fine_sketch(s).tobytes() if len(s) else None)
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(counts, pa.int64()), *[pa.array(x, pa.binary()) for x in (keys, sigs, fines)]], ["doc", "h", "n", "key", "sig", "fine"]
            )
        release_memory()

    return run


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(-1, TOKENS)
            p = paths(sig).reshape(-1, LEVELS)
            keys = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), TREES)))
            yield pa.record_batch([keys, *[pa.array(p[:, k]) for k in range(LEVELS)]], ["key", *[f"p{k}" for k in range(LEVELS)]])
    release_memory()


def _branches_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, key, root, sig) to the BRANCHES nodes below, each by a token of its own."""
    for batch in batches:
        leaf = batch.column(0).to_numpy().view(np.uint64)
        sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4").reshape(-1, TOKENS).astype(np.uint64)
        for k in range(BRANCHES):
            c = (mix(leaf + np.uint64(0x51ED + k)) % np.uint64(TOKENS)).astype(np.int64)
            below = mix(leaf * np.uint64(0x9E3779B97F4A7C15) + sig[np.arange(len(leaf)), c] + np.uint64(2 + k))
            yield pa.record_batch([pa.array(below.view(np.int64)), batch.column(1), batch.column(2)], ["leaf", "key", "root"])


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted rows: tables, and where the groups of a table begin and end."""
    held: list[pa.RecordBatch] = []

    def edges(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [t.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 4096:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        e = edges(t)
        if len(e) > 2:
            yield t.slice(0, e[-2]), e[:-1]
        held = t.slice(e[-2]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, edges(t)


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each of a to each of b, by fine sketches."""
    x, y = (a > 0).astype(np.float32), (b > 0).astype(np.float32)
    filled = x.sum(1)[:, None] + y.sum(1)[None] - x @ y.T
    same = np.empty((len(a), len(b)), np.float32)
    for at in range(0, len(a), 16):
        same[at : at + 16] = (a[at : at + 16, None] == b[None]).sum(2)
    same -= BINS - filled  # bins that are empty in both
    return same / np.maximum(filled, 1)


def spanning_pairs(like: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest, the likeliest first, over pairs that are likely enough (Prim's algorithm)."""
    n = len(like)
    if n == 2:
        return [(0, 1)] if like[0, 1] >= least else []
    out, outside = [], np.ones(n, bool)
    best, by = np.full(n, -1.0), np.zeros(n, np.int64)
    for _ in range(n):
        k = int(np.argmax(np.where(outside, best, -2)))
        if best[k] >= least:
            out.append((int(by[k]), k))
        outside[k] = False
        better = outside & (like[k] > best)
        best[better], by[better] = like[k][better], k
        if not outside.any():
            break
    return out


def _forests(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in groups(batches, ("leaf", "block")):
            keys = t.column("key").to_pylist()
            sig = np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(-1, BINS)
            a, b = [], []
            for s, e in zip(edges[:-1], edges[1:]):
                for i, j in spanning_pairs(_likeness(sig[s:e], sig[s:e]), least) if e - s > 1 else ():
                    a.append(keys[s + i])
                    b.append(keys[s + j])
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        release_memory()

    return run


class Roots:
    """Components while links come in; names are those of the components that were known before."""

    def __init__(self) -> None:
        self.of: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        root = x
        while (up := self.of.get(root, root)) != root:
            root = up
        while x != root:
            self.of[x], x = root, self.of.get(x, x)
        return root

    def join(self, a: bytes, b: bytes) -> bool:
        """Whether they were apart."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.of[max(a, b)] = min(a, b)
        return a != b


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(keys, probe, rows) of neighbouring rows with equal keys, as they come; a long run comes in several parts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in (*keys, "probe")]
        change = np.zeros(n - 1, bool)
        for x in columns:
            change |= x[1:] != x[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1, [n]]).tolist()
        for s, e in zip(edges[:-1], edges[1:]):
            yield tuple(x[s] for x in columns[:-1]), bool(columns[-1][s]), batch.slice(s, e - s)


def joining(likely: np.ndarray, of_rows: list[bytes], of_columns: list[bytes], number: np.ndarray, roots: Roots) -> Iterator[tuple[int, int]]:
    """The (row, column) that are set in likely and join two components; number is the same for columns of one component."""
    for i in np.flatnonzero(likely.any(1)).tolist():
        at = np.flatnonzero(likely[i])
        for j in at[np.unique(number[at], return_index=True)[1]].tolist():
            if roots.join(of_rows[i], of_columns[j]):
                yield i, j


def _crossing(least: float):
    """Likely pairs that join different components, of which one is a probe: at most one for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sig, keys, names = None, [], [], []
        for key, probe, part in runs(batches, "leaf", "block"):
            if key != held:
                held, sig, keys, names, roots = key, [], [], [], Roots()
                x = number = None
            fine = np.frombuffer(b"".join(part.column("fine").to_pylist()), np.uint8).reshape(-1, BINS)
            if not probe:  # the members of a block come before its probes
                sig.append(fine)
                keys += part.column("key").to_pylist()
                names += part.column("root").to_pylist()
                continue
            if not keys:
                continue
            if x is None:
                x, number = np.concatenate(sig), np.unique(names, return_inverse=True)[1]
            own, mine, a, b = part.column("key").to_pylist(), part.column("root").to_pylist(), [], []
            for at in range(0, len(own), 256):
                for i, j in joining(_likeness(fine[at : at + 256], x) >= least, mine[at : at + 256], names, number, roots):
                    a.append(own[at + i])
                    b.append(keys[j])
            if a:
                yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        release_memory()

    return run


def _sets(size: int):
    """Full sets as sorted 48-bit hashes; of a key that comes again in the task only the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part, data, off in pieces(batches, "text"):
            h, _, _, first = word_hashes(data, off)
            keys, out = part.column(2).to_pylist(), []
            new = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            for k in new:
                out.append((shingle_set(h[first[k] : first[k + 1]], size) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            rows = part.take(pa.array(new, pa.int64()))
            yield pa.record_batch([*rows.columns[:3], pa.array(out, pa.binary())], ["cluster", "block", "key", "elements"])
        release_memory()

    return run


def _unpacked(raw: bytes) -> np.ndarray:
    x = np.zeros((len(raw) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return x.view("<u8").ravel()


class Sets:
    """Sets of which the sizes of all intersections with others are wanted."""

    COLUMNS = 4096

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.elements, self.column = np.unique(np.concatenate(sets), return_inverse=True)
        self.row = np.repeat(np.arange(len(sets)), self.sizes)

    def linked(self, others: Sets, percent: int) -> np.ndarray:
        """Which of the others (rows) share percent of the union with which of these (columns)."""
        at = np.minimum(np.searchsorted(self.elements, others.elements), len(self.elements) - 1)
        both = self.elements[at] == others.elements
        place = np.full(len(self.elements), -1)
        place[at[both]] = np.arange(both.sum())
        x, y = place[self.column], np.where(both, np.cumsum(both) - 1, -1)[others.column]
        common = np.zeros((len(others.sizes), len(self.sizes)), np.float32)
        for low in range(0, int(both.sum()), self.COLUMNS):
            some, more = (x >= low) & (x < low + self.COLUMNS), (y >= low) & (y < low + self.COLUMNS)
            width = min(self.COLUMNS, int(both.sum()) - low)
            m, n = np.zeros((len(self.sizes), width), np.float32), np.zeros((len(others.sizes), width), np.float32)
            m[self.row[some], x[some] - low] = 1
            n[others.row[more], y[more] - low] = 1
            common += n @ m.T
        common = np.rint(common).astype(np.int64)
        return 100 * common >= percent * (others.sizes[:, None] + self.sizes[None] - common)


def _links(percent: int):
    """Links that join components: among the sets of a block, or of its probes with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[bytes] = []
        b: list[bytes] = []

        def among(sets: list[np.ndarray], keys: list[bytes]) -> None:
            if len(sets) < 9:
                roots = Roots()
                for i, x in enumerate(sets):
                    for j, y in enumerate(sets[:i]):
                        # too unlike in size to be linked, or joined by other links already
                        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or roots.find(keys[i]) == roots.find(keys[j]):
                            continue
                        z = np.sort(np.concatenate([x, y]))
                        common = int((z[1:] == z[:-1]).sum())
                        if 100 * common >= percent * (len(z) - common) and roots.join(keys[i], keys[j]):
                            a.append(keys[i])
                            b.append(keys[j])
                return
            known = Sets(sets)
            like, outside = known.linked(known, percent), np.ones(len(sets), bool)
            while outside.any():
                todo = [int(np.argmax(outside))]
                outside[todo[0]] = False
                while todo:
                    i = todo.pop()
                    for j in np.flatnonzero(like[i] & outside).tolist():
                        outside[j] = False
                        todo.append(j)
                        a.append(keys[i])
                        b.append(keys[j])

        def emitted() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            a.clear()
            b.clear()
            return out

        held, sets, keys, names, seen, probed = None, [], [], [], set(), False
        known = number = roots = None
        for key, probe, part in runs(batches, "cluster", "block"):
            if key != held:
                if len(sets) > 1 and not probed:
                    among(sets, keys)
                held, sets, keys, names, seen, probed = key, [], [], [], set(), False
                known, roots = None, Roots()
                if len(a) > 4096:
                    yield emitted()
            own, mine, raw = part.column("key").to_pylist(), part.column("root").to_pylist(), part.column("elements")
            if not probe:  # the members of a block come before its probes
                for k, x in enumerate(own):
                    if x not in seen:
                        seen.add(x)
                        keys.append(x)
                        names.append(mine[k])
                        sets.append(_unpacked(raw[k].as_py()))
                continue
            probed = True
            if not sets:
                continue
            if known is None:
                known, number = Sets(sets), np.unique(names, return_inverse=True)[1]
            for at in range(0, len(own), 256):
                like = known.linked(Sets([_unpacked(raw[k].as_py()) for k in range(at, min(at + 256, len(own)))]), percent)
                for i, j in joining(like, mine[at : at + 256], names, number, roots):
                    a.append(own[at + i])
                    b.append(keys[j])
            if len(a) > 4096:
                yield emitted()
        if len(sets) > 1 and not probed:
            among(sets, keys)
        yield emitted()
        release_memory()

    return run


class NearDuplicates:
    """One run over a table of documents; see near_duplicates."""

    def __init__(self, docs: DataFrame, percent: int, size: int, id_col: str, text_col: str):
        self.spark, self.percent, self.size = docs.sparkSession, percent, size
        self.ws = Workspace(self.spark, "near")
        self.least = percent / 100 - MARGIN
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))

    def sketched(self) -> None:
        rows = self.docs.mapInArrow(_sketches(self.size), "doc long, h long, n long, key binary, sig binary, fine binary")
        self.rows = self.ws.table(rows)
        some = self.rows.where("key is not null")
        # of each class one row stands for all: the one with the smallest (id, hash of the text)
        self.classes = self.ws.table(some.groupBy("key").agg(F.min(F.struct("doc", "h")).alias("one"), F.min("doc").alias("low"), F.first("sig").alias("sig"), F.first("fine").alias("fine"), F.first("n").alias("n")))

    def leaves(self) -> DataFrame:
        """Rows (leaf, size, key): a class in a node of each tree, without nodes of one class."""
        schema = "key binary, " + ", ".join(f"p{k} long" for k in range(LEVELS))
        left = self.classes.select("key", "sig").mapInArrow(_branches, schema)
        left = self.ws.table(left)
        done = None
        for level in range(LEVELS):
            p = f"p{level}"
            # written, so that adaptive execution can split a hot node
            sizes = self.ws.table(left.groupBy(p).agg(F.count("*").alias("size")).where("size > 1"))
            left = self.ws.table(left.join(sent_if_small(sizes), p).select("key", "size", *[f"p{k}" for k in range(level, LEVELS)]))
            ends = F.lit(True) if level == LEVELS - 1 else F.col("size") <= NODE
            found = left.where(ends).select(F.col(p).alias("leaf"), "size", "key")
            done = found if done is None else done.unionByName(found)
            left = left.where(~ends).drop("size", p)
        return self.ws.table(done)

    def _in_blocks(self, rows: DataFrame, *columns: str) -> DataFrame:
        return rows.join(self.classes.select("key", "fine"), "key").select("leaf", "block", "key", "fine", *columns)

    def forest(self, leaves: DataFrame) -> DataFrame:
        blocks = F.ceil(F.col("size") / NODE).cast("int")
        rows = leaves.select("leaf", F.when(F.col("size") <= NODE, 0).otherwise(F.pmod(F.xxhash64("key"), blocks)).cast("int").alias("block"), "key")
        large = leaves.where(F.col("size") > NODE).groupBy("leaf").agg(F.min("key").alias("key"), F.first("size").alias("size"))
        leader = large.select("leaf", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "key")
        rows = self._in_blocks(rows.unionByName(leader).distinct())
        return rows.repartition(self._partitions(), "leaf", "block").sortWithinPartitions("leaf", "block").mapInArrow(_forests(self.least), "a binary, b binary")

    def _partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _open(self, rows: DataFrame) -> DataFrame:
        """Rows (leaf, key, root) of nodes that hold more than one component, with the node's size, largest component and how many are outside it."""
        of_leaf = rows.groupBy("leaf", "root").agg(F.count("*").alias("n")).groupBy("leaf").agg(F.count("*").alias("roots"), F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("most"))
        of_leaf = self.ws.table(of_leaf.where("roots > 1").select("leaf", "size", F.col("most.root").alias("most"), (F.col("size") - F.col("most.n")).alias("outside")))
        return self.ws.table(rows.join(sent_if_small(of_leaf), "leaf"))

    def crossing(self, leaves: DataFrame, roots: DataFrame) -> DataFrame:
        """Likely pairs that join components which the forests have left apart, a spanning part of them for each block."""
        of_key = self.ws.table(leaves.select("key").distinct().join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("root")))
        open_ = self._open(leaves.select("leaf", "key").join(sent_if_small(of_key), "key"))
        for _ in range(DEEPER):
            wide = open_.where(F.col("outside") > BLOCK)
            if not wide.limit(1).count():
                break
            below = wide.select("leaf", "key", "root").join(self.classes.select("key", "sig"), "key").select("leaf", "key", "root", "sig")
            below = self._open(self.ws.table(below.mapInArrow(_branches_on, "leaf long, key binary, root binary")))
            open_ = self.ws.table(open_.where(F.col("outside") <= BLOCK).unionByName(below))
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        members = open_.select("leaf", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), "key", "root", F.lit(False).alias("probe"))
        probes = open_.where("root <> most").select("leaf", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "key", "root", F.lit(True).alias("probe"))
        rows = self._in_blocks(members.unionByName(probes), "root", "probe")
        return rows.repartition(self._partitions(), "leaf", "block").sortWithinPartitions("leaf", "block", "probe").mapInArrow(_crossing(self.least), "a binary, b binary")

    def sets_of(self, clusters: DataFrame) -> DataFrame:
        """Rows (cluster, blocks, block, key, elements): the full sets of all classes in clusters, from the text of one row of each."""
        of = clusters.select(F.col("node").alias("key"), F.xxhash64("component").alias("cluster")).join(self.classes.select("key", "n", "one"), "key")
        of = self.ws.table(of.select("key", "cluster", "n", F.col("one.doc").alias("d"), F.col("one.h").alias("h")))
        wide = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SETS)).cast("int")
        self.wide = self.ws.table(of.groupBy("cluster").agg(wide.alias("blocks")).where("blocks > 1"))
        block = F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))).cast("int")
        wanted = self.ws.table(of.join(sent_if_small(self.wide), "cluster", "left").select("key", "cluster", block.alias("block"), "d", "h"))
        wanted = sent_if_small(wanted)
        text = self.docs.join(wanted, F.col("doc").eqNullSafe(F.col("d")) & (self.docs["h"] == wanted["h"])).select("cluster", "block", "key", "text")
        return self.ws.table(text.mapInArrow(_sets(self.size), "cluster long, block int, key binary, elements binary"))

    def links(self, sets: DataFrame) -> DataFrame:
        """Rows (cluster, block, key, elements, root, probe) to links that join components."""
        rows = sets.select("cluster", "block", "key", "elements", "root", "probe").repartition(self._partitions(), "cluster", "block")
        return self.ws.table(rows.sortWithinPartitions("cluster", "block", "probe").mapInArrow(_links(self.percent), "a binary, b binary"))

    def across(self, sets: DataFrame, roots: DataFrame) -> DataFrame | None:
        """The sets of clusters in several blocks, where they have more than one component yet: each block with all probes."""
        if not self.wide.limit(1).count():
            return None
        large = sets.join(sent_if_small(self.wide), "cluster")
        of_key = self.ws.table(large.select("cluster", "blocks", "key").distinct().join(roots.withColumnRenamed("node", "key"), "key", "left").select("cluster", "key", "blocks", F.coalesce("component", "key").alias("root")))
        most = of_key.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most"))
        most = self.ws.table(most.where("roots > 1").select("cluster", "most.root").withColumnRenamed("root", "most"))
        of_key = self.ws.table(of_key.join(sent_if_small(most), "cluster").select("key", "blocks", "root", "most"))
        open_ = sets.join(sent_if_small(of_key), "key")
        probes = open_.where("root <> most").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return open_.withColumn("probe", F.lit(False)).unionByName(probes.withColumn("probe", F.lit(True)))

    def run(self) -> DataFrame:
        """Rows (doc, h, n_shingles, component_id, kept); h is the hash of the text."""
        ends = lambda roots: roots.select(F.col("node").alias("a"), F.col("component").alias("b"))
        components = lambda edges: self.ws.table(connected_components(self.spark, edges, self.ws))
        with arrow_batches(self.spark, 500):
            self.sketched()
            leaves = self.leaves()
            clusters = components(self.ws.table(self.forest(leaves)))
            more = self.ws.table(self.crossing(leaves, clusters))
            if more.limit(1).count():
                clusters = components(ends(clusters).unionByName(more))
            sets = self.sets_of(clusters)
            roots = components(self.links(sets.withColumns({"root": F.col("key"), "probe": F.lit(False)})))
            rest = self.across(sets, roots)
            if rest is not None:
                second = self.links(rest)
                if second.limit(1).count():
                    roots = components(ends(roots).unionByName(second))
        found = self.ws.table(self.answer(roots))
        self.ws.drop_but(found)
        return found

    def answer(self, roots: DataFrame) -> DataFrame:
        joined = self.classes.select("key", "low").join(roots.withColumnRenamed("node", "key"), "key")
        lows = joined.groupBy("component").agg(F.min("low").alias("component_id"))
        linked = joined.join(lows, "component").select("key", "component_id")
        of_class = self.classes.select("key", "low").join(linked, "key", "left").select("key", F.coalesce("component_id", "low").alias("component_id"))
        # written, so that adaptive execution can split a hot class
        of_class = sent_if_small(self.ws.table(of_class))
        some = self.rows.where("key is not null").select("doc", "h", "n", "key").join(of_class, "key").select("doc", "h", "n", "component_id")
        none = self.rows.where("key is null").select("doc", "h", "n", F.col("doc").alias("component_id"))
        return some.unionByName(none).select("doc", "h", F.col("n").alias("n_shingles"), "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, n_shingles, component_id, kept), one for each row of docs.

    Two documents are linked when their sets of `size`-word shingles have an intersection of at least percent of their
    union; component_id is the smallest id that links reach, and kept marks the document with that id. Words are parted
    by blanks and compared with A-Z lower-cased; fewer than size words are one shingle. A null text or one without words
    has an empty set and is linked with nothing. Null ids are larger than all others; components of null ids alone have
    a null component_id, and their rows are kept. Repeated ids share their verdict.

    Hot groups: exact copies meet as one class in an aggregate with map-side combine; near copies meet in nodes and
    clusters that are compared in blocks, inside a kernel that gives spanning links only; joins on a hot class are
    broadcast where the other side is small, else merge joins of written tables, which adaptive execution splits.
    """
    return NearDuplicates(docs, percent, size, id_col, text_col).run().drop("h")


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each component the document with the smallest id stays, unchanged.

    Of repeated rows (equal ids and texts) one stays, without regard to other columns. Documents without words stay.
    """
    found = NearDuplicates(docs, percent, size, id_col, text_col).run()
    # verdicts that change something, under names that docs does not have
    d, h, kept, n = (f"{OWN}{c}" for c in ("doc", "hash", "kept", "n"))
    verdicts = found.groupBy(F.col("doc").alias(d), F.col("h").alias(h)).agg(F.max("kept").alias(kept), F.count("*").alias(n)).where(f"not {kept} or {n} > 1")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    verdicts = Workspace(docs.sparkSession, "verdicts").table(verdicts)
    judged = docs.join(sent_if_small(verdicts), F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (key == F.col(h)), "left").where(f"{kept} is null or {kept}")
    once = judged.where(f"{n} is null").select(docs.columns)
    return once.unionByName(judged.where(f"{n} > 1").dropDuplicates([d, h]).select(docs.columns))
