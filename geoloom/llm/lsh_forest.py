"""Near-duplicate groups by an LSH forest of MinHash signatures.

A document's set is that of its distinct word shingles. Documents with equal sets are one node.
The forest has ``TREES`` orders of the signature's values. In each, the nodes are sorted by their
values in that order (a range sort over all partitions), and neighbours with the longest common
prefixes are candidates. Nodes that share ``LEVELS[0]`` values are a region, and the depth adapts to it:
in a region of ``SMALL`` nodes or fewer neighbours in order are linked first; in a larger one, and each region of longer
prefixes in it, each node is linked to the hub. The hub is the node that most
others share deep prefixes with: in a group of copies of one text that is the text itself, which
its copies resemble more than they do each other. Ranges end anywhere, so that no region is one
task's; pieces of a region share its hub.

When these links are confirmed and their components found, only pairs of different components can still change
anything. Of small regions these are all other pairs. Large regions have no pairs made: their nodes outside the region's
largest component are *open*, and these are joined with all nodes of large regions exactly (``exact_candidates``): sets of similarity
t share one of the first n - ceil(t * n) + 1 of their hashes in any common order, here the rarest first by a sketch of counts, and their places in
it bound what they can have in common. So no linked pair of a large region is left out, whatever the region's size, and
rows are made for rare hashes only.

Candidates of small regions whose signatures agree in less than ``ESTIMATE`` (over six standard deviations below
the threshold of 0.8) are left, and all whose set sizes rule the threshold out; all others are confirmed on
the full sets of 64-bit shingle hashes. A pair of similarity s in small regions only is found with
probability 1 - (1 - s**3)**16, 0.99998 at 0.8.

Null or empty text: the empty set, linked with nothing. Fewer words than a shingle: the whole
sequence is the one shingle. Long texts: whole sets. Repeated rows: each gets the group's result. Rows that share
a doc_id are one document with several texts, in one component. Null doc_id: kept, without a
component, linked with nothing. Other columns are not looked at; names of theirs can clash with none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ._shared import HashCache, MemberFilter, materialize, mix64, slices, words_of
from .components import components

TREES = 16
VALUES = 6 * TREES
LEVELS = (3, 6, 9, 12, 16)
SMALL = 48
COUNTERS = 1 << 18
RANGE_BYTES = 32 << 20
ESTIMATE = 0.55
_ODD = (mix64(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1))[None, :]


def shingles(text: str | None, size: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = cache.of(words_of(text))
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for i in range(min(size, len(words))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(out)


def signature(values: np.ndarray) -> np.ndarray:
    """MinHash of a set of hashes: ``VALUES`` 32-bit minima."""
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), 4096):
        part = (values[at : at + 4096, None] * _ODD) >> np.uint64(32)
        best = np.minimum(best, part.min(axis=0).astype(np.uint32))
    return best


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for whole in batches:
            for batch in slices(whole, 1):
                n, keys, sigs = [], [], []
                for text in batch.column(1).to_pylist():
                    own = shingles(text, size, cache)
                    n.append(len(own))
                    if len(own):
                        sums = np.array([mix64(own).sum(dtype=np.uint64), mix64(~own).sum(dtype=np.uint64)])
                        keys.append(sums.tobytes())
                        sigs.append(signature(own).tobytes())
                    else:
                        keys.append(None)
                        sigs.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n", "key", "sig"]
                )

    return run


def _orders(length: int) -> np.ndarray:
    """Places in the signature by which each tree sorts."""
    return np.array([[(6 * t + i) % VALUES for i in range(length)] for t in range(TREES)])


def _keyed(orders: np.ndarray, kind: str):
    """A row for each node and tree: the low bits of its values (a ``kind``) in the tree's order, and the columns after the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, length = orders.shape
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                n = batch.num_rows
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, VALUES)
                values = np.ascontiguousarray((sig & np.uint32(256 ** np.dtype(kind).itemsize - 1)).astype(kind)[:, orders])
                ends = np.arange(n * trees + 1, dtype=np.int32) * np.int32(values.itemsize * length)
                keys = pa.Array.from_buffers(pa.binary(), n * trees, [None, pa.py_buffer(ends), pa.py_buffer(values)])
                rows = pa.array(np.repeat(np.arange(n), trees))
                rest = [batch.column(i).take(rows) for i in (0, *range(2, batch.num_columns))]
                names = ["tree", "key", batch.schema.names[0], *batch.schema.names[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), keys, *rest], names=names)

    return run


class Sorted:
    """The rows of one range in order: how long a prefix each shares with the row before it."""

    def __init__(self, batches: Iterator[pa.RecordBatch], kind: str, most: int) -> None:
        self.rows, self.most = list(batches), most
        self.tree = self.column(0)
        n = len(self.tree)
        parts = [np.frombuffer(b"".join(b.column(1).to_pylist()), kind).reshape(b.num_rows, -1) for b in self.rows if b.num_rows]
        self.key = np.concatenate(parts) if parts else np.zeros((0, 1), kind)
        agree = np.zeros(n, bool)
        agree[1:] = self.tree[1:] == self.tree[:-1]
        self.prefix = np.zeros(n, np.int32)
        for i in range(self.key.shape[1]):
            agree[1:] &= self.key[1:, i] == self.key[:-1, i]
            self.prefix += agree
        self.active = np.ones(n, bool)  # in no region that is small and whole

    def column(self, i: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(b.column(i).to_numpy(zero_copy_only=False) for b in self.rows)])

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of regions of this depth that are in none that is small: places of the rows in small ones and in larger
        ones. One that the range's end may cut is in both."""
        start = np.flatnonzero(self.prefix < depth)
        size = np.diff(np.append(start, len(self.prefix)))
        self.run = np.repeat(np.arange(len(start)), size)
        self.size = size[self.run]
        small = self.active & (self.size > 1) & (self.size <= self.most)
        if len(self.run):
            self.active &= (self.size > self.most) | (self.run == 0) | (self.run == self.run[-1])
        return np.flatnonzero(small), np.flatnonzero(self.active)

    def pairs(self, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of the rows ``at`` with those up to ``most`` after them in their region."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(1, most + 1):
            at = at[at + k < len(self.run)]
            at = at[self.run[at] == self.run[at + k]]
            left.append(at)
            right.append(at + k)
        return np.concatenate(left), np.concatenate(right)


FOUND = "a bigint, b bigint, region bigint, level int, n bigint"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of small regions with their distance in order (n), and nodes (a) of larger ones with the region, its depth and size."""
    rows = Sorted(batches, ">u2", SMALL)
    node, state, done = rows.column(2), rows.tree.astype(np.uint64), 0
    for depth in LEVELS:
        small, large = rows.level(depth)
        for i in range(done, depth):
            state = mix64(state * np.uint64(0x9E3779B97F4A7C15) + rows.key[:, i].astype(np.uint64) + np.uint64(1))
        done = depth
        if depth == LEVELS[0]:
            within = np.zeros(len(node), bool)
            within[large] = True  # in a large region, or one that may be
            for x, y in _chunks(*rows.pairs(small, SMALL - 1)):
                a, b = node[x], node[y]
                rest = [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32()), pa.array((y - x).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *rest], names=["a", "b", "region", "level", "n"])
        else:
            large = np.flatnonzero(within & (rows.size > 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[large]), pa.nulls(len(large), pa.int64()), pa.array(state[large].view(np.int64)), pa.array(np.full(len(large), depth, np.int32)), pa.array(rows.size[large])],
            names=["a", "b", "region", "level", "n"],
        )


def _chunks(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(x), 1 << 14):
        yield x[at : at + (1 << 14)], y[at : at + (1 << 14)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, n): how many hashes fall on each counter, for sets (node, hashes)."""
    own = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for hashes in batch.column(1).to_pylist():
            np.add.at(own, _counter(np.frombuffer(hashes, np.uint64)), 1)
    at = own.nonzero()[0]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], names=["at", "n"])


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(COUNTERS - 1)).astype(np.int64)


def _least_common(n: int, percent: int) -> int:
    """How many hashes of a set of ``n`` another one must have to be linked with it."""
    return -(-percent * n // 100)


def _prefixes(counts, percent: int):
    """(node, n, prefix): the size of a set, and the first of its hashes by count, of which a linked set has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prefix = [], []
            for hashes in batch.column(1).to_pylist():
                own = np.frombuffer(hashes, np.uint64)
                first = np.lexsort((own, counts.value[_counter(own)]))[: len(own) - _least_common(len(own), percent) + 1]
                n.append(len(own))
                prefix.append(own[first].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prefix, pa.binary())], names=["node", "n", "prefix"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hash of a prefix, with its place; columns are those of ``_prefixes`` and the node's component and whether it is open."""
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            hashes = [np.frombuffer(b, np.int64) for b in batch.column(2).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]))
            at = np.concatenate([np.arange(len(h)) for h in hashes])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes)), pa.array(at.astype(np.int64)), *(batch.column(i).take(rows) for i in (0, 1, 3, 4))],
                names=["hash", "at", "node", "n", "component", "is_open"],
            )


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(axis=-1) >= ESTIMATE


@F.pandas_udf(BooleanType())
def _likely(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(len(s), VALUES) for s in (a, b))
    return pd.Series(_alike(x, y))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmer(percent: int):
    @F.pandas_udf(BooleanType())
    def confirm(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            out.append(_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
        return pd.Series(out, dtype=bool)

    return confirm


class Forest:
    """The nodes of a table of documents, their signatures and their regions."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> None:
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        self.size, self.percent = size, percent
        self.rows = materialize(self.docs.mapInArrow(_signed(size), "doc_id bigint, n bigint, key binary, sig binary"), "signatures")
        keyed = self.rows.where("key is not null and doc_id is not null").groupBy("key")
        self.nodes = materialize(keyed.agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
        found = self.sorted(self.nodes.select("node", "sig"), _orders(LEVELS[-1]), ">u2").mapInArrow(_forest, FOUND)
        self.found = materialize(found, "forest")

    def sorted(self, nodes: DataFrame, orders: np.ndarray, kind: str) -> DataFrame:
        """The nodes (node, sig, ...) in each of the orders, in ranges of about ``RANGE_BYTES`` of keys."""
        rest = "".join(f", {f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields[2:])
        rows = nodes.mapInArrow(_keyed(orders, kind), "tree int, key binary, node bigint" + rest)
        least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(least, -(-nodes.count() * orders.size * np.dtype(kind).itemsize // RANGE_BYTES))
        return rows.repartitionByRange(ranges, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")

    def candidates(self) -> DataFrame:
        """(a, b): the neighbours in small regions, and each node of a larger one with its hub."""
        large = self.found.where("b is null").select(F.col("a").alias("node"), "region", "n")
        score = large.groupBy("node").agg(F.sum("n").alias("score"))
        hubs = large.join(score, "node").groupBy("region").agg(F.max(F.struct(F.col("score"), (-F.col("node")).alias("id"))).alias("hub"))
        stars = large.select("node", "region").join(hubs.select("region", (-F.col("hub")["id"]).alias("hub")), "region").where("node <> hub")
        stars = stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        return self.found.where("b is not null and n = 1").select("a", "b").unionAll(stars).distinct()

    def other_candidates(self, found: DataFrame) -> DataFrame:
        """(a, b): the pairs of small regions that are of different components; ``found`` is (node, component)."""
        pairs = self.found.where("b is not null and n > 1").select("a", "b").distinct()
        of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias("of_" + c))
        pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")

    def exact_candidates(self, found: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """(a, b) of different components, one of them outside the largest component of a large region: all that can be linked, by the rarest
        hashes of their sets; and those sets. ``found`` is (node, component). None if there is no such node."""
        large = self.found.where(f"b is null and level = {LEVELS[0]}").select(F.col("a").alias("node"), "region").join(found, "node", "left")
        large = large.select("region", "node", F.coalesce("component", "node").alias("component"))
        parts = large.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
        most = parts.groupBy("region").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n_all"))
        most = most.where(F.col("most")["n"] < F.col("n_all")).select("region", F.col("most")["component"].alias("largest"))
        rows = large.join(most, "region").groupBy("node").agg(F.max("component").alias("component"), F.max(F.col("component") != F.col("largest")).alias("is_open"))
        rows = materialize(rows, "open-nodes")
        if rows.isEmpty():
            return None
        sets = self.sets(rows.select("node"))
        told = sets.mapInArrow(_counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(COUNTERS, np.int64)
        counts[told["at"].to_numpy()] = told["n"].to_numpy()
        shared = rows.sparkSession.sparkContext.broadcast(counts)
        prefixes = sets.mapInArrow(_prefixes(shared, self.percent), "node bigint, n bigint, prefix binary").join(rows, "node")
        listed = prefixes.select("node", "n", "prefix", "component", "is_open").mapInArrow(_listed, "hash bigint, at bigint, node bigint, n bigint, component bigint, is_open boolean")
        listed = materialize(listed, "prefixes")
        x, y = (listed.select("hash", *(F.col(c).alias(p + c) for c in ("at", "node", "n", "component", "is_open"))) for p in ("x_", "y_"))
        # two open nodes meet once; at the first hash that two sets share, no more than what follows in both can be common
        once = (F.col("x_component") != F.col("y_component")) & (~F.col("y_is_open") | (F.col("x_node") < F.col("y_node")))
        common = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
        enough = common * (100 + self.percent) >= (F.col("x_n") + F.col("y_n")) * self.percent
        sizes = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * self.percent
        met = x.where("x_is_open").join(y, "hash").where(once & sizes & enough)
        return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct(), sets

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Of (a, b), those whose sizes and signatures allow the threshold."""
        a = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        b = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        both = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        return both.where(_likely("sig_a", "sig_b")).select("a", "b").distinct()

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, hashes), materialised: the full sets of ``nodes`` (a column), and of a few others.

        The texts are filtered and made into sets where they are read, before any shuffle.
        """
        size, shared = self.size, self.docs.sparkSession.sparkContext.broadcast(MemberFilter.of(nodes))

        def run(batches):
            cache = HashCache()
            for whole in batches:
                known = whole.filter(pc.is_valid(whole.column(0)))
                kept = known.filter(pa.array(shared.value.has(known.column(0).to_numpy(zero_copy_only=False))))
                for batch in slices(kept, 1):
                    sets = [shingles(text, size, cache).tobytes() for text in batch.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])

        return materialize(self.docs.mapInArrow(run, "node bigint, hashes binary"), "sets")

    def confirmed(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Of (a, b), those that the full sets confirm."""
        sets = sets or self.sets(pairs.select("a").unionAll(pairs.select("b")).distinct())
        a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
        b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
        return pairs.join(a, "a").join(b, "b").where(_confirmer(self.percent)("set_a", "set_b")).select("a", "b")

    def components(self) -> DataFrame:
        """(node, component) of all linked nodes."""
        tried = materialize(self.likely(self.candidates()), "candidates")
        links = materialize(self.confirmed(tried), "links")
        found = components(links)
        # only pairs of different components are left to be tried
        more = []
        tried = materialize(self.likely(self.other_candidates(found)), "other-candidates")
        if not tried.isEmpty():
            more.append(materialize(self.confirmed(tried), "other-links"))
        exact = None if self.found.where("b is null").isEmpty() else self.exact_candidates(found)
        if exact is not None:
            tried = materialize(exact[0], "exact-candidates")
            more.append(materialize(self.confirmed(tried, exact[1]), "exact-links"))
        more = [m for m in more if not m.isEmpty()]
        return components(reduce(DataFrame.unionAll, [links, *more])) if more else found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Documents are linked if ``100 * intersection >= percent * union`` of their shingle sets.
    """
    forest = Forest(docs, id_col, text_col, shingle_words, percent)
    by_node = forest.components()
    by_key = forest.nodes.select("key", "node").join(by_node, "node", "left")
    by_key = by_key.groupBy("key").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    rows = forest.rows.select("doc_id", "n", "key").join(by_key, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each near-duplicate group, with all their columns.

    Of rows that share an id one stays (the first by text); rows without an id stay.
    """
    marks = near_duplicates(docs, id_col, text_col, shingle_words, percent)
    # written, so that their size decides how they are joined
    gone = materialize(marks.where("not kept").select(F.col("doc_id").alias("__id")).distinct(), "gone")
    again = materialize(marks.where("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("n")).where("__id is not null and n > 1").select("__id"), "repeated")
    kept = docs.join(gone, docs[id_col].cast("bigint") == F.col("__id"), "left_anti")
    if again.isEmpty():
        return kept
    order = Window.partitionBy(id_col).orderBy(text_col)
    several = kept.join(again, kept[id_col].cast("bigint") == F.col("__id"), "left_semi").withColumn("__at", F.row_number().over(order)).where("__at = 1").drop("__at")
    return kept.join(again, kept[id_col].cast("bigint") == F.col("__id"), "left_anti").unionByName(several)
