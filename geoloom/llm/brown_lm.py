"""Scoring texts with a Brown class-based bigram model.

log P(text) is the sum over its tokens of log P(class | class before) + log P(word | class).
Every word of the training texts has a class by its own neighbours; only words that are not in
them take the class of one of ``GROUPS`` groups, by a hash of their last two characters.

Exchange clustering gives an item the class that gains most, from the item bigrams, under the
class-bigram likelihood (Brown et al. 1992, Martin et al. 1998). It runs ``ROUNDS`` rounds over
the words with at least one of ``1 << EXCHANGE_BITS`` training tokens and the groups; odd and even
items move in turn, against the counts of the round before, so a round is one aggregation
(Uszkoreit and Brants 2008). All other words then move once, each in the
partition of its hash, from the classes of the tokens on both sides of it in the whole corpus (a
neighbour that is itself not among the first counts as its group). Class sizes and class
bigrams are counted again with the final class of each word. Both distributions are smoothed by
added counts.

Corpus counts cover all training texts, and the table of words with their classes grows with
them. What a worker or the driver holds does not: a word with a share of 2**-LOCAL_BITS of the
tokens is kept in memory, and there can be no more than 2**LOCAL_BITS of these; counts and
classes of all other words are joined in a shuffle by the word's hash, in blocks of texts. The
classes' tables have ``CLASSES`` squared entries.

Words are cut and hashed in whole columns of texts by array operations (``Words``): a table of 250,000 words,
emptied when full, missed one token in seven of the check tool's first documents.

Null and empty texts are the end token alone. Repeated rows, and rows that share an id, are scored, and learnt, each.
Long texts are read whole. Items that gain equally from two classes take the first. Other columns are not looked at.
Without training texts every count is 0 and the base score of a token is that of one unseen.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, mix64, slices

CLASSES = 48
GROUPS = 256
EXCHANGE_BITS = 14
LOCAL_BITS = 20
ROUNDS = 8
ADDED = 0.5
END_HASH = np.uint64(0x9E3779B97F4A7C15)
FLUSH = 1_000_000
LONG_WORD = 64


def group_of(word: bytes) -> int:
    """The item of a word that is none of its own."""
    return zlib.crc32(word.decode("utf-8", "ignore")[-2:].encode("utf-8", "ignore")) % GROUPS


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a text or binary column are cut, and all their bytes; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, cuts, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    cuts = np.frombuffer(cuts, np.int64)[column.offset : column.offset + len(column) + 1]
    return cuts - cuts[0], np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]


_LOWER, _SPACE = np.arange(256, dtype=np.uint8), np.zeros(256, bool)
_LOWER[65:91] += 32
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ONE, _TWO = (np.array([zlib.crc32(bytes(c)) % GROUPS for c in itertools.product(range(128), repeat=n)], np.int32) for n in (1, 2))


class Words:
    """The tokens of a column of texts: words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and an end after each text.

    Words are cut and hashed for the whole column at once, as most of them are too rare for a table of words seen before.
    ``ends`` are the texts' past-the-end places.
    """

    def __init__(self, column: pa.Array | None = None) -> None:
        cuts, data = raw(pa.array([], pa.string()) if column is None else column)
        self._set(_LOWER[data])
        word = ~_SPACE[data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        # texts stand one after another with nothing between them
        first, last = cuts[:-1][cuts[:-1] < len(data)], cuts[1:][cuts[1:] > 0] - 1
        opens[first], closes[last] = word[first], word[last]
        starts = np.flatnonzero(opens)
        self.ends = np.cumsum(np.diff(np.searchsorted(starts, cuts)) + 1)
        self.is_end = np.zeros(len(starts) + len(self.ends), bool)
        self.is_end[self.ends - 1] = True
        self._starts, self._sizes = np.zeros(len(self.is_end), np.int64), np.zeros(len(self.is_end), np.int64)
        self._starts[~self.is_end], self._sizes[~self.is_end] = starts, np.flatnonzero(closes) + 1 - starts
        self.hashes = np.where(self.is_end, END_HASH, self._hashes(self._starts, self._sizes))

    def _set(self, data: np.ndarray) -> None:
        self._data = np.append(data, np.zeros(8, np.uint8))
        # the eight bytes from each place on
        self._eight = np.ndarray((len(data) + 1,), "<u8", self._data, strides=(1,))

    def _hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """64-bit hashes of words, eight bytes at a time; of equal sizes up to eight bytes no two are the same."""
        out = mix64(mix64(sizes.astype(np.uint64)) ^ (self._eight[starts] & _LOW_BYTES[np.minimum(sizes, 8)]))
        more = np.flatnonzero(sizes > 8)
        for done in range(8, LONG_WORD, 8):
            more = more[sizes[more] > done]
            left = np.minimum(sizes[more] - done, 8)
            out[more] = mix64(out[more] ^ (self._eight[starts[more] + done] & _LOW_BYTES[left]))
        for at in np.flatnonzero(sizes > LONG_WORD):
            out[at] = xxhash.xxh64_intdigest(self._data[starts[at] : starts[at] + sizes[at]])
        return out

    def _hash(self, word: bytes) -> int:
        """Of one word."""
        self._set(np.frombuffer(word, np.uint8))
        return int(self._hashes(np.zeros(1, np.int64), np.array([len(word)]))[0])

    def groups(self, at: np.ndarray) -> np.ndarray:
        """The groups of the words at these places."""
        starts, ends = self._starts[at], self._starts[at] + self._sizes[at]
        one, last = ends - starts == 1, self._data[ends - 1]
        before = self._data[ends - 2]
        out = np.where(one, _ONE[last & 127], _TWO[(before & 127).astype(np.int32) << 7 | (last & 127)])
        other = np.flatnonzero((last > 127) | ((before > 127) & ~one))
        starts, ends = starts[other], ends[other]
        two = ends
        for _ in range(2):  # a character back
            two = two - 1
            for _ in range(3):
                two = two - (self._data[two] >> 6 == 2)
            two = np.maximum(two, starts)
        _, firsts, kind = np.unique(self._hashes(two, ends - two), return_index=True, return_inverse=True)
        found = [group_of(self._data[a:b].tobytes()) for a, b in zip(two[firsts], ends[firsts])]
        out[other] = np.array(found, np.int32)[kind]
        return out


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0]


def _counts(parts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of a task and their counts, given out when they are many."""
    held, size = [], 0
    for part in parts:
        held.append(np.unique(part, return_counts=True))
        size += len(held[-1][0])
        if size > 2 * FLUSH:
            held = [_summed(*map(np.concatenate, zip(*held)))]
            size = len(held[0][0])
            if size > FLUSH:
                yield held.pop()
                size = 0
    if held:
        yield _summed(*map(np.concatenate, zip(*held)))


def _pieces(batches: Iterator[pa.RecordBatch], text_index: int = 0) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for whole in batches:
        for batch in slices(whole, text_index):
            yield batch, Words(batch.column(text_index))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n) of a task's words."""
    for hashes, n in _counts(words.hashes for _, words in _pieces(batches)):
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["hash", "n"])


@dataclass
class Local:
    """Frequent words in memory: their hashes, counts and items."""

    hashes: np.ndarray
    counts: np.ndarray
    items: np.ndarray
    n_items: int  # their items; then come the groups, then the end

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for none."""
        if not hasattr(self, "_index"):
            self._index = pd.Index(self.hashes)
        return self._index.get_indexer(hashes)

    def item_of(self, words: Words) -> np.ndarray:
        item = np.append(self.items, -1)[self.find(words.hashes)]
        other = np.flatnonzero((item < 0) & ~words.is_end)
        item[other] = self.n_items + words.groups(other)
        item[words.is_end] = self.n_items + GROUPS
        return item


def _before(items: np.ndarray, ends: np.ndarray, end_item: int) -> np.ndarray:
    """The item before each token; a text starts after an end."""
    before = np.empty_like(items)
    before[1:] = items[:-1]
    if len(items):
        before[0] = end_item
        before[ends[:-1]] = end_item
    return before


def _gain(counts: np.ndarray) -> np.ndarray:
    """What a bigram of two classes adds to the likelihood."""
    smooth = counts + 0.1
    return np.log(smooth * smooth.sum() / np.outer(smooth.sum(axis=1), smooth.sum(axis=0)))


def _packed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct keys, and the values of each as binary."""
    order = np.argsort(keys)
    keys, values = keys[order], np.ascontiguousarray(values[order])
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    offsets = (np.append(starts, len(keys)) * values.itemsize).astype(np.int32)
    return keys[starts], pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def exchange(n_items: int, pairs: DataFrame, freq: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each item but the end, and the class-bigram counts (the end's class is the last).

    ``pairs`` is (a, b, n) of items; each round sums it up by item and neighbour's class.
    """
    spark = pairs.sparkSession
    end = n_items
    classes = np.empty(n_items + 1, np.int64)
    classes[np.argsort(-freq[:n_items], kind="stable")] = np.arange(n_items) % CLASSES
    classes[end] = CLASSES
    k = CLASSES + 1

    def histograms(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of (item, class after) and (class before, item)."""
        shared = spark.sparkContext.broadcast(classes)

        def summed(batches):
            # items and classes are bounded, so are a task's sums
            after, before = np.zeros((len(shared.value), k), np.int64), np.zeros((len(shared.value), k), np.int64)
            for batch in batches:
                a, b, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                np.add.at(after, (a, shared.value[b]), n)
                np.add.at(before, (b, shared.value[a]), n)
            for side, counts in ((0, after), (1, before)):
                item, cls = counts.nonzero()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(item), side, np.int32)), pa.array(item * k + cls), pa.array(counts[item, cls])], names=["side", "cell", "n"]
                )

        rows = pairs.mapInArrow(summed, "side int, cell bigint, n bigint").groupBy("side", "cell").agg(F.sum("n").alias("n")).toPandas()
        out = []
        for side in (0, 1):
            own = rows[rows["side"] == side]
            flat = np.zeros((n_items + 1) * k)
            flat[own["cell"].to_numpy()] = own["n"].to_numpy()
            out.append(flat.reshape(n_items + 1, k))
        return out[0], out[1]

    def table(classes: np.ndarray, after: np.ndarray) -> np.ndarray:
        out = np.zeros((k, k))
        np.add.at(out, classes, after)
        return out

    def likelihood(counts: np.ndarray) -> float:
        def h(x):
            return float((x[x > 0] * np.log(x[x > 0])).sum())

        return h(counts) - h(counts.sum(axis=0)) - h(counts.sum(axis=1))

    best, best_classes, best_counts = -np.inf, classes, None
    for r in range(rounds + 1):
        after, before = histograms(classes)
        counts = table(classes, after)
        now = likelihood(counts)
        if now > best:
            best, best_classes, best_counts = now, classes.copy(), counts
        if r == rounds:
            break
        gain = _gain(counts)
        value = after @ gain.T + before @ gain
        value[:, CLASSES] = -np.inf
        wanted = value[:n_items].argmax(axis=1)
        moving = (np.arange(n_items) % 2 == r % 2) | (r == 0)
        classes = classes.copy()
        classes[:n_items][moving] = wanted[moving]
    return best_classes, best_counts


def learn(train: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict]:
    """(hash, n, cls) of the training words, materialised, and the bounded part of the model."""
    spark = train.sparkSession
    texts = train.select(F.col(text_col).alias("text"))
    counted = texts.mapInArrow(_count_words, "hash bigint, n bigint")
    counts = materialize(counted.groupBy("hash").agg(F.sum("n").alias("n")), "word-counts")
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # at most 2**EXCHANGE_BITS words can have such a share of the tokens
    frequent = counts.where((F.col("n") >= max(2.0, n_tokens / (1 << EXCHANGE_BITS))) & (F.col("hash") != int(END_HASH.view(np.int64)))).toPandas()
    hashes = frequent["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    local = Local(hashes[order], frequent["n"].to_numpy(np.int64)[order], np.arange(len(order)), len(order))
    shared = spark.sparkContext.broadcast(local)

    def count_pairs(batches):
        own = shared.value
        end = own.n_items + GROUPS

        def keys():
            for _, words in _pieces(batches):
                item = own.item_of(words)
                yield _before(item, words.ends, end) * (end + 1) + item

        for found, n in _counts(keys()):
            yield pa.RecordBatch.from_arrays([pa.array((found // (end + 1)).astype(np.int32)), pa.array((found % (end + 1)).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

    pairs = texts.mapInArrow(count_pairs, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs, "item-pairs")
    # every token is the second of one pair
    size = np.zeros(local.n_items + GROUPS + 1)
    for item, n in pairs.groupBy("b").agg(F.sum("n")).toPandas().itertuples(index=False):
        size[item] = n
    classes, bigrams = exchange(local.n_items + GROUPS, pairs, size)
    table = materialize(_with_classes(texts, counts, local, classes, _gain(bigrams)), "word-classes")
    model = {"classes": classes, "n": int(n_tokens), "v": int(n_words), "ends": int(size[-1])}
    # the words kept in memory, at most 2**LOCAL_BITS, with their own classes as items
    kept = table.where((F.col("n") >= max(2.0, n_tokens / (1 << LOCAL_BITS))) & (F.col("cls") < CLASSES)).toPandas()
    hashes = kept["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    local = Local(hashes[order], kept["n"].to_numpy(np.int64)[order], kept["cls"].to_numpy(np.int64)[order], CLASSES)
    sizes, varieties = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for c, count, v in table.groupBy("cls").agg(F.sum("n"), F.count(F.lit(1))).toPandas().itertuples(index=False):
        sizes[c], varieties[c] = count, v
    return table, model | {"local": local, "groups": classes[-GROUPS - 1 : -1], "below": np.log10(sizes + varieties + 1)}


def _with_classes(texts: DataFrame, counts: DataFrame, local: Local, classes: np.ndarray, gain: np.ndarray) -> DataFrame:
    """(hash, n, cls) of ``counts``: words that are no items move to the class that gains most."""
    spark = texts.sparkSession
    done = spark.createDataFrame(
        [(int(h), int(c)) for h, c in zip(local.hashes.view(np.int64), classes[local.items])], "hash bigint, moved int"
    )
    shared = spark.sparkContext.broadcast((local, classes))
    k = CLASSES + 1

    def sides(batches):
        """(hash, cells): the classes before and after each occurrence, two bytes for both."""
        local, classes = shared.value
        held, size = [], 0

        def out():
            keys, cells = _packed(*map(np.concatenate, zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), cells], names=["hash", "cells"])

        for _, words in _pieces(batches):
            item = local.item_of(words)
            cls = classes[item].astype(np.uint16)
            # a text ends in an end, so each of its words has a token after it
            cell = _before(cls, words.ends, CLASSES) * np.uint16(k) + np.append(cls[1:], np.uint16(CLASSES))
            open_ = (item >= local.n_items) & ~words.is_end
            held.append((words.hashes[open_], cell[open_]))
            size += len(held[-1][0])
            if size > 4 * FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    # what one occurrence between two classes adds to the value of each class
    worth = np.ascontiguousarray((gain[:CLASSES].T[None, :, :] + gain[:, None, :CLASSES]).reshape(k * k, CLASSES), np.float32)

    def move(batches):
        """(hash, class) of rows sorted by hash: a word's rows are summed up as they come."""
        word, value = None, np.zeros(CLASSES)
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                hashes = batch.column(0).to_numpy()
                cuts, cell = raw(batch.column(1))
                cell = cell.view(np.uint16)
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1]]))
                if not len(first):
                    continue
                starts = cuts[first] // 2
                sums = np.add.reduceat(worth[cell], starts, axis=0, dtype=np.float64)
                own = hashes[first]
                if own[0] == word:
                    sums[0] += value
                elif word is not None:
                    own, sums = np.append(word, own), np.vstack([value, sums])
                word, value = own[-1], sums[-1]
                yield pa.RecordBatch.from_arrays([pa.array(own[:-1]), pa.array(sums[:-1].argmax(axis=1).astype(np.int32))], names=["hash", "moved"])
        if word is not None:
            yield pa.RecordBatch.from_arrays([pa.array([word], pa.int64()), pa.array([value.argmax()], pa.int32())], names=["hash", "moved"])

    seen = texts.mapInArrow(sides, "hash bigint, cells binary").repartition("hash").sortWithinPartitions("hash")
    moved = seen.mapInArrow(move, "hash bigint, moved int").unionAll(done)
    # the end alone is no word
    return counts.join(moved, "hash", "left").select("hash", "n", F.coalesce("moved", F.lit(CLASSES)).alias("cls"))


def annotate(df: DataFrame, table: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, inside, classes) of each row of ``df``, materialised.

    ``classes`` has a byte for each token, ``inside`` is the sum of log P(word | class). A block of texts
    gives a row of its own and one for each rare word in it with that word's places; counts
    and classes are joined to these, and the block's rows meet again.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    doc_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["block", "hash", "places", "ids", "own"]
    schema = f"block bigint, hash bigint, places binary, ids array<{doc_type}>, own binary"

    def run(batches):
        from pyspark import TaskContext

        m = shared.value
        local = m["local"]
        # by place among the words kept, with a last one for all others
        own_class = np.append(local.items, 0).astype(np.uint8)
        own_above = np.append(np.log10(local.counts + 1.0), 0.0)
        own_inside = np.append(own_above[:-1] - m["below"][local.items], 0.0)
        whole_log = np.log10(m["n"] + m["v"] + 1)
        block = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in slices(whole, 1):
                words = Words(batch.column(1))
                docs = batch.num_rows
                n_tokens = np.diff(words.ends, prepend=0)
                doc = np.repeat(np.arange(docs), n_tokens)
                place = local.find(words.hashes)
                known = place >= 0
                rare = np.flatnonzero(~known & ~words.is_end)
                cls = own_class[place]
                cls[rare] = m["groups"][words.groups(rare)]
                cls[words.is_end] = CLASSES
                base = np.bincount(doc, own_above[place], docs) + np.log10(m["ends"] + 1.0) - n_tokens * whole_log
                keys, places = _packed(words.hashes[rare], rare.astype(np.uint32))
                n = len(keys)
                own = b"".join(
                    x.tobytes()
                    for x in (words.ends, np.bincount(doc, known, docs).astype(np.int64) + (m["ends"] > 0), base, np.bincount(doc, own_inside[place], docs), cls)
                )
                ids = pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), batch.column(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, block)),
                        # a block's own row meets no word: its key only spreads the rows
                        pa.array(np.append(keys, mix64(np.array([block], np.uint64))).view(np.int64)),
                        pa.concat_arrays([places, pa.nulls(1, pa.binary())]),
                        pa.concat_arrays([pa.nulls(n, ids.type), ids]),
                        pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([own], pa.binary())]),
                    ],
                    names=names,
                )
                block += 1

    def meet(rows: pa.Table) -> pa.Table:
        below = shared.value["below"]
        rows = rows.combine_chunks()
        mine = rows.filter(rows.column("ids").is_valid())
        ids = mine.column("ids").combine_chunks().flatten()
        docs, own = len(ids), mine.column("own")[0].as_py()
        ends, known = np.frombuffer(own, np.int64, 2 * docs).reshape(2, docs)
        base, inside = np.frombuffer(own, np.float64, 2 * docs, 16 * docs).reshape(2, docs)
        cls = np.frombuffer(own, np.uint8, -1, 32 * docs).copy()
        rest = rows.filter(rows.column("places").is_valid())
        sizes, at = raw(rest.column("places").combine_chunks())
        sizes, at = np.diff(sizes) // 4, at.view(np.uint32)
        n = np.repeat(rest.column("c").fill_null(0).to_numpy(), sizes)
        moved = np.repeat(rest.column("cls").fill_null(-1).to_numpy(), sizes)
        cls[at] = np.where(moved >= 0, moved, cls[at])
        count, rare = np.zeros(len(cls), np.int64), np.zeros(len(cls), bool)
        count[at], rare[at] = n, True
        doc = np.repeat(np.arange(docs), np.diff(ends, prepend=0))[rare]
        above = np.log10(count[rare] + 1.0)
        text = cls.tobytes()
        starts = np.append(0, ends[:-1])
        return pa.table(
            {
                "doc_id": ids,
                "n_tokens": pa.array(np.diff(ends, prepend=0)),
                "n_known": pa.array(known + np.bincount(doc, count[rare] > 0, docs).astype(np.int64)),
                "base_score": pa.array(base + np.bincount(doc, above, docs)),
                "inside": pa.array(inside + np.bincount(doc, above - below[cls[rare]], docs)),
                "classes": pa.array([text[a:b] for a, b in zip(starts, ends)], pa.binary()),
            }
        )

    parts = rows.mapInArrow(run, schema)
    joined = parts.join(table.select("hash", F.col("n").alias("c"), "cls"), "hash", "left").drop("hash")
    out = f"doc_id {doc_type}, n_tokens bigint, n_known bigint, base_score double, inside double, classes binary"
    return materialize(joined.groupBy("block").applyInArrow(meet, out), "token-classes")


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of texts one after another, and those before them: each text ends in an end."""
    cls = np.frombuffer(b"".join(column.to_pylist()), np.uint8).astype(np.int64)
    return cls, np.append(CLASSES, cls[:-1]) if len(cls) else cls


def steps(trained: DataFrame) -> np.ndarray:
    """log P(class | class before) from the ``classes`` of annotated training texts."""
    k = CLASSES + 1

    def run(batches):
        counts = np.zeros(k * k, np.int64)
        for batch in batches:
            cls, before = _sequence(batch.column(0))
            counts += np.bincount(before * k + cls, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(counts)], names=["cell", "n"])

    bigrams = np.zeros(k * k)
    for cell, n in trained.select("classes").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).toPandas().itertuples(index=False):
        bigrams[cell] = n
    bigrams = bigrams.reshape(k, k)
    return np.log10((bigrams + ADDED) / (bigrams.sum(axis=1, keepdims=True) + ADDED * k))


def score(annotated: DataFrame, step: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of annotated texts."""
    kept = ["doc_id", "n_tokens", "n_known", "base_score"]
    schema = annotated.select(*kept, F.col("inside").alias("score")).schema

    def run(batches):
        for batch in batches:
            cls, before = _sequence(batch.column(5))
            doc = np.repeat(np.arange(batch.num_rows), batch.column(1).to_numpy())
            own = batch.column(4).to_numpy() + np.bincount(doc, step[before, cls], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own)], names=[*kept, "score"])

    return annotated.mapInArrow(run, schema)
