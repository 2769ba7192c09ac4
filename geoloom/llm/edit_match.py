"""Benchmark decontamination by pigeonhole edit matching.

A test item of n normalised characters may differ from a passage by ``n // 12`` edits. It is
cut into one piece more than that, so a passage within the budget holds one piece unchanged.
Pieces have twelve characters at most. Hashes of all runs of characters of a piece's length, for many documents in one array, are looked up
among those of the pieces, and each hit's surroundings are verified with Myers' bit-parallel distance. Texts are case-folded and their white space
is folded to single spaces first; documents are searched whole. An item without an edit to spare
(fewer than ``CHARS_PER_EDIT`` characters) is a passage only between characters that are no letters or digits.

The benchmark is measured first and dealt into blocks of about ``BLOCK_CHARS`` characters; each
block is one pass over the documents (a block is larger than most benchmarks), so what a worker holds is bounded whatever its size.

Null or blank texts match nothing, and nor do null or blank items or items without an id. Equal items are reported
each under its own id; rows of one id are items each, and equal rows are one. Repeated documents are reported repeatedly, and so are
those that share an id. Of equally near passages of an item the one found first is given. Very long texts and items are
read whole. An empty benchmark or table gives no rows. Only the id and text columns are looked at; ``clean`` keeps the others.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, mix64, slices

CHARS_PER_EDIT = 12
BLOCK_CHARS = 16_000_000
CHUNK = 1 << 20
_STATE: dict = {}


def normalised(text: str | None) -> str:
    return " ".join(text.casefold().split()) if text else ""


def budget_of(item: str) -> int:
    return len(item) // CHARS_PER_EDIT


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget + 1`` pieces whose lengths differ by one at most."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def masks_of(item: str) -> dict[str, int]:
    """Of each character, the bits of its places in the item."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """(distance, past-the-end place) of the substring of ``text`` nearest to an item (Myers 1999)."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, at = length, 0
    get = masks.get
    for j, ch in enumerate(text):
        equal = get(ch, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, at = score, j + 1
    return best, at


def _inside_a_word(text: str, start: int, end: int) -> bool:
    """Whether a letter or digit goes on on either side."""
    return any(text[at].isalnum() and text[next_to].isalnum() for at, next_to in ((start, start - 1), (end - 1, end)) if 0 <= next_to < len(text))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit polynomial hash of each run of ``length`` characters."""
    out, done, power, width = None, 0, codes, 1
    with np.errstate(over="ignore"):
        base = _BASE
        while True:
            if length & width:  # runs of the lengths that are powers of two, one after another
                out = power if out is None else out[: len(power) - done] * base + power[done:] if len(power) > done else out[:0]
                done += width
            if width * 2 > length:
                return out[: max(0, len(codes) - length + 1)]
            power = power[: max(0, len(power) - width)] * base + power[width:]
            base, width = base * base, width * 2


class Pieces:
    """The pieces of one length: their hashes in order, with the item and the offset of each."""

    def __init__(self, length: int, pieces: list[tuple[str, int, int]]) -> None:
        self.length = length
        codes = np.frombuffer("".join(p for p, _, _ in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        hashes = run_hashes(codes, length)[::length]
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.items, self.offsets = (np.array([p[k] for p in pieces], np.int64)[order] for k in (1, 2))
        bits = max(10, min(24, int(np.ceil(np.log2(len(pieces) * 64)))))
        self.shift = np.uint64(64 - bits)
        self.known = np.zeros(1 << bits, bool)
        self.known[mix64(self.hashes) >> self.shift] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, which) of each piece in each place of the text."""
        own = run_hashes(codes, self.length)
        place = np.flatnonzero(self.known[mix64(own) >> self.shift])
        first, last = (np.searchsorted(self.hashes, own[place], side) for side in ("left", "right"))
        n = last - first
        which = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(place, n), which


class Matcher:
    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(key, text, budget_of(text)) for key, text in items]
        self.budgets = np.array([budget for _, _, budget in self.items], np.int64)
        by_length: dict[int, list[tuple[str, int, int]]] = {}
        for i, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                by_length.setdefault(len(piece), []).append((piece, i, offset))
        self.pieces = [Pieces(length, own) for length, own in sorted(by_length.items())]
        self.masks = functools.lru_cache(maxsize=4096)(lambda i: masks_of(self.items[i][1]))

    def _hits(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place, offset in the item) of every piece that the texts hold."""
        longest, none = self.pieces[-1].length, np.zeros(0, np.int64)
        found = [(none, none, none)]
        for at in range(0, len(joined), CHUNK):
            codes = np.frombuffer(joined[at : at + CHUNK + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            for own in self.pieces:
                place, which = own.hits(codes)
                use = place < CHUNK  # the next chunk has the others
                place, which = place[use], which[use]
                found.append((own.items[which], at + place, own.offsets[which]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item id, distance, end) of each item within its budget: its best match in each of the normalised texts."""
        if not self.pieces or not any(texts):
            return []
        # normalised texts have no line ends, so no piece reaches over one
        item, place, offset = self._hits("\n".join(texts))
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, place, side="right")
        start = place - offset - (ends - sizes)[text]
        # alignments of one item in runs of budget + 1 places
        run = start // (self.budgets[item] + 1)
        order = np.lexsort((start, run, item, text))
        item, text, start, run = item[order], text[order], start[order], run[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(item)), bool), (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(run) != 0)]))
        last = np.append(new[1:], len(item))[: len(new)] - 1
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for t, i, low, top in zip(text[new].tolist(), item[new].tolist(), start[new].tolist(), start[last].tolist()):
            _, wanted, budget = self.items[i]
            body, best = texts[t], found.get((t, i), (budget + 1, 0))
            if best[0] == 0:
                continue
            if low == top and low >= 0 and body.startswith(wanted, low):
                if budget or not _inside_a_word(body, low, low + len(wanted)):
                    found[t, i] = (0, low + len(wanted))
                continue
            left = max(0, low - budget)
            distance, at = best_match(self.masks(i), len(wanted), body[left : top + len(wanted) + budget])
            if budget and distance <= budget and distance < best[0]:
                found[t, i] = (distance, left + at)
        return [(t, self.items[i][0], d, end) for (t, i), (d, end) in found.items()]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of bounded size."""
    chars = benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    dealt = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    for block in range(n):
        rows = dealt.where(F.pmod(F.xxhash64("id"), F.lit(n)) == block).collect()
        yield sorted({(r["id"], text) for r in rows if (text := normalised(r["text"]))})


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance int, end_char long): documents and the items they hold.

    ``distance`` is that of the nearest passage and ``end_char`` where it ends in the
    normalised text.
    """
    spark = docs.sparkSession
    doc_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {doc_type}, item_id bigint, distance int, end_char bigint"
    out = None
    for items in _blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, items))

        def run(batches, shared=shared):
            key, own = shared.value
            if _STATE.get("key") != key:
                _STATE.update(key=key, matcher=Matcher(own))
            find = _STATE["matcher"].find
            for whole in batches:
                for batch in slices(whole, 1, 2 << 20):
                    got = find([normalised(text) for text in batch.column(1).to_pylist()])
                    columns = [batch.column(0).take(pa.array([r[0] for r in got], pa.int64()))]
                    for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64()), 1):
                        columns.append(pa.array([r[k] for r in got], kind))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "distance", "end_char"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no test item, with all their columns. Rows that share an id with one that does go too."""
    found = matches(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__found")).distinct()
    # written, so that its size decides whether texts are shuffled for the join
    found = materialize(found, "contaminated")
    return docs.join(found, docs[id_col].eqNullSafe(F.col("__found")), "left_anti")
