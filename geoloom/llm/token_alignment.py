"""Alignment of two tokenizers over the same bytes, and the pairs of tokens that are linked across a corpus.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece BPE; both read a space and the text
(B puts the space itself). Ends of tokens are running sums of their bytes; ends that both share cut the bytes into groups;
a token's group is that of the first common end at or after its own. An A and a B token are linked if their bytes overlap,
which is a run of B tokens for each A token: links are the A tokens repeated by the lengths of their runs.
All documents of a batch lie on one axis, as their ends are common.

Texts are coded by their distinct words, what stands between single spaces: A's pre-tokenizer begins a piece at such a space,
and none of B's tokens has a space behind another character. Whether a word's tokens give back its bytes is tested when it
is first met; a document with a word that does not has no tokens. Special tokens' strings are plain text.

Counting: a chunk of documents (``CHUNK`` bytes) gives each of its pairs once, with the number of its documents that have it
linked. The pairs are summed up in two stages, first by pair and a salt of the chunk, then by pair. Totals go back to chunks, not
to documents: a chunk's distinct pairs meet the ids of its documents, which are kept from the first pass, compressed, and links
are made again from them. Nothing is broadcast but the vocabularies.

Null and empty texts have no tokens: zeros, empty lists and an empty string of groups. Rows that repeat or share an id are
counted as documents each; a null id is kept. An empty table gives an empty result. A text is one task's, whole; of the columns of the
input only the id is kept.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, materialize, slices
from .byte_bpe import byte_table

#: Bytes of text in a chunk, and those aligned at once.
CHUNK, AT_ONCE = 4 << 20, 1 << 20
#: Tokens of documents that are counted at once (one document at least).
TOKENS_AT_ONCE = 100_000
SALTS = 16
CACHE_WORDS = 200_000
_STATE: dict = {}


class ByteLevelCoder:
    """A: a file of the tokenizers library with a byte-level BPE; ``code`` gives the ids of all words, each after a space, and how many each has."""

    def __init__(self, path: str, pattern: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte_of = {ch: byte for byte, ch in byte_table().items()}
        names = [""] * (max(vocabulary.values()) + 1)
        for name, token in vocabulary.items():
            names[token] = name
        self.bytes_of = [bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else b"" for name in names]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self._split = regex.compile(pattern).findall

    def code(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        # a word of ASCII letters is one piece
        split = [(" " + w,) if w.isascii() and w.isalpha() else self._split(" " + w) for w in words]
        pieces = np.fromiter(map(len, split), np.int64, len(split))
        place: dict[str, int] = {}
        at = np.fromiter((place.setdefault(p, len(place)) for p in chain.from_iterable(split)), np.int64, int(pieces.sum()))
        ids, size = self._coded(list(place))
        first = np.cumsum(size) - size
        size, first = size[at], first[at]
        flat = ids[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first, size)]
        return flat.tolist(), np.bincount(np.repeat(np.arange(len(words)), pieces), size, len(words)).astype(np.int64)

    def _coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has: by their bytes, where the tokens give these back, else by the library's slower answer."""
        ids = np.array(self.tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
        raw = [p.encode() for p in pieces]
        if b"".join(map(self.bytes_of.__getitem__, ids.tolist())) == b"".join(raw) and self.lengths[ids].all():
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))) + 1
            return ids, np.diff(ends, prepend=0)
        coded = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(coded.ids, np.int64), np.bincount(np.array(coded.word_ids, np.int64), minlength=len(pieces))


class SentencePieceCoder:
    """B: a sentencepiece BPE with byte fallback, whose spaces only stand at the beginning of tokens."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("tokens of this model have a space inside, so texts cannot be coded by words")
        self.bytes_of = [bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

    def code(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        rows = self.model.encode(words, num_threads=1)  # which puts the space itself
        return list(chain.from_iterable(rows)), np.fromiter(map(len, rows), np.int64, len(rows))


_RUN, _BETWEEN = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")


def words_of(text: str) -> list[str]:
    """What stands between single spaces; both tokenizers begin anew at a space between other characters."""
    return _BETWEEN.split(text) if text[:1].isspace() or text[-1:].isspace() or _RUN.search(text) else text.split(" ")


class Coders:
    """Both tokenizers, and the ids of at most ``CACHE_WORDS`` words in flat arrays."""

    def __init__(self, settings: tuple[str, str, str]) -> None:
        self.sides = (ByteLevelCoder(*settings[:2]), SentencePieceCoder(settings[2]))
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.fits = array("b")
        self.ids, self.sizes = (array("i"), array("i")), (array("i"), array("i"))

    def _learn(self, words: list[str]) -> None:
        raw = [(" " + w).encode() for w in words]
        length, fits = np.fromiter(map(len, raw), np.int64, len(raw)), np.ones(len(raw), bool)
        for side, flat, sizes in zip(self.sides, self.ids, self.sizes):
            ids, size = side.code(words)
            flat.extend(ids)
            sizes.extend(size.tolist())
            tokens = list(map(side.bytes_of.__getitem__, ids))
            given = np.bincount(np.repeat(np.arange(len(words)), size), side.lengths[np.array(ids, np.int64)], len(words))
            if (given != length).any() or b"".join(tokens) != b"".join(raw):
                ends = np.cumsum(size).tolist()
                fits &= [b"".join(tokens[a:b]) == r for a, b, r in zip([0, *ends], ends, raw)]
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.fits.extend(fits.tolist())

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of A and of B: the ids of all texts one after the other, and how many each text has. A text
        with a word that its tokens do not give back has none."""
        rows = [words_of(t) if t else [] for t in texts]
        wanted = set().union(*rows)
        new = [w for w in wanted if w not in self.index]
        if len(self.index) + len(new) > CACHE_WORDS:
            self.forget()
            new = list(wanted)
        for start in range(0, len(new), 8192):
            self._learn(new[start : start + 8192])
        count = np.array([len(r) for r in rows], np.int64)
        word = np.fromiter(map(self.index.__getitem__, chain.from_iterable(rows)), np.int64, int(count.sum()))
        of = np.repeat(np.arange(len(texts)), count)
        bad = np.zeros(len(texts), bool)
        bad[of[~np.array(self.fits, bool)[word]]] = True
        word, of = word[~bad[of]], of[~bad[of]]
        out = []
        for flat, sizes in zip(self.ids, self.sizes):
            size = np.array(sizes, np.int64)
            first = np.cumsum(size) - size
            size, first = size[word], first[word]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first, size)
            out.append((np.array(flat, np.int64)[at], np.bincount(of, size, len(texts)).astype(np.int64)))
        return out


class Alignment:
    """Groups and links of token sequences that cover the same bytes, documents laid one after the other.

    ``a_doc`` and ``b_doc`` number the documents from 0, rising; a document has tokens of both or of neither.
    """

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray) -> None:
        """``a_ends``, ``b_ends``: running sums of the tokens' bytes over all documents."""
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        self.groups = len(common)
        a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
        first = np.searchsorted(b_ends, a_starts[: len(a_ends)], side="right")
        runs = np.searchsorted(b_starts[: len(b_ends)], a_ends, side="left") - first
        self.link_a = np.repeat(np.arange(len(a_ends)), runs)
        self.link_b = np.arange(len(self.link_a)) - np.repeat(np.cumsum(runs) - runs - first, runs)


def _per_document(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, values, n).astype(np.int64) if values is not None else np.bincount(of, minlength=n)


def _coders(settings: tuple[str, str, str]) -> Coders:
    if _STATE.get("settings") != settings:
        _STATE.update(settings=settings, coders=Coders(settings))
    return _STATE["coders"]


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


def _flat(rows: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *rows])


def _doc_pairs(doc: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of links and how many documents have each; documents rise along the links."""
    if len(doc) and doc[-1] >= 1 << 20:
        raise ValueError("too many documents at once")
    different = np.unique(pair << np.int64(20) | doc) >> np.int64(20)
    first = np.flatnonzero(np.concatenate([[True], different[1:] != different[:-1]])[: len(different)])
    return different[first], np.diff(np.append(first, len(different)))


_CODED = "chunk bigint, id array<{0}>, sizes array<int>, codes binary, pairs array<bigint>, docs array<bigint>"


def _packed(a: np.ndarray, b: np.ndarray) -> bytes:
    """Ids of A and of B in as many bytes as they need, compressed; they are written and shuffled."""
    wide = max(a.max(initial=0), b.max(initial=0)) >= 1 << 16
    return bytes([int(wide)]) + pa.compress(np.concatenate([a, b]).astype("<u4" if wide else "<u2").tobytes(), "zstd", asbytes=True)


def _unpacked(codes: bytes, count: int) -> np.ndarray:
    width = 4 if codes[0] else 2
    return np.frombuffer(pa.decompress(codes[1:], count * width, "zstd", asbytes=True), f"<u{width}").astype(np.int64)


def _coded(batches: Iterator[pa.RecordBatch], settings: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, text): rows with the ids of some of them, and for each chunk a row with its pairs and their documents."""
    from pyspark import TaskContext

    coders = _coders(settings)
    a_coder, b_coder = coders.sides
    task, number, held, size, pairs = TaskContext.get().partitionId() << 32, 0, 0, 0, []
    schema = None

    def chunk_row() -> pa.RecordBatch:
        pair, count = _flat([p for p, _ in pairs]), _flat([c for _, c in pairs])
        different, at = np.unique(pair, return_inverse=True)
        totals = _per_document(count, at, len(different))
        one = np.array([len(different)])
        return pa.RecordBatch.from_arrays([
            pa.array([task + number], pa.int64()), pa.nulls(1, schema.field(1).type), pa.nulls(1, schema.field(2).type), pa.nulls(1, schema.field(3).type),
            _lists(different, one, pa.int64()), _lists(totals, one, pa.int64()),
        ], schema=schema)

    for whole in batches:
        for batch in slices(whole, 1, AT_ONCE):
            texts = batch.column(1).to_pylist()
            n = len(texts)
            (a, a_sizes), (b, b_sizes) = coders.encode(texts)
            made = Alignment(np.cumsum(a_coder.lengths[a]), np.cumsum(b_coder.lengths[b]))
            doc = np.repeat(np.arange(n), a_sizes)[made.link_a]
            pairs.append(_doc_pairs(doc, a[made.link_a] * len(b_coder.lengths) + b[made.link_b]))
            keys = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0))
            columns = [pa.array([task + number], pa.int64()), keys, _lists(np.concatenate([a_sizes, b_sizes]), np.array([2 * n]), pa.int32()), pa.array([_packed(a, b)], pa.binary())]
            columns += [pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))]
            schema = schema or pa.schema(list(zip(["chunk", "id", "sizes", "codes", "pairs", "docs"], [c.type for c in columns])))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            size += sum(len(t) for t in texts if t)
            if size >= CHUNK:
                yield chunk_row()
                number, size, pairs = number + 1, 0, []
    if pairs:
        yield chunk_row()
    coders.forget()  # a worker that goes on to count has no use for words


def _written_groups(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each document: ids by group, in order."""
    last_a = np.append(a_group[1:] != a_group[:-1], True)[: len(a)]
    last_b = np.append(b_group[1:] != b_group[:-1], True)[: len(b)]
    # a group's ids of A stand before its ids of B
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    codes = np.concatenate([2 * a + last_a, 2 * b + last_b])[order]
    side = np.concatenate([np.zeros(len(a), bool), np.ones(len(b), bool)])[order]
    names = _STATE.get("names")
    if names is None or len(names) <= 3 * (codes.max(initial=0) // 2) + 2:
        names = _STATE["names"] = [f"{i}{mark}" for i in range(int(codes.max(initial=0)) // 2 + 1024) for mark in ",|;"]
    # an id with the mark that follows it
    flat = list(map(names.__getitem__, (3 * (codes >> 1) + np.where(codes & 1, 1 + side, 0)).tolist()))
    ends = np.concatenate([[0], np.cumsum(a_sizes + b_sizes)]).tolist()
    return ["".join(flat[s:e])[:-1] for s, e in zip(ends[:-1], ends[1:])]


_STATS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def _few_tokens(docs: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(id, a, b, a_sizes, b_sizes) of documents that have about ``TOKENS_AT_ONCE`` tokens."""
    for row in docs.to_batches(max_chunksize=1):
        for i in range(row.num_rows):
            key = row.column("id")[i].values
            n = len(key)
            sizes = row.column("sizes")[i].values.to_numpy().astype(np.int64)
            codes = _unpacked(row.column("codes")[i].as_py(), int(sizes.sum()))
            a_sizes, b_sizes = sizes[:n], sizes[n:]
            a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes) + a_sizes.sum()
            start = 0
            while start < n:
                before = a_end[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(a_end, before + TOKENS_AT_ONCE, side="right")))
                a, b = codes[before : a_end[end - 1]], codes[(b_end[start - 1] if start else a_end[-1]) : b_end[end - 1]]
                yield key.slice(start, end - start), a, b, a_sizes[start:end], b_sizes[start:end]
                start = end


def _counted(docs: pa.Table, totals: pa.Table, a_lengths: np.ndarray, b_lengths: np.ndarray) -> pa.Table:
    """Of a chunk: documents (chunk, id, sizes, codes) and its pairs' totals (chunk, pair, total, best)."""
    pair = totals.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, total, best = pair[order], totals.column("total").to_numpy()[order], totals.column("best").to_numpy(zero_copy_only=False).astype(np.int64)[order]
    out = []
    for key, a, b, a_sizes, b_sizes in _few_tokens(docs):
        n = len(key)
        made = Alignment(np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b]))
        a_doc = np.repeat(np.arange(n), a_sizes)
        doc = a_doc[made.link_a]
        at = np.searchsorted(pair, a[made.link_a] * len(b_lengths) + b[made.link_b])
        ends = np.append(made.a_group[1:] != made.a_group[:-1], True)[: len(a)]
        groups = _written_groups(a, b, made.a_group, made.b_group, a_sizes, b_sizes)
        # sums are of integers below 2**53 a document
        stats = [a_sizes, b_sizes, _per_document(None, a_doc[ends], n), _per_document(None, doc, n), _per_document(best[at], doc, n), _per_document(total[at], doc, n)]
        arrays = [key, *(pa.array(s, pa.int64()) for s in stats), pa.array(groups, pa.string())]
        out.append(pa.RecordBatch.from_arrays(arrays, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]))
    pa.default_memory_pool().release_unused()
    return pa.Table.from_batches(out)


def _totals(coded: DataFrame, b_size: int) -> DataFrame:
    """(pair, total, best): documents of each pair, and whether no pair of its A token has more."""
    of_chunks = coded.where("pairs is not null").select("chunk", F.explode(F.arrays_zip("pairs", "docs")).alias("one"))
    salted = of_chunks.groupBy(F.col("one.pairs").alias("pair"), F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).alias("salt")).agg(F.sum("one.docs").alias("part"))
    total = salted.groupBy("pair").agg(F.sum("part").alias("total"))
    # an A token has at most one pair for each B token
    of_a = Window.partitionBy(F.floor(F.col("pair") / b_size))
    return total.select("pair", "total", (F.col("total") == F.max("total").over(of_a)).alias("best"))


def _settings(a_path: str, b_path: str, pattern: str | None) -> tuple[str, str, str]:
    import public_tokenizers

    return a_path, pattern or public_tokenizers.PATTERN, b_path


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row.

    ``n_best``: links whose pair is in as many documents as any of its A token; ``count_sum``: documents of
    the links' pairs, over links; ``groups``: the ids as ``a1,a2|b1;a3|b2,b3``.
    """
    settings = _settings(a_path, b_path, pattern)
    a_coder, b_coder = ByteLevelCoder(*settings[:2]), SentencePieceCoder(settings[2])
    lengths, b_size = (a_coder.lengths, b_coder.lengths), len(b_coder.lengths)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    coded = materialize(rows.mapInArrow(lambda batches: _coded(batches, settings), _CODED.format(kind)), "coded")
    totals = materialize(_totals(coded, b_size), "pairs")
    of_chunks = coded.where("pairs is not null").select("chunk", F.explode("pairs").alias("pair")).join(totals, "pair").select(F.col("chunk").alias("of"), "pair", "total", "best")
    docs = coded.where("pairs is null").select("chunk", "id", "sizes", "codes")
    met = docs.groupBy("chunk").cogroup(of_chunks.groupBy("of"))
    return met.applyInArrow(lambda d, t: _counted(d, t, *lengths), f"id {kind}, {_STATS}").withColumnRenamed("id", id_col)


def pairs(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """(a, b, docs, best): the id pairs that are linked, in how many documents, and whether none of the A token is in more."""
    settings = _settings(a_path, b_path, pattern)
    b_size = len(SentencePieceCoder(settings[2]).lengths)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    coded = materialize(rows.mapInArrow(lambda batches: _coded(batches, settings), _CODED.format(kind)), "coded")
    made = materialize(_totals(coded, b_size), "pairs")
    discard(coded)
    return made.select(F.floor(F.col("pair") / b_size).cast("int").alias("a"), (F.col("pair") % b_size).cast("int").alias("b"), F.col("total").alias("docs"), "best")
