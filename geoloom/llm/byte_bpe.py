"""Byte-level BPE encoding and decoding over Arrow batches.

A rank file gives the vocabulary. Every match of the pattern is encoded separately: its bytes are merged
by rank, by the tiktoken library's function for one piece. The ids of distinct matches are kept in a bounded
cache, because natural text repeats its words. Decoding joins the tokens' bytes.

A token is bytes, so a sequence of ids that is cut anywhere can begin or end inside a character:
``decode`` gives bytes, and text in which such a rest is a replacement character; ``joined`` puts pieces of a
sequence together before they are read as text, so characters split over them come out whole.

Null text: no ids, decodes to the empty text. Empty text: the same. Null ids: no bytes. Long texts are encoded
whole; only single rows, never a column, are held as Python lists. Rows that tie or repeat are coded each. An empty table gives an empty result.
Columns named as the results are replaced, others are kept.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_PIECES = 100_000
_STATE: dict = {}


def byte_table() -> dict[int, str]:
    """byte -> character: printable Latin-1 bytes stand for themselves, others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PieceEncoder:
    """Encodes texts piece by piece; keeps the ids of at most ``CACHE_PIECES`` pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        from tiktoken import Encoding

        self.merge = Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, list[int]] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known."""
        new = pieces.difference(self.ids)
        if len(self.ids) + len(new) > CACHE_PIECES:
            self.ids, new = {}, pieces
        merge = self.merge
        self.ids.update((piece, merge(piece.encode())) for piece in new)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        get = self.ids.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, pieces)), np.int32) for pieces in split]

    def offsets(self, text: str | None, length_of: list[int]) -> tuple[list[int], list[int]]:
        """First and past-the-end code point of each token; a token that holds a part of a
        character covers that whole character."""
        starts, ends, base = [], [], 0
        for piece in self.split(text) if text else []:
            at_byte: list[int] = []
            for i, ch in enumerate(piece):
                at_byte += [i] * len(ch.encode("utf-8"))
            at = 0
            for token in self.ids[piece]:
                starts.append(base + at_byte[at])
                at += length_of[token]
                ends.append(base + at_byte[at - 1] + 1)
            base += len(piece)
        return starts, ends


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _encoder(ranks: dict[bytes, int], key: int, pattern: str) -> PieceEncoder:
    """The worker's encoder; ``key`` stands for the ranks."""
    if _STATE.get("encoder_key") != (key, pattern):
        _STATE.update(encoder_key=(key, pattern), encoder=PieceEncoder(ranks, pattern))
    return _STATE["encoder"]


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", with_offsets: bool = False
) -> DataFrame:
    """``df`` with ``ids_col`` array<int> and, if asked for, ``starts`` and ``ends`` (code points).

    Columns of ``df`` with these names are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    from ._shared import slices

    ranks = read_ranks(ranks_path)
    lengths = [0] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    with open(ranks_path, "rb") as file:
        key = zlib.crc32(file.read())
    shared = df.sparkSession.sparkContext.broadcast((ranks, lengths))
    names = [ids_col] + ["starts", "ends"] * with_offsets
    kept = df.drop(*names)
    schema = StructType(kept.schema.fields + [StructField(n, ArrayType(IntegerType(), False), False) for n in names])
    arrow, at = to_arrow_schema(schema), kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, length_of = shared.value
        coder = _encoder(ranks, key, pattern)
        for whole in batches:
            for batch in slices(whole, at, 1 << 20):
                texts = batch.column(at).to_pylist()
                columns = [coder.encode(texts)]
                if with_offsets:
                    spans = [coder.offsets(t, length_of) for t in texts]
                    columns += [[np.array(s, np.int32) for s, _ in spans], [np.array(e, np.int32) for _, e in spans]]
                made = [_lists(c) for c in columns]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*batch.columns, *made], arrow.types)], schema=arrow)
        coder.forget()  # a worker that goes on to other steps has no use for pieces

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded", text_col: str | None = None) -> DataFrame:
    """``df`` with ``bytes_col``: the bytes that the ids stand for (null ids: none), and with ``text_col`` if named.

    The text has a replacement character for each part of a character that the ids begin or end with.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    ranks = read_ranks(ranks_path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    kept = df.drop(bytes_col, *([text_col] if text_col else []))
    made_fields = [StructField(bytes_col, BinaryType(), False)] + ([StructField(text_col, StringType(), False)] if text_col else [])
    schema = StructType(kept.schema.fields + made_fields)
    arrow, at = to_arrow_schema(schema), kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows = (batch.column(at)[i].values for i in range(batch.num_rows))
                found = [b"".join(map(get, ids.to_numpy().tolist())) if ids is not None else b"" for ids in rows]
                made = [pa.array(found, pa.binary())] + ([pa.array([b.decode("utf-8", "replace") for b in found], pa.string())] if text_col else [])
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*batch.columns, *made], arrow.types)], schema=arrow)

    return kept.mapInArrow(run, schema)


def joined(pieces: DataFrame, key_cols: list[str], order_col: str, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """(*key_cols, ids, decoded, text) of sequences given in pieces, one row for each, in order of ``order_col``.

    The ids of a sequence are joined before they are decoded, as a character may be split over pieces.
    """
    whole = pieces.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("at"), F.col(ids_col).alias("ids")))).alias("__parts"))
    whole = whole.select(*key_cols, F.flatten(F.transform(F.filter("__parts", lambda p: p["ids"].isNotNull()), lambda p: p["ids"])).alias("ids"))
    return decode(whole, ranks_path, "ids", "decoded", "text")
