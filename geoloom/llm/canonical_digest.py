"""Exact fingerprints of canonical texts.

A text is normalised (NFKC), case-folded and normalised again, its runs of white space become
one space and its ends are trimmed; the 128-bit xxhash of the result is its digest. Documents
are grouped by digest, and inside a bucket with several documents the canonical bytes are
compared: the aggregation has them as a grouping key, so copies collapse before the shuffle
and a bucket of many equal copies is one row for each task. Should different canonical texts
share a digest, each gets the digest and its ordinal among them in byte order.

Null text: as the empty text. Long texts are digested whole. Repeated rows get equal results, but for what follows
them: null ids come last, and rows that share an id stand in order of a hash of their text. An empty table gives no rows.
Columns named as the results are replaced, others are kept (``fingerprint``) or not looked at.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ._shared import MemberFilter, among, materialize, slices

#: What ``compared`` gives for each text.
COLUMNS = {"n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "next_fingerprint": "string"}
_KINDS = {"bigint": pa.int64(), "string": pa.string()}


def canonical(text: str | None) -> str:
    """Normalised, case-folded text with single spaces."""
    if not text:
        return ""
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest_of(text: str | None) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action=None)


def _digested(digest: Callable) -> Callable:
    @F.pandas_udf(StringType())
    def own(texts: pd.Series) -> pd.Series:
        return texts.map(digest, na_action=None)

    return own


def collisions(texts: DataFrame) -> DataFrame:
    """Of rows (text, digest): (digest, canonical, ordinal) where texts that differ share a digest.

    Only digests that occur twice are looked at; the byte comparison is the grouping.
    """
    again = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    same = texts.join(again, "digest", "left_semi").withColumn("canonical", _canonical(F.col("text")))
    distinct = same.groupBy("digest", "canonical").agg(F.count(F.lit(1)).alias("n"))
    several = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1").select("digest")
    order = Window.partitionBy("digest").orderBy("canonical")
    return distinct.join(several, "digest", "left_semi").select("digest", "canonical", F.row_number().over(order).alias("ordinal"))


def fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", digest: Callable = digest_of) -> DataFrame:
    """``df`` with ``out_col``: equal for rows whose canonical texts are equal, and only for them."""
    rows = df.withColumn(out_col, _digested(digest)(F.col(text_col)))
    clash = collisions(rows.select(F.col(text_col).alias("text"), F.col(out_col).alias("digest")))
    if clash.isEmpty():
        return rows
    clash = clash.select(F.col("digest").alias(out_col), F.col("canonical").alias("__canonical"), F.col("ordinal").alias("__ordinal"))
    marked = rows.withColumn("__canonical", _canonical(F.col(text_col))).join(clash, [out_col, "__canonical"], "left")
    full = F.concat(F.col(out_col), F.coalesce(F.concat(F.lit("-"), F.col("__ordinal").cast("string")), F.lit("")))
    return marked.withColumn(out_col, full).drop("__canonical", "__ordinal").select(*rows.columns)


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fingerprint, n rows, smallest id) of each group of equal canonical texts."""
    marked = fingerprint(df.select(id_col, text_col), text_col)
    return marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_rows"), F.min(id_col).alias("first_id"))


def _first_and_last(batches: Iterator[pa.RecordBatch], make: Callable, columns: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (id, text): what ``make`` gives for each text and the one after it; the last
    row of a range waits for the next range, so its text and that of the first row go along."""
    from pyspark import TaskContext

    part, waiting, first = TaskContext.get().partitionId(), None, True
    for whole in batches:
        for batch in slices(whole, 1, 4 << 20):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            if not texts:
                continue
            head = texts[0] if first else None
            if waiting is not None:
                ids, texts = pa.concat_arrays([waiting[0], ids]), [waiting[1], *texts]
            waiting = (ids.slice(len(ids) - 1), texts[-1])
            done = len(texts) - 1
            yield _made(columns, part, ids.slice(0, done), make(texts[:-1], texts[1:]), ids.slice(1), [None] * done, [None] * done)
            if first:
                yield _made(columns, part, ids.slice(0, 1), None, pa.nulls(1, ids.type), [head], [None])
                first = False
    if waiting is not None:
        yield _made(columns, part, waiting[0], None, pa.nulls(1, waiting[0].type), [None], [waiting[1]])


def _made(columns: dict[str, str], part: int, ids: pa.Array, made: list[list] | None, next_ids: pa.Array, heads: list, tails: list) -> pa.RecordBatch:
    n, kinds = len(ids), [_KINDS[t] for t in columns.values()]
    values = [pa.array(column, kind) for column, kind in zip(made, kinds)] if made else [pa.nulls(n, kind) for kind in kinds]
    arrays = [pa.array(np.full(n, part, np.int32)), ids, next_ids, *values, pa.array(heads, pa.string()), pa.array(tails, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "id", "next_id", *columns, "head", "tail"])


def by_descending_id(df: DataFrame, make: Callable, columns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, next_id, *columns): the lists that ``make`` gives for the lists of the rows' texts and of those that
    follow in descending order of id; ``columns`` are their names and types.

    After the last row comes the first. Null ids come last; rows that share an id are in order of
    a hash of their text. Texts are shuffled once, by range, and each range's rows are met in a stream; only one
    row for each range waits for the first row of the next.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"part int, id {kind}, next_id {kind}, {', '.join(f'{n} {t}' for n, t in columns.items())}, head string, tail string"
    found = materialize(ranges.mapInArrow(lambda batches: _first_and_last(batches, make, columns), schema), "followed")
    done = found.where("head is null and tail is null").select("id", "next_id", *columns)
    # two rows for each range, as many as shuffle partitions whatever the input
    heads = found.where("head is not null").select("part", F.col("id").alias("next_id"), "head")
    tails = found.where("tail is not null").select("part", "id", "tail")
    turn = Window.orderBy("part")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.struct("next_id", "head")
    after = heads.select("part", F.coalesce(F.lead(head).over(turn), F.first(head).over(whole)).alias("after"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            arrays = [pa.array(c, _KINDS[t]) for c, t in zip(made, columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "next_id", *columns])

    last = tails.join(after, "part").select("id", "after.next_id", "tail", "after.head").mapInArrow(rest, done.schema)
    return done.unionAll(last)


def followed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, next_id, text, next): each row's text and that of the row after it in descending order of id."""
    return by_descending_id(df, lambda texts, following: [texts, following], {"text": "string", "next": "string"}, id_col, text_col)


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the beginning of ``following``, or all of that."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(texts: list[str], following: list[str], marks: dict[tuple[str, str], int], digest: Callable) -> list[list]:
    """The columns of ``COLUMNS``; ``marks`` are the ordinals of different texts that share a digest."""

    def mark(text: str) -> str:
        own = digest(text)
        ordinal = marks.get((own, canonical(text))) if marks else None
        return own if ordinal is None else f"{own}-{ordinal}"

    changed = [edited(a, b) for a, b in zip(texts, following)]
    own = [mark(t) for t in texts]
    after = [*own[1:], mark(following[-1])] if following[:-1] == texts[1:] and texts else [mark(t) for t in following]
    sums = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    return [[len(t) for t in texts], sums, own, [mark(t) for t in changed], after]


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable = digest_of) -> DataFrame:
    """(id, next_id, *COLUMNS) with exact fingerprints: of each text, its edited text and the next text.

    Digests that occur once are whole. Texts behind the others are read again and their
    canonical bytes are compared; only if some differ is the work done again with their ordinals.
    """
    plain = lambda texts, following: fingerprints(texts, following, {}, digest)
    rows = by_descending_id(df, plain, COLUMNS, id_col, text_col)
    digests = rows.select("id", F.col("fingerprint").alias("digest")).unionAll(rows.select("id", F.col("edited_fingerprint").alias("digest")))
    again = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    again = materialize(again, "digests-again")
    of = lambda c: rows.join(again, rows[c] == again["digest"], "left_semi")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = [_digests(among(docs, of("fingerprint").select("id"), "id"), digest)]
    if not of("edited_fingerprint").isEmpty():
        # edited texts are made again where their rows are met, as ids may repeat; few of the others pass the filter
        shared = df.sparkSession.sparkContext.broadcast(MemberFilter.of(again.select(F.crc32(F.col("digest").cast("binary")).alias("at"))))

        def repeated(own: list[str], following: list[str]) -> list[list]:
            made = [edited(a, b) for a, b in zip(own, following)]
            keys = np.array([zlib.crc32(digest(t).encode()) for t in made], np.int64)
            return [[t if met else None for t, met in zip(made, shared.value.has(keys))]]

        made = by_descending_id(df, repeated, {"text": "string"}, id_col, text_col).where("text is not null")
        texts.append(_digests(made, digest))
    clash = collisions(materialize(texts[0].unionAll(texts[-1]) if len(texts) > 1 else texts[0], "shared-digests"))
    marks = {(r["digest"], r["canonical"]): r["ordinal"] for r in clash.collect()}  # none, but for broken digests
    return by_descending_id(df, lambda texts, following: fingerprints(texts, following, marks, digest), COLUMNS, id_col, text_col) if marks else rows


def _digests(texts: DataFrame, digest: Callable) -> DataFrame:
    """(text, digest) of the column text."""
    return texts.select("text", _digested(digest)(F.col("text")).alias("digest"))
