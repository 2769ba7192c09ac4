"""What the operators of this subpackage share: materialised tables, tokens, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
BATCH_ROWS = 1500


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="geoloom-"))
    return _OWN_DIR[0]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table ends the lineage, so a lost executor costs only the tasks that read it. The
    shuffle files of the write are no longer needed then, and Spark is told to remove them at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geoloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    read = spark.read.schema(df.schema).parquet(path)
    read.step_path = path
    return read


def discard(*steps: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that is made of them is written itself."""
    for step in steps:
        spark = step.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(step.step_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # whole texts go to Python: batches of a few MB, not of 10,000 rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def text_key(column: str) -> Column:
    """A 128-bit key of a text; equal texts, and only they, share it. Null counts as empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.unhex(F.md5(text.cast("binary")))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8 bytes.

    ``bytes.lower`` touches ASCII letters only and ``bytes.split`` splits on these six bytes.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class HashCache(dict):
    """word -> 64-bit hash; emptied when it has grown beyond ``bound`` words."""

    def __init__(self, bound: int = 150_000) -> None:
        import xxhash

        super().__init__()
        self._hash, self._bound = xxhash.xxh64_intdigest, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._bound:
            self.clear()
        value = self[word] = self._hash(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(batch, text_index: int, max_bytes: int = 8 << 20) -> Iterator:
    """Cut an Arrow batch into pieces of about ``max_bytes`` of text (one row at least)."""
    lengths = batch.column(text_index)
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(lengths), 0), dtype=np.int64)
    start = 0
    total = np.cumsum(sizes)
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + max_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()


def among(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id is among ``ids`` (a column) or null, and a few others.

    Rows are left out where they are read, by a filter of bounded size, before any shuffle.
    """
    import pyarrow as pa

    at = df.columns.index(id_col)
    shared = df.sparkSession.sparkContext.broadcast(MemberFilter.of(ids.where(F.col(ids.columns[0]).isNotNull())))

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            yield batch.filter(pa.array(np.asarray(column.is_null()) | shared.value.has(np.asarray(column.fill_null(0)))))

    return df.mapInArrow(run, df.schema)


class MemberFilter:
    """A Bloom filter of 64-bit ids with at most ``2**MOST_BITS`` bits, so of bounded size.

    It may let others through; past its capacity it lets more through, and nothing is lost.
    """

    MOST_BITS = 26

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def _places(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(ids.astype(np.int64).view(np.uint64))
        low = np.uint64(size - 1)
        return h & low, (h >> np.uint64(32)) & low

    @classmethod
    def of(cls, ids: DataFrame) -> MemberFilter:
        """Of the one column of ``ids``; every task gives its own words, which are summed up."""
        import pyarrow as pa

        size = 1 << int(min(cls.MOST_BITS, max(10, np.ceil(np.log2(16 * ids.count() + 1)))))

        def words(batches):
            own = np.zeros(size // 64, np.uint64)
            for batch in batches:
                for place in cls._places(batch.column(0).to_numpy(zero_copy_only=False), size):
                    np.bitwise_or.at(own, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
            at = own.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], names=["at", "word"])

        rows = ids.mapInArrow(words, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
        bits = np.zeros(size // 64, np.uint64)
        bits[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64).view(np.uint64)
        return cls(bits)

    def has(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for place in self._places(ids, len(self.bits) * 64):
            out &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out
