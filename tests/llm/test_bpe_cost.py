"""What coding a text costs beside the coding library itself."""

import time

import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from geoloom.llm import byte_bpe, queries


def test_new_pieces_cost_little_more_than_the_library_takes():
    import public_tokenizers as public

    ranks = byte_bpe.read_ranks(public.path(queries.RANKS))
    coder, plain = byte_bpe.PieceEncoder(ranks, public.PATTERN), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [" ".join(f"w{i * 7919 % 100003:x}q{'abcdefgh'[i % 8] * (i % 5)}é" for i in range(at, at + 2000)) for at in range(0, 60_000, 2000)]
    start = time.process_time()
    wanted = [plain.encode_ordinary(t) for t in texts]
    library = time.process_time() - start
    start = time.process_time()
    assert [ids.tolist() for ids in coder.encode(texts)] == wanted
    assert time.process_time() - start < 6 * library + 0.2


def test_runs_that_the_whole_text_coder_cannot_take():
    import public_tokenizers as public

    ranks = byte_bpe.read_ranks(public.path(queries.RANKS))
    text = " " * 1_200_000 + "x"
    ids = byte_bpe.PieceEncoder(ranks, public.PATTERN).encode([text])[0].tolist()
    token = {rank: token for token, rank in ranks.items()}
    assert b"".join(token[i] for i in ids) == text.encode()


def test_a_worker_keeps_no_pieces_after_its_task(spark):
    """Workers are used again: what one has learnt would add to the memory of the next steps."""
    import public_tokenizers as public

    rows = spark.range(1).select(F.lit("many words of one text").alias("text")).coalesce(1)
    byte_bpe.encode(rows, public.path(queries.RANKS), public.PATTERN).collect()

    def held(batches):
        list(batches)
        from geoloom.llm import byte_bpe

        coder = byte_bpe._STATE.get("encoder")
        yield pa.RecordBatch.from_arrays([pa.array([len(coder.ids) if coder else 0])], names=["n"])

    found = spark.range(0, 64, 1, 8).mapInArrow(held, "n long").agg(F.max("n")).first()[0]
    assert found == 0
