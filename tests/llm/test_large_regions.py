"""Large regions of the LSH forest: every linked pair in them is found, and confirmed pairs do not grow with the square of a group."""

import random

from pyspark.sql import functions as F

from geoloom.llm import lsh_forest


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_every_pair_of_a_large_region_is_found(spark):
    """All texts are one region at every depth, so their order tells nothing; in it each copy has one partner, just above the threshold."""
    rng = random.Random(3)
    common = words(rng, 160)
    texts = [f"{common} {words(rng, 42)}" for _ in range(100)]
    n = len(texts)
    for i in range(n):
        own = texts[i].split()
        for at in rng.sample(range(160, 202), 10):
            own[at] = words(rng, 1)
        texts.append(" ".join(own))
    sets = [{tuple(w[k : k + 2]) for k in range(len(w) - 1)} for w in (t.split() for t in texts)]
    linked = {i for i in range(n) if 100 * len(sets[i] & sets[i + n]) >= 80 * len(sets[i] | sets[i + n])}
    forest = lsh_forest.Forest(rows_of(spark, texts), "doc_id", "text", 2, 80)
    forest.nodes = forest.nodes.withColumn("sig", F.lit(bytearray(4 * lsh_forest.VALUES)))
    forest.found = forest.nodes.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(1).cast("long").alias("region"), F.lit(lsh_forest.LEVELS[0]).alias("level"), F.lit(2 * n).cast("long").alias("n"))
    assert len(linked) > 50
    assert {tuple(r) for r in forest.components().collect()} == {(i + k, i) for i in linked for k in (0, n)}


def test_confirmed_pairs_grow_with_a_group_of_near_copies(spark, monkeypatch):
    tried = []
    confirmed = lsh_forest.Forest.confirmed
    monkeypatch.setattr(lsh_forest.Forest, "confirmed", lambda self, pairs, *more: tried.append(pairs.count()) or confirmed(self, pairs, *more))
    rng = random.Random(4)
    base, texts = words(rng, 120).split(), []
    for _ in range(600):
        own = list(base)
        for at in rng.sample(range(120), rng.randint(1, 6)):
            own[at] = words(rng, 1)
        texts.append(" ".join(own))
    got = lsh_forest.near_duplicates(rows_of(spark, texts), shingle_words=2).select(F.count_distinct("component_id")).first()[0]
    assert got == 1 and sum(tried) <= 16 * 600
