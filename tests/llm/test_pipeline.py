"""The corpus pipeline against a plain version of its stages, and odd tables."""

import random
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm import byte_bpe, crf_language, edit_match, queries


def share_of(model, text):
    """(label, share) of a text: posteriors of each run of words by sums over forward and backward logarithms."""
    words = (text or "").lower().split()
    mass = np.zeros(len(model.labels))
    for start in range(0, len(words), crf_language.LENGTH):
        run = words[start : start + crf_language.LENGTH]
        place, hashed, letter = crf_language.features(run)
        emission = crf_language.scores(model.weights, place, hashed, len(run)) if len(place) else np.zeros((len(run), len(model.labels)))
        ahead, behind = [model.first + emission[0]], [np.zeros(len(model.labels))]
        for row in emission[1:]:
            ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + model.transition, axis=0) + row)
        for row in emission[:0:-1]:
            behind.append(np.logaddexp.reduce(model.transition + row + behind[-1], axis=1))
        for a, b, has in zip(ahead, behind[::-1], letter):
            if has:
                mass += np.exp(a + b - np.logaddexp.reduce(a + b))
    return (model.labels[int(mass.argmax())], mass.max() / mass.sum()) if mass.sum() > 0.5 else (crf_language.UNKNOWN, 0.0)


def smallest_of_groups(texts, size=5, percent=80):
    sets, root = {}, {key: key for key in texts}
    for key, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def test_run_against_a_plain_version(spark, sf_dir):
    import public_tokenizers as public

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    learnt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = crf_language.fit(rows.where(learnt))
    for key, text in list(texts.items()):
        label, share = share_of(model, text)
        if label == crf_language.UNKNOWN or share < corpus_pipeline.MIN_SHARE:
            del texts[key]
    assert len(texts) > 100
    texts = {key: texts[key] for key in smallest_of_groups(texts)}
    items = [edit_match.normalised(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for key, text in list(texts.items()):
        plain = edit_match.normalised(text)
        if any(edit_match.best_match(edit_match.masks_of(item), len(item), plain)[0] <= edit_match.budget_of(item) for item in items if item and plain):
            del texts[key]
    coder = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public.path(queries.RANKS)), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(texts) and len(got) < rows.count()
    for key, text in texts.items():
        assert list(got[key].ids) == coder.encode_ordinary(text or "") and got[key].whole and got[key].n_tokens == len(got[key].ids)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(5)
    say = lambda n, letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    item = say(30, "abcdef")
    copy = say(50, "abcdef")
    texts = [(i, say(60, letters), lang) for i, (letters, lang) in enumerate([("abcdef", "xx"), ("qrstuv", "yy")] * 20)]
    texts += [(100, copy, "xx"), (101, copy, "xx"), (102, copy + " end", None), (103, say(9, "abcdef") + " " + item.upper(), "xx"), (104, None, "xx"), (105, "", "xx"), (106, "12 34", "yy")]
    texts += [(107, "12 ab", None), (None, say(20, "abcdef"), "xx"), (108, say(40_000, "qrstuv"), "yy"), (109, copy, "xx"), (109, copy, "xx")]
    home = str(tmp_path_factory.mktemp("pipeline"))
    rows = spark.createDataFrame([(*t, "s", "clash", 1.0, "clash") for t in texts], "doc_id long, text string, lang string, source string, lang_pred string, lang_score double, ids string")
    rows.write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    none = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{home}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    return home, none


def test_stages_on_odd_tables(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, odd[0])
    assert kept.columns == docs.columns and {r.lang_pred for r in kept.collect()} == {"clash"}
    left = sorted((r.doc_id or -1) for r in kept.collect())
    assert not {104, 105, 106} & set(left) and {*range(1, 40), 100, 101, 102, 103, 107, 108} <= set(left) and left.count(109) == 2
    unique = corpus_pipeline.near_dedup(spark, docs, odd[0])
    ids = [r.doc_id for r in unique.collect()]
    assert unique.columns == docs.columns and not {101, 102, 109} & set(ids) and ids.count(None) == 1 and {100, 104, 105} <= set(ids)
    clean = corpus_pipeline.decontaminate(spark, docs, odd[0])
    assert clean.columns == docs.columns and docs.count() - clean.count() == 1 and 103 not in {r.doc_id for r in clean.collect()}
    coded = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, odd[0]).collect()}
    assert coded[104].ids == [] and coded[105].whole and coded[108].n_tokens > 40_000
    assert zlib.crc32(b"") == 0 and corpus_pipeline.run(spark, odd[1]).collect() == []
    assert {r.doc_id for r in corpus_pipeline.run(spark, odd[0]).collect()} == {*range(40), 100, 107, 108, None}
