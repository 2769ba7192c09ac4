"""Operators that SQL cannot express against plain versions over whole small tables."""

import hashlib
import itertools
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import brown_lm, byte_bpe, canonical_digest, chat_windows, crf_language, edit_match, hilbert, lsh_forest, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def test_shards_of_all_documents(spark, sf_dir, documents):
    got = queries.op1_hilbert_shards(spark, sf_dir).collect()
    of = {r.doc_id: r for r in documents}
    for r in got:
        raw = (of[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        axes = [zlib.crc32(v.encode()) % 32 if v is not None else 0 for v in (of[r.doc_id].lang, of[r.doc_id].source)]
        axes.append(min(31, int(np.floor(np.log2(max(len(raw), 1)) * 2))))
        assert r.curve == hilbert.hilbert_index([np.array([a]) for a in axes], 5)[0]
    ranked = sorted(got, key=lambda r: (r.curve, r.text_crc32, r.doc_id))
    n = len(ranked)
    cuts = [-(-s * n // 16) for s in range(17)]
    assert [(r.shard, r.slot) for r in ranked] == [(s, i) for s in range(16) for i in range(cuts[s + 1] - cuts[s])]
    index = hilbert.hilbert_index([a.ravel() for a in np.indices((32, 32, 32))], 5)
    place = np.stack([a.ravel() for a in np.indices((32, 32, 32))], 1)[np.argsort(index)]
    assert sorted(index) == list(range(32**3)) and (np.abs(np.diff(place, axis=0)).sum(1) == 1).all()


def test_equal_texts_stand_side_by_side(spark):
    rng = random.Random(1)
    texts = [words(rng, 3) for _ in range(40)] + ["the same text"] * 20
    rng.shuffle(texts)
    rows = docs(spark, texts).withColumn("crc", F.crc32(F.col("text").cast("binary")))
    got = hilbert.shard(rows, [hilbert.category(F.col("lang"))], F.col("doc_id"), 2, group=F.col("crc")).collect()
    at = sorted(30 * r.shard + r.slot for r in got if r.text == "the same text")
    assert at == list(range(at[0], at[0] + 20))


def plain_canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split())


def brute_digests(rows, got):
    """Checks op4's columns: rows is {id: text} with distinct ids."""
    ids = sorted(rows, reverse=True)
    made = {}
    for key, after in zip(ids, ids[1:] + ids[:1]):
        text, following = rows[key] or "", rows[after] or ""
        half = len(text) // 2
        made[key] = (text, text[: len(text) - half] + following[:half], following)
    seen = {}
    for r in got:
        text, edited, following = made[r.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == float(plain_canonical(text) == plain_canonical(edited))
        assert r.near_next == float(plain_canonical(text) == plain_canonical(following))
        for shown, own in ((r.fingerprint, text), (r.edited_fingerprint, edited)):
            assert seen.setdefault(shown, plain_canonical(own)) == plain_canonical(own)
    assert len(seen) == len({plain_canonical(t) for text, edited, _ in made.values() for t in (text, edited)}) and len(got) == len(rows)


def test_digests_of_all_documents(spark, sf_dir, documents):
    brute_digests({r.doc_id: r.text for r in documents}, queries.op4_canonical_digest(spark, sf_dir).collect())


def test_digests_of_sparse_and_negative_ids(spark):
    rng = random.Random(2)
    rows = {rng.randint(-(2**62), 2**62): rng.choice(["same", "Same ", "ｓame", "x y", "", None, words(rng, 9)]) for _ in range(300)}
    made = canonical_digest.compared(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(7))
    like = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    got = made.select("*", F.col("id").alias("doc_id"), like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next")).collect()
    brute_digests(rows, got)


def test_a_digest_that_clashes_is_told_apart(spark):
    def weak(text):
        return str(len(canonical_digest.canonical(text)) % 3)

    texts = ["a", "A", "bb", "b b", "cccc", "c", "", None, "dddd"]
    made = canonical_digest.compared(docs(spark, texts), digest=weak).collect()
    shown = {r.id: r.fingerprint for r in made}
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert (shown[a] == shown[b]) == (plain_canonical(texts[a]) == plain_canonical(texts[b]))
    of_edited = {plain_canonical(texts[r.id]): r.fingerprint for r in made}
    for r in made:
        own, after = texts[r.id] or "", texts[(r.id - 1) % len(texts)] or ""
        edited = plain_canonical(canonical_digest.edited(own, after))
        assert (r.edited_fingerprint == r.fingerprint) == (edited == plain_canonical(own))
        assert edited not in of_edited or of_edited[edited] == r.edited_fingerprint
    again = canonical_digest.fingerprint(docs(spark, texts), digest=weak).collect()
    assert len({r.fingerprint for r in again}) == len({plain_canonical(t) for t in texts})


def test_ids_that_tie_or_are_null(spark):
    rows = [(None, "n"), (3, "a"), (3, "b"), (3, "a"), (None, "n"), (1, "z")]
    got = canonical_digest.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id is None, r.id or 0, r.n_chars) for r in got) == [(False, 1, 1), (False, 3, 1), (False, 3, 1), (False, 3, 1), (True, 0, 1), (True, 0, 1)]
    assert [r.next_id for r in got if r.id == 1] == [None] and sum(r.next_id == 3 for r in got if r.id is None) == 1


def plain_distance(item, text):
    row = np.zeros(len(text) + 1, int)
    codes, at = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    for i, ch in enumerate(item, 1):
        step = np.concatenate([[i], np.minimum(row[:-1] + (codes != ord(ch)), row[1:] + 1)])
        row = np.minimum.accumulate(step - at) + at
    return int(row.min())


def test_benchmark_items_of_all_documents(spark, sf_dir, documents):
    items = {r.item_id: edit_match.normalised(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op6_edit_match(spark, sf_dir).collect()}
    want = {}
    for r in documents:
        text = edit_match.normalised(r.text)
        if len(text) > 60_000:  # the plain table of one is gigabytes
            text = text[:60_000] if not any(k == r.doc_id for k, _ in got) else text
        for key, item in items.items():
            found = edit_match.best_match(edit_match.masks_of(item), len(item), text)[0] if item and text else None
            if found is not None and found <= edit_match.budget_of(item):
                want[r.doc_id, key] = found
    assert got == want and want
    rng = random.Random(1)
    for key, item in rng.sample(sorted(got), min(6, len(got))):
        text = edit_match.normalised(next(r.text for r in documents if r.doc_id == key))
        assert plain_distance(items[item], text) == got[key, item]


def test_short_items_are_whole_words(spark):
    bench = spark.createDataFrame([(1, "an"), (2, "c++"), (3, "an"), (3, "an"), (None, "an")], "item_id long, text string")
    texts = ["some banana text", "it is an apple", "(an)", "c++, an", "xc++", "An"]
    got = sorted((r.doc_id, r.item_id) for r in edit_match.matches(docs(spark, texts), bench).collect())
    assert got == [(1, 1), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (3, 3), (5, 1), (5, 3)]


def test_forward_backward_over_all_paths():
    rng = np.random.default_rng(3)
    emission, transition, first = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    real = np.array([[True] * 4, [True, True, True, False]])
    posterior, pair = crf_language.forward_backward(emission, transition, first, real)
    want, moves = np.zeros_like(posterior), np.zeros((3, 3))
    for row in range(2):
        n = int(real[row].sum())
        weights = {}
        for path in itertools.product(range(3), repeat=n):
            value = first[path[0]] + sum(emission[row, i, k] for i, k in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:]))
            weights[path] = np.exp(value)
        total = sum(weights.values())
        for path, weight in weights.items():
            for i, k in enumerate(path):
                want[row, i, k] += weight / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += weight / total
        assert np.allclose(posterior[row, :n], want[row, :n])
    assert np.allclose(pair, moves)


def test_code_switched_text_has_spans(spark):
    rng = random.Random(4)
    texts = [(words(rng, 60, "abcdef"), "xx") for _ in range(60)] + [(words(rng, 60, "qrstuv"), "yy") for _ in range(60)]
    rows = spark.createDataFrame([(i % 90, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    model = crf_language.fit(rows)
    both = words(rng, 20, "abcdef") + " 123 " + words(rng, 30, "qrstuv")
    found = crf_language.spans(docs(spark, [both, "", None, "1 2"]), model).collect()
    assert {r.id for r in found} == {0} and [r.lang for r in sorted(found, key=lambda r: r.start)] == ["xx", "yy"]
    assert found[0].end in (20, 21) or found[1].end in (20, 21)
    # all words of a sampled text are learnt: languages that differ only far behind
    late = [(words(rng, 3000, "abcdef") + " " + words(rng, 300, "mnop"), "xx") if i % 2 else (words(rng, 3000, "abcdef") + " " + words(rng, 300, "ijkl"), "yy") for i in range(20)]
    model = crf_language.fit(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(late)], "doc_id long, text string, lang string"))
    assert [model.documents([words(rng, 50, letters)])[0][0] for letters in ("mnop", "ijkl")] == ["xx", "yy"]


def test_the_sample_is_of_rows(spark, monkeypatch):
    monkeypatch.setattr(crf_language, "SAMPLE", 5)
    rows = [(1, f"t{i}", "aa") for i in range(20)] + [(None, "null id", "bb")] * 50 + [(2, None, "aa"), (3, "x", None)]
    got = crf_language.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.lang == "aa" for r in got) == 5 and [r.text for r in got if r.lang == "bb"] == ["null id"]


def test_windows_are_within_the_budget(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(6):
        for turn in range(30):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]
            n = (400 if conv < 4 else 10) if role == "system" else rng.choice((5, 100, 180, 300, 500))
            rows.append((conv, turn, role, words(rng, n)))
    rows += [(9, 0, "system", words(rng, 1500)), (9, 1, "user", words(rng, 5)), (9, 2, "assistant", words(rng, 9))]
    made = chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))).collect()
    tokens = lambda part: 4 + len(re.findall(r"\w+|[^\w\s]", part.split("\n", 1)[1]))
    repeats = 0
    for w in made:
        turns = w.text.split("<|end|>\n")[:-1]
        system = [t for t in turns if t.startswith("<|turn|>system\n")]
        context, own = turns[: w.n_context], turns[w.n_context :]
        repeats += sum(t not in system for t in context)
        over = sum(map(tokens, turns)) > 1024
        assert not over or (len([t for t in own if t not in system]) <= 1 and not [t for t in context if t not in system])
        assert not over or sum(map(tokens, {*system, *own})) > 1024
        assert w.conv_id % 2 == 0 or len(system) == 1
    assert repeats > 10 and sum(sum(map(tokens, w.text.split("<|end|>\n")[:-1])) > 1024 for w in made) == 3  # conversation 9
    read = chat_windows.read_back(chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for r in read:
        own = [x for x in rows if x[0] == r.conv_id]
        assert r.turns == "".join(f"{x[2]}\n{x[3]}\n" for x in own) and r.loss_text == "".join(x[3] for x in own if x[2] == "assistant")


def test_split_characters(spark):
    import public_tokenizers as public

    path = public.path(queries.RANKS)
    ranks = byte_bpe.read_ranks(path)
    raw = "né🙂x".encode()
    ids = [ranks[bytes([b])] for b in raw]
    rows = spark.createDataFrame([(0, ids[:2]), (1, ids[2:5]), (2, ids[5:]), (3, None), (4, [])], "at int, ids array<int>")
    got = {r.at: r for r in byte_bpe.decode(rows, path, text_col="text").collect()}
    assert b"".join(bytes(got[i].decoded) for i in range(3)) == raw and [bytes(got[i].decoded) for i in (3, 4)] == [b"", b""]
    assert got[0].text == "n�" and got[1].text[0] == "�" and got[2].text.endswith("x") and got[3].text == ""
    whole = byte_bpe.joined(rows.withColumn("doc", F.lit("d")), ["doc"], "at", path).collect()
    assert [r.text for r in whole] == ["né🙂x"] and list(whole[0].ids) == ids


def test_class_model_against_plain_counts(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(("the", "a", "Cat", "dog", "ran", "sat", f"w{rng.randrange(40)}")) for _ in range(rng.randrange(12))) for _ in range(80)]
    rows = docs(spark, [*texts, None, ""])
    table, model = brown_lm.learn(rows)
    marked = brown_lm.annotate(rows, table, model)
    step = brown_lm.steps(marked)
    got = {r.doc_id: r for r in brown_lm.score(marked, step).collect()}
    hashed = lambda w: int(np.array([brown_lm.Words()._hash(w)], np.uint64).view(np.int64)[0])
    cls = {r.hash: r.cls for r in table.collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate([*texts, None, ""])}
    counts, bigrams = {}, np.zeros((brown_lm.CLASSES + 1,) * 2)
    class_of = lambda w: brown_lm.CLASSES if w is None else cls[hashed(w)]
    for own in tokens.values():
        for before, w in zip([None, *own], own):
            counts[w] = counts.get(w, 0) + 1
            bigrams[class_of(before), class_of(w)] += 1
    move = (bigrams + brown_lm.ADDED) / (bigrams.sum(axis=1, keepdims=True) + brown_lm.ADDED * (brown_lm.CLASSES + 1))
    assert np.allclose(10**step, move) and np.allclose(move.sum(axis=1), 1)
    for c in {class_of(w) for w in counts if w is not None}:
        inside = [w for w in counts if w is not None and class_of(w) == c]
        below = sum(counts[w] for w in inside) + len(inside) + 1
        # the words of a class and one that was not seen share its probability
        assert np.isclose(sum((counts[w] + 1) / below for w in inside) + 1 / below, 1) and np.isclose(10 ** model["below"][c], below)
    for i, own in tokens.items():
        want = 0.0
        for before, w in zip([None, *own], own):
            want += np.log10(move[class_of(before), class_of(w)])
            if w is not None:
                inside = [x for x in counts if x is not None and class_of(x) == class_of(w)]
                want += np.log10((counts[w] + 1) / (sum(counts[x] for x in inside) + len(inside) + 1))
        assert np.isclose(got[i].score, want) and got[i].n_tokens == len(own)


def sets_of(texts, size):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def test_many_texts_with_common_boilerplate(spark):
    """No large region has its pairs made, and linked pairs in it are found."""
    rng = random.Random(11)
    common = words(rng, 150)
    texts = [f"{common} {words(rng, 50)}" for _ in range(1500)]
    for i in range(0, 1000, 50):  # a copy of the id divisible by 50, with similarity just above the threshold
        own = texts[i].split()
        for at in rng.sample(range(150, 200), 10):
            own[at] = words(rng, 1)
        texts.append(" ".join(own))
    forest = lsh_forest.Forest(docs(spark, texts), "doc_id", "text", 2, 80)
    made = forest.candidates().count()
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs(spark, texts), shingle_words=2).collect()}
    sets = sets_of(texts, 2)
    want = [(i, j) for i in range(0, len(texts), 50) for j in range(len(texts)) if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    found = sum(got[i] == got[j] for i, j in want)
    assert len(want) >= 20 and found >= 0.9 * len(want)
    assert sum(got[i] != i for i in got) == sum(1 for i in range(1500, len(texts)) if got[i] != i)  # nothing else is linked
    assert made < 300 * len(texts)


def test_recall_on_all_documents(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op2_lsh_forest(spark, sf_dir).collect()}
    ids = [r.doc_id for r in documents]
    sets = dict(zip(ids, sets_of([r.text for r in documents], 2)))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [(i, j) for i, j in itertools.combinations(sorted(ids), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    assert links and {i: got[i].component_id for i in ids} == {i: find(i) for i in ids}
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (find(i) == i) for i in ids)


def test_ids_of_near_duplicates_that_repeat(spark):
    base = words(random.Random(1), 40)
    rows = [(1, base), (1, "something else"), (None, base), (2, base + " x"), (None, None), (3, None), (3, ""), (4, "a b c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(0))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(frame, shingle_words=2).collect()), key=repr)
    assert [g for g in got if g[0]] == [(True, 0, 0, None, True), (True, 0, 39, None, True)]
    assert {(g[1], g[3], g[4]) for g in got if not g[0]} == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)}
    left = lsh_forest.deduplicated(frame, shingle_words=2)
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 0, 1, 3, 4] and left.columns == frame.columns


def test_every_language_is_learnt_whatever_its_share(spark):
    """A part of the sample mixes its languages: the largest is neither first nor forgotten."""
    found = queries.op10_crf_language(spark, "/root/testdata/sf0.01").where("held_out and lang_pred <> 'und'")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    for lang in {r.lang for r in rows}:
        own = [r for r in rows if r.lang == lang]
        assert sum(r.lang_pred == lang for r in own) >= 0.95 * len(own) and sum(r.score for r in own) >= 0.9 * len(own)


def test_digests_of_many_rows_without_an_id(spark):
    """Rows that share an id, or have none, and an edited text grow in proportion."""
    rows = spark.range(20_000).selectExpr("cast(null as bigint) as doc_id", "'one text' as text").unionByName(spark.range(5_000).selectExpr("7L as doc_id", "'another text' as text"))
    got = canonical_digest.compared(rows)
    assert got.groupBy("id").count().orderBy("id").collect() == [(None, 20_000), (7, 5_000)]
    assert got.select("fingerprint").distinct().count() == 2
