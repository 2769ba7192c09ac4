"""The text operators on small tables: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import brown_lm, byte_bpe, canonical_digest, chat_windows, crf_language, edit_match, hilbert, lsh_forest, page_templates, queries, url_rules
from geoloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empty, long and repeated texts."""
    rng = random.Random(3)
    base = words(rng, 60)
    texts = [None, "", "  ", "one", "One", base, base, base + " x", words(rng, 30000), "é" * 5, "1 2 3", base.upper(), "a\x0bb"]
    home = tmp_path_factory.mktemp("odd")
    made = docs(spark, texts).withColumn("shard", F.lit("clash")).withColumn("score", F.lit(1))
    made.write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(0, words(rng, 20)), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    spark.createDataFrame([(0, None, None), (1, "x", "<p>a"), (2, "http://h/p", "")], "page_id long, url string, html string").write.parquet(f"{home}/pages.parquet")
    spark.createDataFrame([(0, 0, None, None), (0, 0, "assistant", "a"), (None, None, "user", "")], "conv_id long, turn long, role string, text string").write.parquet(f"{home}/conversations.parquet")
    none = tmp_path_factory.mktemp("none")
    for name in ("documents", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{home}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    return {"odd": str(home), "none": str(none), "texts": texts}


@pytest.mark.parametrize("name", sorted(queries.queries()))
@pytest.mark.parametrize("which", ["odd", "none"])
def test_odd_tables(spark, odd, name, which):
    got = queries.queries()[name](spark, odd[which]).collect()
    n = len(odd["texts"]) if which == "odd" else 0
    if name.startswith("op3"):
        assert len(got) == (3 if which == "odd" else 1)
    elif name.startswith(("op5", "op8")):
        assert len(got) == (3 if which == "odd" else 0)
    elif not name.startswith("op6"):
        assert len(got) == n


def test_pipeline(spark, odd):
    import corpus_pipeline

    got = {r.doc_id for r in corpus_pipeline.run(spark, odd["odd"]).collect()}
    assert not got & {0, 1, 2, 10} and 5 in got and 6 not in got


def test_shards(spark):
    rows = docs(spark, ["x"] * 103)
    got = hilbert.shard(rows, [hilbert.category(F.col("lang")), hilbert.magnitude(F.col("n_chars"))], F.col("doc_id"), 4).collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert sorted(map(len, by.values())) == [25, 26, 26, 26] and all(v == list(range(len(v))) for v in by.values())
    index = hilbert.hilbert_index([a.ravel() for a in np.indices((8, 8, 8))], 3)
    place = np.stack([a.ravel() for a in np.indices((8, 8, 8))], 1)[np.argsort(index)]
    assert sorted(index) == list(range(512)) and (np.abs(np.diff(place, axis=0)).sum(1) == 1).all()


def brute_groups(texts, size=2, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def test_near_duplicates_of_a_hub(spark):
    """Copies that resemble the text they come from, but not each other."""
    rng = random.Random(5)
    base = words(rng, 120).split()
    texts = [" ".join(base)]
    for _ in range(150):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.randint(1, 7)):
            own[at] = words(rng, 1)
        texts.append(" ".join(own))
    texts += [words(rng, 40) for _ in range(20)] + ["", None, "one"]
    want, sizes = brute_groups(texts)
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(docs(spark, texts), shingle_words=2).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert set(got.values()) == {1, 100} and len(got) == 63


def test_chat_windows(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(4):
        for turn in range(40):
            role = "system" if turn == 0 else ("user", "assistant")[turn % 2 == 0]
            rows.append((conv, turn, role, words(rng, rng.choice((3, 40, 400))) + " <|end|> &amp; </s>"))
    made = chat_windows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=300)
    read = {r.conv_id: r for r in chat_windows.read_back(made).collect()}
    for conv in range(4):
        own = [r for r in rows if r[0] == conv]
        assert read[conv].turns == "".join(f"{r[2]}\n{r[3]}\n" for r in own)
        assert read[conv].loss_text == "".join(r[3] for r in own if r[2] == "assistant") and read[conv].n_turns == 40
    for w in made.collect():
        assert w.text.startswith("<|turn|>system\n")
        own = w.text.split("<|end|>\n")[:-1][w.n_context :]
        assert len(own) == 1 or sum(len(__import__("re").findall(r"\w+|[^\w\s]", t)) for t in own) < 2 * 300


def test_digest_and_next(spark):
    texts = ["Ａbc  d", "abc d", "x", None, "straße", "STRASSE"]
    got = {r.doc_id: r.fingerprint for r in canonical_digest.fingerprint(docs(spark, texts)).collect()}
    assert got[0] == got[1] and got[4] == got[5] and len(set(got.values())) == 4
    many = spark.range(0, 5000, 700).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    follow = {r.id: r.next for r in canonical_digest.followed(many).collect()}
    ids = sorted(follow, reverse=True)
    assert all(follow[a] == str(b) for a, b in zip(ids, ids[1:] + ids[:1]))


def test_collisions_are_told_apart(spark):
    rows = spark.createDataFrame([("a", "d"), ("A", "d"), ("b", "d"), ("c", "e")], "text string, digest string")
    assert sorted(map(tuple, canonical_digest.collisions(rows).collect())) == [("d", "a", 1), ("d", "b", 2)]


def test_pages():
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>m</a></ul></nav><div class='cookie-notice'>c</div><article><h1>H &amp; h</h1><p>one<br>two <b>three<p>four</article><div class=comments><p>no</p></div><script>var x='<p>'</script><footer>f</footer>"
    assert page_templates.main_text(page, None) == "H & h\none two three\nfour"
    assert page_templates.main_text("<body><div id=nav>menu</div><div><p>long text here</p><p>more text</p></div></body>", None) == "long text here\nmore text"
    assert page_templates.main_text(None, None) == "" and page_templates.main_text("plain", None) == "plain"


def test_pages_without_an_article_keep_all_text():
    page = "<html><body><div class=c><p>twenty characters ab</p><ul><li>" + "x " * 40 + "</ul></div></body></html>"
    assert page_templates.main_text(page, None) == "twenty characters ab\n" + ("x " * 40).strip()
    assert page_templates.main_text("<p>first</p><div>" + "y " * 40 + "</div>", None) == "first\n" + ("y " * 40).strip()


def test_pages_of_a_host_with_several_layouts(spark):
    pages = [(i, f"http://h/{i}", f"<html><body><div>every page</div><div class=layout{'abc'[i % 3]}><article><p>text {i}</article></div></body></html>") for i in range(9)]
    got = page_templates.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"text {i}" for i in range(9)}


def test_edit_distance():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for a in p:
            last, row = row, [row[0] + 1]
            for j, b in enumerate(t):
                row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (a != b)))
        return min(row)

    rng = random.Random(2)
    for _ in range(300):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randint(1, n))) for n in (12, 30))
        d, end = edit_match.best_match(edit_match.masks_of(p), len(p), t)
        assert d == plain(p, t) and (d == len(p) or plain(p, t[:end]) == d)


def test_benchmark_passages(spark):
    rng = random.Random(8)
    item = words(rng, 40)
    edited = item[:20] + "zz" + item[21:90] + item[93:]
    texts = [words(rng, 50) + " " + item.upper().replace(" ", "\n") + words(rng, 9), words(rng, 9) + edited + words(rng, 30), words(rng, 200), None, ""]
    bench = spark.createDataFrame([(7, item), (8, None), (9, " ")], "item_id long, text string")
    got = {r.doc_id: r.distance for r in edit_match.matches(docs(spark, texts), bench).collect()}
    assert set(got) == {0, 1} and got[0] == 0 and 0 < got[1] <= 5
    assert [r.doc_id for r in edit_match.clean(docs(spark, texts), bench).collect()] == [2, 3, 4]


def test_bpe(spark):
    import base64

    import public_tokenizers as public
    import tiktoken

    ranks = byte_bpe.read_ranks(public.path(queries.RANKS))
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world's \n\n end ", "日本語 🙂🙂", "", None, "a" * 3000, "\u0085​ x", "<|endoftext|>"]
    rows = byte_bpe.encode(docs(spark, texts), public.path(queries.RANKS), public.PATTERN, with_offsets=True)
    for r in byte_bpe.decode(rows, public.path(queries.RANKS)).collect():
        text = r.text or ""
        assert r.ids == own.encode_ordinary(text) and bytes(r.decoded).decode() == text
        assert not r.ids or (r.starts[0] == 0 and r.ends[-1] == len(text) and all(a < b for a, b in zip(r.starts, r.ends)))
    assert base64 and zlib


def test_urls(spark):
    urls = ["https://a.EXAMPLE.com/en/71?x", "http://example.com/en/8", "http://x.net/de/8", "http://example.net/de/8", "ftp://org/es/", "x.com/en/", None, "http://b.fr/cheap-pills/1", "http://example.comx/en/7"]
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    rules = [url_rules.site(*s) for s in queries.SITES]
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(rows, [*rules, *url_rules.PATTERNS]).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "block"), ("example.net/de/8", "block"), ("org/es/", "block"),
        (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"),
    ]


def test_pattern_ends(spark):
    urls = ["http://example.com/ads/1", "http://a.example.com/x/ADS/banner.gif", "http://b.fr/ads/", "http://b.fr/ads", "http://b.fr/loads/1", "http://b.fr/xcasino/", "http://b.fr/casino7", "http://b.fr/my-casino"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(rows, list(url_rules.PATTERNS)).collect()}
    assert [got[i] for i in range(len(urls))] == ["block"] * 3 + ["allow"] * 4 + ["block"]


def test_language(spark, sf_dir):
    got = queries.op10_crf_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    posterior, pair = crf_language.forward_backward(np.zeros((1, 4, 2)), np.zeros((2, 2)), np.zeros(2), np.ones((1, 4), bool))
    assert np.allclose(posterior, 0.5) and np.allclose(pair.sum(), 3)


def test_language_model(spark, sf_dir):
    rows = queries.op9_brown_lm(spark, sf_dir).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    counts: dict = {}
    for k, t in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for w in [*(t or "").encode().lower().split(), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows[:20]:
        tokens = [*(texts[r.doc_id] or "").encode().lower().split(), None]
        want = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens)
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.n_known == sum(w in counts for w in tokens) and r.train_tokens == n
    assert brown_lm.CLASSES and hashlib


def test_rare_words_have_classes_of_their_own(spark):
    # two kinds of words of 30 occurrences, below a share of 2**-14, with one ending and different company
    rng = random.Random(5)
    kinds = [[f"{kind}{i:03d}zz" for i in range(200)] for kind in "ab"]
    texts = []
    for kind, company in zip(kinds, ("p", "q")):
        pool = [w for w in kind for _ in range(30)]
        rng.shuffle(pool)
        for i in range(0, len(pool), 40):
            texts.append(" ".join(f"{w} " + " ".join(f"{company}{rng.randrange(20)}" for _ in range(50)) for w in pool[i : i + 40]))
    words, _ = brown_lm.learn(docs(spark, texts))
    found = {r.hash: r.cls for r in words.collect()}
    of = lambda w: found[int(np.array([brown_lm.Words()._hash(w.encode())], np.uint64).view(np.int64)[0])]
    first, second = ({of(w) for w in kind} for kind in kinds)
    assert not first & second
