"""Values of every query on odd tables: nulls, empty and very long texts, ties, repeats, clashing column names."""

import hashlib
import random
import zlib

import pytest
import tiktoken
from pyspark.sql import functions as F

from geoloom.llm import byte_bpe, edit_match, queries
from geoloom.llm.canonical_digest import canonical


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def clash(df, names):
    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(12)
    base, item = words(rng, 60), words(rng, 20)
    texts = [None, "", " \t", "one", "One", base, base, base + " x", words(rng, 60_000), "é" * 5, "1 2 3", "x " + item + " y", "ＡＢ c", "ab C"]
    docs = [(i, t, "en" if i % 3 else None, "s", 1) for i, t in enumerate(texts)] + [(40, "tie", "en", "s", 1), (40, "tie", "en", "s", 1), (None, "no id", None, None, None)]
    home = str(tmp_path_factory.mktemp("values"))
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    clash(rows, ["id", "key", "node", "n", "host", "curve", "shard", "slot", "size", "ids", "decoded", "score", "lang_pred", "fingerprint", "next_id", "item_id", "known", "hash"]).write.parquet(f"{home}/documents.parquet")
    items = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, item), (3, item), (None, item), (4, words(rng, 5_000))], "item_id long, text string")
    clash(items, ["doc_id", "id", "distance", "end_char"]).write.parquet(f"{home}/benchmark.parquet")
    long_page = words(rng, 60_000)
    pages = [(0, None, None), (1, "http://h.com/en/x", "<p>a"), (2, "http://h.com/p", ""), (None, "http://h.com/p", f"<article>{long_page}</article>"), (4, "HTTP://Sub.Example.NET/de/8?x", "<p>a"), (4, "HTTP://Sub.Example.NET/de/8?x", "<p>a")]
    clash(spark.createDataFrame(pages, "page_id long, url string, html string"), ["host", "path", "rule", "verdict", "text", "id", "page", "token", "classes"]).write.parquet(f"{home}/pages.parquet")
    turns = [(0, 0, None, None), (0, 0, "assistant", "a"), (None, None, "user", ""), (5, 1, "assistant", words(rng, 30_000)), (5, 0, "system", "s & </s>"), (5, 2, "user", "q"), (5, 2, "user", "q")]
    clash(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), ["window", "at", "body", "tokens", "loss"]).write.parquet(f"{home}/conversations.parquet")
    return {"home": home, "docs": docs, "pages": pages, "turns": turns, "item": item, "long_page": long_page}


def run(spark, odd, name):
    return queries.queries()[name](spark, odd["home"]).collect()


def test_shards(spark, odd):
    got = run(spark, odd, "op1_hilbert_shards")
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in odd["docs"])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want
    counts = [sum(r.shard == s for r in got) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in range(16))


def test_near_duplicates(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run(spark, odd, "op2_lsh_forest")]
    by = {g[0]: g for g in got}
    assert by[0][1:] == by[0][1:] and [by[i][1] for i in (0, 1, 2, 3, 10)] == [0, 0, 0, 1, 2]
    assert [by[i][2] for i in (0, 1, 2, 3, 4, 5, 6, 7)] == [0, 1, 2, 3, 3, 5, 5, 5] and by[None][2:] == (None, True)
    assert sum(g[0] == 40 and g[2:] == (40, True) for g in got) == 2 and len(got) == len(odd["docs"])


def test_chat(spark, odd):
    got = {r.conv_id: r for r in run(spark, odd, "op3_chat_windows")}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for conv in {t[0] for t in odd["turns"]} | {-1}:
        own = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")] if conv == -1 else sorted((t for t in odd["turns"] if t[0] == conv), key=order)
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        digest = hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), digest)
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(got) == 4


def test_digests(spark, odd):
    got = run(spark, odd, "op4_canonical_digest")
    shown = {}
    for r in got:
        shown.setdefault(r.fingerprint, set()).add(r.doc_id)
    same = {}
    for d, t, *_ in odd["docs"]:
        same.setdefault(canonical(t), set()).add(d)
    assert sorted(map(repr, shown.values())) == sorted(map(repr, same.values())) and len(got) == len(odd["docs"])
    whole = {d: t or "" for d, t, *_ in odd["docs"]}
    for after, own in ((4, 5), (5, 6), (9, 10)):
        text, following = whole[own], whole[after]
        want = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert next(r.edited_sha256 for r in got if r.doc_id == own) == hashlib.sha256(want.encode()).hexdigest()


def test_pages(spark, odd):
    got = {(r.page_id, r.text, r.n_chars) for r in run(spark, odd, "op5_page_templates")}
    assert got == {(0, "", 0), (1, "a", 1), (2, "", 0), (None, odd["long_page"], len(odd["long_page"])), (4, "a", 1)}
    judged = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in run(spark, odd, "op8_url_rules")]
    assert sorted(judged, key=repr) == sorted(
        [(0, "", "", None, "allow"), (1, "h.com", "/en/x", "com/en/", "block"), (2, "h.com", "/p", None, "allow"), (None, "h.com", "/p", None, "allow")]
        + [(4, "sub.example.net", "/de/8", "example.net/de/8", "block")] * 2, key=repr
    )


def test_items(spark, odd):
    got = sorted((r.doc_id, r.item_id, r.distance) for r in run(spark, odd, "op6_edit_match"))
    assert got == [(11, 0, 0), (11, 3, 0)] and edit_match.budget_of(odd["item"]) > 0


def test_tokens(spark, odd):
    import public_tokenizers as public

    coder = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public.path(queries.RANKS)), special_tokens={})
    want = []
    for d, t, *_ in odd["docs"]:
        ids = coder.encode_ordinary(t or "")
        want.append((repr(d), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, odd, "op7_byte_bpe")) == sorted(want)


def test_scores_and_languages(spark, odd):
    held = lambda d, n: zlib.crc32(b"" if d is None else str(d).encode()) % n == 2
    scored = run(spark, odd, "op9_brown_lm")
    tokens = {repr(d): len((t or "").split()) + 1 for d, t, *_ in odd["docs"]}
    assert all(r.n_tokens == tokens[repr(r.doc_id)] and r.held_out == held(r.doc_id, 7) and r.score < 0 and r.base_score < 0 for r in scored) and len(scored) == len(odd["docs"])
    assert {r.train_tokens for r in scored} == {sum(len((t or "").split()) + 1 for d, t, *_ in odd["docs"] if not held(d, 7))}
    found = run(spark, odd, "op10_crf_language")
    letters = {repr(d): any(map(str.isalpha, t or "")) for d, t, *_ in odd["docs"]}
    assert all((r.lang_pred == "en") == letters[repr(r.doc_id)] and r.held_out == held(r.doc_id, 4) and 0 <= r.score <= 1 for r in found) and len(found) == len(odd["docs"])
    assert {(r.lang_pred, r.score) for r in found if not letters[repr(r.doc_id)]} == {("und", 0.0)}
