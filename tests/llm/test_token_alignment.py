"""Alignment of two tokenizers against plain loops over whole texts coded by the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoloom.llm import token_alignment
from geoloom.llm.byte_bpe import byte_table

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def both(coders, text):
    """[(id, bytes)] of A and of B; none if they do not cover the text."""
    tokenizer, model = coders
    back = {c: b for b, c in byte_table().items()}
    if not text:
        return [], []
    a = [(i, bytes(back[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        name = model.id_to_piece(i)
        b.append((i, bytes([int(name[3:-1], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])


def spans(tokens):
    at, out = 0, []
    for token, raw in tokens:
        out.append((token, at, at + len(raw)))
        at += len(raw)
    return out


def plain(coders, rows):
    coded = [(k, *map(spans, both(coders, t))) for k, t in rows]
    links = [[(a, b) for a, s, e in left for b, s2, e2 in right if s < e2 and s2 < e] for _, left, right in coded]
    count = Counter(p for own in links for p in set(own))
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for (key, left, right), own in zip(coded, links):
        cuts = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(t) for t, _, e in side if low < e <= high) for side in (left, right)))
            low = high
        best = sum(count[p] == highest[p[0]] for p in own)
        out.append((key, len(left), len(right), len(cuts), len(own), best, sum(count[p] for p in own), ";".join(groups)))
    return out, count, highest


TEXTS = [None, "", " ", "a", "  two  spaces ", "Is and retitioning ouen the of, nterti.\n\nThe the", "漢字 éèç ﬁ", "▁under", "<s> x <|endoftext|> <0x41>", "tab\tand \x00 nul", "the the the", "🙂🙂"]


def sample(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in rows if r.text and len(r.text) < 900][:60] + [(10**6 + i, t) for i, t in enumerate(TEXTS)]


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_equals_plain_loops(spark, sf_dir, coders, monkeypatch, chunk):
    monkeypatch.setattr(token_alignment, "CHUNK", chunk)
    monkeypatch.setattr(token_alignment, "AT_ONCE", chunk)
    rows = sample(spark, sf_dir)
    want, count, highest = plain(coders, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_alignment.align(df, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    found = {(r.a, r.b): (r.docs, r.best) for r in token_alignment.pairs(df, A, B).collect()}
    assert found == {p: (n, n == highest[p[0]]) for p, n in count.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" ab'\n\t.é漢▁ <s>0x🙂\x00́"), max_size=24) | st.text(max_size=12))
def test_words_code_as_whole_texts_do(text):
    coders = test_words_code_as_whole_texts_do.__dict__.setdefault("coders", None) or (Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B))
    test_words_code_as_whole_texts_do.coders = coders
    coders[0].encode_special_tokens = True
    own = test_words_code_as_whole_texts_do.__dict__.setdefault("own", None) or token_alignment.Coders((A, public.PATTERN, B))
    test_words_code_as_whole_texts_do.own = own
    a, b = both(coders, text)
    got = [ids.tolist() for ids, _ in own.encode([text])]
    assert got == [[i for i, _ in a], [i for i, _ in b]]


def test_odd_rows(spark, coders):
    rng = random.Random(4)
    long = " ".join(rng.choice(["the", "of", "naïve", "x1"]) for _ in range(150_000))
    rows = [(None, "a tie"), (None, "a tie"), (7, "a tie"), (7, None), (8, ""), (9, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as a", "3 as b", "4 as chunk", "5 as pairs", "6 as n_a")
    got = token_alignment.align(df, A, B).collect()
    short = [tuple(r) for r in got if r.doc_id != 9]
    tie, _, _ = plain(coders, [(i, t) for i, t in enumerate(t for _, t in rows[:5])])
    assert [r[1:5] for r in sorted(short, key=repr)] == [r[1:5] for r in sorted(((k, *t[1:]) for (k, _), t in zip(rows, tie)), key=repr)]
    left, right = map(spans, both(coders, long))
    one = next(r for r in got if r.doc_id == 9)
    assert (one.n_a, one.n_b, one.n_groups) == (len(left), len(right), len({e for *_, e in left} & {e for *_, e in right}))
    assert token_alignment.align(df.where(F.lit(False)), A, B).collect() == []


def test_document_counts_of_pairs():
    pair, n = token_alignment._doc_pairs(np.array([0, 0, 0, 1, 1, 2]), np.array([5, 5, 2, 5, 9, 2]))
    assert (pair.tolist(), n.tolist()) == ([2, 5, 9], [2, 2, 1])
    assert hashlib.sha256(b"").hexdigest() and token_alignment._doc_pairs(np.zeros(0, np.int64), np.zeros(0, np.int64))[0].size == 0
