"""Fill-in-the-middle against the token pattern, in whole texts and in pieces."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import fill_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def texts(seed, n=400):
    rng = random.Random(seed)
    out = [None, "", " ", "\t\n", "a", " a", "a ", "<P>", "x <M> y", "é" * 40]
    return out + ["".join(rng.choice("ab é \t\n  漢\x0b ") for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("piece", [7, 1 << 16])
def test_equals_the_pattern(spark, piece):
    rows = list(enumerate(texts(piece)))
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), piece=piece)
    got = {r.doc_id: tuple(r)[1:-1] for r in made.select("*", fill_middle.restored().alias("back")).collect()}
    assert got == {k: plain(k, t) for k, t in rows}
    back = {r.doc_id: r.back for r in made.select("doc_id", fill_middle.restored().alias("back")).collect()}
    assert back == {k: t or "" for k, t in rows}
    assert {v[1] for v in got.values()} == {"plain", "psm", "spm"}


def test_functions_compose():
    """Pieces give the states and counts that the whole gives, wherever it is cut and however it is entered."""
    rng = random.Random(3)
    for _ in range(200):
        raw = bytes(rng.choice(b"ab \t") for _ in range(rng.randint(0, 12)))
        at = rng.randint(0, len(raw))
        data = np.frombuffer(raw, np.uint8)
        states, counts = fill_middle.scan(data, np.array([0, at, len(raw)]))
        whole = fill_middle.scan(data, np.array([0, len(raw)]))
        for entry in range(3):
            middle = states[0, entry]
            assert states[1, middle] == whole[0][0, entry] and counts[0, entry] + counts[1, middle] == whole[1][0, entry]
            assert len(fill_middle.token_ends(data, entry)) == whole[1][0, entry]


def test_odd_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, "x y"), (3, "x y"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as id", "3 as output", "4 as form", "5 as key", "6 as part")
    for piece in (2, 99):
        got = [tuple(r) for r in fill_middle.fill_in_middle(df, piece=piece).collect()]
        assert sorted(got, key=repr) == sorted(((k, *plain(k, t)) for k, t in rows), key=repr)
    assert fill_middle.fill_in_middle(df.where(F.lit(False))).collect() == []
    long = "word " * 200_000 + "end"
    one = fill_middle.fill_in_middle(spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in one) == [(k, *plain(k, long)) for k in (1, 2)]
