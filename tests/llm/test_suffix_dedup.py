"""Repeated strings against a plain search of all windows."""

import random

import numpy as np
import pytest

from geoloom.llm import suffix_dedup

DOCS = "doc_id long, text string"


def plain(rows, length=100):
    """{(id, text): (kept bytes, runs)} of rows with distinct ids."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        out[key] = (bytes(b for b, g in zip(raw, gone) if not g), [tuple(e) for e in edges.reshape(-1, 2).tolist()])
    return out


def text(rng, n):
    return "".join(rng.choice("abc é") for _ in range(n))


def copies(seed, n=60):
    """Texts that share passages, with edits, inside and across documents."""
    rng = random.Random(seed)
    passages = [text(rng, rng.randint(60, 400)) for _ in range(6)] + ["ab" * 150, "x" * 260]
    rows = []
    for key in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(passages) if rng.random() < 0.7 else text(rng, rng.randint(1, 300))
            for _ in range(rng.randint(0, 2)):
                at = rng.randint(0, len(part))
                part = part[:at] + rng.choice(["", "Z", "~~"]) + part[at + rng.randint(0, 2) :]
            parts.append(part)
        rows.append((key * 7 % 61, "".join(parts) if rng.random() < 0.95 else None))
    return rows


def found(spark, rows, **options):
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, DOCS), **options).collect()
    return {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.removed]) for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_search(spark, seed):
    rows = copies(seed)
    assert found(spark, rows) == plain(rows)


def test_frequent_grams_are_cut_into_windows(spark):
    rows = copies(3)
    assert found(spark, rows, hot=2) == plain(rows)


def test_segments_of_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    passage = text(rng, 900)
    rows = [(1, text(rng, 1500) + passage + text(rng, 700) + passage), (2, passage), (3, "")]
    made = suffix_dedup.spans_of(np.frombuffer(rows[0][1].encode(), np.uint8), np.array([0, len(rows[0][1].encode())]), 100)
    windows = made[2] - made[1] - 99
    assert windows.sum() == len(rows[0][1].encode()) - 99 and (made[4] >= 0).all()
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "SEGMENT", 512)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([rows[0][1]])], names=["doc", "text"])
    parts = list(suffix_dedup._segments(iter([batch]), 100))
    assert sum(len(p[1]) - 99 for p in parts) == len(rows[0][1].encode()) - 99
    cut = [b for b in suffix_dedup._cut(iter([batch]), 100)]
    starts = np.concatenate([b.column(1).to_numpy() for b in cut if b.column(3).null_count == 0])
    assert starts.max() > 512


def test_odd_rows(spark):
    rng = random.Random(6)
    base = text(rng, 300)
    rows = [(5, base), (5, base), (None, base), (None, None), (6, ""), (7, "short"), (4, base[:150])]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as start", "2 as stop", "3 as gram", "4 as doc", "5 as kept", "6 as removed")
    got = sorted(((r.doc_id is None, r.doc_id or 0, len(r.kept), len(r.removed)) for r in suffix_dedup.deduplicated(df).collect()))
    n, first = len(base.encode()), len(base[:150].encode())
    assert got == sorted([(False, 4, first, 0), (False, 5, n - first, 1), (False, 5, 0, 1), (True, 0, 0, 1), (True, 0, 0, 0), (False, 6, 0, 0), (False, 7, 5, 0)])
    assert suffix_dedup.deduplicated(df.limit(0)).collect() == []


def test_collided_hashes_are_seen(monkeypatch):
    """With hashes that say all is equal the order fails its byte check; a right base is taken next."""
    rng = random.Random(7)
    raws = [bytes(rng.choice(b"ab") for _ in range(160)) for _ in range(40)]
    want = suffix_dedup.repeated_windows(raws, np.full(40, 30), np.zeros(40, np.int64), 100)
    true = suffix_dedup.PrefixHashes

    class Weak(true):
        def of(self, start, stop):
            return super().of(start, stop) if self.strong else np.zeros(len(start), np.uint64)

        def __init__(self, data, base):
            super().__init__(data, base)
            self.strong = base != suffix_dedup.BASES[0]

    monkeypatch.setattr(suffix_dedup, "PrefixHashes", Weak)
    assert (suffix_dedup.repeated_windows(raws, np.full(40, 30), np.zeros(40, np.int64), 100) == want).all()


def test_suffix_order_is_the_plain_one():
    rng = random.Random(8)
    data = bytes(rng.choice(b"ab") for _ in range(500))
    at = np.array([rng.randrange(450) for _ in range(80)])
    size = np.array([rng.randint(0, 50) for _ in at])
    group = np.array([rng.randrange(4) for _ in at])
    made = suffix_dedup.SuffixOrder(np.frombuffer(data, np.uint8), at, size, group)
    suffix = lambda i: data[at[i] : at[i] + size[i]]
    assert made.order.tolist() == sorted(range(80), key=lambda i: (group[i], suffix(i), i))
    for previous, own, common in zip(made.order, made.order[1:], made.common[1:]):
        a, b = suffix(previous), suffix(own)
        same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert common == (same if group[previous] == group[own] else 0)
