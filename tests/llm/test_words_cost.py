"""Cutting texts into words, most of which are seen once."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa

from geoloom.llm import brown_lm


def test_rare_words_cost_no_more_than_a_plain_count():
    rng = random.Random(3)
    words = [f"{rng.getrandbits(rng.randrange(8, 40)):x}{'aéß'[i % 3]}" for i in range(400_000)]
    texts = [" ".join(words[at : at + 400]) for at in range(0, len(words), 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

    def spent(run):
        start = time.process_time()
        out = run()
        return time.process_time() - start, out

    plain, counts = spent(lambda: Counter(w for t in texts for w in t.encode().lower().split()))
    own, out = spent(lambda: list(brown_lm._count_words(iter([batch]))))
    n = np.concatenate([b.column(b.schema.names.index("n")).to_numpy() for b in out])
    assert Counter(n.tolist()) == Counter(counts.values()) + Counter([len(texts)])
    assert own < plain


def test_words_of_odd_texts():
    rng = random.Random(4)
    parts = [*"abAB zZ\t\n\x0b\x0c\r   \0\u0085 é日🙂ß\x1c", "a\0", "w" * 9, "é" * 40, "Q" * 63, "Q" * 64, "Q" * 200]
    texts = [*("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)), *[None, ""] * 5]
    rng.shuffle(texts)
    hashes = {}
    for column in (pa.array(texts), pa.array(texts).slice(5, 2000), pa.array(texts, pa.large_string()), pa.array(["", None, ""]), pa.array([], pa.string())):
        own, want = brown_lm.Words(column), [w for t in column.to_pylist() for w in [*(t or "").encode().lower().split(), None]]
        assert own.is_end.tolist() == [w is None for w in want] and own.ends.tolist() == [i + 1 for i, w in enumerate(want) if w is None]
        for w, h in zip(want, own.hashes.tolist()):
            assert hashes.setdefault(w, h) == h
        at = np.flatnonzero(~own.is_end)
        assert own.groups(at).tolist() == [brown_lm.group_of(want[i]) for i in at]
    assert len(set(hashes.values())) == len(hashes)
    assert all(brown_lm.Words()._hash(w) == h for w, h in hashes.items() if w is not None)
