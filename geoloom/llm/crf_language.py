"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes (1 to 3 characters), its character 2- and 3-grams and the
word itself (the lexicon), hashed into ``1 << HASH_BITS`` weights
for each label. Labels are the languages; transition weights are learned with them. Training
maximises the conditional likelihood by forward-backward on all runs of ``LENGTH`` words of the sampled texts, of
which a part is spliced from two runs, so that transitions between languages occur.

The sample is at most ``SAMPLE`` rows of each language (those of the smallest hashes of id and text;
equal rows count once); of these, whole texts are read, and the words of a text of more than ``FULL`` runs weigh
as much together as those of ``FULL`` runs, so that a few very long texts do not outweigh the others. An epoch trains ``SHARDS`` parts of it side
by side, each from the same weights, and each weight goes on with the mean of the parts that changed it (after McDonald, Hall
and Mann 2010), so no text leaves the executors.

Prediction labels every word of every document: chains are runs of ``LENGTH`` words, the
posteriors of forward-backward are summed over the document, and the label with most of it is
the document's language; its share is the score. ``spans`` gives the words' own labels.

A text that is null or has no letter is ``und`` with score 0. Words without a letter have no
features and follow their neighbours. With no labelled text at all, everything is ``und``. Rows without text or
language are not learnt from. Long texts are read whole. Repeated rows, and rows that share an id, are each predicted. Ties
go to the label first in order. Columns named as the results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, mix64, slices

HASH_BITS = 17
LENGTH = 32
SAMPLE = 600
EPOCHS = 4
SHARDS = 4
PARTS = 16
BATCH, BUFFER = 128, 4096
FULL = 4
RATE = 0.3
UNKNOWN = "und"
CACHE_WORDS = 120_000
MOST = 48


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``words``, hashed feature) of all features, and whether a word has a letter.

    Words are lower-cased; those without a letter have no features.
    """
    letter = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in words), bool, len(words))
    own = np.flatnonzero(letter)
    mask = (1 << HASH_BITS) - 1
    lexicon = np.fromiter((zlib.crc32(words[i].encode("utf-8", "surrogatepass")) & mask for i in own), np.int64, len(own))
    if not len(own):
        return own, lexicon, letter
    # all words in a row, each between edge marks; a gram starts at each character
    codes = np.frombuffer("".join([f"^{words[i]}$" for i in own]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(words[i]) + 2 for i in own), np.int64, len(own))
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters from here to the word's end
    is_first = np.zeros(len(codes), bool)
    is_first[ends - lengths] = True
    word = np.repeat(own, lengths)
    places, hashes = [own], [lexicon]
    rolled = codes
    for k in (2, 3, 4):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + codes[k - 1 :]
        mixed = (mix64(rolled) & np.uint64(mask)).astype(np.int64)
        here, first = left[: len(mixed)], is_first[: len(mixed)]
        if k < 4:
            places.append(word[: len(mixed)][here >= k])
            hashes.append(mixed[here >= k])
        for salt, edge in ((0x55, first & (here >= k)), (0xAA, here == k)):  # affixes
            places.append(word[: len(mixed)][edge])
            hashes.append(mixed[edge] ^ (salt << 8 | k))
    return np.concatenate(places), np.concatenate(hashes), letter


def scores(weights: np.ndarray, place: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
    """Sums of the weights of each word's features; those of overlong words are scaled down."""
    counts = np.bincount(place, minlength=n)
    sums = np.stack([np.bincount(place, weights[hashed, k], n) for k in range(weights.shape[1])], axis=1)
    return sums / np.maximum(1.0, counts / MOST)[:, None]


def forward_backward(emission: np.ndarray, transition: np.ndarray, first: np.ndarray, real: np.ndarray, pairs: bool = True):
    """Posteriors (b, t, l) and, if asked for, expected transitions (l, l).

    ``emission`` is (b, t, l) in logarithms; places where ``real`` is false pass messages on.
    """
    b, t, n = emission.shape
    peak = emission.max(axis=2, keepdims=True)
    local = np.exp(emission - peak)
    local[~real] = 1.0
    step = np.exp(transition)
    alpha, beta, scale = np.empty((b, t, n)), np.ones((b, t, n)), np.ones((b, t))
    state = np.exp(first)[None, :] * local[:, 0]
    for i in range(t):
        if i:
            moved = state @ step
            moved[~real[:, i]] = state[~real[:, i]]
            state = moved * local[:, i]
        scale[:, i] = state.sum(axis=1)
        state = state / scale[:, i : i + 1]
        alpha[:, i] = state
    for i in range(t - 2, -1, -1):
        back = (beta[:, i + 1] * local[:, i + 1]) @ step.T
        back = np.where(real[:, i + 1 : i + 2], back, beta[:, i + 1])
        beta[:, i] = back / scale[:, i + 1 : i + 2]
    posterior = alpha * beta
    posterior /= posterior.sum(axis=2, keepdims=True)
    pair = np.zeros((n, n))
    for i in range(1, t if pairs else 1):
        use = real[:, i]
        pair += np.einsum("bi,bj->ij", alpha[use, i - 1], beta[use, i] * local[use, i] / scale[use, i : i + 1]) * step
    return posterior, pair


class Model:
    """Weights of a trained field; ``scores`` keeps those of a bounded number of words."""

    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray, first: np.ndarray) -> None:
        self.labels, self.weights, self.transition, self.first = labels, weights, transition, first
        self.known: dict[str, int] = {}
        self.rows = np.zeros((CACHE_WORDS + 1, max(1, len(labels))), np.float32)
        self.letter = np.zeros(CACHE_WORDS + 1, bool)

    def __reduce__(self):
        return Model, (self.labels, self.weights, self.transition, self.first)

    def index(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        if len(new) > CACHE_WORDS:
            raise ValueError("a call must have fewer words than the cache")
        if new:
            fresh, start = list(new), len(known) + 1
            place, hashed, letter = features(fresh)
            self.rows[start : start + len(fresh)] = scores(self.weights, place, hashed, len(fresh))
            self.letter[start : start + len(fresh)] = letter
            known.update(zip(fresh, range(start, start + len(fresh))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each word (n, labels), and whether it has a letter."""
        n = len(words)
        out, letter = np.zeros((n, len(self.labels))), np.zeros(n, bool)
        for at in range(0, n, LENGTH * 2048):
            part = self.index(words[at : at + LENGTH * 2048])
            chains = -(-len(part) // LENGTH)
            padded = np.zeros(chains * LENGTH, np.int64)
            padded[: len(part)] = part
            real = (np.arange(chains * LENGTH) < len(part)).reshape(chains, LENGTH)
            emission = self.rows[padded].astype(float).reshape(chains, LENGTH, -1)
            posterior = forward_backward(emission, self.transition, self.first, real, pairs=False)[0]
            out[at : at + len(part)] = posterior.reshape(chains * LENGTH, -1)[: len(part)]
            letter[at : at + len(part)] = self.letter[part]
        return out, letter

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; chains do not cross documents."""
        if not self.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        words, ends = [], []
        for text in texts:
            own = text.lower().split() if text else []
            own += [""] * (-len(own) % LENGTH)  # fills up the last chain; has no features
            words += own
            ends.append(len(words))
        posterior, letter = self.words(words) if words else (np.zeros((0, len(self.labels))), np.zeros(0, bool))
        weight = np.where(letter, 1.0, 0.0)
        total = np.vstack([np.zeros(len(self.labels)), np.cumsum(posterior * weight[:, None], axis=0)])
        out, start = [], 0
        for end in ends:
            mass = total[end] - total[start]
            start = end
            whole = mass.sum()
            best = int(mass.argmax()) if whole > 0.5 else -1
            out.append((self.labels[best], float(min(1.0, mass[best] / whole))) if best >= 0 else (UNKNOWN, 0.0))
        return out


class Trainer:
    """Weights, and the sums of their squared slopes, that learn from runs of words of one language."""

    def __init__(self, labels: list[str], arrays: list[np.ndarray] | None = None) -> None:
        n = max(1, len(labels))
        sizes = ((1 << HASH_BITS, n), (n, n), (n,))
        self.labels = labels
        self.arrays = arrays or [np.zeros(size, np.float32) for size in sizes] + [np.full(size, 1e-6, np.float32) for size in sizes]

    def model(self) -> Model:
        weights, transition, first = self.arrays[:3]
        return Model(self.labels, weights, transition.astype(float), first.astype(float))

    def code(self, runs: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Words as numbers, the place of each word's first feature, and all features."""
        known: dict[str, int] = {}
        coded = [np.array([known.setdefault(w, len(known)) for w in run]) for run in runs]
        place, hashed, _ = features(list(known))
        hashed = hashed[np.argsort(place, kind="stable")]
        return coded, np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(known)))]), hashed

    def learn(self, runs: list[tuple[int, list[str], float]], rng: np.random.Generator) -> None:
        """One pass over (label, words, weight), in batches of random order."""
        coded, begin, hashed = self.code([words for _, words, _ in runs])
        label, share = np.array([lang for lang, _, _ in runs]), np.array([weight for _, _, weight in runs], np.float32)
        order = rng.permutation(len(coded))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            words, gold = np.full((len(picked), LENGTH), -1, np.int64), np.zeros((len(picked), LENGTH), np.int64)
            weigh = np.repeat(share[picked][:, None], LENGTH, axis=1)
            for row, i in enumerate(picked):
                own = coded[i]
                words[row, : len(own)], gold[row] = own, label[i]
                if rng.random() < 0.3:  # code-switching: the second half is from another run
                    j = int(rng.integers(len(coded)))
                    other, cut = coded[j][: LENGTH // 2], len(own) // 2
                    words[row, cut:] = -1
                    words[row, cut : cut + len(other)] = other[: LENGTH - cut]
                    gold[row, cut:], weigh[row, cut:] = label[j], share[j]
            self.step(words, gold, weigh, begin, hashed)

    def step(self, words: np.ndarray, gold: np.ndarray, weigh: np.ndarray, begin: np.ndarray, hashed: np.ndarray) -> None:
        weights, transition, first, total, move_total, first_total = self.arrays
        real = words >= 0
        own = words[real]
        n_features = begin[own + 1] - begin[own]
        cells = hashed[np.repeat(begin[own] - np.cumsum(n_features) + n_features, n_features) + np.arange(n_features.sum())]
        scale = np.repeat(1 / np.maximum(1.0, n_features / MOST), n_features)[:, None].astype(np.float32)
        word = np.repeat(np.arange(len(own)), n_features)
        emission = np.zeros((*words.shape, weights.shape[1]))
        emission[real] = np.stack([np.bincount(word, (weights[cells, k] * scale[:, 0]), len(own)) for k in range(weights.shape[1])], axis=1)
        posterior, pair = forward_backward(emission, transition.astype(float), first.astype(float), real)
        truth = np.eye(weights.shape[1])[gold]
        slope = ((truth - posterior)[real] * weigh[real][:, None] / len(words)).astype(np.float32)
        touched, inverse = np.unique(cells, return_inverse=True)
        summed = np.stack([np.bincount(inverse, slope[word, k] * scale[:, 0], len(touched)) for k in range(weights.shape[1])], axis=1).astype(np.float32)
        total[touched] += summed**2
        weights[touched] += RATE * summed / np.sqrt(total[touched])
        follow = real[:, 1:] & real[:, :-1]
        seen = np.zeros(transition.shape)
        np.add.at(seen, (gold[:, :-1][follow], gold[:, 1:][follow]), 1)
        for value, change, sums in ((transition, (seen - pair) / len(words), move_total), (first, (truth[:, 0] - posterior[:, 0]).sum(axis=0) / len(words), first_total)):
            sums += (change**2).astype(np.float32)
            value += (0.1 * change / np.sqrt(sums)).astype(np.float32)


def _runs(batches: Iterator[pa.RecordBatch], labels: list[str]) -> Iterator[tuple[int, list[str], float]]:
    """(label, words, weight) of all runs of the rows (lang, text)."""
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = text.lower().split()
            for start in range(0, len(own), LENGTH):
                yield labels.index(lang), own[start : start + LENGTH], min(1.0, FULL * LENGTH / len(own))


def sampled(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text, at) of the rows to learn from, ``SAMPLE`` of each language at most, materialised."""
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = labelled.select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("at")).where("text is not null and lang is not null")
    # rows are ranked without their texts, in parts of a language first
    ranked = rows.select("lang", "at").distinct()
    for keys in ([F.col("lang"), F.pmod("at", F.lit(PARTS))], [F.col("lang")]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("rank") <= SAMPLE).drop("rank")
    ranked = materialize(ranked, "language-ranks")
    return materialize(rows.join(ranked, ["lang", "at"]).dropDuplicates(["lang", "at"]).select("lang", "text", "at"), "language-sample")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on a bounded sample of the rows whose text and language are not null."""
    rows = sampled(labelled, id_col, text_col, lang_col)
    context = labelled.sparkSession.sparkContext
    labels = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    trainer = Trainer(labels)
    # hashed again: the larger a language, the smaller are the hashes of its sample, and a part mixes all languages
    parts = rows.repartition(SHARDS, F.pmod("at", F.lit(SHARDS))).sortWithinPartitions(F.xxhash64(F.lit(1), "at")).select("lang", "text")
    for epoch in range(EPOCHS if labels else 0):
        shared = context.broadcast((labels, trainer.arrays))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            own = Trainer(shared.value[0], [a.copy() for a in shared.value[1]])
            rng, runs, n = np.random.default_rng(epoch), _runs(batches, own.labels), 0
            while part := list(islice(runs, BUFFER)):
                own.learn(part, rng)
                n += len(part)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([[a.tobytes() for a in own.arrays]], pa.list_(pa.binary()))], names=["arrays"])

        found = parts.mapInArrow(run, "arrays array<binary>").collect()
        if found:
            for i, start in enumerate(trainer.arrays):
                # a weight is the mean of those parts that changed it: most words are in one part only
                moved = [np.frombuffer(r["arrays"][i], np.float32).reshape(start.shape) - start for r in found]
                trainer.arrays[i] = start + sum(moved) / np.maximum(1, sum(m != 0 for m in moved)).astype(np.float32)
    return trainer.model()


def spans(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start int, end int, lang): runs of words (split at white space) with one label, of texts with a letter."""
    doc_type = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows, starts, ends, langs = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.lower().split() if text else []
                if not own.labels or not any(map(str.isalpha, text or "")):
                    continue
                best = own.words(words)[0].argmax(axis=1)
                cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(words)]
                for start, end in zip(cuts, cuts[1:]):
                    rows.append(i)
                    starts.append(start)
                    ends.append(end)
                    langs.append(own.labels[best[start]])
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(langs, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "end", "lang"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {doc_type}, start int, end int, lang string")


def predict(df: DataFrame, model: Model, text_col: str = "text", label_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``df`` with ``label_col`` string and ``score_col`` double; such columns are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kept = df.drop(label_col, score_col)
    schema = StructType([*kept.schema.fields, StructField(label_col, StringType(), False), StructField(score_col, DoubleType(), False)])
    arrow, at = to_arrow_schema(schema), kept.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, at, 1 << 20):
                found = own.documents(batch.column(at).to_pylist())
                made = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*batch.columns, *made], arrow.types)], schema=arrow)

    return kept.mapInArrow(run, schema)
