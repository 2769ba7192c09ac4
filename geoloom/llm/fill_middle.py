"""Fill-in-the-middle: a text is cut at two token borders by hashes of its id and put together anew.

A token is a run of non-spaces with the white space before it; white space at the end of a text is a token of its
own. An automaton of three states reads a text: nothing read since the last token (``FRESH``), white space read
(``GAP``), a word read (``WORD``). A white space met in a word ends a token, and so does the end of a text in any
state but ``FRESH``.

Texts are scanned in pieces, each by itself: a piece gives its transition function, the state it leaves for each
state it may be entered in, and how many tokens end in it for each. Functions compose associatively, so
the entry state of every piece and the number of tokens before it follow without reading texts again.
A cut is then looked up in the one piece that holds it. A text of at most ``PIECE`` bytes is one piece, whose entry
state is known, and is cut where it is read; pieces of longer ones are dealt over all tasks, and only
the functions and cuts of a text, never its pieces, are brought together before the output row is made.

Null text: as the empty text. Null id: the hash is that of the seed and nothing. Rows that repeat or share an id are
cut alike and each by itself. An empty table gives an empty result. Of the columns of the input only the id is kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, slices

FRESH, GAP, WORD = range(3)
PIECE = 1 << 16
SEED, RATE, SPM_RATE = 42, 50, 80
#: What marks the parts in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RESULT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_RESULT_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (and the last ends)."""
    raw = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all."""
    return np.concatenate([[0], np.cumsum(flags)])


def scan(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces that lie one after the other: (states that each is left in, tokens that end in it), by entry state."""
    size = np.diff(starts)
    space = _SPACE[data]
    ends = _before(space[1:] & ~space[:-1])  # at a white space after a word, both in the data
    last = np.maximum(starts[1:] - 1, starts[:-1])
    inside = np.where(size > 0, ends[np.minimum(last, len(ends) - 1)] - ends[np.minimum(starts[:-1], len(ends) - 1)], 0)
    padded = np.append(space, True)
    left = np.where(padded[last], GAP, WORD)
    states = np.where((size > 0)[:, None], left[:, None], np.arange(3))
    opened = (size > 0) & padded[starts[:-1]]
    return states, np.column_stack([inside, inside, inside + opened])


def token_ends(data: np.ndarray, entry: int) -> np.ndarray:
    """Where tokens end in one piece that is entered in a state."""
    space = _SPACE[data]
    before = np.concatenate([[entry != WORD], space[:-1]])[: len(space)]
    return np.flatnonzero(space & ~before)


def _cut_columns(seed: int, id_col: str) -> list[Column]:
    """h1 to h4, from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"__h{i + 1}") for i in range(4)]


def _form(h3: Column, h4: Column, plain: Column, rate: int, spm_rate: int) -> Column:
    return F.when(plain | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")


def _is_plain(text: Column) -> Column:
    return (F.octet_length(text) == 0) | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def _arranged(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    p, s, m = PREFIX.encode() + prefix, SUFFIX.encode() + suffix, MIDDLE.encode() + middle
    return p + s + m if form == "psm" else s + p + m


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id, text, h1, h2, form): the result of texts that are one piece each."""
    for large in batches:
        for batch in slices(large, 1, 4 << 20):
            data, starts = _bytes_of(batch.column(1))
            states, counts = scan(data, starts)
            rows = np.arange(len(starts) - 1)
            n = counts[rows, FRESH] + (states[rows, FRESH] != FRESH)
            space = _SPACE[data]
            ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            ends = ends[~np.isin(ends, starts)]
            first = np.searchsorted(ends, starts[:-1])
            chars = _before((data & 0xC0) != 0x80)
            cuts = []
            for h in (2, 3):
                k = batch.column(h).to_numpy() % (n + 1)
                inner = np.minimum(first + np.maximum(k, 1) - 1, max(len(ends) - 1, 0))
                cuts.append(np.where(k == 0, starts[:-1], np.where(k == n, starts[1:], ends[inner] if len(ends) else 0)))
            low, high = np.minimum(*cuts), np.maximum(*cuts)
            forms = batch.column(4).to_pylist()
            plain = np.array([f == "plain" for f in forms], bool)
            raw = data.tobytes()
            spans = zip(starts[:-1].tolist(), low.tolist(), high.tolist(), starts[1:].tolist(), forms)
            made = [raw[a:d] if f == "plain" else _arranged(raw[a:b], raw[b:c], raw[c:d], f) for a, b, c, d, f in spans]
            columns = [n, forms, chars[low] - chars[starts[:-1]], chars[high] - chars[low]]
            arrays = [pa.array(c, t, mask=plain if i > 1 else None) for i, (c, t) in enumerate(zip(columns, _RESULT_TYPES))]
            out = pa.array(made, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, out], names=["id", *_RESULT.replace(" bigint", "").replace(" string", "").split(", ")])


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(key, part, piece) of rows (key, text): pieces of about ``size`` bytes, cut between characters."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
            cuts = [0]
            while cuts[-1] < len(data):
                at = min(cuts[-1] + size, len(data))
                while at < len(data) and data[at] & 0xC0 == 0x80:
                    at += 1
                cuts.append(at)
            for part in range(len(cuts) - 1):
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array([key], pa.int64()), "part": pa.array([part], pa.int32()), "piece": pa.array([data[cuts[part] : cuts[part + 1]].tobytes()], pa.binary()).cast(pa.string())}
                )


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, states, counts, chars) of each piece."""
    for whole in batches:
        for batch in slices(whole, 2, 4 << 20):
            data, starts = _bytes_of(batch.column(2))
            states, counts = scan(data, starts)
            chars = _before((data & 0xC0) != 0x80)
            lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 3), pa.int32()), pa.array(x.ravel(), t))
            made = [lists(states, pa.int32()), lists(counts, pa.int64()), pa.array(chars[starts[1:]] - chars[starts[:-1]], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["key", "part", "states", "counts", "chars"])


def composed(functions: DataFrame) -> DataFrame:
    """(key, n, parts): the tokens of each text, and for its pieces in order the entry state and the tokens and characters before them."""
    parts = functions.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "states", "counts", "chars"))).alias("parts"))
    start = F.struct(F.lit(FRESH).alias("state"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("chars"), F.array().cast("array<struct<part:int,state:int,tokens:bigint,chars:bigint,own:bigint>>").alias("parts"))

    def step(done: Column, own: Column) -> Column:
        count = F.element_at(own["counts"], done["state"] + 1)
        met = F.struct(own["part"].alias("part"), done["state"].alias("state"), done["tokens"].alias("tokens"), done["chars"].alias("chars"), count.alias("own"))
        return F.struct(
            F.element_at(own["states"], done["state"] + 1).alias("state"), (done["tokens"] + count).alias("tokens"), (done["chars"] + own["chars"]).alias("chars"),
            F.concat(done["parts"], F.array(met)).alias("parts"),
        )

    whole = parts.select("key", F.aggregate("parts", start, step).alias("all"))
    n = F.col("all.tokens") + (F.col("all.state") != FRESH).cast("bigint")
    return whole.select("key", n.alias("n"), F.col("all.chars").alias("chars"), F.col("all.parts").alias("parts"))


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, side, part, at, chars) of rows (key, part, piece, cuts): where in a piece its cuts fall."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    for batch in batches:
        out: list[list] = [[] for _ in kinds]
        for key, part, piece, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            data = np.frombuffer(piece.as_py().encode(), np.uint8)
            for cut in cuts:
                at = int(token_ends(data, cut["state"])[cut["local"] - 1]) if cut["local"] else (len(data) if cut["whole"] else 0)
                found = (key, cut["side"], part, at, cut["chars"] + int(np.count_nonzero((data[:at] & 0xC0) != 0x80)))
                for column, value in zip(out, found):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["key", "side", "part", "at", "chars"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, part, segment) of rows (key, part, piece, cuts): a piece's bytes by prefix (0), middle (1), suffix (2)."""
    for batch in batches:
        for key, part, piece, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            raw = piece.as_py().encode()
            low, high = ((len(raw) if part < c["part"] else (c["at"] if part == c["part"] else 0)) for c in cuts)
            segments = (raw[:low], raw[low:high], raw[high:])
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array([key] * 3, pa.int64()), "place": pa.array([0, 1, 2], pa.int32()), "part": pa.array([part] * 3, pa.int32()), "segment": pa.array(segments, pa.binary()).cast(pa.string())}
            )


def _holds(k: Column, part: Column) -> Column:
    """Whether the k-th token ends in a piece."""
    return (part["tokens"] < k) & (k <= part["tokens"] + part["own"])


def _in_pieces(rows: DataFrame, size: int) -> DataFrame:
    """The result of rows (id, text, h1, h2, form) whose texts are scanned in pieces."""
    id_type = rows.schema["id"].dataType.simpleString()
    keyed = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "long-texts")
    # dealt by piece, so that one text's are scanned by many tasks
    pieces = materialize(keyed.select("key", "text").mapInArrow(lambda b: _pieces(b, size), "key bigint, part int, piece string").repartition("key", "part"), "pieces")
    scanned = composed(pieces.mapInArrow(_functions, "key bigint, part int, states array<int>, counts array<bigint>, chars bigint"))
    about = materialize(keyed.select("key", "id", "__h1", "__h2", "form").join(scanned, "key"), "scans")
    cuts = []
    for side, h in enumerate(("__h1", "__h2")):
        k = F.col(h) % (F.col("n") + 1)
        # the piece in which the k-th token ends, else the text's very beginning or end
        holds = F.filter("parts", functools.partial(_holds, k))
        held = (F.size(holds) > 0) & (k > 0)
        part = F.when(held, F.element_at(holds, 1)).when(k == 0, F.element_at("parts", 1)).otherwise(F.element_at("parts", -1))
        local = F.when(held, k - part["tokens"]).otherwise(0)
        cuts.append(F.struct(F.lit(side).alias("side"), part["part"].alias("part"), part["state"].alias("state"), local.alias("local"), (k > 0).alias("whole"), part["chars"].alias("chars")))
    targets = about.select("key", F.explode(F.array(*cuts)).alias("cut")).groupBy("key", F.col("cut.part").alias("part")).agg(F.collect_list("cut").alias("cuts"))
    found = pieces.join(targets, ["key", "part"]).select("key", "part", "piece", "cuts").mapInArrow(_looked_up, "key bigint, side int, part int, at bigint, chars bigint")
    placed = materialize(found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("part", "at", "chars"))).alias("cuts")), "cuts")
    parts = pieces.join(placed, "key").select("key", "part", "piece", "cuts").mapInArrow(_segments, "key bigint, place int, part int, segment string")
    joined = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "part", "segment"))).alias("all"))
    of = lambda place: F.array_join(F.transform(F.filter("all", lambda s: s["place"] == place), lambda s: s["segment"]), "")
    prefix, middle, suffix = (F.concat(F.lit(mark), of(place)) for mark, place in ((PREFIX, 0), (MIDDLE, 1), (SUFFIX, 2)))
    whole = F.array_join(F.transform("all", lambda s: s["segment"]), "")
    output = F.when(F.col("form") == "plain", whole).when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).otherwise(F.concat(suffix, prefix, middle))
    made = joined.join(about.select("key", "id", "form", "n"), "key").join(placed, "key")
    chars = lambda value: F.when(F.col("form") != "plain", value)
    first, second = F.col("cuts")[0]["chars"], F.col("cuts")[1]["chars"]
    return made.select(F.col("id").cast(id_type).alias("id"), "n", "form", chars(first).alias("prefix_chars"), chars(second - first).alias("middle_chars"), output.alias("output"))


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, piece: int = PIECE
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): the tokens of each text, ``plain``, ``psm`` or ``spm``, how
    many code points the prefix and the middle have (null if plain) and the text in that form.

    ``rate`` of a hundred texts are transformed, and of these ``spm_rate`` of a hundred have the suffix first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), *_cut_columns(seed, id_col))
    form = _form(F.col("__h3"), F.col("__h4"), _is_plain(F.col("text")), rate, spm_rate)
    rows = rows.select("id", "text", "__h1", "__h2", form.alias("form"))
    small = rows.where(F.octet_length("text") <= piece)
    done = small.mapInArrow(_whole, f"id {rows.schema['id'].dataType.simpleString()}, {_RESULT}")
    return done.unionAll(_in_pieces(rows.where(F.octet_length("text") > piece), piece)).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of a form was made of."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(F.concat(parts[2], parts[3], parts[1]))
