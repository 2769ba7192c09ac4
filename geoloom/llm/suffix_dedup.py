"""Removal of long byte strings that occur earlier, by a sparse suffix order compared through hashes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller
id, or in the same one further left. Matches are judged on the input and never cross documents.

1. *Cut.* Each window of ``length`` bytes is owned by one of the grams (``GRAM_SHARE`` of its length) inside
   it: the one of smallest hash, the leftmost of several. Equal windows have equal owners at equal places, so
   only windows of one gram need to meet, and one row stands for a run of windows, its span (a row for
   about thirty bytes). Equal spans of a chunk of texts are one row before any shuffle.
2. *Meet.* Spans are sorted by range of (gram, digest of their bytes), so a frequent gram is spread over tasks.
   A span that is not the first of its bytes is removed whole; first spans of a gram with several go on.
3. *Order.* Their bytes are fetched and dealt by gram. Inside a gram the suffixes that start at it, and the
   reversed prefixes that end at it, are merge-sorted: two of them are compared by binary search for their common
   extension over prefix polynomial hashes, in a logarithmic number of steps. The common extensions of neighbours
   give, for each place of a window, classes of equal windows, of which all but the first are removed.
   Sorted neighbours are verified byte by byte; should hashes have collided, the sort is done again with another base.
   Spans whose whole bytes are equal in 2 are told by two unrelated 64-bit hashes, of gram and span.
4. Grams with more than ``HOT`` different spans are not gathered: each of their windows becomes a span and
   a gram of its own, and step 2 decides.
5. *Remove.* The removed stretches of a document are joined to its text.

Texts are handled whole, in segments of bounded size. Null and empty texts, and those shorter than ``length``, lose
nothing. Null ids come after all others; rows that share an id are in order of a hash of their text and count as
documents of their own. An empty table gives an empty result. Columns named as the results are replaced, others kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from ._shared import discard, materialize, mix64, slices

LENGTH = 100
#: A gram has this share of the window's bytes.
GRAM_SHARE = 0.4
#: More different spans of one gram than this are not sorted in one task.
HOT = 4096
#: Bytes of text handled at once; spans sorted at once (whole grams).
SEGMENT = 4 << 20
SORTED_AT_ONCE = 8192
#: Odd bases of the polynomial hashes, tried in turn.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)

_SPAN = "doc bigint, start int, stop int, gram bigint, body bigint, lead int"
_SPAN_NAMES = ["doc", "start", "stop", "gram", "body", "lead"]
_SPAN_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0.. and its inverses, modulo 2**64; at least ``n`` of them."""
    found = _POWERS.get(base)
    if found is None or len(found[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        found = _POWERS[base] = (both[0], both[1])
    return found


class PrefixHashes:
    """Hashes of all stretches of a byte array in constant time: prefix sums of value * base**place."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]) -> None:
        power, self.inverse = _powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * power[: len(data)], out=self.sums[1:])

    def runs(self, size: int) -> np.ndarray:
        """The hash of each stretch of ``size`` bytes, by its start."""
        return (self.sums[size:] - self.sums[: len(self.sums) - size]) * self.inverse[: len(self.sums) - size]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    rest = size - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def spans_of(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(segment, start, stop, gram, lead) of the spans of the segments that begin at ``starts`` (and the end of
    ``data``): places in ``data``, hashes of their grams and how far these are from the start."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    size = max(1, int(length * GRAM_SHARE))
    grams = mix64(PrefixHashes(data).runs(size))
    place = np.arange(len(grams), dtype=np.uint64)
    high = np.uint64(0xFFFFFFFF00000000)
    owner = (_sliding_min((grams & high) | place, length - size + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(starts)
    windows = np.maximum(sizes - length + 1, 0)
    segment = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts[:-1], windows)
    if not len(at):
        return none, none, none, none, none
    owner = owner[at]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return segment[first], at[first], at[last] + length, grams[owner[first]].view(np.int64), owner[first] - at[first]


def _rows(*columns) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, _SPAN_TYPES)], names=_SPAN_NAMES)


def _stretches(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Removed stretches, those of a document that touch as one; stops rise with starts."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])])) if len(doc) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(doc)]]).astype(np.int64) - 1 if len(doc) else first
    return _rows(doc[first], start[first], stop[last], None, None, None)


def _first_of_chunk(doc, start, stop, gram, body, lead) -> Iterator[pa.RecordBatch]:
    """The first span of each (gram, body) as a row; the others are removed stretches."""
    order = np.lexsort((start, doc, body, gram))
    again = np.concatenate([[False], (gram[order][1:] == gram[order][:-1]) & (body[order][1:] == body[order][:-1])])
    new, old = order[~again], order[again]
    yield _rows(*(c[new] for c in (doc, start, stop, gram, body, lead)))
    if len(old):
        yield _stretches(doc[old], start[old], stop[old])


def _segments(batches: Iterator[pa.RecordBatch], length: int, at: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, data, starts, row, base): the texts of some rows as bytes; a text beyond ``SEGMENT`` comes
    in several segments that overlap by a window less one byte. ``base`` is a segment's place in its text."""
    for whole in batches:
        for batch in slices(whole, at, SEGMENT):
            texts = batch.column(at).fill_null("").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            if len(texts) > 1 or len(data) <= 2 * SEGMENT:
                yield batch, data, offsets, np.arange(len(texts)), np.zeros(len(texts), np.int64)
                continue
            for base in range(0, len(data), SEGMENT):
                part = data[base : base + SEGMENT + length - 1]
                yield batch, part, np.array([0, len(part)]), np.array([0]), np.array([base])


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of rows (doc, text)."""
    import xxhash

    for batch, data, starts, row, base in _segments(batches, length):
        segment, start, stop, gram, lead = spans_of(data, starts, length)
        if not len(segment):
            continue
        view, digest = memoryview(data), xxhash.xxh3_64_intdigest
        body = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist())), np.uint64, len(start)).view(np.int64)
        doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[row[segment]]
        shift = base[segment] - starts[segment]
        yield from _first_of_chunk(doc, start + shift, stop + shift, gram, body, lead)


def _met(batches: Iterator[pa.RecordBatch], alone: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (gram, body, doc, start): removed stretches, and with ``alone`` off the first
    spans of grams that have several, or may have them beyond the ends of this range."""
    state: dict = {"gram": None, "body": None, "multi": True, "held": None}
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, start, stop, gram, body, lead = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        same = np.concatenate([[gram[0] == state["gram"] and body[0] == state["body"]], (gram[1:] == gram[:-1]) & (body[1:] == body[:-1])])
        if same.any():
            yield _stretches(doc[same], start[same], stop[same])
        state["gram"], state["body"] = gram[-1], body[-1]
        if alone or same.all():
            continue
        # the last first span waits until it is known whether its gram has another
        own = [c[~same] for c in (doc, start, stop, gram, body, lead)]
        if state["held"] is not None:
            own = [np.concatenate([h, c]) for h, c in zip(state["held"], own)]
        linked = own[3][1:] == own[3][:-1]
        several = np.concatenate([[state["multi"]], linked]) | np.concatenate([linked, [False]])
        state["multi"], state["held"] = bool(several[-1]), [c[-1:] for c in own]
        out = several[:-1]
        if out.any():
            yield _rows(*(c[:-1][out] for c in own))
    if state["held"] is not None:
        yield _rows(*state["held"])


def _meet(spans: DataFrame, alone: bool = False) -> DataFrame:
    ranges = spans.where("gram is not null").repartitionByRange("gram", "body").sortWithinPartitions("gram", "body", "doc", "start")
    return ranges.mapInArrow(lambda batches: _met(batches, alone), _SPAN)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text, spans) of the documents of ``wanted`` spans; a document's list is no longer than its text."""
    lists = wanted.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "gram", "lead"))).alias("spans"))
    return docs.join(lists, "doc").select("doc", "text", "spans")


def _span_columns(spans: pa.ListScalar) -> list[np.ndarray]:
    return [spans.values.field(i).to_numpy(zero_copy_only=False) for i in range(4)]


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc, start, lead, bytes) of each span of rows (doc, text, spans)."""
    for whole in batches:
        for batch in slices(whole, 1, SEGMENT):
            out: list[list] = [[], [], [], [], []]
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                start, stop, gram, lead = _span_columns(spans)
                out[0].append(gram)
                out[1].append(np.full(len(gram), doc, np.int64))
                out[2].append(start)
                out[3].append(lead)
                out[4] += [raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]
            arrays = [pa.array(np.concatenate(c), t) for c, t in zip(out[:4], (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out[4], pa.binary())], names=["gram", "doc", "start", "lead", "raw"])


def _cut_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each window of the spans of rows (doc, text, spans) as a span and a gram of its own."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for whole in batches:
        for batch in slices(whole, 1, SEGMENT):
            docs, starts, grams, bodies = [], [], [], []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                start, stop, *_ = _span_columns(spans)
                windows = stop - start - length + 1
                at = np.repeat(start - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
                docs.append(np.full(len(at), doc, np.int64))
                starts.append(at)
                grams.append(np.fromiter((digest(raw[p : p + length]) for p in at.tolist()), np.uint64, len(at)))
                low = int(at.min())
                part = np.frombuffer(raw, np.uint8, int(at.max()) + length - low, low)
                bodies.append(mix64(PrefixHashes(part, BASES[1]).of(at - low, at - low + length)))
            doc, start = np.concatenate(docs), np.concatenate(starts).astype(np.int64)
            gram, body = np.concatenate(grams).view(np.int64), np.concatenate(bodies).view(np.int64)
            yield from _first_of_chunk(doc, start, start + length, gram, body, np.zeros(len(doc), np.int64))


class SuffixOrder:
    """The order of suffixes of ``data`` that begin at ``at`` and have ``size`` bytes, inside groups.

    ``order`` lists them by group and bytes (a prefix before what it begins; equals in the order given),
    ``common`` the bytes that each shares with the one before it in its group (0 for a group's first).
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> None:
        self.data, self.at, self.size = np.append(data, np.uint8(0)), at, size
        self.steps = [1 << s for s in range(int(size.max(initial=0)).bit_length() - 1, -1, -1)]
        for base in BASES:
            self.hashes = PrefixHashes(data, base)
            self.order = self._merge_sorted(group)
            before, after = self.order[:-1], self.order[1:]
            self.common = np.where(group[before] == group[after], self.extension(before, after), 0)
            if self._verified(before, after, group[before] == group[after]):
                self.common = np.concatenate([[0], self.common])[: len(at)]
                return
        raise ArithmeticError("hashes collided with every base")

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many bytes two suffixes share, by binary search over their prefix hashes."""
        most, found = np.minimum(self.size[x], self.size[y]), np.zeros(len(x), np.int64)
        a, b = self.at[x], self.at[y]
        for step in self.steps:
            fits = np.flatnonzero(found + step <= most)
            if len(fits):
                p, q = a[fits] + found[fits], b[fits] + found[fits]
                found[fits] += step * (self.hashes.of(p, p + step) == self.hashes.of(q, q + step))
        return found

    def less(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix x comes before y, and whether they are equal."""
        common = self.extension(x, y)
        end_x, end_y = common == self.size[x], common == self.size[y]
        byte = self.data[self.at[x] + np.where(end_x, 0, common)] < self.data[self.at[y] + np.where(end_y, 0, common)]
        return np.where(end_x | end_y, end_x & ~end_y, byte), end_x & end_y

    def _merge_sorted(self, group: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort of all groups at once: in a round each element finds by binary search how many of the sibling run come before it."""
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0])) if len(order) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([first, [len(order)]]))
        begin, total = np.repeat(first, count), np.repeat(count, count)
        width = 1
        while width < count.max(initial=0):
            place = np.flatnonzero(total > width)
            start, n = begin[place], total[place]
            own = place - start
            run = own // width
            left = run % 2 == 0
            other = (run ^ 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            base, element = low.copy(), order[place]
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) // 2
                x, y = order[start[open_] + middle], element[open_]
                before, equal = self.less(x, y)
                before |= equal & ~left[open_]  # equals keep their order
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            merged = order.copy()
            merged[start + (run & ~1) * width + own % width + (low - base)] = element
            order, width = merged, 2 * width
        return order

    def _verified(self, before: np.ndarray, after: np.ndarray, grouped: np.ndarray) -> bool:
        """Whether neighbours share exactly the bytes that the hashes say and stand in order."""
        x, y, common = before[grouped], after[grouped], self.common[grouped]
        step = np.arange(common.sum()) - np.repeat(np.cumsum(common) - common, common)
        if (self.data[np.repeat(self.at[x], common) + step] != self.data[np.repeat(self.at[y], common) + step]).any():
            return False
        end_x, end_y = common == self.size[x], common == self.size[y]
        rises = self.data[self.at[x] + np.where(end_x, 0, common)] < self.data[self.at[y] + np.where(end_y, 0, common)]
        return bool((end_x | (~end_y & rises)).all())


def repeated_windows(raws: list[bytes], lead: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """(spans, windows) booleans: whether a window of a span, by its distance left of the gram, also is in an
    earlier span of its group. ``lead`` is the gram's place in each span."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    data = np.frombuffer(b"".join(raws), np.uint8)
    offset = np.cumsum(sizes) - sizes
    anchor = offset + lead
    right = sizes - lead
    onward = SuffixOrder(data, anchor, right, group)
    backward = SuffixOrder(data[::-1], len(data) - anchor, lead, group)
    out = np.zeros((len(raws), int(lead.max(initial=0)) + 1), bool)
    rank = np.zeros((2, len(raws)), np.int64)
    for left in range(out.shape[1]):
        for side, (made, depth) in enumerate(((onward, length - left), (backward, left))):
            # at depth 0 all suffixes are alike; groups are told apart by the other side
            rank[side, made.order] = np.cumsum(made.common < depth)
        own = np.flatnonzero((left <= lead) & (right >= length - left))
        if len(own):
            key = rank[0, own] * (len(raws) + 1) + rank[1, own]
            again = np.ones(len(own), bool)
            again[np.unique(key, return_index=True)[1]] = False
            out[own[again], left] = True
    return out


def _sorted_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Removed stretches of rows (gram, doc, start, lead, raw) sorted by (gram, doc, start)."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        gram, doc, start, lead = (rows.column(i).to_numpy().astype(np.int64) for i in range(4))
        found = repeated_windows(rows.column(4).to_pylist(), lead, gram, length)
        span, left = np.nonzero(found)
        at = start[span] + lead[span] - left
        return _stretches(doc[span], at, at + length)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SORTED_AT_ONCE:
            rows = pa.Table.from_batches(held)
            gram = rows.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1], side="left"))  # the last gram may go on
            if cut:
                yield done(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield done(pa.Table.from_batches(held))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with ``__doc``: the id where ids are distinct numbers, else a row's place in order of id (null last) and a hash of its text."""
    integral = df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if integral and df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 or `{id_col}` is null").isEmpty():
        return df.withColumn("__doc", F.col(id_col).cast("bigint"))
    order = [F.col(id_col).asc_nulls_last(), F.xxhash64(text_col)]
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__doc", F.monotonically_increasing_id()), "numbered")


def _removed(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """(doc, start, stop): removed stretches of documents (doc, text), which may overlap."""
    spans = materialize(docs.mapInArrow(lambda batches: _cut(batches, length), _SPAN), "spans")
    met = materialize(spans.where("gram is null").unionAll(_meet(spans)), "met-spans")
    discard(spans)
    found = [met.where("gram is null").select("doc", "start", "stop")]
    first = met.where("gram is not null")
    counts = first.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = materialize(first.join(counts, "gram").select(*_SPAN_NAMES, "n"), "several-spans")
    fetched = _texts_of(docs, several.where(F.col("n") <= hot)).mapInArrow(_fetch, "gram bigint, doc bigint, start int, lead int, raw binary")
    dealt = fetched.repartition("gram").sortWithinPartitions("gram", "doc", "start")
    found.append(materialize(dealt.mapInArrow(lambda batches: _sorted_out(batches, length), _SPAN).select("doc", "start", "stop"), "sorted-spans"))
    many = several.where(F.col("n") > hot)
    if not many.isEmpty():
        windows = materialize(_texts_of(docs, many).mapInArrow(lambda batches: _cut_windows(batches, length), _SPAN), "windows")
        found.append(materialize(windows.where("gram is null").unionAll(_meet(windows, alone=True)).select("doc", "start", "stop"), "met-windows"))
        discard(windows)
    discard(several)
    return functools.reduce(DataFrame.unionAll, found)


def _kept(batches: Iterator[pa.RecordBatch], text_at: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their last column, the stretches, merged, and what is left of the text."""
    pair = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    for whole in batches:
        for batch in slices(whole, text_at, SEGMENT):
            kept, counts, starts, stops = [], [], [], []
            for text, found in zip(batch.column(text_at), batch.column(batch.num_columns - 1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                own_starts, own_stops = np.zeros(0, np.int32), np.zeros(0, np.int32)
                if found.is_valid and len(found):
                    start, stop = (found.values.field(i).to_numpy() for i in range(2))
                    reach = np.maximum.accumulate(stop)
                    new = np.concatenate([[True], start[1:] > reach[:-1]])
                    own_starts, own_stops = start[new], reach[np.concatenate([new[1:], [True]])]
                edges = [0, *np.column_stack([own_starts, own_stops]).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                counts.append(len(own_starts))
                starts.append(own_starts)
                stops.append(own_stops)
            values = pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int32()) for c in (starts, stops)], fields=list(pair))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values)
            columns = [*batch.columns[:-1], lists, pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types)], schema=arrow)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``df`` with ``removed`` array of (start, stop), the maximal removed runs of bytes, and ``kept`` binary, the other bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rest = [c for c in df.columns if c not in ("removed", "kept")]
    keyed = _keyed(df.select(*rest), id_col, text_col)
    found = _removed(keyed.select(F.col("__doc").alias("doc"), F.col(text_col).alias("text")), length, hot)
    lists = found.groupBy(F.col("doc").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__found"))
    rows = keyed.join(lists, F.col("__doc") == F.col("__of"), "left").select(*rest, "__found")
    stretch = StructType([StructField("start", IntegerType(), False), StructField("stop", IntegerType(), False)])
    schema = StructType([*df.select(*rest).schema.fields, StructField("removed", ArrayType(stretch, False), False), StructField("kept", BinaryType(), False)])
    arrow, at = to_arrow_schema(schema), rest.index(text_col)
    return rows.mapInArrow(lambda batches: _kept(batches, at, arrow), schema)
