"""Main text of web pages by deducing each host's template from equivalence classes.

A page is read as a sequence of tokens: the starts of its containers (elements that hold others,
not paragraphs, lists or tables), told apart by their path. Over the pages of a host, tokens with the
same occurrence vector (how often on which page, folded into 64 bits) are an equivalence class.
A class is valid with ``SUPPORT`` pages (all of them on smaller hosts) and one in ``SHARE`` of the
host's; so each layout of a host has classes of its own, and a host's template is of bounded size.
A class whose tokens come once on each of its pages is a frame: its tokens are nested by their
paths, and what a page has beneath a token but not beneath a deeper one is that token's slot.
Other classes are records (a list's items, say) and belong to the slot around them. A slot whose
text is the same on ``SUPPORT`` pages and on half of those that have it is template text.

The slots are then read from the outside in. The article element is the main token of a page that has
one. Else, beginning with the whole page, the next token is the one that holds ``MOST`` of the text that varies over the host in all tokens
at its level. What stands outside the main token stays where the page has no article element, unless it is template
text, in a record (comments, teasers), mostly links or set apart by HTML. Beneath the
main token everything stays but template text (in slots of its own: a passage that articles share is
no slot) and elements that HTML itself sets apart: navigation, asides, forms, footers, headers
outside the article, articles within the article (comments). No names of classes are known.

A token that the template does not have weighs what it holds on its own page. Null html: empty text. Null url, or one
without a host: the page is read alone, with no template. Repeated rows: each counts and is
given back. Long pages are read whole. An empty table gives an empty result. Columns named ``text`` are replaced.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._shared import materialize
from .url_rules import host_of

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Fixed values of HTML: elements without content, and elements that are blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Fixed values of HTML: elements that are not the article, and the landmark roles that say the same.
APART = frozenset("nav footer aside form head title button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu".split())
#: Fixed values of HTML: elements that are parts of a text, not containers of one.
PARTS = frozenset("html p ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6".split())
SUPPORT, SHARE = 3, 64
MOST = 0.8
#: Hosts with so large a share of the pages, so at most as many, are joined by broadcast.
HOT_SHARE = 1000

Block = tuple[str, str, int, bool]


def _step(name: str, attributes: str) -> tuple[str, bool]:
    """An element's step in a path, and whether HTML sets it apart."""
    words, apart = [], name in APART
    for kind, a, b, c in _NAMED.findall(attributes) if attributes else ():
        value = (a or b or c).lower()
        if kind.lower() == "role":
            apart = apart or value.strip() in ROLES
        else:
            words += re.findall("[a-z]+", value)
    return ".".join([name, *words]), apart


def read_page(page: str | None) -> tuple[dict[str, int], list[Block]]:
    """Containers with their counts, and blocks (container, text, characters in links, apart)."""
    tokens: dict[str, int] = {}
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # name, container, apart
    text: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        plain = " ".join(entities.unescape("".join(text)).split())
        if plain:
            _, path, apart = stack[-1] if stack else ("", "", False)
            blocks.append((path, plain, min(linked, len(plain)), apart))
        text.clear()
        linked = 0

    at, page = 0, page or ""
    for m in _TAG.finditer(page):
        if m.start() > at:
            run = page[at : m.start()]
            text.append(run)
            linked += len(run) if in_link else 0
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            if name == "a":
                in_link = False
            if name in BLOCK:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            continue
        if name == "br":
            text.append(" ")
        elif name == "a":
            in_link = True
        if name in BLOCK:
            flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
            if name in ("li", "dd", "dt", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                stack.pop()
            step, apart = _step(name, m[4])
            _, path, above = stack[-1] if stack else ("", "", False)
            if name in ("article", "header"):  # an article's header is its own, an article in an article is not
                apart = apart or any(s[0] == "article" for s in stack) == (name == "article")
            if name not in PARTS:
                path = f"{path}/{step}"
                tokens[path] = tokens.get(path, 0) + 1
            if name not in VOID:
                stack.append((name, path, apart or above))
    text.append(page[at:])
    flush()
    return tokens, blocks


def _is_text(block: Block) -> bool:
    """Not apart and not mostly links."""
    return not block[3] and 2 * block[2] <= len(block[1])


def slots(tokens: dict[str, int], blocks: list[Block]) -> dict[str, tuple[int, int]]:
    """Of each container, and the page itself (the empty path): a hash of the text in its slot,
    and the characters of that."""
    import xxhash

    own: dict[str, list[str]] = {path: [] for path in ("", *tokens)}
    for block in blocks:
        if _is_text(block):
            own[block[0]].append(block[1])
    return {path: (xxhash.xxh64_intdigest("\n".join(texts)) - 2**63, sum(map(len, texts))) for path, texts in own.items()}


def _above(path: str) -> str:
    return path.rpartition("/")[0]


def main_text(page: str | None, template: dict[str, tuple[float | None, frozenset[int]]] | None) -> str:
    """The text of a page. ``template`` has the varying characters (None: a record) of each of its
    tokens, and the hashes of its template texts."""
    template = template or {}
    tokens, blocks = read_page(page)
    here = slots(tokens, blocks)
    frame = {"": ""}  # container -> the token whose slot it is in
    for path, count in sorted(tokens.items()):
        weight = template[path][0] if path in template else (float(here[path][1]) if count == 1 else None)
        frame[path] = frame[_above(path)] if weight is None else path
    same = {path for path, (key, _) in here.items() if path in template and key in template[path][1]}
    weights, inner = dict.fromkeys(frame.values(), 0.0), {path: set() for path in frame.values()}
    for path, token in frame.items():
        if path == token:
            weights[token] += template[path][0] if path in template else here[path][1]
            if path:
                inner[frame[_above(path)]].add(path)
    articles = [p for p in tokens if re.search(r"/article\b[^/]*$", p)] or [p for p in tokens if re.search(r"/main\b[^/]*$", p)]
    held = {p: sum(len(b[1]) for b in blocks if _is_text(b) and (b[0] == p or b[0].startswith(p + "/"))) for p in articles}
    records: set[str] = set()
    around = not any(held.values())
    if not around:
        main = max(held, key=lambda p: (held[p], p))
    else:
        total: dict[str, float] = {}
        for path in sorted(weights, key=lambda p: -p.count("/")):
            total[path] = weights[path] + sum(total[c] for c in inner[path])
        main = ""
        while inner[main]:
            best = max(inner[main], key=lambda p: (total[p], p))
            if not total[best] or total[best] < MOST * sum(total[c] for c in inner[main]):
                break
            main = best
        for path in sorted(tokens):  # parents first; a token that comes several times is a record, and so is what it holds
            several = template[path][0] is None if path in template else tokens[path] > 1
            if several or _above(path) in records:
                records.add(path)
    kept = []
    for block in blocks:
        if not block[3]:
            beneath = main == "" or block[0] == main or block[0].startswith(main + "/")
            if beneath or (around and _is_text(block) and block[0] not in same and block[0] not in records):
                kept.append(block)
    if any(b[0] not in same for b in kept):  # else all of it is a copy
        kept = [b for b in kept if b[0] not in same or b[0] == main]
    return "\n".join(b[1] for b in kept)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, count, occurrence hash, slot's hash, slot's characters) of each page."""
    import xxhash

    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        out: tuple[list, ...] = tuple([] for _ in kinds)
        for host, key, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
            tokens, blocks = read_page(page)
            for path, (text, chars) in slots(tokens, blocks).items():
                n = tokens.get(path, 1)
                for column, value in zip(out, (host, path, n, xxhash.xxh64_intdigest(f"{key}:{n}") - 2**63, text, chars)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["host", "path", "n", "occurs", "text", "chars"])


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, n_pages, classes): the valid equivalence classes of each host.

    A class has its number of pages, its vector, whether it is a frame, and its tokens: path,
    ``varying`` (mean characters of its slot that are no template text) and ``same`` (hashes of its
    template texts).
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(html_col).alias("page"))
    found = materialize(rows.where("host <> ''").mapInArrow(_token_rows, "host string, path string, n int, occurs bigint, text bigint, chars bigint"), "page-tokens")
    tokens = found.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.max("n").alias("most"), F.bit_xor("occurs").alias("vector"), F.sum("chars").alias("chars"))
    hosts = tokens.where("path = ''").select("host", F.col("pages").alias("n_pages"))
    enough = F.greatest(F.least(F.lit(SUPPORT), F.col("n_pages")), F.ceil(F.col("n_pages") / SHARE))
    tokens = materialize(tokens.join(hosts, "host").where(F.col("pages") >= enough), "template-tokens")
    # a task's equal texts are one row before the shuffle; texts of fewer than SUPPORT pages end here
    texts = found.where("chars > 0").groupBy("host", "path", "text").agg(F.count(F.lit(1)).alias("with_text"), F.sum("chars").alias("same_chars"))
    texts = texts.where(F.col("with_text") >= SUPPORT).join(tokens.select("host", "path", "pages"), ["host", "path"]).where("2 * with_text >= pages")
    texts = texts.groupBy("host", "path").agg(F.sort_array(F.collect_list("text")).alias("same"), F.sum("same_chars").alias("same_chars"))
    varying = (F.col("chars") - F.coalesce("same_chars", F.lit(0))) / F.col("pages")
    whole = tokens.join(texts, ["host", "path"], "left").select(
        "host", "n_pages", "pages", "vector", "most", F.struct("path", varying.alias("varying"), F.coalesce("same", F.array().cast("array<bigint>")).alias("same")).alias("token")
    )
    classes = whole.groupBy("host", "n_pages", "pages", "vector").agg((F.max("most") == 1).alias("frame"), F.sort_array(F.collect_list("token")).alias("tokens"))
    return classes.groupBy("host", "n_pages").agg(F.sort_array(F.collect_list(F.struct("pages", "vector", "frame", "tokens"))).alias("classes"))


@functools.lru_cache(maxsize=256)
def _template(classes: str | None) -> dict[str, tuple[float | None, frozenset[int]]]:
    """The tokens of a template's classes; those of records have no weight."""
    if not classes:
        return {}
    return {t["path"]: (t["varying"] if c["frame"] else None, frozenset(t["same"])) for c in json.loads(classes) for t in c["tokens"]}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col`` but with ``text`` string, the main text (empty if none)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = materialize(templates(pages, id_col, url_col, html_col).select("host", "n_pages", F.to_json("classes").alias("classes")), "templates")
    total = made.agg(F.coalesce(F.sum("n_pages"), F.lit(0))).first()[0]
    is_hot = F.col("n_pages") * HOT_SHARE >= total  # at most HOT_SHARE hosts
    hot = made.where(is_hot).select(F.col("host").alias("__hot"), F.col("classes").alias("__of_hot"))
    other = made.where(~is_hot).select(F.col("host").alias("__other"), F.col("classes").alias("__of_other"))
    rest = [c for c in pages.columns if c not in ("text", html_col)]
    rows = pages.select(*rest, F.col(html_col).alias("__html"), host_of(F.col(url_col)).alias("__host")).join(F.broadcast(hot), F.col("__host") == F.col("__hot"), "left")
    # pages that need no other template have keys of their own, so that none is a hot one
    done = F.col("__hot").isNotNull() | (F.col("__host") == "")
    key = F.when(done, F.concat(F.lit("/"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.hash("__html").cast("string"))).otherwise(F.col("__host"))
    rows = rows.join(other, key == F.col("__other"), "left").select(*rest, "__html", F.coalesce("__of_hot", "__of_other").alias("__classes"))
    schema = StructType([*rows.select(*rest).schema.fields, StructField("text", StringType(), False)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, _template(classes)) for page, classes in zip(batch.column("__html").to_pylist(), batch.column("__classes").to_pylist())]
            columns = [*(batch.column(c) for c in rest), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return rows.mapInArrow(run, schema)
