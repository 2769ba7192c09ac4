"""URL filtering by pattern rules that are indexed by their rarest literal token.

DataFrame operations only. Each rule has a regular expression and the literal tokens
(``[a-z0-9]+`` runs, lower-cased) that every URL it fits must hold. A rule is filed under the
token of its own that the fewest URLs hold; the tokens of a URL fetch the rules filed under
them, and only those run their expression. A rule without tokens is fetched by every URL.

Two kinds of rules: *site* rules (host and path prefix; the longest that fits wins) and
*pattern* rules (``*`` stands for any characters; a pattern that begins or ends with a letter or
digit does so at a token border).
The verdict is that of the site rule, else ``block`` if a blocking pattern fits, else ``allow``.

The rules are a small table that Spark may broadcast by its own size check; otherwise the join
on tokens is shuffled and adaptive execution splits frequent tokens. URLs are judged once each
and joined back, so many rows with one URL cost one judgement.

Null URL, or one without ``://``: empty host and path, no site rule. Repeated rows are kept. Very long URLs are judged whole; an
empty table gives an empty result. Of equally long site rules that fit, the last by name wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "([a-z0-9]+)"
ALWAYS = ""


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str  # site or pattern
    regex: str
    verdict: str
    tokens: tuple[str, ...]


def site(name: str, verdict: str) -> Rule:
    """A rule ``host/path``: the host and its subdomains, paths that start with ``/path``."""
    host, slash, path = name.partition("/")
    # the last token of the path may go on in the URL, so it is literal only before a border
    whole = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(name, "site", rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}", verdict, tuple(dict.fromkeys(whole)))


def pattern(text: str, verdict: str) -> Rule:
    """A rule for URLs (lower-cased) that hold ``text``, at a token border where its own end is of a token."""
    text = text.lower()
    body = ".*".join(map(re.escape, text.split("*")))
    tokens = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", text)
    # an end like "/" is a border itself: what is beyond it may be a letter or digit
    start = "(?<![a-z0-9])" if re.match("[a-z0-9]", text) else ""
    stop = "(?![a-z0-9])" if re.search("[a-z0-9]$", text) else ""
    return Rule(text, "pattern", start + body + stop, verdict, tuple(dict.fromkeys(tokens)))


def host_of(url: Column) -> Column:
    """A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit(TOKEN), F.lit(1)))


def index_rules(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """The rules with their ``token``: the one that the fewest of ``urls`` hold (ties: the first)."""
    spark = urls.sparkSession
    schema = "name string, kind string, regex string, verdict string, tokens array<string>"
    table = spark.createDataFrame([(r.name, r.kind, r.regex, r.verdict, list(r.tokens)) for r in rules], schema)
    own = table.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode(tokens_of(F.col(url_col))).alias("token")).join(own, "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = table.select("*", F.explode_outer("tokens").alias("token")).join(counts, "token", "left")
    least = F.min(F.struct(F.coalesce("n", F.lit(0)), F.coalesce("token", F.lit(ALWAYS)))).alias("least")
    return filed.groupBy("name", "kind", "regex", "verdict").agg(least).select(
        "name", "kind", "regex", "verdict", F.col("least")["col2"].alias("token")
    )


def judge(df: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (the site rule or null), ``patterns`` (names of the
    pattern rules that fit) and ``verdict``. Columns of ``df`` with these names are replaced."""
    made = ["host", "path", "rule", "patterns", "verdict"]
    kept = [c for c in df.columns if c not in made]
    url = F.col(url_col)
    urls = df.select(url.alias("__url")).where(url.isNotNull()).distinct()
    index = index_rules(df, rules, url_col).select(*(F.col(c).alias(f"__{c}") for c in ("name", "kind", "regex", "verdict", "token")))
    fetched = urls.select("__url", F.explode(F.array_union(tokens_of(F.col("__url")), F.array(F.lit(ALWAYS)))).alias("__token")).join(index, "__token")
    place = F.concat(host_of(F.col("__url")), path_of(F.col("__url")))
    subject = F.when(F.col("__kind") == "site", place).otherwise(F.lower("__url"))
    fits = fetched.where(F.regexp_like(subject, F.col("__regex")))
    is_site, is_pattern = F.col("__kind") == "site", F.col("__kind") == "pattern"
    best = F.struct(F.length("__name").alias("length"), F.col("__name").alias("name"), F.col("__verdict").alias("verdict"))
    found = fits.groupBy("__url").agg(
        F.max(F.when(is_site, best)).alias("__best"),
        F.sort_array(F.collect_set(F.when(is_pattern, F.col("__name")))).alias("__patterns"),
        F.max(is_pattern & (F.col("__verdict") == "block")).alias("__blocked"),
    )
    joined = df.select(*kept).join(found, url == F.col("__url"), "left")
    by_pattern = F.when(F.coalesce("__blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        *kept,
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.col("__best")["name"].alias("rule"),
        F.coalesce("__patterns", F.array().cast("array<string>")).alias("patterns"),
        F.coalesce(F.col("__best")["verdict"], by_pattern).alias("verdict"),
    )


#: Pattern rules of the method itself.
PATTERNS = (
    pattern("cheap-pills", "block"),
    pattern("casino", "block"),
    pattern("free-download", "block"),
    pattern("adserver", "block"),
    pattern("/ads/*", "block"),
    pattern("xxx", "block"),
)
