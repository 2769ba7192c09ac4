"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    brown_lm, byte_bpe, canonical_digest, chat_windows, crf_language, edit_match, fill_middle, hilbert, lsh_forest, page_templates, suffix_dedup, token_alignment, url_rules,
)
from ._shared import crc_mod, table

SHARDS = 16
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The site rules of the URL query.
SITES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        hilbert.category(F.col("lang")).alias("q_lang"),
        hilbert.category(F.col("source")).alias("q_source"),
        hilbert.magnitude(F.octet_length(text)).alias("q_size"),
    )
    placed = hilbert.shard(rows, [F.col("q_lang"), F.col("q_source"), F.col("q_size")], F.col("doc_id"), SHARDS, group=F.col("text_crc32"))
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    read = chat_windows.read_back(chat_windows.windows(rows.unionByName(own)))
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical_digest.compared(table(spark, sf_dir, "documents"))
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next")
    )


def op5_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return page_templates.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op6_edit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_match.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = _tokenizer()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.decode(byte_bpe.encode(docs, ranks, pattern).drop("text"), ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.site(name, verdict) for name, verdict in SITES]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, [*rules, *url_rules.PATTERNS]).select("page_id", "host", "path", "rule", "verdict")


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words, model = brown_lm.learn(docs.where(crc_mod("doc_id", 7) != 2))
    marked = brown_lm.annotate(docs, words, model)
    scored = brown_lm.score(marked, brown_lm.steps(marked.where(crc_mod("doc_id", 7) != 2)))
    return scored.select(
        "doc_id",
        (crc_mod("doc_id", 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model["n"]).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = crf_language.fit(docs.where(crc_mod("doc_id", 4) != 2))
    found = crf_language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.deduplicated(docs, length=100).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        (F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm_rate=80)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored()).alias("restored_sha256")
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", groups.alias("groups_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_hilbert_shards, op2_lsh_forest, op3_chat_windows, op4_canonical_digest, op5_page_templates,
        op6_edit_match, op7_byte_bpe, op8_url_rules, op9_brown_lm, op10_crf_language,
        op11_suffix_dedup, op12_fill_middle, op13_token_alignment,
    )
    return {f.__name__: f for f in own}


_OP8_SQL = r"""
WITH place AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
best AS (
  SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM place p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, b.rule,
  coalesce(b.verdict, CASE WHEN regexp_matches(lower(p.url),
    '(^|[^a-z0-9])(cheap-pills|casino|free-download|adserver|xxx)($|[^a-z0-9])|/ads/') THEN 'block' ELSE 'allow' END) AS verdict
FROM place p LEFT JOIN best b USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_url_rules": _OP8_SQL}
