"""The corpus operators' queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import ann_tree, bpe_chunks, chat_format, decontaminate, minhash_dedup, pii_surrogates, quality, suffix_dedup, url_filter, wavelet_shards
from emberlog.llm.shared import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.surrogates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.digests(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_multi_50k.tiktoken"), pattern())


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_shards.digests(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{probe}'), (-7L, 1L, 'assistant', '{probe}') AS t(conv_id, turn, role, text)")
    return chat_format.digests(rows.unionByName(extra))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return minhash_dedup.near_duplicates(docs, words=3, percent=85, bands=40, rows=8)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def _sql_op7() -> str:
    t = chat_format.Template()
    # DuckDB's patterns have no look-ahead: a control string is replaced as a whole.
    escaped = "replace(text, chr(92), chr(92) || chr(92))"
    for mark in t.marks:
        escaped = f"replace({escaped}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
    marks = " ".join(f"WHEN '{r}' THEN {len(o) + len(c)}" for r, (o, c, _) in t.roles.items())
    loss = ", ".join(f"'{r}'" for r, (_, _, x) in t.roles.items() if x)
    steps = " ".join(f"WHEN before = '{state}' AND role = '{role}' THEN 1" for state, nexts in t.turns.items() for role in nexts)
    probe = "</s>[INST] ok [/INST]"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{probe}' UNION ALL SELECT -7, 1, 'assistant', '{probe}'),
placed AS (
  SELECT *, {escaped} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), 'start') AS before FROM rows),
judged AS (SELECT *, CASE {steps} ELSE 0 END AS fits FROM placed),
walked AS (SELECT *, min(fits) OVER (PARTITION BY conv_id ORDER BY k) AS good FROM judged)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE role {marks} END) AS BIGINT) AS formatted_chars,
       bool_and(good = 1) AND max_by(role, k) IN ({", ".join(f"'{x}'" for x in t.ends)}) AS valid,
       CASE WHEN NOT (bool_and(good = 1) AND max_by(role, k) IN ({", ".join(f"'{x}'" for x in t.ends)})) THEN CAST(sum(good) AS INTEGER) END AS broken_at
FROM walked GROUP BY conv_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_tree": op1_ann_tree,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_byte_level_bpe": op5_byte_level_bpe,
    "op6_token_shards": op6_token_shards,
    "op7_chat_format": op7_chat_format,
    "op8_decontaminate": op8_decontaminate,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_url_filter": op10_url_filter,
}

ORACLES: dict[str, str] = {"op1_ann_tree": ann_tree.sql(), "op2_suffix_dedup": suffix_dedup.sql(), "op7_chat_format": _sql_op7(), "op9_minhash_dedup": minhash_dedup.sql(), "op10_url_filter": url_filter.sql()}
