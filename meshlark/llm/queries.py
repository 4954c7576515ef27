"""The queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import chat, html, mixing, oracle, packing, phrases, quality, secrets, simhash, suffixes, topk
from meshlark.llm._common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many candidates and secrets it holds, the secrets' digests, and that of the text without them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = secrets.dictionary(docs)
    out = secrets.scan(docs, secrets.fit_forest(secrets.labelled_findings(spark), known), known)
    digests = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda x: F.sha2(x["token"], 256)))), " ")
    return out.select("doc_id", "n_candidates", F.size("findings").alias("n_secrets"), digests.alias("secrets_sha256"), F.sha2(secrets.redacted(F.coalesce("text", F.lit("")), F.col("findings")), 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of all documents: doc_id, piece, start, length, ids_crc32 and its place, sequence_id and offset. Nulls count as empty texts."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken. A null source is one of its own; a null text has size 0."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base counts, base_failed and kept. A null text has no words and fails."""
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint and component_id. Null and blank texts share fingerprint zero."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text and n_chars of its article; a null page has none."""
    return html.extract(table(spark, sf_dir, "pages"))


def op7_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per transcript of the conversations: the turns, roles and canonical text recovered, and how the roles compare with the given ones.

    The model is counted from conversations of one half by hash; held_out tells the other half.
    """
    texts = chat.transcripts(table(spark, sf_dir, "conversations"))
    held_out = F.pmod(F.xxhash64(F.lit("half"), "conv_id"), F.lit(2)) == 1
    out = chat.format_chats(texts, chat.train(texts.where(~held_out)), ("conv_id", "part", "roles"))
    given = F.array_join("roles", " ", "unknown")
    return out.select("conv_id", "part", held_out.alias("held_out"), "n_turns", "recovered", given.alias("given"), (F.col("recovered") == given).alias("agrees"), "rendered")


def op8_recurring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_sha256; a null text has no words."""
    return phrases.recurring_words(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query (vec_id divisible by 100): its ten best candidates. Vectors that are null or hold null, NaN or infinity take no part."""
    return topk.top_k(topk.integer_vectors(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


def op10_recurring_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256; a null text has no bytes."""
    return suffixes.recurring_bytes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
