"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing and packing.

Each stage takes all that the one before kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import mixing, near_copies, packing, quality, secrets
from meshlark.llm._common import stored
from meshlark.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence from their language let pass."""
    rows = docs.select(F.struct("*").alias("doc"), "text", "lang")
    return quality.judge(rows, ("doc",)).where("kept").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where something was."""
    known = secrets.dictionary(docs)
    found = secrets.scan(docs.select(F.struct("*").alias("doc"), "text"), secrets.fit_forest(secrets.labelled_findings(spark), known), known)
    text = secrets.redacted(F.col("text"), F.col("findings"))
    masked = F.col("doc").withField("text", text).withField("n_chars", F.length(text).cast("long"))
    return found.select(F.when(F.size("findings") > 0, masked).otherwise(F.col("doc")).alias("doc")).select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = stored(mixing.sized(docs, extra=(F.struct(*docs.columns).alias("doc"),)))
    taken = mixing.mix(rows)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return taken.where(copies > 0).select("doc", F.explode(F.sequence(F.lit(1), copies))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("secret scans", redact_secrets), ("mixing sources", mix), ("best-fit packing", pack)]
#: SQL has no tokenizer, forest or fingerprint; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
