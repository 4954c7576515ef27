"""The stages of the pipeline, one by one against what they promise, and all together."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_brute import DOCS, hard_cases
from tests.llm.test_near_copies import kept_ids

EXTRA = ("findings", "n_candidates", "n_words", "key", "row", "id", "doc", "size", "taken", "rank", "root")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def hard(spark):
    """Hard cases, with columns whose names the stages use themselves."""
    df = spark.createDataFrame(hard_cases(), DOCS)
    return df.select("*", *(F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in EXTRA)).cache()


def plain(df):
    return Counter(map(tuple, df.collect()))


def test_quality_keeps_whole_rows(spark, docs, hard, sf_dir):
    for df in (docs, hard):
        out = corpus_pipeline.quality_rules(spark, df, sf_dir)
        assert out.columns == df.columns and not plain(out) - plain(df)
    assert out.where("length(trim(text)) = 0 or text is null").isEmpty()


def test_near_dedup(spark, docs, hard, sf_dir):
    for df in (docs, hard):
        out = corpus_pipeline.near_dedup(spark, df, sf_dir)
        assert out.columns == df.columns and not plain(out) - plain(df)
        want = kept_ids([(r["doc_id"], r["text"]) for r in df.collect()])
        assert set(want) <= {r["doc_id"] for r in out.collect()}


def test_redaction_changes_nothing_but_secrets(spark, docs, hard, sf_dir):
    for df in (docs, hard):
        out = corpus_pipeline.redact_secrets(spark, df, sf_dir)
        assert out.columns == df.columns and out.count() == df.count()
        for row in (plain(out) - plain(df)).keys():
            assert "[SECRET]" in row[1] and row[df.columns.index("n_chars")] == len(row[1])
        others = [c for c in df.columns if c not in ("text", "n_chars")]
        assert plain(out.select(others)) == plain(df.select(others))


def test_mix_takes_whole_epochs(spark, docs, hard, sf_dir):
    for df in (docs, hard):
        out = corpus_pipeline.mix(spark, df, sf_dir)
        assert out.columns == df.columns
        given, taken = plain(df), plain(out)
        assert not set(taken) - set(given) and all(n <= 3 * given[row] for row, n in taken.items())


def test_empty_table(spark, hard, sf_dir):
    df = hard.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, sf_dir).isEmpty()


def test_whole_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "secret scans", "mixing sources", "best-fit packing"]
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert out and {r["doc_id"] for r in out} <= ids
    full = Counter()
    for r in out:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 4096


def test_tables_are_forgotten(spark, docs):
    """Last in this module: nothing that was stored before can be read any more."""
    from meshlark.llm import phrases
    from meshlark.llm._common import forget_tables, stored

    phrases.recurring_words(docs).count()
    table = stored(docs.select("doc_id"))
    assert any(t.name.startswith("meshlark_") for t in spark.catalog.listTables())
    forget_tables(spark)
    assert not any(t.name.startswith("meshlark_") for t in spark.catalog.listTables())
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
