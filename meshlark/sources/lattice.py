"""Lattices from relational tables: two integer keys modulo the extent become coordinates, sums become fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions.address import inside
from meshlark.spec import MeshSpec


def spine(spark: SparkSession, spec: MeshSpec) -> DataFrame:
    """All cells of level 0."""
    n = 1
    for s in spec.sites:
        n *= s
    at, out, below = F.col("id"), [], 1
    for d, s in enumerate(spec.sites):
        out.append(F.pmod(F.floor(at / F.lit(below)) if below > 1 else at, F.lit(s)).cast("long").alias(f"g{d}"))
        below *= s
    return spark.range(n).select(F.lit(0).alias("level"), *out)


def lattice(table: DataFrame, spec: MeshSpec, keys: tuple[str, ...], value: str) -> DataFrame:
    """level, g0, g1 ..., u (sum of value) and c (rows) of every cell; cells without rows hold zeros.

    Partial sums leave the scan, so the shuffle carries one row a cell and task, whatever the table's size.
    """
    sums = table.groupBy(*(F.pmod(F.col(k), F.lit(n)).cast("long").alias(g) for k, n, g in zip(keys, spec.sites, spec.g, strict=True))).agg(F.sum(value).cast("double").alias("u"), F.count("*").alias("c"))
    return spine(table.sparkSession, spec).join(sums, spec.g, "left").select("level", *spec.g, F.coalesce("u", F.lit(0.0)).alias("u"), F.coalesce("c", F.lit(0)).cast("long").alias("c"))


def insert_blocks(blocks: DataFrame, new: DataFrame, spec: MeshSpec) -> DataFrame:
    """blocks and new ones; an error in the plan if a key comes twice."""
    every = blocks.unionByName(new)
    once = every.groupBy("level", *spec.b).agg(F.count("*").alias("n"))
    checked = once.select("level", *spec.b, F.when(F.col("n") > 1, F.raise_error(F.lit("BlockAlreadyExists"))).otherwise(F.lit(True)).cast("boolean").alias("_new"))
    return every.join(checked, ["level", *spec.b]).where("_new").drop("_new")


def within(cells: DataFrame, spec: MeshSpec) -> DataFrame:
    """Cells in the domain."""
    from meshlark.functions.address import wrap

    return cells.where(inside(wrap(spec, [F.col(g) for g in spec.g], F.col("level"))))
