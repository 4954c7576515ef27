"""Helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.spec import MeshSpec


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: what loops and repeated reads use instead of recomputation.

    A local session that names no spark.checkpoint.dir gets a folder of its own; on a cluster that is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="meshlark-"))
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/meshlark-steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(table: DataFrame) -> DataFrame:
    """A table of cells or links as one side of a join: never broadcast.

    Spark guesses its size from packed files and leaves out what explode adds, so it would send whole lattices through the driver.
    """
    return table.hint("merge")


def moved(spec: MeshSpec, d: int, by: int, level: Column | None = None) -> list[Column]:
    """Cell coordinates moved along a dimension and wrapped, with their names; null beyond an open boundary."""
    g = A.cols(spec.g)
    g[d] = g[d] + by
    return [c.alias(n) for c, n in zip(A.wrap(spec, g, F.col("level") if level is None else level), spec.g, strict=True)]


def moves(spec: MeshSpec) -> list[tuple[int, int]]:
    return [(d, s) for d in range(spec.nd) for s in (1, -1)]


def blocks_of(cells: DataFrame, spec: MeshSpec) -> DataFrame:
    """level, b0 ... of the blocks that have cells."""
    return cells.select("level", *A.block_coords(spec)).distinct()


def to_neighbors(cells: DataFrame, spec: MeshSpec, *values: Column) -> DataFrame:
    """Each cell's values at every neighbouring place of its level: level, g0 ..., d, side (+1: the values come from the + side)."""
    targets = [F.struct(*moved(spec, d, -s), F.lit(d).alias("d"), F.lit(s).alias("side")) for d, s in moves(spec)]
    out = cells.select("level", F.explode(F.array(*targets)).alias("_t"), *values)
    return out.select("level", "_t.*", *(c for c in out.columns if c not in ("level", "_t"))).where(A.inside(A.cols(spec.g)))
