"""The register of queries and what they share: the lattice of line items and its SQL."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.operators._common import written
from meshlark.operators.adapt import refine
from meshlark.operators.stencil import block_gradient
from meshlark.sources.lattice import lattice
from meshlark.spec import MeshSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

B = 8
#: SQL: cells along each dimension of the lattice of level 0: a power of two that grows with the root of the number of parts.
SIZE = "size AS (SELECT CAST(greatest(32, pow(2, ceil(log2(sqrt(3.0 * greatest(count(*), 1)))))) AS BIGINT) AS n FROM part)"
N = "(SELECT n FROM size)"
_SITES: ContextVar[int] = ContextVar("sites", default=32)


def sites(spark: SparkSession, sf_dir: str) -> int:
    """What SIZE says, for the tables of a folder."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    return max(32, 1 << math.ceil(math.log2(math.sqrt(3.0 * max(parts, 1)))))


@functools.cache
def _spec(n: int, periodic: bool) -> MeshSpec:
    return MeshSpec((n, n), B, periodic, 1.0, 3)


class _Scaled:
    """The MeshSpec of the lattice that the query at hand works on; its size follows from the tables."""

    def __init__(self, periodic: bool) -> None:
        self._periodic = periodic

    def __getattr__(self, name: str):
        return getattr(_spec(_SITES.get(), self._periodic), name)


SPEC, OPEN = _Scaled(True), _Scaled(False)

#: SQL: the lattice.
CELLS = f"""{SIZE}, spine AS (SELECT CAST(a.range AS BIGINT) AS g0, CAST(b.range AS BIGINT) AS g1 FROM (SELECT unnest(range({N})) AS range) a, (SELECT unnest(range({N})) AS range) b),
sums AS (SELECT l_partkey % {N} AS g0, l_suppkey % {N} AS g1, sum(l_quantity) AS u, count(*) AS c FROM lineitem GROUP BY 1, 2),
cells AS MATERIALIZED (SELECT CAST(0 AS INTEGER) AS level, s.g0, s.g1, CAST(coalesce(x.u, 0) AS DOUBLE) AS u, CAST(coalesce(x.c, 0) AS BIGINT) AS c
  FROM spine s LEFT JOIN sums x ON s.g0 = x.g0 AND s.g1 = x.g1)"""
#: SQL: block gradients of the lattice, and the mesh of two levels: steep blocks refined, their cells told apart.
GRADIENTS = f"""{CELLS},
gradients AS (SELECT CAST(0 AS INTEGER) AS level, x.g0 // {B} AS b0, x.g1 // {B} AS b1, max(greatest(abs(r.u - x.u), abs(t.u - x.u))) AS grad
  FROM cells x JOIN cells r ON r.g0 = x.g0 + 1 AND r.g1 = x.g1 JOIN cells t ON t.g0 = x.g0 AND t.g1 = x.g1 + 1
  WHERE x.g0 % {B} BETWEEN 1 AND {B - 2} AND x.g1 % {B} BETWEEN 1 AND {B - 2} GROUP BY 2, 3)"""
MESH = f"""{GRADIENTS},
mean_grad AS (SELECT avg(grad) AS m FROM gradients),
mesh AS MATERIALIZED (SELECT c.level, c.g0, c.g1, c.u FROM cells c JOIN gradients s ON c.g0 // {B} = s.b0 AND c.g1 // {B} = s.b1 WHERE s.grad <= (SELECT m FROM mean_grad)
  UNION ALL SELECT CAST(1 AS INTEGER), 2 * c.g0 + kx.range, 2 * c.g1 + ky.range, c.u + kx.range + 2 * ky.range
  FROM cells c JOIN gradients s ON c.g0 // {B} = s.b0 AND c.g1 // {B} = s.b1, range(2) kx, range(2) ky WHERE s.grad > (SELECT m FROM mean_grad)),
blocks AS (SELECT DISTINCT level, g0 // {B} AS b0, g1 // {B} AS b1 FROM mesh)"""


def key(level: str, g0: str, g1: str) -> str:
    """SQL: one number for a cell, so that joins of three tables go by whole keys and not by their levels first."""
    return f"((CAST({level} AS BIGINT) * 1048576 + {g0}) * 1048576 + {g1})"


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            token = _SITES.set(sites(spark, sf_dir))
            try:
                return f(spark, sf_dir)
            finally:
                _SITES.reset(token)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return put


def r6(x: Column) -> Column:
    """Six digits, and no minus zero."""
    return F.round(x, 6) + F.lit(0.0)


def sql6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"), SPEC, ("l_partkey", "l_suppkey"), "l_quantity")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).drop("c")


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: blocks steeper than the mean are refined; children differ by 1 and 2 along the dimensions. Written once a query."""
    base = written(plain(spark, sf_dir))
    grad = block_gradient(base, SPEC)
    steep = grad.crossJoin(F.broadcast(grad.agg(F.avg("grad").alias("m")))).where("grad > m")
    fine = refine(base, steep, SPEC, preserve_norm=False)
    offset = F.when(F.col("level") == 1, F.col("g0") % 2 + 2 * (F.col("g1") % 2)).otherwise(0)
    return written(fine.withColumn("u", F.col("u") + offset))


def mesh_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh(spark, sf_dir).select("level", *A.block_coords(SPEC)).distinct()
