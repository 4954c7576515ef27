"""Neighbour, sibling and owner lookups as equi-joins on shifted keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.spec import MeshSpec


def _beyond(blocks: DataFrame, spec: MeshSpec) -> DataFrame:
    """For each block and face the block coordinates on the other side, p0 ...; open boundaries drop out."""
    faces = []
    for f in range(spec.faces):
        at = A.cols(spec.b)
        at[f // 2] = at[f // 2] + (-1 if f % 2 else 1)
        out = []
        for d, c in enumerate(at):
            n = A.shl(F.lit(spec.sites[d] // spec.block_size).cast("long"), F.col("level"))
            out.append((F.pmod(c, n) if spec.periodic[d] else F.when((c >= 0) & (c < n), c)).alias(f"p{d}"))
        faces.append(F.struct(F.lit(f).alias("face"), *out))
    return blocks.select("level", *spec.b, F.explode(F.array(*faces)).alias("f")).select("level", *spec.b, "f.*").where(A.inside([F.col(f"p{d}") for d in range(spec.nd)]))


def neighbors(blocks: DataFrame, spec: MeshSpec) -> DataFrame:
    """level, b0 ..., face, n_level, n0 ..., level_diff: the neighbour of the same level, or else one level coarser; none if finer."""
    keys = blocks.select(F.col("level").alias("k_level"), *(F.col(b).alias(f"k{d}") for d, b in enumerate(spec.b)))
    wanted = _beyond(blocks, spec)
    options = F.array(F.struct(F.col("level").alias("k_level"), *(F.col(f"p{d}").alias(f"k{d}") for d in range(spec.nd))), F.struct((F.col("level") - 1).alias("k_level"), *(A.shr(f"p{d}", 1).alias(f"k{d}") for d in range(spec.nd))))
    found = wanted.select("level", *spec.b, "face", F.explode(options).alias("o")).select("level", *spec.b, "face", "o.*").join(keys, ["k_level", *(f"k{d}" for d in range(spec.nd))])
    best = found.groupBy("level", *spec.b, "face").agg(F.max(F.struct("k_level", *(f"k{d}" for d in range(spec.nd)))).alias("n"))
    return best.select("level", *spec.b, "face", F.col("n.k_level").alias("n_level"), *(F.col(f"n.k{d}").alias(f"n{d}") for d in range(spec.nd)), (F.col("n.k_level") - F.col("level")).alias("level_diff"))


def fine_neighbors(blocks: DataFrame, spec: MeshSpec) -> DataFrame:
    """level, b0 ..., face, n0 ...: the blocks one level finer that touch a face."""
    touching = []
    for child in range(spec.children):
        touching.append(F.struct(F.lit(child).alias("child"), *((2 * F.col(f"p{d}") + (child >> d & 1)).alias(f"n{d}") for d in range(spec.nd))))
    near = A.shr(F.col("c.child"), A.shr("face", 1)).bitwiseAND(F.lit(1)) == F.col("face") % 2
    wanted = _beyond(blocks, spec).select("level", *spec.b, "face", F.explode(F.array(*touching)).alias("c")).where(near).select("level", *spec.b, "face", "c.*").drop("child")
    keys = blocks.select((F.col("level") - 1).alias("level"), *(F.col(b).alias(f"n{d}") for d, b in enumerate(spec.b)))
    return wanted.join(keys, ["level", *(f"n{d}" for d in range(spec.nd))]).select("level", *spec.b, "face", *(f"n{d}" for d in range(spec.nd)))


def neighbor_at_level(blocks: DataFrame, spec: MeshSpec, level: int) -> DataFrame:
    """level, b0 ..., face, n0 ...: the block of a given level, at most the own one, that holds the place beyond the face."""
    up = F.col("level") - level
    wanted = _beyond(blocks.where(up >= 0), spec).select("level", *spec.b, "face", *(A.shr(f"p{d}", up).alias(f"n{d}") for d in range(spec.nd)))
    keys = blocks.where(F.col("level") == level).select(*(F.col(b).alias(f"n{d}") for d, b in enumerate(spec.b)))
    return wanted.join(keys, [f"n{d}" for d in range(spec.nd)]).select("level", *spec.b, "face", *(f"n{d}" for d in range(spec.nd)))


def complete_siblings(blocks: DataFrame, spec: MeshSpec) -> DataFrame:
    """level and b0 ... of the parents all of whose children exist."""
    per = blocks.where("level > 0").groupBy((F.col("level") - 1).alias("level"), *(A.shr(b, 1).alias(b) for b in spec.b)).agg(F.count("*").alias("n"))
    return per.where(F.col("n") == spec.children).drop("n")


def owned(blocks: DataFrame, owners: DataFrame, spec: MeshSpec) -> DataFrame:
    """blocks with their owner."""
    return blocks.join(owners.select("level", *spec.b, "owner"), ["level", *spec.b], "left")


def find_blocks(blocks: DataFrame, keys: DataFrame, spec: MeshSpec) -> DataFrame:
    return blocks.join(keys, ["level", *spec.b], "left_semi")


def coarse_at_fine(blocks: DataFrame, spec: MeshSpec) -> DataFrame:
    """Blocks that have a finer neighbour."""
    return blocks.join(fine_neighbors(blocks, spec), ["level", *spec.b], "left_semi")
