"""Refinement and coarsening of meshes of leaf cells; one pass each, loops are in meshlark.plans.evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.operators.neighbors import _beyond, complete_siblings
from meshlark.operators.stencil import block_gradient
from meshlark.operators.transfer import named, prolongate, restrict
from meshlark.spec import MeshSpec


def refine_flags(gradients: DataFrame, spec: MeshSpec, threshold: float) -> DataFrame:
    """Blocks with refine: below the finest level and steeper than the threshold."""
    return gradients.withColumn("refine", (F.col("level") < spec.max_level) & (F.col("grad") > threshold))


def coarsen_flags(gradients: DataFrame, threshold: float | Column, hysteresis: float) -> DataFrame:
    """Blocks with coarsen: above level 0 and flatter than threshold x hysteresis."""
    return gradients.withColumn("coarsen", (F.col("level") > 0) & (F.col("grad") < threshold * hysteresis))


def refine(cells: DataFrame, blocks: DataFrame, spec: MeshSpec, value: str | tuple[str, ...] = "u", preserve_norm: bool = True) -> DataFrame:
    """cells with those of the given blocks replaced by their children. Blocks of the finest level are an error."""
    keyed = cells.select("level", *spec.g, *named(value), *A.block_coords(spec))
    wanted = blocks.select("level", *spec.b)
    too_fine = F.when(F.col("level") >= spec.max_level, F.raise_error(F.lit("MaxRefinementExceeded")).cast("int")).otherwise(F.col("level"))
    down = keyed.join(wanted, ["level", *spec.b], "left_semi").withColumn("level", too_fine)
    kept = keyed.join(wanted, ["level", *spec.b], "left_anti").select("level", *spec.g, *named(value))
    return kept.unionByName(prolongate(down, spec, value, preserve_norm).select("level", *spec.g, *named(value)))


def coarsenable(gradients: DataFrame, spec: MeshSpec, threshold: float | Column, hysteresis: float) -> DataFrame:
    """level and b0 ... of the parents whose children all exist and are all flat."""
    return complete_siblings(coarsen_flags(gradients, threshold, hysteresis).where("coarsen"), spec)


def coarsen(cells: DataFrame, parents: DataFrame, spec: MeshSpec, value: str | tuple[str, ...] = "u", preserve_norm: bool = True) -> DataFrame:
    """cells with the children of the given parents merged into them."""
    up = parents.select((F.col("level") + 1).alias("level"), *(F.col(b).alias(f"p{d}") for d, b in enumerate(spec.b)))
    keyed = cells.select("level", *spec.g, *named(value), *(A.shr(g, spec.shift + 1).alias(f"p{d}") for d, g in enumerate(spec.g)))
    keys = ["level", *(f"p{d}" for d in range(spec.nd))]
    merged = restrict(keyed.join(up, keys, "left_semi"), spec, value, preserve_norm)
    return keyed.join(up, keys, "left_anti").select("level", *spec.g, *named(value)).unionByName(merged.select("level", *spec.g, *named(value)))


def balance_violations(blocks: DataFrame, spec: MeshSpec) -> DataFrame:
    """level and b0 ... of blocks that have a face neighbour two or more levels finer, each once.

    Every block offers the block beyond each face at all coarser levels from two up; those that exist are too coarse.
    """
    up = F.explode(F.sequence(F.lit(2), F.col("level")))
    beyond = _beyond(blocks.where("level >= 2"), spec).select("level", *(f"p{d}" for d in range(spec.nd)), up.alias("k"))
    wanted = beyond.select((F.col("level") - F.col("k")).alias("level"), *(A.shr(f"p{d}", F.col("k")).alias(b) for d, b in enumerate(spec.b))).distinct()
    return blocks.select("level", *spec.b).join(wanted, ["level", *spec.b], "left_semi")


def delete_blocks(cells: DataFrame, blocks: DataFrame, spec: MeshSpec) -> DataFrame:
    keyed = cells.select("*", *A.block_coords(spec))
    return keyed.join(blocks.select("level", *spec.b), ["level", *spec.b], "left_anti").drop(*spec.b)


def gradient_pass(cells: DataFrame, spec: MeshSpec, threshold: float, value: str = "u", preserve_norm: bool = True) -> DataFrame:
    """One refinement of all steep blocks."""
    steep = refine_flags(block_gradient(cells, spec, value), spec, threshold).where("refine")
    return refine(cells, steep, spec, value, preserve_norm)
