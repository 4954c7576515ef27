"""Transfers between levels: restriction, prolongation, their face and link versions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.operators._common import merged
from meshlark.spec import MeshSpec


def named(value: str | tuple[str, ...]) -> tuple[str, ...]:
    """The value columns of a field: one, or those of its components."""
    return (value,) if isinstance(value, str) else tuple(value)


def restrict(cells: DataFrame, spec: MeshSpec, value: str | tuple[str, ...] = "u", preserve_norm: bool = False, level: int | None = None) -> DataFrame:
    """The mean of the 2^nd children at their parents, times sqrt(2^nd) if the norm is to stay."""
    scale = math.sqrt(spec.children) if preserve_norm else 1.0
    rows = cells.where("level > 0") if level is None else cells.where(F.col("level") == level)
    return rows.groupBy((F.col("level") - 1).alias("level"), *(A.shr(g, 1).alias(g) for g in spec.g)).agg(*((F.sum(v) / spec.children * scale).alias(v) for v in named(value)))


def prolongate(cells: DataFrame, spec: MeshSpec, value: str | tuple[str, ...] = "u", preserve_norm: bool = False) -> DataFrame:
    """Each cell copied to its 2^nd children, over sqrt(2^nd) if the norm is to stay."""
    scale = 1.0 / math.sqrt(spec.children) if preserve_norm else 1.0
    kids = [F.struct(*((2 * F.col(g) + (k >> d & 1)).alias(g) for d, g in enumerate(spec.g))) for k in range(spec.children)]
    return cells.select((F.col("level") + 1).alias("level"), F.explode(F.array(*kids)).alias("k"), *((F.col(v) * scale).alias(v) for v in named(value))).select("level", "k.*", *named(value))


def restrict_into(cells: DataFrame, fine: DataFrame, spec: MeshSpec, value: str = "u") -> DataFrame:
    """cells with the means of fine where it covers them."""
    means = restrict(fine, spec, value).withColumnRenamed(value, "_r")
    return cells.join(means, ["level", *spec.g], "left").withColumn(value, F.coalesce("_r", value)).drop("_r")


def prolongate_into(cells: DataFrame, coarse: DataFrame, spec: MeshSpec, value: str = "u", add: bool = False) -> DataFrame:
    """cells with the value of the coarse cell above them, or that added."""
    above = coarse.select((F.col("level") + 1).alias("level"), *(F.col(g).alias(f"_{g}") for g in spec.g), F.col(value).alias("_p"))
    out = cells.select("*", *(A.shr(g, 1).alias(f"_{g}") for g in spec.g)).join(merged(above), ["level", *(f"_{g}" for g in spec.g)], "left")
    new = F.col(value) + F.coalesce("_p", F.lit(0.0)) if add else F.coalesce("_p", value)
    return out.withColumn(value, new).select(*cells.columns)


def zero_level(cells: DataFrame, level: int, value: str = "u") -> DataFrame:
    return cells.withColumn(value, F.when(F.col("level") == level, 0.0).otherwise(F.col(value)))


def restrict_face(faces: DataFrame, spec: MeshSpec, face: int, value: str = "u") -> DataFrame:
    """Values on a face (level, g0 ... of cells on that side) averaged over 2^(nd - 1) cells each."""
    across = face // 2
    keys = [A.shr(g, 1).alias(g) for g in spec.g]
    return faces.groupBy((F.col("level") - 1).alias("level"), *keys).agg((F.sum(value) / 2 ** (spec.nd - 1)).alias(value)) if across < spec.nd else faces


def prolongate_face(faces: DataFrame, spec: MeshSpec, face: int, value: str = "u") -> DataFrame:
    """Values on a face copied to the 2^(nd - 1) finer cells on that side of it."""
    bit = 0 if face % 2 else 1
    kids = [F.struct(*((2 * F.col(g) + (k >> d & 1)).alias(g) for d, g in enumerate(spec.g))) for k in range(spec.children) if (k >> (face // 2) & 1) == bit]
    return faces.select((F.col("level") + 1).alias("level"), F.explode(F.array(*kids)).alias("k"), value).select("level", "k.*", value)


def boundary_face(cells: DataFrame, spec: MeshSpec, face: int) -> DataFrame:
    """The cells on one face of their blocks, with the block and the face index."""
    return cells.where(A.on_face(spec, face)).select("*", *A.block_coords(spec), F.lit(face).alias("face"), A.face_index(spec, face).alias("face_idx"))


def half_angle(theta: Column) -> Column:
    """Half of an angle taken in (-pi, pi]; a sine that only rounding tells from zero is zero."""
    sine = F.when(F.abs(F.sin(theta)) < 1e-15, 0.0).otherwise(F.sin(theta))
    return F.atan2(sine, F.cos(theta)) / 2


def prolongate_link_face(links: DataFrame, spec: MeshSpec, face: int) -> DataFrame:
    """U(1) links of cells on a face, halved, at the 2^(nd - 1) finer cells on that side of it."""
    bit = 0 if face % 2 else 1
    kids = [F.struct(*((2 * F.col(g) + (k >> d & 1)).alias(g) for d, g in enumerate(spec.g))) for k in range(spec.children) if (k >> (face // 2) & 1) == bit]
    return links.select((F.col("level") + 1).alias("level"), F.explode(F.array(*kids)).alias("k"), "mu", half_angle(F.col("theta")).alias("theta")).select("level", "k.*", "mu", "theta")


def restrict_link_face(links: DataFrame, spec: MeshSpec, face: int) -> DataFrame:
    """U(1) links of the coarser face: the first fine link of each 2^(nd - 1), without a product."""
    first = F.lit(True)
    for d, g in enumerate(spec.g):
        if d != face // 2:
            first = first & (F.col(g) % 2 == 0)
    return links.where(first & (F.col("level") > 0)).select((F.col("level") - 1).alias("level"), *(A.shr(g, 1).alias(g) for g in spec.g), "mu", "theta")


def prolongate_links(links: DataFrame, spec: MeshSpec) -> DataFrame:
    """U(1) links (level, g0 ..., mu, theta) halved: the two finer links along mu of each line of children."""
    kids = [F.struct(*((2 * F.col(g) + (k >> d & 1)).alias(g) for d, g in enumerate(spec.g))) for k in range(spec.children)]
    return links.select((F.col("level") + 1).alias("level"), F.explode(F.array(*kids)).alias("k"), "mu", half_angle(F.col("theta")).alias("theta")).select("level", "k.*", "mu", "theta")


def restrict_links(links: DataFrame, spec: MeshSpec) -> DataFrame:
    """U(1) links of the coarser level: the product of the two fine links along mu that start at the coarse cell's corner."""
    even = None
    for d, g in enumerate(spec.g):
        cond = (F.col("mu") == d) | (F.col(g) % 2 == 0)
        even = cond if even is None else even & cond
    keys = [A.shr(g, 1).alias(g) for g in spec.g]
    return links.where(even & (F.col("level") > 0)).groupBy((F.col("level") - 1).alias("level"), *keys, "mu").agg(F.sum("theta").alias("theta"))
