"""Conservative correction at faces between levels: fluxes, register, reflux."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.operators._common import merged
from meshlark.operators.halo import COARSER, FINER, halo
from meshlark.spec import MeshSpec


def face_fluxes(cells: DataFrame, spec: MeshSpec, value: str = "u", diffusivity: float = 1.0) -> DataFrame:
    """level, g0 ..., face, side ('coarse' or 'fine'), flux: the diffusive flux along +d times the area, at faces between levels.

    Both sides see what a stencil sees: the halo value at one spacing of their own level.
    """
    h = A.spacing(spec)
    sign = F.when(F.col("face") % 2 == 0, 1.0).otherwise(-1.0)
    out = halo(cells, spec, value, (COARSER, FINER), own="_own_value")
    flux = -diffusivity * sign * (F.col(value) - F.col("_own_value")) / h * F.pow(h, F.lit(float(spec.nd - 1)))
    return out.select("level", *spec.g, "face", F.when(F.col("kind") == FINER, "coarse").otherwise("fine").alias("side"), flux.alias("flux"))


def flux_register(fluxes: DataFrame, spec: MeshSpec, scale: float = 1.0, flux: str = "flux") -> DataFrame:
    """level, g0 ..., face, r: at each face of a coarse cell, minus its own flux plus those of the fine cells that touch it."""
    coarse = fluxes.where("side = 'coarse'").select("level", *spec.g, "face", (-scale * F.col(flux)).alias("r"))
    level = F.col("level") - 1
    beyond = []
    for d, g in enumerate(spec.g):
        step = F.when(F.col("face") == 2 * d, 1).when(F.col("face") == 2 * d + 1, -1).otherwise(0)
        beyond.append(A.shr(F.col(g) + step, 1) if not spec.periodic[d] else A.shr(F.pmod(F.col(g) + step, A.extent(spec, d, F.col("level"))), 1))
    fine = fluxes.where("side = 'fine'").select(level.alias("level"), *(c.alias(g) for c, g in zip(beyond, spec.g, strict=True)), F.col("face").bitwiseXOR(F.lit(1)).alias("face"), (scale * F.col(flux)).alias("r"))
    return coarse.unionByName(fine).groupBy("level", *spec.g, "face").agg(F.sum("r").alias("r"))


def reflux(cells: DataFrame, register: DataFrame, spec: MeshSpec, value: str = "u") -> DataFrame:
    """cells with r over the cell volume subtracted at + faces and added at - faces."""
    signed = register.select("level", *spec.g, F.when(F.col("face") % 2 == 0, -F.col("r")).otherwise(F.col("r")).alias("r")).groupBy("level", *spec.g).agg(F.sum("r").alias("_r"))
    out = cells.join(merged(signed), ["level", *spec.g], "left")
    return out.withColumn(value, F.col(value) + F.coalesce("_r", F.lit(0.0)) / A.cell_volume(spec)).drop("_r")
