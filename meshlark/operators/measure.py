"""Norms, energies, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.spec import MeshSpec


def norm_squared(cells: DataFrame, spec: MeshSpec, square: Column) -> DataFrame:
    """norm_sq: the sum of square x cell volume over all leaf cells; one row."""
    return cells.agg(F.coalesce(F.sum(square * A.cell_volume(spec)), F.lit(0.0)).alias("norm_sq"))


def normalized(cells: DataFrame, spec: MeshSpec, square: Column, values: tuple[str, ...]) -> DataFrame:
    """cells with their values divided by the norm; unchanged if it is zero or not finite. The norm is a one-row join."""
    norm = norm_squared(cells, spec, square)
    usable = (F.col("norm_sq") > 0) & (F.col("norm_sq") < float("inf"))
    by = F.when(usable, F.sqrt("norm_sq")).otherwise(1.0)
    return cells.crossJoin(F.broadcast(norm)).withColumns({v: F.col(v) / by for v in values}).drop("norm_sq")


def total(cells: DataFrame, spec: MeshSpec, value: str = "u") -> DataFrame:
    """total: the sum of value x cell volume; one row."""
    return cells.agg(F.coalesce(F.sum(F.col(value) * A.cell_volume(spec)), F.lit(0.0)).alias("total"))
