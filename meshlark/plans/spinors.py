"""Loops over Dirac spinors in imaginary time. State is written each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import matrices as M
from meshlark.operators import special_unitary as SU
from meshlark.operators._common import written
from meshlark.spec import MeshSpec


def normalize(psi: DataFrame, spec: MeshSpec) -> DataFrame:
    """psi over its norm; unchanged if that is zero or not finite. The norm is a one-row join."""
    usable = (F.col("norm_sq") > 0) & (F.col("norm_sq") < float("inf"))
    by = F.when(usable, 1.0 / F.sqrt("norm_sq")).otherwise(1.0)
    return psi.crossJoin(F.broadcast(SU.spinor_norm(psi, spec))).select("level", *spec.g, M.scaled(F.col("v"), by).alias("v"))


def evolve(psi: DataFrame, links: DataFrame, spec: MeshSpec, n: int, mass: float, potential: Column, dt: float, steps: int, normalize_every: int = 1) -> DataFrame:
    """`steps` steps psi - dt (H - m)^2 psi, normalized every so often (0: never) and written."""
    for k in range(1, steps + 1):
        psi = written(SU.dirac_step(psi, links, spec, n, mass, potential, dt))
        if normalize_every and k % normalize_every == 0:
            psi = written(normalize(psi, spec))
    return psi


def evolve_until(psi: DataFrame, links: DataFrame, spec: MeshSpec, n: int, mass: float, potential: Column, dt: float, tolerance: float, most: int = 1000, check: int = 100) -> tuple[DataFrame, dict]:
    """evolve() in chunks of `check` steps until the energy changes by less than the tolerance: (psi, {steps, energy, converged})."""

    def energy() -> float:
        return SU.spinor_energy(psi, SU.dirac(psi, links, spec, n, mass, potential), spec).first()["energy"]

    psi = written(normalize(psi, spec))
    before, steps, now = energy(), 0, None
    while steps < most:
        psi = written(normalize(evolve(psi, links, spec, n, mass, potential, dt, min(check, most - steps), 0), spec))
        steps, now = steps + min(check, most - steps), energy()
        if abs(now - before) < tolerance:
            return psi, {"steps": steps, "energy": now, "converged": True}
        before = now
    return psi, {"steps": steps, "energy": before, "converged": False}
