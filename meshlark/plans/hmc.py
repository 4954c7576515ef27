"""Hybrid Monte Carlo of SU(N) links: leapfrog trajectories and their acceptance. State is written each step."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import matrices as M
from meshlark.operators import special_unitary
from meshlark.operators._common import written
from meshlark.spec import MeshSpec


def _kick(momenta: DataFrame, links: DataFrame, spec: MeshSpec, n: int, beta: float, dt: float) -> DataFrame:
    """p + dt f, f the force of special_unitary.forces: minus the gradient of the action in the metric of the kinetic energy."""
    f = special_unitary.forces(links, spec, n, beta)
    keys = ["level", *spec.g, "mu"]
    return momenta.join(f, keys, "left").select(*keys, M.added(F.col("p"), F.coalesce("f", M.scaled(F.col("p"), 0.0)), dt * n).alias("p"))


def _drift(links: DataFrame, momenta: DataFrame, spec: MeshSpec, dt: float) -> DataFrame:
    keys = ["level", *spec.g, "mu"]
    return links.join(momenta, keys).select(*keys, M.product(M.exp(M.scaled(F.col("p"), dt)), F.col("u")).alias("u"))


def leapfrog(links: DataFrame, momenta: DataFrame, spec: MeshSpec, n: int, beta: float, dt: float, steps: int) -> tuple[DataFrame, DataFrame]:
    """links and momenta after `steps` steps of half a kick, a drift and half a kick; inner half kicks are joined into whole ones."""
    momenta = written(_kick(momenta, links, spec, n, beta, dt / 2))
    for k in range(steps):
        links = written(_drift(links, momenta, spec, dt))
        momenta = written(_kick(momenta, links, spec, n, beta, dt if k + 1 < steps else dt / 2))
    return links, momenta


def hamiltonian(links: DataFrame, momenta: DataFrame, spec: MeshSpec, n: int, beta: float) -> float:
    return special_unitary.kinetic_energy(momenta).first()[0] + special_unitary.wilson_action(links, spec, n, beta).first()[0]


def hmc_step(links: DataFrame, spec: MeshSpec, n: int, beta: float, dt: float, steps: int, seed: int) -> tuple[DataFrame, dict]:
    """(links after acceptance, {accepted, delta}); the links before are kept until then, as DataFrames do not change."""
    momenta = written(special_unitary.random_momenta(links, spec, n, seed))
    before = hamiltonian(links, momenta, spec, n, beta)
    new, moved = leapfrog(links, momenta, spec, n, beta, dt, steps)
    delta = hamiltonian(new, moved, spec, n, beta) - before
    accepted = delta <= 0 or np.random.default_rng(seed).random() < math.exp(-delta)
    return (new if accepted else links), {"accepted": accepted, "delta": delta}


def gradient_check(links: DataFrame, spec: MeshSpec, n: int, beta: float, at: Column, direction: np.ndarray, step: float = 1e-4) -> tuple[float, float]:
    """(central difference, from the force): the derivative of the action as the links at `at` turn along an algebra element."""

    def turned(sign: float) -> DataFrame:
        turn = F.array(*(F.lit(float(x)) for x in M.pack(M.expm(sign * step * direction[None]))[0]))
        return links.withColumn("u", F.when(at, M.product(turn, F.col("u"))).otherwise(F.col("u")))

    up, down = (special_unitary.wilson_action(turned(s), spec, n, beta).first()[0] for s in (1.0, -1.0))
    f = special_unitary.forces(links, spec, n, beta).where(at)
    along = F.array(*(F.lit(float(x)) for x in M.pack(direction[None])[0]))
    dot = F.aggregate(F.zip_with("f", along, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return (up - down) / (2 * step), -n * f.agg(F.coalesce(F.sum(dot), F.lit(0.0))).first()[0]
