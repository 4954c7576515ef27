"""Made data: ground states of a particle among a few random Coulomb centers, one folder a sample."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.operators import gauge
from meshlark.plans import evolution
from meshlark.sources.lattice import spine
from meshlark.spec import MeshSpec


def noise_field(spark: SparkSession, spec: MeshSpec, seed: int) -> DataFrame:
    """level, g0 ..., re, im: Gaussian noise that depends on the cell and the seed alone."""
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "level", *spec.g), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    size, angle = F.sqrt(-2.0 * F.ln(uniform("size"))), 2.0 * math.pi * uniform("angle")
    return spine(spark, spec).select("level", *spec.g, (size * F.cos(angle)).alias("re"), (size * F.sin(angle)).alias("im"))


def generate(spark: SparkSession, path: str, samples: int, spec: MeshSpec, seed: int, steps: int = 50, dt: float = 0.01, mass: float = 1.0, charge: float = 1.0) -> DataFrame:
    """Writes psi of `samples` samples under path and returns them all: sample, n_centers, level, g0 ..., re, im, v.

    A sample has one to four centers at random places; psi begins as noise and takes `steps` steps of imaginary time.
    """
    no_links = spark.createDataFrame([], f"level int, {', '.join(f'{g} long' for g in spec.g)}, mu int, theta double")
    for k in range(samples):
        dice = np.random.default_rng((seed, k))
        centers = [tuple((dice.random(spec.nd) * spec.sites * spec.spacing).tolist()) for _ in range(int(dice.integers(1, 5)))]
        v = gauge.many_centers([gauge.coulomb(charge, F.lit(spec.spacing), c) for c in centers])(A.positions(spec), A.spacing(spec))
        psi = evolution.evolve(noise_field(spark, spec, int(dice.integers(1 << 30))), no_links, spec, mass, v, dt, steps)
        psi.select(F.lit(len(centers)).alias("n_centers"), "level", *spec.g, "re", "im", v.alias("v")).write.mode("overwrite").parquet(f"{path.rstrip('/')}/sample={k}")
    return spark.read.parquet(path)
