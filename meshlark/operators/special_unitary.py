"""SU(N) links as matrices: plaquettes, action, forces, and Dirac spinors. Joins and sums in Spark, products in numpy batches.

links: level, g0 ..., mu, u (2 n^2 doubles). n = 1 gives U(1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.functions import matrices as M
from meshlark.operators._common import moved
from meshlark.operators.gauge import planes
from meshlark.spec import MeshSpec


def haar_links(cells: DataFrame, spec: MeshSpec, n: int, seed: int) -> DataFrame:
    """Uniform random links of all cells; a link depends on its key and the seed alone."""

    def run(keys: pd.Series) -> pd.Series:
        return M.pack(np.concatenate([M.haar(np.random.default_rng(abs(int(k))), 1, n) for k in keys]) if len(keys) else np.empty((0, n, n), complex))

    rows = cells.select("level", *spec.g, F.explode(F.array(*(F.lit(m) for m in range(spec.nd)))).alias("mu"))
    return rows.withColumn("u", F.pandas_udf(run, "array<double>")(F.xxhash64(F.lit(seed), "level", *spec.g, "mu")))


def corners(links: DataFrame, spec: MeshSpec) -> DataFrame:
    """level, g0 ..., mu, nu and the four links round each plaquette, u0 ... u3, in the order of the path."""
    sent = []
    for m, n in planes(spec):
        here = [F.col(g).alias(g) for g in spec.g]
        for of, at, slot in ((m, here, 0), (n, moved(spec, m, -1), 1), (m, moved(spec, n, -1), 2), (n, here, 3)):
            sent.append(F.when(F.col("mu") == of, F.struct(*at, F.lit(m).alias("m"), F.lit(n).alias("nu"), F.lit(slot).alias("slot"))))
    rows = links.select("level", "u", F.explode(F.filter(F.array(*sent), lambda x: x.isNotNull())).alias("s")).select("level", "s.*", "u").where(A.inside(A.cols(spec.g)))
    per = rows.groupBy("level", *spec.g, F.col("m").alias("mu"), "nu").agg(*(F.max(F.when(F.col("slot") == k, F.col("u"))).alias(f"u{k}") for k in range(4)))
    return per.where(F.col("u0").isNotNull() & F.col("u3").isNotNull())


def _filled(per: DataFrame, n: int) -> DataFrame:
    return per.withColumns({f"u{k}": F.coalesce(f"u{k}", M.identity(n)) for k in range(4)})


def plaquettes(links: DataFrame, spec: MeshSpec, n: int) -> DataFrame:
    """level, g0 ..., mu, nu, p: the product round each plaquette."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return M.pack(M.unpack(a) @ M.unpack(b) @ M.adjoint(M.unpack(c)) @ M.adjoint(M.unpack(d)))

    per = _filled(corners(links, spec), n)
    return per.select("level", *spec.g, "mu", "nu", F.pandas_udf(run, "array<double>")("u0", "u1", "u2", "u3").alias("p"))


def wilson_action(links: DataFrame, spec: MeshSpec, n: int, beta: float) -> DataFrame:
    """action: beta x n x (1 - Re tr P / n) summed over plaquettes."""
    return plaquettes(links, spec, n).agg(F.coalesce(F.sum(beta * (n - M.trace(F.col("p"), n)["re"])), F.lit(0.0)).alias("action"))


def forces(links: DataFrame, spec: MeshSpec, n: int, beta: float) -> DataFrame:
    """level, g0 ..., mu, f = -beta / n x the algebra part of U x staples. Each plaquette hands its product, begun at each link, to its links."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        w, x, y, z = (M.unpack(s) for s in (a, b, c, d))
        yh, zh, xh, wh = (M.adjoint(s) for s in (y, z, x, w))
        loops = (w @ x @ yh @ zh, x @ yh @ zh @ w, y @ xh @ wh @ z, z @ y @ xh @ wh)
        flat = [np.stack((m.real, m.imag), -1).reshape(len(m), -1) for m in loops]
        return pd.Series([[list(f[i]) for f in flat] for i in range(len(w))])

    per = _filled(corners(links, spec), n).withColumn("loops", F.pandas_udf(run, "array<array<double>>")("u0", "u1", "u2", "u3"))
    sent = []
    for m, v in planes(spec):
        here = [F.col(g).alias(g) for g in spec.g]
        for of, at, slot in ((m, here, 0), (v, moved(spec, m, 1), 1), (m, moved(spec, v, 1), 2), (v, here, 3)):
            sent.append(F.when((F.col("mu") == m) & (F.col("nu") == v), F.struct(*at, F.lit(of).alias("mu"), F.get("loops", F.lit(slot)).alias("w"))))
    rows = per.select("level", F.explode(F.filter(F.array(*sent), lambda x: x.isNotNull())).alias("s")).select("level", "s.*").where(A.inside(A.cols(spec.g)))
    sums = rows.groupBy("level", *spec.g, "mu").agg(F.array(*(F.sum(F.get("w", F.lit(k))) for k in range(2 * n * n))).alias("w"))
    return sums.select("level", *spec.g, "mu", M.scaled(M.projected(F.col("w")), -beta / n).alias("f"))


def kinetic_energy(momenta: DataFrame) -> DataFrame:
    """kinetic: half the sum of squared norms of p."""
    return momenta.agg(F.coalesce(F.sum(M.norm_squared(F.col("p"))) / 2, F.lit(0.0)).alias("kinetic"))


def random_momenta(links: DataFrame, spec: MeshSpec, n: int, seed: int) -> DataFrame:
    """level, g0 ..., mu, p: Gaussian algebra elements, from the link's key and the seed alone."""

    def run(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            dice = np.random.default_rng(abs(int(k)))
            out.append(M.to_algebra(dice.normal(size=(1, n, n)) + 1j * dice.normal(size=(1, n, n))))
        return M.pack(np.concatenate(out) if out else np.empty((0, n, n), complex))

    return links.select("level", *spec.g, "mu", F.pandas_udf(run, "array<double>")(F.xxhash64(F.lit(seed), "level", *spec.g, "mu")).alias("p"))


def transported_spinors(psi: DataFrame, links: DataFrame, spec: MeshSpec, n: int) -> DataFrame:
    """level, g0 ..., mu, side, v: U psi(x + mu) (side 1) and U+ psi(x - mu) (side -1). psi: v, spin times color complex numbers, color fastest."""
    kinds = []
    for m in range(spec.nd):
        kinds.append(F.struct(*moved(spec, m, -1), F.lit(m).alias("mu"), F.lit(1).alias("side")))
        kinds.append(F.struct(*(F.col(g).alias(g) for g in spec.g), F.lit(m).alias("mu"), F.lit(-1).alias("side")))
    rows = psi.select("level", F.explode(F.array(*kinds)).alias("k"), "v").select("level", "k.*", "v").where(A.inside(A.cols(spec.g)))
    linked = rows.join(links.select("level", *spec.g, "mu", "u"), ["level", *spec.g, "mu"], "left").withColumn("u", F.coalesce("u", M.identity(n)))

    def run(u: pd.Series, v: pd.Series, side: pd.Series) -> pd.Series:
        m = M.unpack(u)
        back = side.to_numpy() < 0
        m[back] = M.adjoint(m[back])
        z = np.stack(v.to_numpy()).reshape(len(v), -1, n, 2)
        z = np.einsum("rij,rsj->rsi", m, z[..., 0] + 1j * z[..., 1])
        return pd.Series(list(np.stack((z.real, z.imag), -1).reshape(len(z), -1)))

    turned = linked.withColumn("v", F.pandas_udf(run, "array<double>")("u", "v", "side")).drop("u")
    step = lambda d: F.when((F.col("side") == -1) & (F.col("mu") == d), 1).otherwise(0)
    target = A.wrap(spec, [F.col(g) + step(d) for d, g in enumerate(spec.g)], F.col("level"))
    return turned.select("level", *(c.alias(g) for c, g in zip(target, spec.g, strict=True)), "mu", "side", "v").where(A.inside(A.cols(spec.g)))


def dirac(psi: DataFrame, links: DataFrame, spec: MeshSpec, n: int, mass: float, potential: Column, shifted: bool = False) -> DataFrame:
    """level, g0 ..., v of H psi = -i alpha . D psi + beta m psi + V psi, D over dimensions 1 to 3; shifted: (H - m) psi."""
    gamma = M.gammas()
    alphas = [gamma[0] @ gamma[k] for k in (1, 2, 3)]
    h = A.spacing(spec)

    def kinetic(v: pd.Series, mu: pd.Series, weight: pd.Series) -> pd.Series:
        z = np.stack(v.to_numpy()).reshape(len(v), 4, -1, 2)
        z = z[..., 0] + 1j * z[..., 1]
        a = np.array(alphas)[mu.to_numpy() - 1]
        z = -1j * np.einsum("rst,rtc->rsc", a, z) * weight.to_numpy()[:, None, None]
        return pd.Series(list(np.stack((z.real, z.imag), -1).reshape(len(z), -1)))

    def local(v: pd.Series, potential: pd.Series) -> pd.Series:
        z = np.stack(v.to_numpy()).reshape(len(v), 4, -1)
        sign = np.array([1, 1, -1, -1])[None, :, None]
        out = z * (mass * sign + potential.to_numpy()[:, None, None] - (mass if shifted else 0.0))
        return pd.Series(list(out.reshape(len(z), -1)))

    moved_rows = transported_spinors(psi, links, spec, n).where("mu between 1 and 3")
    terms = moved_rows.select("level", *spec.g, F.pandas_udf(kinetic, "array<double>")("v", "mu", F.col("side") / (2.0 * h)).alias("v"), F.lit(False).alias("own"))
    own = psi.select("level", *spec.g, F.pandas_udf(local, "array<double>")("v", potential).alias("v"), F.lit(True).alias("own"))
    every = own.unionByName(terms).groupBy("level", *spec.g).agg(F.array(*(F.sum(F.get("v", F.lit(k))) for k in range(8 * n))).alias("v"), F.max("own").alias("own"))
    return every.where("own").drop("own")


def dirac_step(psi: DataFrame, links: DataFrame, spec: MeshSpec, n: int, mass: float, potential: Column, dt: float) -> DataFrame:
    """psi - dt (H - m)^2 psi."""
    twice = dirac(dirac(psi, links, spec, n, mass, potential, True), links, spec, n, mass, potential, True)
    return psi.join(twice.withColumnRenamed("v", "_v"), ["level", *spec.g]).select("level", *spec.g, M.added(F.col("v"), F.col("_v"), -dt).alias("v"))


def spinor_norm(psi: DataFrame, spec: MeshSpec) -> DataFrame:
    return psi.agg(F.coalesce(F.sum(M.norm_squared(F.col("v")) * A.cell_volume(spec)), F.lit(0.0)).alias("norm_sq"))


def spinor_energy(psi: DataFrame, h_psi: DataFrame, spec: MeshSpec) -> DataFrame:
    """energy: Re <psi, H psi>, not divided by the norm."""
    both = psi.join(h_psi.withColumnRenamed("v", "_v"), ["level", *spec.g])
    dot = F.aggregate(F.zip_with("v", "_v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.agg(F.coalesce(F.sum(dot * A.cell_volume(spec)), F.lit(0.0)).alias("energy"))
