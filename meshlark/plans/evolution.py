"""Loops in the driver over steps that Spark runs: imaginary time, adaptation to a fixed point, V-cycles.

Each step's state is written to the shared folder, so plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.operators import adapt, flux, gauge, measure, stencil, transfer
from meshlark.operators._common import blocks_of, written
from meshlark.spec import MeshSpec


def imaginary_step(psi: DataFrame, links: DataFrame, spec: MeshSpec, mass: float, potential: Column, dt: float) -> DataFrame:
    """psi - dt H psi."""
    return _stepped(gauge.beside_hamiltonian(psi, links, spec, mass, potential), spec, dt)


def _stepped(both: DataFrame, spec: MeshSpec, dt: float) -> DataFrame:
    """psi - dt H psi from psi and H psi side by side."""
    return both.select("level", *spec.g, *((F.col(c) - dt * F.col(f"_{c}")).alias(c) for c in ("re", "im")))


def normalize(psi: DataFrame, spec: MeshSpec) -> DataFrame:
    return measure.normalized(psi, spec, F.col("re") * F.col("re") + F.col("im") * F.col("im"), ("re", "im"))


def evolve(psi: DataFrame, links: DataFrame, spec: MeshSpec, mass: float, potential: Column, dt: float, steps: int, normalize_every: int = 1) -> DataFrame:
    """`steps` steps of imaginary time, normalized every so often and at the end.

    The links are written once; a step is written before its norm is taken, as the norm and the division both read it.
    """
    if steps > 0:
        psi, links = written(psi), written(links)
    for k in range(1, steps + 1):
        psi = written(imaginary_step(psi, links, spec, mass, potential, dt))
        if normalize_every and k % normalize_every == 0:
            psi = normalize(psi, spec)
    return normalize(psi, spec)


def evolve_until(psi: DataFrame, links: DataFrame, spec: MeshSpec, mass: float, potential: Column, dt: float, tolerance: float, most: int = 1000, check: int = 100) -> tuple[DataFrame, dict]:
    """evolve() until the energy changes by less than the tolerance between checks: (psi, steps, energy, converged)."""
    before, steps = None, 0
    while steps < most:
        n = min(check, most - steps)
        psi = written(evolve(psi, links, spec, mass, potential, dt, n))
        steps += n
        now = gauge.energy(psi, gauge.hamiltonian(psi, links, spec, mass, potential), spec).first()["energy"]
        if before is not None and abs(now - before) < tolerance:
            return psi, {"steps": steps, "energy": now, "converged": True}
        before = now
    return psi, {"steps": steps, "energy": before, "converged": False}


def evolve_adaptive(psi: DataFrame, links: DataFrame, spec: MeshSpec, mass: float, potential: Column, dt: float, steps: int, normalize_every: int = 1, adapt_every: int = 0, threshold: float = 0.1, hysteresis: float = 0.5) -> DataFrame:
    """Imaginary time on a mesh of several levels: each step is corrected by the fluxes at faces between levels, then
    normalized and adapted every so often; normalized at the end.

    Fluxes carry the factor -dt / 2m, so that what leaves one level enters the other: without potential the sum of psi
    over the volume does not change. Links stay as they are; where an adapted mesh has none, the identity counts.
    """
    for k in range(1, steps + 1):
        fluxes = written(gauge.covariant_face_fluxes(psi, links, spec, -dt / (2.0 * mass)))
        psi = _stepped(gauge.beside_hamiltonian(psi, links, spec, mass, potential, levels=True), spec, dt)
        for c in ("re", "im"):
            psi = flux.reflux(psi, flux.flux_register(fluxes, spec, flux=c), spec, c)
        psi = written(psi)
        if normalize_every and k % normalize_every == 0:
            psi = written(normalize(psi, spec))
        if adapt_every and k % adapt_every == 0:
            psi = adapt_mesh(psi, spec, threshold, hysteresis, ("re", "im")).cells
    return normalize(psi, spec)


@dataclass(frozen=True)
class Adapted:
    cells: DataFrame
    refined: int
    coarsened: int

    @property
    def changed(self) -> bool:
        return bool(self.refined or self.coarsened)


def adapt_mesh(cells: DataFrame, spec: MeshSpec, threshold: float, hysteresis: float, value: str | tuple[str, ...] = "u", preserve_norm: bool = True) -> Adapted:
    """Refines all steep blocks until none is left, then blocks two levels too coarse for a neighbour, then merges flat siblings.

    Each pass treats all its blocks at once; the finest level bounds the passes. A merge that would put a block beside one
    two levels finer is left out. Of several value columns the gradient of their magnitude counts.
    """
    refined = coarsened = 0
    names = transfer.named(value)
    cells = written(cells.select("level", *spec.g, *names))

    def gradient() -> DataFrame:
        seen = F.col(names[0]) if len(names) == 1 else F.sqrt(sum((F.col(v) * F.col(v) for v in names[1:]), F.col(names[0]) * F.col(names[0])))
        return stencil.block_gradient(cells.select("level", *spec.g, seen.alias("_seen")), spec, "_seen")

    while True:
        steep = written(adapt.refine_flags(gradient(), spec, threshold).where("refine").select("level", *spec.b))
        n = steep.count()
        if not n:
            break
        cells, refined = written(adapt.refine(cells, steep, spec, value, preserve_norm)), refined + n
    while True:
        coarse = written(adapt.balance_violations(blocks_of(cells, spec), spec))
        n = coarse.count()
        if not n:
            break
        cells, refined = written(adapt.refine(cells, coarse, spec, value, preserve_norm)), refined + n
    while True:
        parents = written(adapt.coarsenable(gradient(), spec, threshold, hysteresis))
        if parents.isEmpty():
            break
        merged = blocks_of(adapt.coarsen(cells, parents, spec, value, preserve_norm), spec)
        allowed = written(parents.join(adapt.balance_violations(merged, spec), ["level", *spec.b], "left_anti"))
        n = allowed.count()
        if not n:
            break
        cells, coarsened = written(adapt.coarsen(cells, allowed, spec, value, preserve_norm)), coarsened + n
    return Adapted(cells, refined, coarsened)


def jacobi(u: DataFrame, f: DataFrame, spec: MeshSpec, weight: float = 0.8) -> DataFrame:
    """One weighted Jacobi sweep of lap u = f."""
    h2 = A.spacing(spec) * A.spacing(spec)
    lap = stencil.laplacian(u, spec)
    out = lap.join(f.select("level", *spec.g, F.col("u").alias("_f")), ["level", *spec.g])
    return out.select("level", *spec.g, (F.col("u") + weight * h2 / (2.0 * spec.nd) * (F.col("lap") - F.col("_f"))).alias("u"))


def smoothed(u: DataFrame, f: DataFrame, spec: MeshSpec, sweeps: int, smoother=jacobi) -> DataFrame:
    """u after that many sweeps, written; Jacobi sweeps go by as many at once as the tiles have room for."""
    most = stencil.sweeps_at_once(spec) if smoother is jacobi else 0
    while sweeps > 0:
        n = min(most, sweeps) or 1
        u = written(stencil.relaxed(u, f, spec, n) if most else smoother(u, f, spec))
        sweeps -= n
    return u


def residual(u: DataFrame, f: DataFrame, spec: MeshSpec) -> DataFrame:
    """f - lap u."""
    if stencil.sweeps_at_once(spec):
        return stencil.relaxed(u, f, spec, 0, residual=True)
    out = stencil.laplacian(u, spec).join(f.select("level", *spec.g, F.col("u").alias("_f")), ["level", *spec.g])
    return out.select("level", *spec.g, (F.col("_f") - F.col("lap")).alias("u"))


def v_cycle(u: DataFrame, f: DataFrame, spec: MeshSpec, level: int, sweeps: int = 2, coarsest_sweeps: int = 8, smoother=jacobi) -> DataFrame:
    """One V-cycle for lap u = f on a uniform level: smooth, restrict the residual, recurse, add the correction, smooth."""
    u = smoothed(u, f, spec, coarsest_sweeps if level == 0 else sweeps, smoother)
    if level == 0:
        return u
    r = written(transfer.restrict(residual(u, f, spec), spec))
    e = v_cycle(r.withColumn("u", F.lit(0.0)), r, spec, level - 1, sweeps, coarsest_sweeps, smoother)
    u = written(transfer.prolongate_into(u, e, spec, add=True))
    return smoothed(u, f, spec, sweeps, smoother)


def noise_schedule(spark, steps: int = 1000, first: float = 1e-4, last: float = 0.02) -> DataFrame:
    """t, beta, alpha, alpha_bar, alpha_bar_before and posterior_variance of a linear schedule; `steps` rows."""
    from pyspark.sql import Window as W

    upto = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    beta = F.lit(first) + F.col("t") * ((last - first) / max(steps - 1, 1))
    out = spark.range(steps).select(F.col("id").alias("t")).withColumn("beta", beta).withColumn("alpha", 1.0 - F.col("beta"))
    out = out.withColumn("alpha_bar", F.exp(F.sum(F.ln("alpha")).over(upto))).withColumn("alpha_bar_before", F.coalesce(F.lag("alpha_bar").over(W.orderBy("t")), F.lit(1.0)))
    return out.withColumn("posterior_variance", F.col("beta") * (1.0 - F.col("alpha_bar_before")) / (1.0 - F.col("alpha_bar")))


def add_noise(rows: DataFrame, schedule: DataFrame, value: str = "x", noise: str = "noise") -> DataFrame:
    """rows (t, value, noise) with the value noised to step t. The schedule has as many rows as steps."""
    s = schedule.select("t", "alpha_bar")
    return rows.join(F.broadcast(s), "t").withColumn(value, F.sqrt("alpha_bar") * F.col(value) + F.sqrt(1.0 - F.col("alpha_bar")) * F.col(noise)).drop("alpha_bar")


def denoise_step(rows: DataFrame, schedule: DataFrame, value: str = "x", predicted: str = "eps", noise: str = "noise") -> DataFrame:
    """One reverse step from t: the mean from the predicted noise, and noise of the posterior variance but at t = 0."""
    out = rows.join(F.broadcast(schedule), "t")
    mean = (F.col(value) - F.col("beta") * F.col(predicted) / F.sqrt(1.0 - F.col("alpha_bar"))) / F.sqrt("alpha")
    return out.withColumn(value, F.when(F.col("t") == 0, mean).otherwise(mean + F.sqrt("posterior_variance") * F.col(noise))).select(*rows.columns)


def sample(rows: DataFrame, steps: int, predict, value: str = "x", noise: str = "noise", first: float = 1e-4, last: float = 0.02) -> DataFrame:
    """rows with the value denoised from step steps - 1 down to 0.

    predict(x, t): the predicted noise as a column; noise: an array with one number a step. The schedule's few rows are
    literals and the loop is a fold within each row, so nothing is shuffled or written between steps.
    """
    table = noise_schedule(rows.sparkSession, steps, first, last).orderBy("t").collect()
    at = {c: F.array(*(F.lit(float(r[c])) for r in table)) for c in ("beta", "alpha", "alpha_bar", "posterior_variance")}

    def back(x: Column, t: Column) -> Column:
        s = {c: F.get(a, t) for c, a in at.items()}
        mean = (x - s["beta"] * predict(x, t) / F.sqrt(1.0 - s["alpha_bar"])) / F.sqrt(s["alpha"])
        return F.when(t == 0, mean).otherwise(mean + F.sqrt(s["posterior_variance"]) * F.get(noise, t))

    return rows.withColumn(value, F.aggregate(F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)), F.col(value), back))
