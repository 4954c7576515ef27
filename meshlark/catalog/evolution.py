"""Queries on loops: imaginary time, adaptation, V-cycles, noise schedules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from meshlark.catalog._register import SPEC, plain, query, r6, sql6
from meshlark.catalog.gauge import ENERGY, links, potential, psi
from meshlark.operators import measure
from meshlark.plans import evolution as E
from meshlark.spec import MeshSpec


@query("imaginary_step", f"WITH {ENERGY} SELECT level, g0, g1, {sql6('pr - 0.05 * re')} AS re, {sql6('pi_ - 0.05 * im')} AS im FROM h")
def imaginary_step(spark, sf_dir):
    out = E.imaginary_step(psi(spark, sf_dir), links(spark, sf_dir), SPEC, 1.0, potential(), 0.05)
    return out.withColumns({c: r6(F.col(c)) for c in ("re", "im")})


def _steps(n: int) -> str:
    """SQL: psi0 ... psi<n>, each a normalized step of imaginary time after the one before."""
    first = ENERGY.index("psi AS (")
    head, body = ENERGY[:first], ENERGY[ENERGY.index("sides AS (") :]
    out = [head + re.sub(r"\bpsi\b", "psi0", ENERGY[first : ENERGY.index("sides AS (")]).rstrip().rstrip(",")]
    for k in range(n):
        part = re.sub(r"\b(psi|sides|turned|lap|h)\b", lambda m, k=k: f"{m[1]}{k}", body)
        out.append(f"{part}, moved{k} AS MATERIALIZED (SELECT level, g0, g1, pr - 0.05 * re AS re, pi_ - 0.05 * im AS im FROM h{k}), psi{k + 1} AS MATERIALIZED (SELECT level, g0, g1, re / n AS re, im / n AS im FROM moved{k}, (SELECT sqrt(sum(re * re + im * im)) AS n FROM moved{k}))")
    return ", ".join(out)


@query("evolve_five_steps", f"WITH {_steps(5)} SELECT level, g0, g1, {sql6('re')} AS re, {sql6('im')} AS im FROM psi5")
def evolve_five_steps(spark, sf_dir):
    out = E.evolve(psi(spark, sf_dir), links(spark, sf_dir), SPEC, 1.0, potential(), 0.05, 5)
    return out.withColumns({c: r6(F.col(c)) for c in ("re", "im")})


@query("adapt_mesh")
def adapt_mesh(spark, sf_dir):
    """Cells and their sum by level after adaptation at 1.1 times the mean block gradient of the lattice."""
    from meshlark.operators.stencil import block_gradient

    base = plain(spark, sf_dir)
    mean = block_gradient(base, SPEC).agg(F.avg("grad").alias("m")).first()["m"]
    out = E.adapt_mesh(base, SPEC, 1.1 * mean, 0.5)
    return out.cells.groupBy("level").agg(F.count("*").alias("cells"), F.sum("u").alias("total"))


@query("v_cycle")
def v_cycle(spark, sf_dir):
    """Two V-cycles of the Poisson equation on level 1, the source being the lattice less its mean: squared residual after each."""
    fine = E.written(plain(spark, sf_dir).withColumn("level", F.lit(1)))
    mean = fine.agg(F.avg("u").alias("m"))
    half = MeshSpec(tuple(n // 2 for n in SPEC.sites), SPEC.block_size, True, 2.0, 3)
    f = E.written(fine.crossJoin(F.broadcast(mean)).select("level", *SPEC.g, (F.col("u") - F.col("m")).alias("u")))
    u, rows = f.withColumn("u", F.lit(0.0)), []
    for k in range(3):
        r = E.residual(u, f, half)
        rows.append(measure.norm_squared(r, half, F.col("u") * F.col("u")).select(F.lit(k).alias("cycle"), "norm_sq"))
        u = E.v_cycle(u, f, half, 1) if k < 2 else u
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("noise_schedule", f"""WITH s AS (SELECT range AS t, 1e-4 + range * ((0.02 - 1e-4) / 999) AS beta FROM range(1000)), p AS (SELECT *, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS bar FROM s),
q AS (SELECT *, coalesce(lag(bar) OVER (ORDER BY t), 1.0) AS before FROM p)
SELECT t, {sql6('beta')} AS beta, {sql6('bar')} AS alpha_bar, {sql6('beta * (1 - before) / (1 - bar)')} AS posterior_variance FROM q""")
def noise_schedule(spark, sf_dir):
    return E.noise_schedule(spark).select("t", *(r6(F.col(c)).alias(c) for c in ("beta", "alpha_bar", "posterior_variance")))


@query("add_noise", f"""WITH s AS (SELECT range AS t, 1e-4 + range * ((0.02 - 1e-4) / 999) AS beta FROM range(1000)), p AS (SELECT *, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS bar FROM s),
v AS (SELECT vec_id, vec_id % 1000 AS t, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(list_reverse(embedding)) AS DOUBLE) AS n FROM embeddings) SELECT vec_id, t, k, {sql6('sqrt(bar) * x + sqrt(1 - bar) * n')} AS x FROM v JOIN p USING (t)""")
def add_noise(spark, sf_dir):
    """All components, each noised by the one that mirrors it."""
    pairs = F.arrays_zip("embedding", F.reverse("embedding").alias("noise"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.col("vec_id") % 1000).alias("t"), F.posexplode(pairs).alias("k", "c"))
    rows = rows.select("vec_id", "t", F.col("k").cast("long").alias("k"), F.col("c.embedding").cast("double").alias("x"), F.col("c.noise").cast("double").alias("noise"))
    return E.add_noise(rows, E.noise_schedule(spark)).select("vec_id", "t", "k", r6(F.col("x")).alias("x"))
