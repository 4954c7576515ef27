"""Loops and links: conservation, gradients, convergence, and what adaptation leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import algebra as G
from meshlark.functions import matrices as M
from meshlark.operators import adapt, gauge, measure, partition, special_unitary
from meshlark.plans import evolution, hmc, spinors
from meshlark.sources import dataset, lattice
from meshlark.sources.lattice import spine
from meshlark.spec import MeshSpec

SPEC = MeshSpec((4, 4), 4, True, 1.0, 1)
WIDE = MeshSpec((16, 16), 4, True, 1.0, 2)


@pytest.fixture(scope="module")
def two_levels(spark):
    """psi and links on a mesh with one refined block in four."""
    cells = spine(spark, WIDE).withColumn("u", F.sin(F.col("g0") * 0.4) + F.cos(F.col("g1") * 0.9))
    blocks = cells.select("level", (F.floor(F.col("g0") / 4)).alias("b0"), F.floor(F.col("g1") / 4).alias("b1")).distinct().where("b0 % 2 = 1 and b1 % 2 = 0")
    mesh = adapt.refine(cells, blocks, WIDE, preserve_norm=False)
    psi = mesh.select("level", *WIDE.g, F.col("u").alias("re"), (F.col("g0") * 0.1).alias("im")).cache()
    return psi, spark.createDataFrame([], "level int, g0 long, g1 long, mu int, theta double")


def totals(psi, spec):
    return [measure.total(psi, spec, c).first()["total"] for c in ("re", "im")]


def test_flux_correction_conserves(two_levels):
    """Without a potential the sum of psi over the volume stays, which it does not without the correction."""
    psi, links = two_levels
    h = gauge.hamiltonian(psi, links, WIDE, 0.5, F.lit(0.0), levels=True).withColumnsRenamed({"re": "_re", "im": "_im"})
    plain = psi.join(h, ["level", *WIDE.g]).select("level", *WIDE.g, *((F.col(c) - 0.05 * F.col(f"_{c}")).alias(c) for c in ("re", "im")))
    out = evolution.evolve_adaptive(psi, links, WIDE, 0.5, F.lit(0.0), 0.05, 1, normalize_every=0)
    size = measure.norm_squared(psi, WIDE, F.lit(1.0)).first()[0]
    before, after, other = totals(psi, WIDE), totals(out, WIDE), totals(plain, WIDE)
    ratio = after[1] / after[0]
    assert size == pytest.approx(256) and ratio == pytest.approx(before[1] / before[0], rel=1e-9)
    assert abs(other[1] / other[0] - before[1] / before[0]) > 1e-6


def test_adaptation_in_the_loop(two_levels):
    psi, links = two_levels
    out = evolution.evolve_adaptive(psi, links, WIDE, 1.0, F.lit(0.0), 0.02, 2, adapt_every=2, threshold=1e9, hysteresis=1e9)
    assert {r["level"] for r in out.select("level").distinct().collect()} == {0}
    norm = measure.norm_squared(out, WIDE, F.col("re") * F.col("re") + F.col("im") * F.col("im")).first()[0]
    assert norm == pytest.approx(1.0)


def test_force_is_the_gradient(spark):
    for n, direction in ((1, np.array([[1j]])), (2, 1j * M.PAULI[1])):
        links = special_unitary.haar_links(spine(spark, SPEC), SPEC, n, 3).cache()
        numeric, analytic = hmc.gradient_check(links, SPEC, n, 1.7, (F.col("g0") == 1) & (F.col("g1") == 2) & (F.col("mu") == 0), direction)
        assert numeric == pytest.approx(analytic, abs=1e-5) and abs(numeric) > 1e-3


def test_hmc_accepts_short_steps(spark):
    links = special_unitary.haar_links(spine(spark, SPEC), SPEC, 2, 5).cache()
    new, said = hmc.hmc_step(links, SPEC, 2, 1.5, 0.01, 3, 4)
    assert said["accepted"] and abs(said["delta"]) < 0.05
    u = M.unpack(new.toPandas()["u"])
    assert np.allclose(u @ M.adjoint(u), np.eye(2), atol=1e-9) and np.allclose(np.linalg.det(u), 1, atol=1e-9)
    again = links.join(new.withColumnRenamed("u", "w"), ["level", *SPEC.g, "mu"]).where(M.norm_squared(G.subtracted(F.col("u"), F.col("w"))) > 1e-12)
    assert again.count() == links.count()


def test_dirac_converges(spark):
    spec = MeshSpec((4, 4, 4, 4), 4, True, 1.0, 1)
    v = F.array(*(F.sin(F.col("g1") * (k + 1.0)) for k in range(8)))
    psi = spine(spark, spec).where("g0 = 0").withColumn("v", v)
    none = spark.createDataFrame([], "level int, g0 long, g1 long, g2 long, g3 long, mu int, u array<double>")
    out, said = spinors.evolve_until(psi, none, spec, 1, 0.5, F.lit(0.0), 0.2, 1e-1, 12, 4)
    assert said["converged"] and said["steps"] <= 12
    assert special_unitary.spinor_norm(out, spec).first()[0] == pytest.approx(1.0)


def test_samplers_and_gamma5():
    u = M.near_identity(np.random.default_rng(1), 100, 3, 0.01)
    assert np.allclose(u @ M.adjoint(u), np.eye(3)) and np.allclose(np.linalg.det(u), 1) and np.abs(u - np.eye(3)).max() < 0.2
    g, g5 = M.gammas(), M.gamma5()
    assert np.allclose(g5 @ g5, np.eye(4)) and all(np.allclose(g5 @ x + x @ g5, 0) for x in g)


def test_three_by_three_in_columns(spark):
    u = M.haar(np.random.default_rng(2), 20, 3)
    df = spark.createDataFrame([(x.tolist(),) for x in M.pack(u * 1.5)], "m array<double>")
    m = F.col("m")
    rows = df.select(G.determinant(m, 3).alias("d"), G.is_unitary(m, 3).alias("not"), G.is_unitary(M.scaled(m, 1 / 1.5), 3).alias("is"), G.multiplied(m, G.adjoint(m, 3), 3).alias("p")).collect()
    for r, x in zip(rows, u, strict=True):
        det = np.linalg.det(x * 1.5)
        assert r["d"]["re"] == pytest.approx(det.real) and r["d"]["im"] == pytest.approx(det.imag, abs=1e-9) and r["is"] and not r["not"]
        assert r["p"] == pytest.approx((2.25 * np.stack((np.eye(3), np.zeros((3, 3))), -1)).ravel().tolist(), abs=1e-9)


def test_inserted_blocks(spark):
    blocks = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "level int, b0 long, b1 long")
    assert lattice.insert_blocks(blocks, spark.createDataFrame([(1, 0, 0)], blocks.schema), SPEC).count() == 3
    with pytest.raises(Exception, match="BlockAlreadyExists"):
        lattice.insert_blocks(blocks, blocks.limit(1), SPEC).collect()


def test_spec():
    assert WIDE.fully_periodic and not WIDE.fully_open and MeshSpec((8,), 4, False).fully_open
    for bad in ({"sites": ()}, {"sites": (6,), "block_size": 4}, {"sites": (8,), "block_size": 3}, {"sites": (8, 8), "block_size": 4, "periodic": (True,)}):
        with pytest.raises(ValueError, match="."):
            MeshSpec(**bad)


def test_repartition(spark):
    cells = spine(spark, WIDE).withColumn("u", F.when(F.col("g0") < 4, 5.0).otherwise(0.1))
    weights = partition.entropy_weights(cells, WIDE, F.col("u") * F.col("u"))
    blocks, dealt = partition.repartition_if_needed(cells, weights.withColumn("owner", F.lit(0)), WIDE, 2)
    assert dealt and not partition.repartition_if_needed(cells, blocks.select("level", *WIDE.b, "owner", "weight"), WIDE, 2, 1.0, 1.0)[1]
    links = cells.select("level", *WIDE.g, F.lit(0).alias("mu"), F.col("u").alias("theta"))
    for table in (cells, links):  # links ride along with their cells
        out = partition.repartition(table, blocks, WIDE, 2).withColumn("at", F.spark_partition_id())
        assert out.count() == table.count() and out.where("at <> owner").isEmpty()


def test_dataset(spark, tmp_path):
    out = dataset.generate(spark, f"file://{tmp_path}/made", 2, MeshSpec((4, 4), 4, True, 0.5, 1), 1, steps=2)
    per = out.groupBy("sample").agg(F.count("*").alias("n"), F.sum((F.col("re") ** 2 + F.col("im") ** 2) * 0.25).alias("norm"), F.max("n_centers").alias("c")).collect()
    assert [r["n"] for r in per] == [16, 16] and all(r["norm"] == pytest.approx(1) and 1 <= r["c"] <= 4 for r in per)


def test_sampling_loop(spark):
    steps, noise = 6, [0.1, -0.2, 0.3, 0.0, 0.5, -0.4]
    schedule = [r.asDict() for r in evolution.noise_schedule(spark, steps).orderBy("t").collect()]
    x = 0.7
    for t in reversed(range(steps)):
        s = schedule[t]
        x = (x - s["beta"] * (0.5 * x) / np.sqrt(1 - s["alpha_bar"])) / np.sqrt(s["alpha"]) + (np.sqrt(s["posterior_variance"]) * noise[t] if t else 0)
    df = spark.createDataFrame([(0.7, noise)], "x double, noise array<double>")
    assert evolution.sample(df, steps, lambda v, t: 0.5 * v).first()["x"] == pytest.approx(x)
