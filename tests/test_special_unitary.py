"""Matrices, SU(N) links, spinors, checkpoints and lattice files: identities and round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import matrices as M
from meshlark.operators import special_unitary
from meshlark.plans import hmc
from meshlark.sources import checkpoint, sunfile
from meshlark.sources.lattice import spine
from meshlark.spec import MeshSpec

SPEC = MeshSpec((4, 4), 4, True, 1.0, 1)


def test_matrices():
    u = M.haar(np.random.default_rng(1), 200, 3)
    one = np.eye(3)
    assert np.allclose(u @ M.adjoint(u), one) and np.allclose(np.linalg.det(u), 1)
    assert np.allclose(M.expm(M.logm(u)), u) and np.allclose(M.unitarize(u * 1.7), u, atol=1e-8)
    theta = 0.7
    assert np.allclose(M.expm(1j * theta * M.PAULI[:1])[0], np.cos(theta) * np.eye(2) + 1j * np.sin(theta) * M.PAULI[0])
    g = M.gell_mann()
    assert np.allclose(np.einsum("aij,bji->ab", g, g), 2 * np.eye(8))
    metric = np.diag([1, -1, -1, -1])
    gamma = M.gammas()
    for a in range(4):
        for b in range(4):
            assert np.allclose(gamma[a] @ gamma[b] + gamma[b] @ gamma[a], 2 * metric[a, b] * np.eye(4))


@pytest.mark.parametrize("n", [1, 2])
def test_action_of_identity_and_force(spark, n):
    cells = spine(spark, SPEC)
    links = cells.select("level", *SPEC.g, F.explode(F.array(F.lit(0), F.lit(1))).alias("mu"), M.identity(n).alias("u"))
    assert special_unitary.wilson_action(links, SPEC, n, 2.0).first()[0] == pytest.approx(0)
    assert special_unitary.forces(links, SPEC, n, 2.0).select(F.sum(M.norm_squared(F.col("f")))).first()[0] == pytest.approx(0)


def test_leapfrog_energy_error_falls(spark):
    """Half the step, about a quarter of the error: the force is the gradient of the action."""
    links = special_unitary.haar_links(spine(spark, SPEC), SPEC, 2, 7).cache()
    momenta = special_unitary.random_momenta(links, SPEC, 2, 8).cache()
    before = hmc.hamiltonian(links, momenta, SPEC, 2, 1.5)
    errors = [abs(hmc.hamiltonian(*hmc.leapfrog(links, momenta, SPEC, 2, 1.5, 0.1 / k, 2 * k), SPEC, 2, 1.5) - before) for k in (1, 2)]
    assert errors[1] < 0.4 * errors[0]


def test_dirac_of_constant_spinor(spark):
    spec = MeshSpec((4, 4, 4, 4), 4, True, 1.0, 1)
    v = F.array(*(F.lit(float(k == 0)) for k in range(8)))
    psi = spine(spark, spec).where("g0 = 0").withColumn("v", v)
    out = special_unitary.dirac(psi, spark.createDataFrame([], "level int, g0 long, g1 long, g2 long, g3 long, mu int, u array<double>"), spec, 1, 0.5, F.lit(0.25))
    rows = out.collect()
    assert len(rows) == 64 and all(r["v"] == pytest.approx([0.75] + [0.0] * 7) for r in rows)


def test_checkpoint(spark, tmp_path):
    cells = spine(spark, SPEC).withColumn("u", F.col("g0") + 0.5)
    checkpoint.write(f"file://{tmp_path}", 3, SPEC, cells=cells)
    back = checkpoint.read(spark, f"file://{tmp_path}", 3, SPEC)["cells"]
    assert sorted(map(tuple, back.select(*cells.columns).collect())) == sorted(map(tuple, cells.collect()))
    with pytest.raises(checkpoint.CheckpointError, match="sites"):
        checkpoint.read(spark, f"file://{tmp_path}", 3, MeshSpec((8, 8), 8, True))


def test_sun_round_trip(spark, tmp_path):
    dice = np.random.default_rng(2)
    rows = [{"level": k, "origin": [4 * k, 0, 0, 0], "block_size": 4, "n_gauge": 1, "n_field": 2, "density": dice.random(256), "field": dice.random(1024), "links": dice.random(1024), "plaquettes": dice.random(1536)} for k in range(2)]
    (tmp_path / "frame0007.sun").write_bytes(sunfile.encode(rows, 0.5, 11))
    got = sunfile.frames(sunfile.read_sun(spark, f"file://{tmp_path}")).orderBy("block").collect()
    assert [r["spacing"] for r in got] == [0.5, 0.25] and got[0]["time_slice"] == 11 and got[0]["frame"] == 7
    for r, want in zip(got, rows, strict=True):
        assert all(np.array_equal(r[c], want[c]) for c in ("density", "field", "links", "plaquettes")) and r["origin"] == want["origin"]
    with pytest.raises(ValueError, match="not a .sun file"):
        list(sunfile.parse("x", b"BAD!" + bytes(60)))
