"""What must not go through the driver, and the steps that work on many blocks or sweeps at once."""

import __spark_entry__ as entry


def broadcast_joins(df):
    """The broadcast joins of a plan but for those with a single row."""
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "BroadcastHashJoin" in line]


def test_links_and_halos_are_not_broadcast(spark, sf_dir):
    """Files of links are far smaller than their rows; under the default threshold whole tables went to the driver."""
    for name in ("cov_laplacian_levels", "cov_face_fluxes_u1", "synced_links_u1", "halo_fine_to_coarse"):
        assert broadcast_joins(entry.queries()[name](spark, sf_dir)) == [], name


def test_a_step_over_levels_is_not_broadcast(spark, sf_dir, monkeypatch):
    """Neither the tables that a step writes nor its result come from a broadcast of cells; the norm, one row, is."""
    from meshlark.plans import evolution

    seen, put = [], evolution.written
    monkeypatch.setattr(evolution, "written", lambda df: (seen.append(broadcast_joins(df)), put(df))[1])
    entry.queries()["imaginary_step_levels"](spark, sf_dir)
    assert len(seen) >= 3 and seen == [[]] * len(seen)


def test_kernel_calls_are_few(spark):
    """A call of pandas serves many blocks: 128 blocks of a small lattice took 128 calls; the kernel still sees one block with its ghosts."""
    from pyspark.sql import functions as F

    from meshlark.operators import stencil
    from meshlark.spec import MeshSpec

    spec = MeshSpec((32, 64), 4, (True, False))
    cells = spark.range(32 * 64).select(F.lit(0).alias("level"), (F.col("id") % 32).alias("g0"), F.floor(F.col("id") / 32).cast("long").alias("g1"), (F.col("id") * 7 % 101).cast("double").alias("u"))
    cells = cells.where("g0 != 5 or g1 != 9")

    def kernel(u, ghosts, level):
        assert u.shape == (4, 4) and all(g.shape == (4,) for g in ghosts.values())
        out = -4 * u
        out[1:] += u[:-1]
        out[:-1] += u[1:]
        out[:, 1:] += u[:, :-1]
        out[:, :-1] += u[:, 1:]
        out[-1] += ghosts[0]
        out[0] += ghosts[1]
        out[:, -1] += ghosts[2]
        out[:, 0] += ghosts[3]
        return out

    new = stencil.apply_kernel(cells, spec, kernel)
    got = {(r["g0"], r["g1"]): r["u"] for r in new.collect()}
    want = {(r["g0"], r["g1"]): r["lap"] for r in stencil.laplacian(cells, spec).collect()}
    assert got == want and len(got) == 32 * 64 - 1
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [level" in plan and "b0#" not in plan.split("FlatMapGroupsInPandas")[1].split("],")[0]


def test_a_step_is_computed_once(spark, sf_dir, monkeypatch):
    """Fields and links are written first, then one table a step, before its norm is taken; no step works on the lineitems again."""
    from meshlark.plans import evolution

    plans, put = [], evolution.written
    monkeypatch.setattr(evolution, "written", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), put(df))[1])
    entry.queries()["evolve_five_steps"](spark, sf_dir)
    assert len(plans) == 7 and all("l_quantity" in p for p in plans[:2])
    assert not any("l_quantity" in p for p in plans[2:])


def test_sweeps_in_tiles(spark, monkeypatch):
    """Several sweeps from one exchange give what single sweeps give: tiles, cut tiles, wrapped, open and missing cells, one tile alone."""
    import numpy as np
    from pyspark.sql import functions as F

    from meshlark.operators import stencil
    from meshlark.plans import evolution
    from meshlark.spec import MeshSpec

    for sites, periodic, tile, sweeps in (((24, 40), True, 1 << 8, 4), ((8, 8), (True, False), 1 << 14, 4), ((40, 12), False, 1 << 6, 3), ((12, 8, 4), True, 1 << 6, 4)):
        monkeypatch.setattr(stencil, "TILE", tile)
        spec, n = MeshSpec(sites, 4, periodic, 2.0), int(np.prod(sites)) * 2 ** len(sites)
        at, below = [], 1
        for s, g in zip(sites, spec.g, strict=True):
            at.append((F.floor(F.col("id") / below) % (2 * s)).cast("long").alias(g))
            below *= 2 * s
        u = spark.range(n).where("id % 17 > 0").select(F.lit(1).alias("level"), *at, (F.col("id") * 7 % 101 / 10).alias("u"))
        f = spark.range(n).where("id % 29 > 0").select(F.lit(1).alias("level"), *at, (F.col("id") * 11 % 37 / 10).alias("u"))
        one = u
        for _ in range(sweeps):
            one = evolution.written(evolution.jacobi(one, f, spec))
        lap = stencil.laplacian(one, spec).join(f.withColumnRenamed("u", "f"), ["level", *spec.g]).select("level", *spec.g, (F.col("f") - F.col("lap")).alias("u"))
        many = stencil.relaxed(u, f, spec, sweeps)
        for got, want in ((many, one), (evolution.residual(one, f, spec), lap)):
            got, want = ({tuple(r)[:-1]: r["u"] for r in df.collect()} for df in (got, want))
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want), (sites, periodic)


def test_a_v_cycle_writes_few_steps(spark, monkeypatch):
    """Smoothing, correction and smoothing on two levels: 14 tables for each cycle of single sweeps."""
    from pyspark.sql import functions as F

    from meshlark.plans import evolution
    from meshlark.spec import MeshSpec

    seen, put = [], evolution.written
    monkeypatch.setattr(evolution, "written", lambda df: (seen.append(1), put(df))[1])
    spec = MeshSpec((8, 8), 8, True, 2.0)
    f = spark.range(256).select(F.lit(1).alias("level"), (F.col("id") % 16).alias("g0"), F.floor(F.col("id") / 16).cast("long").alias("g1"), (F.col("id") % 2 - 0.5).alias("u"))
    assert evolution.v_cycle(f.withColumn("u", F.lit(0.0)), f, spec, 1).count() == 256
    assert len(seen) == 5
