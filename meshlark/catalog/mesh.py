"""Queries on cells, blocks and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.catalog._register import B, CELLS, GRADIENTS, MESH, N, OPEN, SPEC, cells, key, mesh, mesh_blocks, plain, query, r6, sql6, table
from meshlark.functions import address as A
from meshlark.operators import adapt, flux, halo, knn, measure, neighbors, partition, stencil, transfer
from meshlark.operators._common import written

L = B - 1


@query("cells_basic", f"WITH {CELLS} SELECT level, g0, g1, u, c FROM cells")
def cells_basic(spark, sf_dir):
    return cells(spark, sf_dir)


@query("local_index", f"WITH {CELLS} SELECT g0, g1, CAST(g0 % {B} + {B} * (g1 % {B}) AS INTEGER) AS idx, g0 // {B} AS b0, g1 // {B} AS b1 FROM cells")
def local_index(spark, sf_dir):
    return cells(spark, sf_dir).select("g0", "g1", A.local_index(SPEC).alias("idx"), *A.block_coords(SPEC))


@query("global_coords", f"WITH {CELLS} SELECT g0, g1, CAST(g0 + 0 AS BIGINT) AS r0, CAST(g1 + 0 AS BIGINT) AS r1 FROM cells")
def global_coords(spark, sf_dir):
    keyed = cells(spark, sf_dir).select("g0", "g1", *A.block_coords(SPEC), A.local_index(SPEC).alias("i"))
    back = A.global_coords(SPEC, F.col("i"))
    return keyed.select("g0", "g1", back[0].cast("long").alias("r0"), back[1].cast("long").alias("r1"))


_MORTON = " + ".join(f"(((g{d} >> {k}) & 1) << {2 * k + d})" for d in range(2) for k in range(12))


@query("morton_encode", f"WITH {CELLS} SELECT g0, g1, CAST({_MORTON} AS BIGINT) AS morton FROM cells")
def morton_encode(spark, sf_dir):
    return cells(spark, sf_dir).select("g0", "g1", A.morton_encode(A.cols(SPEC.g), 12).alias("morton"))


@query("morton_decode_roundtrip", f"WITH {CELLS} SELECT CAST({_MORTON} AS BIGINT) AS morton, g0 AS d0, g1 AS d1 FROM cells")
def morton_decode_roundtrip(spark, sf_dir):
    keyed = morton_encode(spark, sf_dir)
    back = A.morton_decode(F.col("morton"), 2, 12)
    return keyed.select("morton", back[0].alias("d0"), back[1].alias("d1"))


@query("block_order", f"""WITH {MESH}, keyed AS (SELECT level, b0, b1, CAST({" + ".join(f"((((b{d} << (3 - level)) >> {k}) & 1) << {2 * k + d})" for d in range(2) for k in range(12))} AS BIGINT) AS morton FROM blocks)
SELECT level, b0, b1, morton, row_number() OVER (ORDER BY morton, level) - 1 AS rank FROM keyed""")
def block_order(spark, sf_dir):
    return partition.ordered(mesh_blocks(spark, sf_dir), SPEC).select("level", "b0", "b1", "morton", F.col("rank").cast("long").alias("rank"))


@query("block_key_compat", f"""WITH {MESH} SELECT level, b0, b1, CAST({" + ".join(f"((((b{d} << level) & ((1 << (CAST(log2({N} // {B}) AS INTEGER) + level)) - 1)) >> {k} & 1) << {2 * k + d})" for d in range(2) for k in range(12))} AS BIGINT) AS morton FROM blocks""")
def block_key_compat(spark, sf_dir):
    return mesh_blocks(spark, sf_dir).select("level", "b0", "b1", A.block_morton_compat(SPEC).alias("morton"))


@query("block_summary", f"WITH {MESH} SELECT level, g0 // {B} AS b0, g1 // {B} AS b1, count(*) AS n, sum(u) AS total, min(u) AS low, max(u) AS high FROM mesh GROUP BY 1, 2, 3")
def block_summary(spark, sf_dir):
    return mesh(spark, sf_dir).groupBy("level", *A.block_coords(SPEC)).agg(F.count("*").alias("n"), F.sum("u").alias("total"), F.min("u").alias("low"), F.max("u").alias("high"))


@query("level_counts", f"WITH {MESH} SELECT level, count(*) AS blocks FROM blocks GROUP BY 1")
def level_counts(spark, sf_dir):
    return mesh_blocks(spark, sf_dir).groupBy("level").agg(F.count("*").alias("blocks"))


@query("physical_positions", f"WITH {MESH} SELECT level, g0, g1, g0 / pow(2, level) AS x0, g1 / pow(2, level) AS x1, {B} / pow(2, level) AS extent FROM mesh")
def physical_positions(spark, sf_dir):
    return mesh(spark, sf_dir).select("level", "g0", "g1", *A.positions(SPEC), A.block_extent(SPEC).alias("extent"))


@query("position_to_block", f"WITH {MESH} SELECT level, g0, g1, CAST(floor(g0 / pow(2, level) / ({B} / pow(2, level))) AS BIGINT) AS b0, CAST(floor(g1 / pow(2, level) / ({B} / pow(2, level))) AS BIGINT) AS b1 FROM mesh")
def position_to_block(spark, sf_dir):
    return mesh(spark, sf_dir).select("level", "g0", "g1", *A.block_of_position(SPEC, A.positions(SPEC), F.col("level")))


@query("boundary_cells", f"WITH {CELLS} SELECT g0, g1 FROM cells WHERE g0 % {B} IN (0, {L}) OR g1 % {B} IN (0, {L})")
def boundary_cells(spark, sf_dir):
    return cells(spark, sf_dir).where(A.on_boundary(SPEC)).select("g0", "g1")


@query("face_extract", f"WITH {CELLS} SELECT g0 // {B} AS b0, g1 // {B} AS b1, CAST(g1 % {B} AS INTEGER) AS face_idx, u FROM cells WHERE g0 % {B} = {L}")
def face_extract(spark, sf_dir):
    return transfer.boundary_face(cells(spark, sf_dir), SPEC, 0).select("b0", "b1", "face_idx", "u")


@query("wrap_periodic", f"WITH {CELLS} SELECT g0, g1, (g0 - 5 + {N}) % {N} AS w0, (g1 + 7) % {N} AS w1 FROM cells")
def wrap_periodic(spark, sf_dir):
    w = A.wrap(SPEC, [F.col("g0") - 5, F.col("g1") + 7], F.col("level"))
    return cells(spark, sf_dir).select("g0", "g1", w[0].alias("w0"), w[1].alias("w1"))


@query("wrap_open", f"WITH {CELLS} SELECT g0, g1, CASE WHEN g0 >= 5 THEN g0 - 5 END AS w0, CASE WHEN g1 < {N} - 7 THEN g1 + 7 END AS w1 FROM cells")
def wrap_open(spark, sf_dir):
    w = A.wrap(OPEN, [F.col("g0") - 5, F.col("g1") + 7], F.col("level"))
    return cells(spark, sf_dir).select("g0", "g1", w[0].alias("w0"), w[1].alias("w1"))


@query("threshold_points", f"WITH {MESH} SELECT g0 / pow(2, level) AS x0, g1 / pow(2, level) AS x1, u FROM mesh WHERE u > (SELECT avg(u) FROM cells)")
def threshold_points(spark, sf_dir):
    mean = plain(spark, sf_dir).agg(F.avg("u").alias("m"))
    return mesh(spark, sf_dir).crossJoin(F.broadcast(mean)).where("u > m").select(*A.positions(SPEC), "u")


@query("zero_level", f"WITH {MESH} SELECT level, g0, g1, CASE WHEN level = 1 THEN 0.0 ELSE u END AS u FROM mesh")
def zero_level(spark, sf_dir):
    return transfer.zero_level(mesh(spark, sf_dir), 1)


_BEYOND = f"""faces AS (SELECT * FROM (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) f(face, dx, dy)),
beyond AS (SELECT level, b0, b1, CAST(face AS INTEGER) AS face, dx, dy, (b0 + dx + ({N} // {B} << level)) % ({N} // {B} << level) AS p0, (b1 + dy + ({N} // {B} << level)) % ({N} // {B} << level) AS p1 FROM blocks, faces)"""


@query("neighbors_same_level", f"WITH {MESH}, {_BEYOND} SELECT x.level, x.b0, x.b1, x.face, n.b0 AS n0, n.b1 AS n1 FROM beyond x JOIN blocks n ON n.level = x.level AND n.b0 = p0 AND n.b1 = p1")
def neighbors_same_level(spark, sf_dir):
    return neighbors.neighbors(mesh_blocks(spark, sf_dir), SPEC).where("level_diff = 0").select("level", "b0", "b1", "face", "n0", "n1")


@query("neighbors_cross_level", f"""WITH {MESH}, {_BEYOND} SELECT x.level, x.b0, x.b1, x.face, n.level AS n_level, n.b0 AS n0, n.b1 AS n1, n.level - x.level AS level_diff FROM beyond x
JOIN blocks n ON (n.level = x.level AND n.b0 = p0 AND n.b1 = p1) OR (n.level = x.level - 1 AND n.b0 = p0 // 2 AND n.b1 = p1 // 2)""")
def neighbors_cross_level(spark, sf_dir):
    return neighbors.neighbors(mesh_blocks(spark, sf_dir), SPEC)


@query("fine_neighbors", f"""WITH {MESH}, {_BEYOND} SELECT x.level, x.b0, x.b1, x.face, n.b0 AS n0, n.b1 AS n1 FROM beyond x JOIN blocks n ON n.level = x.level + 1 AND n.b0 // 2 = p0 AND n.b1 // 2 = p1
WHERE CASE face WHEN 0 THEN n.b0 % 2 = 0 WHEN 1 THEN n.b0 % 2 = 1 WHEN 2 THEN n.b1 % 2 = 0 ELSE n.b1 % 2 = 1 END""")
def fine_neighbors(spark, sf_dir):
    return neighbors.fine_neighbors(mesh_blocks(spark, sf_dir), SPEC)


@query("neighbor_at_level", f"WITH {MESH}, {_BEYOND} SELECT x.level, x.b0, x.b1, x.face, n.b0 AS n0, n.b1 AS n1 FROM beyond x JOIN blocks n ON n.level = 0 AND n.b0 = p0 >> x.level AND n.b1 = p1 >> x.level")
def neighbor_at_level(spark, sf_dir):
    return neighbors.neighbor_at_level(mesh_blocks(spark, sf_dir), SPEC, 0)


@query("coarse_at_fine", f"WITH {MESH}, {_BEYOND} SELECT DISTINCT x.level, x.b0, x.b1 FROM beyond x JOIN blocks n ON n.level = x.level + 1 AND n.b0 // 2 = p0 AND n.b1 // 2 = p1")
def coarse_at_fine(spark, sf_dir):
    return neighbors.coarse_at_fine(mesh_blocks(spark, sf_dir), SPEC)


@query("siblings_complete", f"WITH {MESH} SELECT level - 1 AS level, b0 // 2 AS b0, b1 // 2 AS b1 FROM blocks WHERE level > 0 GROUP BY 1, 2, 3 HAVING count(*) = 4")
def siblings_complete(spark, sf_dir):
    return neighbors.complete_siblings(mesh_blocks(spark, sf_dir), SPEC)


def _halo_sql(kind: str) -> str:
    rim = f"""faces AS (SELECT * FROM (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) f(face, dx, dy)),
rim AS (SELECT level, g0, g1, CAST(face AS INTEGER) AS face, CAST(CASE WHEN face < 2 THEN g1 % {B} ELSE g0 % {B} END AS INTEGER) AS face_idx,
  (g0 + dx + ({N} << level)) % ({N} << level) AS o0, (g1 + dy + ({N} << level)) % ({N} << level) AS o1 FROM mesh, faces
  WHERE CASE face WHEN 0 THEN g0 % {B} = {L} WHEN 1 THEN g0 % {B} = 0 WHEN 2 THEN g1 % {B} = {L} ELSE g1 % {B} = 0 END)"""
    at = f"x.level, x.g0 // {B} AS b0, x.g1 // {B} AS b1, x.face, x.face_idx"
    if kind == "same":
        return f"WITH {MESH}, {rim} SELECT {at}, m.u FROM rim x JOIN mesh m ON m.level = x.level AND m.g0 = o0 AND m.g1 = o1"
    if kind == "coarser":
        return f"WITH {MESH}, {rim} SELECT {at}, m.u FROM rim x JOIN mesh m ON m.level = x.level - 1 AND m.g0 = o0 // 2 AND m.g1 = o1 // 2"
    return f"""WITH {MESH}, {rim} SELECT {at}, avg(m.u) AS u FROM rim x JOIN mesh m ON m.level = x.level + 1 AND m.g0 // 2 = o0 AND m.g1 // 2 = o1
WHERE CASE face WHEN 0 THEN m.g0 % 2 = 0 WHEN 1 THEN m.g0 % 2 = 1 WHEN 2 THEN m.g1 % 2 = 0 ELSE m.g1 % 2 = 1 END GROUP BY ALL"""


def _halo(kind: str):
    return lambda spark, sf_dir: halo.halo(mesh(spark, sf_dir), SPEC, kinds=(kind,)).select("level", "b0", "b1", "face", "face_idx", "u")


query("halo_same", _halo_sql("same"))(_halo(halo.SAME))
query("halo_coarse_to_fine", _halo_sql("coarser"))(_halo(halo.COARSER))
query("halo_fine_to_coarse", _halo_sql("finer"))(_halo(halo.FINER))


def _sum_sql(open_: bool) -> str:
    at = lambda g, d: f"x.{g} + {d}" if open_ else f"(x.{g} + {d} + {N}) % {N}"
    return f"""beside AS (SELECT x.level, x.g0, x.g1, x.u, {at("g0", "dx")} AS o0, {at("g1", "dy")} AS o1 FROM cells x, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) f(dx, dy)),
nb AS (SELECT x.level, x.g0, x.g1, x.u, sum(n.u) AS nb FROM beside x LEFT JOIN cells n ON n.g0 = o0 AND n.g1 = o1 GROUP BY 1, 2, 3, 4)"""


@query("laplacian_periodic", f"WITH {CELLS}, {_sum_sql(False)} SELECT level, g0, g1, u, nb - 4 * u AS lap FROM nb")
def laplacian_periodic(spark, sf_dir):
    return stencil.laplacian(plain(spark, sf_dir), SPEC)


@query("laplacian_open", f"WITH {CELLS}, {_sum_sql(True)} SELECT level, g0, g1, u, nb - 4 * u AS lap FROM nb")
def laplacian_open(spark, sf_dir):
    return stencil.laplacian(plain(spark, sf_dir), OPEN)


@query("heat_step", f"WITH {CELLS}, {_sum_sql(False)} SELECT level, g0, g1, u + 0.125 * (nb - 4 * u) AS u FROM nb")
def heat_step(spark, sf_dir):
    return stencil.heat_step(plain(spark, sf_dir), SPEC, 0.25, 0.5)


@query("diffusion_step", f"WITH {CELLS}, {_sum_sql(True)} SELECT level, g0, g1, u + 0.0625 * (nb - 4 * u) AS u FROM nb")
def diffusion_step(spark, sf_dir):
    return stencil.diffusion_step(plain(spark, sf_dir), OPEN, 0.25, 0.25)


#: SQL: a leaf's neighbours over all levels, as its stencil sees them.
_ALL_NB = f"""dirs AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) f(dx, dy)),
looked AS (SELECT level, g0, g1, u, dx, dy, (g0 + dx + ({N} << level)) % ({N} << level) AS o0, (g1 + dy + ({N} << level)) % ({N} << level) AS o1 FROM mesh, dirs),
seen AS (SELECT x.*, coalesce(s.u, k.u, (SELECT avg(f.u) FROM mesh f WHERE f.level = x.level + 1 AND f.g0 // 2 = x.o0 AND f.g1 // 2 = x.o1
    AND CASE WHEN dx = 1 THEN f.g0 % 2 = 0 WHEN dx = -1 THEN f.g0 % 2 = 1 WHEN dy = 1 THEN f.g1 % 2 = 0 ELSE f.g1 % 2 = 1 END)) AS n, s.u IS NULL AND k.u IS NULL AS at_fine, k.u IS NOT NULL AS at_coarse
  FROM looked x LEFT JOIN mesh s ON s.level = x.level AND s.g0 = o0 AND s.g1 = o1 LEFT JOIN mesh k ON k.level = x.level - 1 AND k.g0 = o0 // 2 AND k.g1 = o1 // 2)"""


@query("laplacian_levels", f"WITH {MESH}, {_ALL_NB} SELECT level, g0, g1, u, (sum(n) - 4 * u) * pow(4, level) AS lap FROM seen GROUP BY level, g0, g1, u")
def laplacian_levels(spark, sf_dir):
    return stencil.laplacian(mesh(spark, sf_dir), SPEC, levels=True)


@query("block_kernel", f"WITH {MESH}, {_ALL_NB} SELECT level, g0, g1, u + 0.125 * (sum(n) - 4 * u) AS u FROM seen GROUP BY level, g0, g1, u")
def block_kernel(spark, sf_dir):
    """The heat step as a block kernel on arrays with ghosts."""
    import numpy as np

    def heat(u, ghosts, level):
        out = -4 * u
        for d in range(u.ndim):
            padded = np.concatenate((np.expand_dims(ghosts[2 * d + 1], d), u, np.expand_dims(ghosts[2 * d], d)), axis=d)
            n = u.shape[d]
            out = out + np.take(padded, range(2, n + 2), d) + np.take(padded, range(n), d)
        return u + 0.125 * out

    return stencil.apply_kernel(mesh(spark, sf_dir), SPEC, heat)


@query("gradient_per_block", f"WITH {GRADIENTS} SELECT level, b0, b1, grad FROM gradients")
def gradient_per_block(spark, sf_dir):
    return stencil.block_gradient(plain(spark, sf_dir), SPEC)


@query("refine_flags", f"WITH {GRADIENTS} SELECT level, b0, b1, grad, grad > 100 AS refine FROM gradients")
def refine_flags(spark, sf_dir):
    return adapt.refine_flags(stencil.block_gradient(plain(spark, sf_dir), SPEC), SPEC, 100.0)


#: SQL: block gradients of the mesh of two levels.
_MESH_GRADIENTS = f"""{MESH}, steep AS (SELECT x.level, x.g0 // {B} AS b0, x.g1 // {B} AS b1, max(greatest(abs(r.u - x.u), abs(t.u - x.u))) AS grad
  FROM mesh x JOIN mesh r ON {key('r.level', 'r.g0', 'r.g1')} = {key('x.level', 'x.g0 + 1', 'x.g1')} JOIN mesh t ON {key('t.level', 't.g0', 't.g1')} = {key('x.level', 'x.g0', 'x.g1 + 1')}
  WHERE x.g0 % {B} BETWEEN 1 AND {B - 2} AND x.g1 % {B} BETWEEN 1 AND {B - 2} GROUP BY 1, 2, 3), middle AS (SELECT quantile_disc(grad, 0.5) AS m FROM steep WHERE level = 1)"""


def _middle(spark, sf_dir):
    """The mesh's block gradients, and the middle one of level 1 in a row of its own."""
    grad = written(stencil.block_gradient(mesh(spark, sf_dir), SPEC))
    return grad, grad.where("level = 1").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY grad)").alias("m"))


@query("coarsen_flags", f"WITH {_MESH_GRADIENTS} SELECT level, b0, b1, grad, level > 0 AND grad < m AS coarsen FROM steep, middle")
def coarsen_flags(spark, sf_dir):
    """On the mesh of two levels; flat is what lies below the middle gradient of level 1."""
    grad, middle = _middle(spark, sf_dir)
    return adapt.coarsen_flags(grad.crossJoin(F.broadcast(middle)), 2.0 * F.col("m"), 0.5).drop("m")


@query("coarsenable", f"WITH {_MESH_GRADIENTS} SELECT level - 1 AS level, b0 // 2 AS b0, b1 // 2 AS b1 FROM steep, middle WHERE level > 0 AND grad < 1.25 * m GROUP BY 1, 2, 3 HAVING count(*) = 4")
def coarsenable(spark, sf_dir):
    """Parents all of whose children exist and are flatter than five quarters of the middle gradient of level 1."""
    grad, middle = _middle(spark, sf_dir)
    return adapt.coarsenable(grad.crossJoin(F.broadcast(middle)), SPEC, 2.5 * F.col("m"), 0.5)


@query("refine_once", f"""WITH {GRADIENTS} SELECT c.level, c.g0, c.g1, c.u FROM cells c JOIN gradients s ON c.g0 // {B} = s.b0 AND c.g1 // {B} = s.b1 WHERE s.grad <= 100
UNION ALL SELECT CAST(1 AS INTEGER), 2 * c.g0 + kx.range, 2 * c.g1 + ky.range, c.u / 2 FROM cells c JOIN gradients s ON c.g0 // {B} = s.b0 AND c.g1 // {B} = s.b1, range(2) kx, range(2) ky WHERE s.grad > 100""")
def refine_once(spark, sf_dir):
    return adapt.gradient_pass(plain(spark, sf_dir), SPEC, 100.0)


@query("coarsen_once", f"""WITH {MESH}, parents AS (SELECT b0 // 2 AS b0, b1 // 2 AS b1 FROM blocks WHERE level = 1 GROUP BY 1, 2 HAVING count(*) = 4)
SELECT level, g0, g1, u FROM mesh WHERE level = 0 UNION ALL SELECT CAST(0 AS INTEGER), g0 // 2, g1 // 2, sum(u) / 2 FROM mesh WHERE level = 1 AND (g0 // {2 * B}, g1 // {2 * B}) IN (SELECT b0, b1 FROM parents) GROUP BY 2, 3""")
def coarsen_once(spark, sf_dir):
    m = mesh(spark, sf_dir)
    return adapt.coarsen(m, neighbors.complete_siblings(m.select("level", *A.block_coords(SPEC)).distinct(), SPEC), SPEC)


@query("delete_blocks", f"WITH {MESH} SELECT level, g0, g1, u FROM mesh WHERE level = 0")
def delete_blocks(spark, sf_dir):
    m = mesh(spark, sf_dir)
    return adapt.delete_blocks(m, m.where("level = 1").select("level", *A.block_coords(SPEC)).distinct(), SPEC)


@query("balance_violations", f"""WITH {MESH}, jump AS (SELECT CAST(0 AS INTEGER) AS level, b0, b1 FROM blocks WHERE level = 0 UNION ALL SELECT CAST(2 AS INTEGER), 2 * b0 + kx.range, 2 * b1 + ky.range FROM blocks, range(2) kx, range(2) ky WHERE level = 1),
beyond AS (SELECT (b0 + dx + {N} // 2) % ({N} // 2) AS p0, (b1 + dy + {N} // 2) % ({N} // 2) AS p1 FROM jump, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) f(dx, dy) WHERE level = 2)
SELECT level, b0, b1 FROM jump WHERE level = 0 AND (b0, b1) IN (SELECT p0 // 4, p1 // 4 FROM beyond)""")
def balance_violations(spark, sf_dir):
    """On the mesh with its level 1 refined once more at one stroke."""
    blocks = mesh_blocks(spark, sf_dir)
    kids = F.explode(F.array(*(F.struct((2 * F.col("b0") + (k & 1)).alias("c0"), (2 * F.col("b1") + (k >> 1)).alias("c1")) for k in range(4))))
    fine = blocks.where("level = 1").select(F.lit(2).alias("level"), kids.alias("k")).select("level", F.col("k.c0").alias("b0"), F.col("k.c1").alias("b1"))
    return adapt.balance_violations(blocks.where("level = 0").unionByName(fine), SPEC)


_UP = """lifted AS (SELECT CAST(level + 1 AS INTEGER) AS level, g0, g1, u FROM cells)"""


@query("restrict_full_weight", f"WITH {CELLS}, {_UP} SELECT CAST(level - 1 AS INTEGER) AS level, g0 // 2 AS g0, g1 // 2 AS g1, sum(u) / 4 AS u FROM lifted GROUP BY 1, 2, 3")
def restrict_full_weight(spark, sf_dir):
    return transfer.restrict(plain(spark, sf_dir).withColumn("level", F.col("level") + 1), SPEC)


@query("restrict_preserve_norm", f"WITH {CELLS}, {_UP} SELECT CAST(level - 1 AS INTEGER) AS level, g0 // 2 AS g0, g1 // 2 AS g1, sum(u) / 2 AS u FROM lifted GROUP BY 1, 2, 3")
def restrict_preserve_norm(spark, sf_dir):
    return transfer.restrict(plain(spark, sf_dir).withColumn("level", F.col("level") + 1), SPEC, preserve_norm=True)


@query("prolongate_injection", f"WITH {CELLS} SELECT CAST(1 AS INTEGER) AS level, 2 * g0 + kx.range AS g0, 2 * g1 + ky.range AS g1, u FROM cells, range(2) kx, range(2) ky")
def prolongate_injection(spark, sf_dir):
    return transfer.prolongate(plain(spark, sf_dir), SPEC)


@query("restrict_prolong_residual", f"WITH {CELLS}, {_UP}, low AS (SELECT g0 // 2 AS g0, g1 // 2 AS g1, sum(u) / 4 AS r FROM lifted GROUP BY 1, 2) SELECT x.level, x.g0, x.g1, x.u - r AS u FROM lifted x JOIN low ON low.g0 = x.g0 // 2 AND low.g1 = x.g1 // 2")
def restrict_prolong_residual(spark, sf_dir):
    fine = plain(spark, sf_dir).withColumn("level", F.col("level") + 1)
    coarse = transfer.restrict(fine, SPEC).withColumn("u", -F.col("u"))
    return transfer.prolongate_into(fine, coarse, SPEC, add=True)


@query("restrict_face", f"WITH {CELLS}, {_UP} SELECT CAST(level - 1 AS INTEGER) AS level, g0 // 2 AS g0, g1 // 2 AS g1, sum(u) / 2 AS u FROM lifted WHERE g0 % {B} = {L} GROUP BY 1, 2, 3")
def restrict_face(spark, sf_dir):
    lifted = plain(spark, sf_dir).withColumn("level", F.col("level") + 1)
    return transfer.restrict_face(lifted.where(A.on_face(SPEC, 0)), SPEC, 0)


@query("prolongate_face", f"WITH {CELLS} SELECT CAST(1 AS INTEGER) AS level, 2 * g0 + 1 AS g0, 2 * g1 + k.range AS g1, u FROM cells, range(2) k WHERE g0 % {B} = {L}")
def prolongate_face(spark, sf_dir):
    return transfer.prolongate_face(plain(spark, sf_dir).where(A.on_face(SPEC, 0)), SPEC, 0)


_FLUX = f"""{MESH}, {_ALL_NB},
flux AS (SELECT level, g0, g1, CAST(CASE WHEN dx = 1 THEN 0 WHEN dx = -1 THEN 1 WHEN dy = 1 THEN 2 ELSE 3 END AS INTEGER) AS face, -(dx + dy) * (n - u) AS f, o0, o1, at_fine, at_coarse FROM seen),
register AS (SELECT level, g0, g1, face, sum(r) AS r FROM (SELECT level, g0, g1, face, -f AS r FROM flux WHERE at_fine
  UNION ALL SELECT CAST(level - 1 AS INTEGER), o0 // 2, o1 // 2, CAST(xor(face, 1) AS INTEGER), f FROM flux WHERE at_coarse) GROUP BY 1, 2, 3, 4)"""


@query("flux_register", f"WITH {_FLUX} SELECT level, g0, g1, face, r FROM register")
def flux_register(spark, sf_dir):
    return flux.flux_register(flux.face_fluxes(mesh(spark, sf_dir), SPEC), SPEC)


@query("reflux", f"WITH {_FLUX} SELECT m.level, m.g0, m.g1, m.u + coalesce(s.r, 0) * pow(4, m.level) AS u FROM mesh m LEFT JOIN (SELECT level, g0, g1, sum(CASE WHEN face % 2 = 0 THEN -r ELSE r END) AS r FROM register GROUP BY 1, 2, 3) s ON s.level = m.level AND s.g0 = m.g0 AND s.g1 = m.g1")
def reflux(spark, sf_dir):
    m = mesh(spark, sf_dir)
    return flux.reflux(m, flux.flux_register(flux.face_fluxes(m, SPEC), SPEC), SPEC)


@query("conservation_total", f"WITH {MESH} SELECT {sql6('sum(u / pow(4, level))')} AS total FROM mesh")
def conservation_total(spark, sf_dir):
    """The total after a diffusion step with flux correction: that before it."""
    m = written(mesh(spark, sf_dir))
    dt = 0.0625
    step = stencil.diffusion_step(m, SPEC, 1.0, dt, levels=True)
    register = flux.flux_register(flux.face_fluxes(m, SPEC), SPEC, dt)
    return measure.total(flux.reflux(step, register, SPEC), SPEC).select(r6(F.col("total")).alias("total"))


@query("norm_sq", f"WITH {MESH} SELECT {sql6('sum(u * u / pow(4, level))')} AS norm_sq FROM mesh")
def norm_sq(spark, sf_dir):
    return measure.norm_squared(mesh(spark, sf_dir), SPEC, F.col("u") * F.col("u")).select(r6(F.col("norm_sq")).alias("norm_sq"))


@query("normalized", f"WITH {MESH}, n AS (SELECT sqrt(sum(u * u / pow(4, level))) AS n FROM mesh) SELECT level, g0, g1, {sql6('u / n')} AS u FROM mesh, n")
def normalized(spark, sf_dir):
    return measure.normalized(mesh(spark, sf_dir), SPEC, F.col("u") * F.col("u"), ("u",)).select("level", "g0", "g1", r6(F.col("u")).alias("u"))


_WEIGHTS = f"{MESH}, whole AS (SELECT sum(u * u) AS w FROM mesh), weights AS (SELECT level, g0 // {B} AS b0, g1 // {B} AS b1, greatest(sum(CASE WHEN u <> 0 THEN -(u * u / w) * ln(u * u / w) ELSE 0 END), 1e-12) AS weight FROM mesh, whole GROUP BY 1, 2, 3)"


@query("entropy_weights", f"WITH {_WEIGHTS} SELECT level, b0, b1, {sql6('weight')} AS weight FROM weights")
def entropy_weights(spark, sf_dir):
    return partition.entropy_weights(mesh(spark, sf_dir), SPEC, F.col("u") * F.col("u")).withColumn("weight", r6(F.col("weight")))


@query("owners_contiguous", f"""WITH {MESH}, keyed AS (SELECT level, b0, b1, CAST({" + ".join(f"((((b{d} << (3 - level)) >> {k}) & 1) << {2 * k + d})" for d in range(2) for k in range(12))} AS BIGINT) AS morton FROM blocks)
SELECT level, b0, b1, CAST(ntile(5) OVER (ORDER BY morton, level) - 1 AS INTEGER) AS owner FROM keyed""")
def owners_contiguous(spark, sf_dir):
    return partition.contiguous_owners(mesh_blocks(spark, sf_dir), SPEC, 5).select("level", "b0", "b1", "owner")


@query("balance_metrics", f"""WITH {_WEIGHTS}, per AS (SELECT (b0 + b1) % 3 AS owner, sum(weight) AS w, count(*) AS n FROM weights GROUP BY 1)
SELECT {sql6('sum(w)')} AS total_weight, {sql6('max(w)')} AS max_weight, {sql6('sum(w) / 4')} AS avg_weight, {sql6('(max(w) - sum(w) / 4) / (sum(w) / 4)')} AS weight_imbalance,
CAST(sum(n) AS BIGINT) AS total_blocks, max(n) AS max_blocks, sum(n) / 4 AS avg_blocks, {sql6('(max(n) - sum(n) / 4) / (sum(n) / 4)')} AS count_imbalance FROM per""")
def balance_metrics(spark, sf_dir):
    """Three owners of four have blocks."""
    w = partition.entropy_weights(mesh(spark, sf_dir), SPEC, F.col("u") * F.col("u")).withColumn("owner", (F.col("b0") + F.col("b1")) % 3)
    out = partition.balance(w, 4)
    return out.withColumns({c: r6(F.col(c)) for c in ("total_weight", "max_weight", "avg_weight", "weight_imbalance", "count_imbalance")})


def _cut(k: int) -> str:
    """SQL: the last block of owner k - 1 of four, and the sum up to it."""
    start, used = ("0", "0") if k == 1 else (f"c{k - 1}.r + 1", f"c{k - 1}.u")
    before = "" if k == 1 else f", c{k - 1}"
    return f"c{k} AS (SELECT max(rank) AS r, max(upto) AS u FROM dealt, (SELECT count(*) AS n, sum(weight) AS w FROM dealt){before} WHERE rank >= {start} AND rank < greatest(n - {4 - k}, {start} + 1) AND (upto <= ({used} + (w - {used}) / {5 - k}) * (1 + 1e-12) OR rank = {start}))"


@query("owners_weighted", f"""WITH {_WEIGHTS}, keyed AS (SELECT *, CAST({" + ".join(f"((((b{d} << (3 - level)) >> {k}) & 1) << {2 * k + d})" for d in range(2) for k in range(12))} AS BIGINT) AS morton FROM weights),
dealt AS (SELECT *, row_number() OVER (ORDER BY morton, level) - 1 AS rank, sum(weight) OVER (ORDER BY morton, level ROWS UNBOUNDED PRECEDING) AS upto FROM keyed), {_cut(1)}, {_cut(2)}, {_cut(3)}
SELECT level, b0, b1, {sql6('weight')} AS weight, CAST((rank > c1.r)::INT + (rank > c2.r)::INT + (rank > c3.r)::INT AS INTEGER) AS owner FROM dealt, c1, c2, c3""")
def owners_weighted(spark, sf_dir):
    w = partition.entropy_weights(mesh(spark, sf_dir), SPEC, F.col("u") * F.col("u"))
    return partition.weighted_owners(w, SPEC, 4).select("level", "b0", "b1", r6(F.col("weight")).alias("weight"), "owner")


@query("knn_l2", f"""SELECT vec_id AS id, {sql6('sqrt(list_sum(list_transform(list_zip(embedding, q), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))))')} AS dist
FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) ORDER BY dist, id LIMIT 10""")
def knn_l2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    query_vector = vectors.where("id = 7").first()["v"]
    return knn.search(vectors, query_vector, 10).select("id", r6(F.col("dist")).alias("dist"))


@query("checkpoint_due_steps", "SELECT range AS step FROM range(40) WHERE range >= 5 AND (range - 5) % 7 = 0")
def checkpoint_due_steps(spark, sf_dir):
    from meshlark.sources.checkpoint import Schedule

    return spark.range(40).select(F.col("id").alias("step")).where(Schedule(interval=7, start=5).due(F.col("id")))


@query("vector_totals", "SELECT label, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, min(x) AS low, max(x) AS high, round(stddev_pop(x), 6) + 0.0 AS std FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1")
def vector_totals(spark, sf_dir):
    """Mean, extremes and population deviation over all components, as benchmarks report them."""
    x = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x")).select("label", F.col("x").cast("double").alias("x"))
    return x.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), r6(F.stddev_pop("x")).alias("std"))
