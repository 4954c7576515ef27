"""Queries on U(1) links and complex fields."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meshlark.catalog._register import B, CELLS, MESH, N, SPEC, cells, key, mesh, query, r6, sql6
from meshlark.functions import address as A
from meshlark.operators import gauge, transfer

LINKS = f"{CELLS}, links AS (SELECT level, g0, g1, CAST(m.range AS INTEGER) AS mu, 2 * pi() * ((3 * c + 5 * m.range + g0 + 2 * g1) % 64) / 64 AS theta FROM cells, range(2) m)"
PLAQ = f"""{LINKS}, wide AS (SELECT level, g0, g1, max(CASE WHEN mu = 0 THEN theta END) AS t0, max(CASE WHEN mu = 1 THEN theta END) AS t1 FROM links GROUP BY 1, 2, 3),
plaq AS (SELECT x.level, x.g0, x.g1, x.t0 + a.t1 - b.t0 - x.t1 AS angle FROM wide x JOIN wide a ON a.g0 = (x.g0 + 1) % {N} AND a.g1 = x.g1 JOIN wide b ON b.g0 = x.g0 AND b.g1 = (x.g1 + 1) % {N})"""
LOOPS = f"""{PLAQ}, loops AS (SELECT p.level, p.g0, p.g1, m.range AS mu, CASE m.range WHEN 0 THEN sin(p.angle) - sin(q.angle) ELSE sin(r.angle) - sin(p.angle) END AS s,
  CASE m.range WHEN 0 THEN cos(p.angle) + cos(q.angle) ELSE cos(r.angle) + cos(p.angle) END AS c
  FROM plaq p JOIN plaq q ON q.g0 = p.g0 AND q.g1 = (p.g1 + {N} - 1) % {N} JOIN plaq r ON r.g0 = (p.g0 + {N} - 1) % {N} AND r.g1 = p.g1, range(2) m)"""
COV = f"""{PLAQ}, psi AS (SELECT level, g0, g1, u AS re, CAST(c AS DOUBLE) AS im FROM cells),
sides AS (SELECT x.level, x.g0, x.g1, 0 AS mu, 1 AS side, n.re, n.im, x.t0 AS a FROM wide x JOIN psi n ON n.g0 = (x.g0 + 1) % {N} AND n.g1 = x.g1
  UNION ALL SELECT x.level, x.g0, x.g1, 0, -1, n.re, n.im, -l.t0 FROM wide x JOIN psi n ON n.g0 = (x.g0 + {N} - 1) % {N} AND n.g1 = x.g1 JOIN wide l ON l.g0 = n.g0 AND l.g1 = n.g1
  UNION ALL SELECT x.level, x.g0, x.g1, 1, 1, n.re, n.im, x.t1 FROM wide x JOIN psi n ON n.g0 = x.g0 AND n.g1 = (x.g1 + 1) % {N}
  UNION ALL SELECT x.level, x.g0, x.g1, 1, -1, n.re, n.im, -l.t1 FROM wide x JOIN psi n ON n.g0 = x.g0 AND n.g1 = (x.g1 + {N} - 1) % {N} JOIN wide l ON l.g0 = n.g0 AND l.g1 = n.g1),
turned AS (SELECT level, g0, g1, mu, side, re * cos(a) - im * sin(a) AS re, re * sin(a) + im * cos(a) AS im FROM sides),
lap AS (SELECT p.level, p.g0, p.g1, sum(t.re) - 4 * p.re AS re, sum(t.im) - 4 * p.im AS im FROM psi p JOIN turned t ON t.g0 = p.g0 AND t.g1 = p.g1 GROUP BY p.level, p.g0, p.g1, p.re, p.im)"""
ENERGY = f"""{COV}, h AS (SELECT p.level, p.g0, p.g1, p.re AS pr, p.im AS pi_, -l.re / 2 + v * p.re AS re, -l.im / 2 + v * p.im AS im
  FROM psi p JOIN lap l ON l.g0 = p.g0 AND l.g1 = p.g1, (SELECT 1) one, LATERAL (SELECT -1 / sqrt(pow(p.g0 - 16, 2) + pow(p.g1 - 16, 2) + 0.25) AS v) w)"""


def links(spark, sf_dir):
    rows = cells(spark, sf_dir).select("level", *SPEC.g, "c", F.explode(F.array(F.lit(0), F.lit(1))).alias("mu"))
    return rows.select("level", *SPEC.g, "mu", (2 * math.pi * ((3 * F.col("c") + 5 * F.col("mu") + F.col("g0") + 2 * F.col("g1")) % 64) / 64).alias("theta"))


def psi(spark, sf_dir):
    return cells(spark, sf_dir).select("level", *SPEC.g, F.col("u").alias("re"), F.col("c").cast("double").alias("im"))


def potential():
    return gauge.coulomb(1.0, F.lit(0.5), (16.0, 16.0))(A.positions(SPEC), A.spacing(SPEC))


@query("plaquette_u1", f"WITH {PLAQ} SELECT level, g0, g1, {sql6('angle')} AS angle FROM plaq")
def plaquette_u1(spark, sf_dir):
    return gauge.plaquettes(links(spark, sf_dir), SPEC).select("level", *SPEC.g, r6(F.col("angle")).alias("angle"))


@query("avg_plaquette", f"WITH {PLAQ} SELECT {sql6('avg(a)')} AS avg FROM (SELECT avg(cos(angle)) AS a FROM plaq GROUP BY g0 // 8, g1 // 8)")
def avg_plaquette(spark, sf_dir):
    return gauge.average_plaquette(links(spark, sf_dir), SPEC).select(r6(F.col("avg")).alias("avg"))


@query("block_plaquette", f"WITH {PLAQ} SELECT level, g0 // 8 AS b0, g1 // 8 AS b1, {sql6('avg(cos(angle))')} AS avg FROM plaq GROUP BY 1, 2, 3")
def block_plaquette(spark, sf_dir):
    return gauge.block_plaquettes(links(spark, sf_dir), SPEC).withColumn("avg", r6(F.col("avg")))


@query("wilson_action", f"WITH {PLAQ} SELECT {sql6('sum(2.5 * (1 - cos(angle)))')} AS action FROM plaq")
def wilson_action(spark, sf_dir):
    return gauge.wilson_action(links(spark, sf_dir), SPEC, 2.5).select(r6(F.col("action")).alias("action"))


@query("force_u1", f"WITH {LOOPS} SELECT level, g0, g1, CAST(mu AS INTEGER) AS mu, {sql6('-2.5 * s')} AS f FROM loops")
def force_u1(spark, sf_dir):
    return gauge.forces(links(spark, sf_dir), SPEC, 2.5).withColumn("f", r6(F.col("f")))


@query("staple_u1", f"WITH {LOOPS} SELECT x.level, x.g0, x.g1, CAST(x.mu AS INTEGER) AS mu, {sql6('c * cos(theta) + s * sin(theta)')} AS re, {sql6('s * cos(theta) - c * sin(theta)')} AS im FROM loops x JOIN links l ON l.g0 = x.g0 AND l.g1 = x.g1 AND l.mu = x.mu")
def staple_u1(spark, sf_dir):
    return gauge.staples(links(spark, sf_dir), SPEC).withColumns({c: r6(F.col(c)) for c in ("re", "im")})


@query("cov_laplacian_u1", f"WITH {COV} SELECT level, g0, g1, {sql6('re')} AS re, {sql6('im')} AS im FROM lap")
def cov_laplacian_u1(spark, sf_dir):
    return gauge.covariant_laplacian(psi(spark, sf_dir), links(spark, sf_dir), SPEC).withColumns({c: r6(F.col(c)) for c in ("re", "im")})


@query("cov_derivative_u1", f"WITH {COV} SELECT level, g0, g1, CAST(mu AS INTEGER) AS mu, {sql6('sum(side * re) / 2')} AS re, {sql6('sum(side * im) / 2')} AS im FROM turned GROUP BY 1, 2, 3, 4")
def cov_derivative_u1(spark, sf_dir):
    return gauge.covariant_derivative(psi(spark, sf_dir), links(spark, sf_dir), SPEC).withColumns({c: r6(F.col(c)) for c in ("re", "im")})


@query("hamiltonian_u1", f"WITH {ENERGY} SELECT level, g0, g1, {sql6('re')} AS re, {sql6('im')} AS im FROM h")
def hamiltonian_u1(spark, sf_dir):
    return gauge.hamiltonian(psi(spark, sf_dir), links(spark, sf_dir), SPEC, 1.0, potential()).withColumns({c: r6(F.col(c)) for c in ("re", "im")})


@query("energy_u1", f"WITH {ENERGY} SELECT {sql6('sum(pr * re + pi_ * im) / sum(pr * pr + pi_ * pi_)')} AS energy FROM h")
def energy_u1(spark, sf_dir):
    p, u = psi(spark, sf_dir), links(spark, sf_dir)
    return gauge.energy(p, gauge.hamiltonian(p, u, SPEC, 1.0, potential()), SPEC).select(r6(F.col("energy")).alias("energy"))


@query("link_restrict_u1", f"WITH {LINKS} SELECT CAST(0 AS INTEGER) AS level, g0 // 2 AS g0, g1 // 2 AS g1, mu, {sql6('sum(theta)')} AS theta FROM links WHERE CASE mu WHEN 0 THEN g1 % 2 = 0 ELSE g0 % 2 = 0 END GROUP BY 2, 3, 4")
def link_restrict_u1(spark, sf_dir):
    fine = links(spark, sf_dir).withColumn("level", F.col("level") + 1)
    return transfer.restrict_links(fine, SPEC).withColumn("theta", r6(F.col("theta")))


_HALF = "atan2(CASE WHEN abs(sin(theta)) < 1e-15 THEN 0.0 ELSE sin(theta) END, cos(theta)) / 2"


@query("link_prolong_u1", f"WITH {LINKS} SELECT CAST(1 AS INTEGER) AS level, 2 * g0 + kx.range AS g0, 2 * g1 + ky.range AS g1, mu, {sql6(_HALF)} AS theta FROM links, range(2) kx, range(2) ky")
def link_prolong_u1(spark, sf_dir):
    return transfer.prolongate_links(links(spark, sf_dir), SPEC).withColumn("theta", r6(F.col("theta")))


@query("link_prolong_face", f"WITH {LINKS} SELECT CAST(1 AS INTEGER) AS level, 2 * g0 AS g0, 2 * g1 + ky.range AS g1, mu, {sql6(_HALF)} AS theta FROM links, range(2) ky WHERE g0 % {B} = 0")
def link_prolong_face(spark, sf_dir):
    return transfer.prolongate_link_face(links(spark, sf_dir).where(A.on_face(SPEC, 1)), SPEC, 1).withColumn("theta", r6(F.col("theta")))


@query("link_restrict_face", f"WITH {LINKS} SELECT level, g0 // 2 AS g0, g1 // 2 AS g1, mu, {sql6('theta')} AS theta FROM links WHERE g0 % {B} = {B - 1} AND g1 % 2 = 0")
def link_restrict_face(spark, sf_dir):
    fine = links(spark, sf_dir).withColumn("level", F.col("level") + 1)
    return transfer.restrict_link_face(fine.where(A.on_face(SPEC, 0)), SPEC, 0).withColumn("theta", r6(F.col("theta")))


#: SQL: links on the mesh of two levels, and the rim of its blocks.
MESH_LINKS = f"""{MESH}, mlinks AS MATERIALIZED (SELECT level, g0, g1, CAST(m.range AS INTEGER) AS mu, ((3 * g0 + 5 * m.range + 2 * g1 + level) % 8 + 0.5) / 8 AS theta FROM mesh, range(2) m),
faces AS (SELECT * FROM (VALUES (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) f(face, dx, dy)),
rim AS MATERIALIZED (SELECT level, g0, g1, g0 // {B} AS b0, g1 // {B} AS b1, CAST(face AS INTEGER) AS face, CAST(CASE WHEN face < 2 THEN g1 % {B} ELSE g0 % {B} END AS INTEGER) AS face_idx,
  (g0 + dx + ({N} << level)) % ({N} << level) AS o0, (g1 + dy + ({N} << level)) % ({N} << level) AS o1 FROM mesh, faces
  WHERE CASE face WHEN 0 THEN g0 % {B} = {B - 1} WHEN 1 THEN g0 % {B} = 0 WHEN 2 THEN g1 % {B} = {B - 1} ELSE g1 % {B} = 0 END)"""
_LINK_HALO = f"""same AS (SELECT x.level, b0, b1, face, face_idx, l.mu, l.theta FROM rim x JOIN mlinks l ON l.level = x.level AND l.g0 = o0 AND l.g1 = o1),
coarse AS (SELECT x.level, b0, b1, face, face_idx, l.mu, CASE WHEN l.mu = face // 2 AND face % 2 = 1 THEN 0.0 ELSE {_HALF} END AS theta FROM rim x JOIN mlinks l ON l.level = x.level - 1 AND l.g0 = o0 // 2 AND l.g1 = o1 // 2),
fine AS (SELECT level, b0, b1, face, face_idx, mu, CASE WHEN mu = face // 2 THEN mean ELSE product END AS theta FROM (
  SELECT x.level, b0, b1, face, face_idx, l.mu, atan2(avg(sin(theta)), avg(cos(theta))) AS mean, sum(theta) AS product FROM rim x JOIN mlinks l ON l.level = x.level + 1 AND l.g0 // 2 = o0 AND l.g1 // 2 = o1
  WHERE CASE face WHEN 0 THEN l.g0 % 2 = 0 WHEN 1 THEN l.g0 % 2 = 1 WHEN 2 THEN l.g1 % 2 = 0 ELSE l.g1 % 2 = 1 END GROUP BY 1, 2, 3, 4, 5, 6))"""


def mesh_links(m):
    rows = m.select("level", *SPEC.g, F.explode(F.array(F.lit(0), F.lit(1))).alias("mu"))
    return rows.select("level", *SPEC.g, "mu", (((3 * F.col("g0") + 5 * F.col("mu") + 2 * F.col("g1") + F.col("level")) % 8 + 0.5) / 8).alias("theta"))


@query("link_halo_u1", f"WITH {MESH_LINKS}, {_LINK_HALO} SELECT level, b0, b1, face, face_idx, mu, {sql6('theta')} AS theta FROM (FROM same UNION ALL FROM coarse UNION ALL FROM fine)")
def link_halo_u1(spark, sf_dir):
    """Links beyond the faces of all blocks: of the same level, halved from a coarser one, combined from a finer one."""
    m = mesh(spark, sf_dir)
    return gauge.link_halo(mesh_links(m), SPEC, m.select("level", *A.block_coords(SPEC)).distinct()).withColumn("theta", r6(F.col("theta")))


@query("synced_links_u1", f"WITH {MESH_LINKS} SELECT m.level, m.g0, m.g1, CAST(k.range AS INTEGER) AS mu, coalesce(l.theta, 0.0) AS theta FROM mesh m CROSS JOIN range(2) k LEFT JOIN (SELECT * FROM mlinks WHERE (g0 + g1) % 3 > 0) l ON l.level = m.level AND l.g0 = m.g0 AND l.g1 = m.g1 AND l.mu = k.range")
def synced_links_u1(spark, sf_dir):
    """A third of the cells have no links and get the identity."""
    m = mesh(spark, sf_dir)
    return gauge.synced_links(m, mesh_links(m).where("(g0 + g1) % 3 > 0"), SPEC)


def _link(alias: str) -> str:
    return f"{key(f'{alias}.level', f'{alias}.g0', f'{alias}.g1')} * 2 + {alias}.mu"


_ACROSS = f"""{MESH_LINKS}, mpsi AS MATERIALIZED (SELECT level, g0, g1, u AS re, (u * 3 + g0) % 7 AS im FROM mesh),
ghosts AS MATERIALIZED (SELECT x.level, x.g0, x.g1, face, 'fine' AS side, n.re, n.im, CASE WHEN face % 2 = 0 THEN o.theta ELSE -k.theta END AS a FROM rim x JOIN mpsi n ON {key("n.level", "n.g0", "n.g1")} = {key("x.level - 1", "o0 // 2", "o1 // 2")}
    JOIN mlinks o ON {_link("o")} = {key("x.level", "x.g0", "x.g1")} * 2 + face // 2 JOIN mlinks k ON {_link("k")} = {key("x.level - 1", "o0 // 2", "o1 // 2")} * 2 + face // 2
  UNION ALL SELECT x.level, x.g0, x.g1, face, 'coarse', avg(n.re), avg(n.im), CASE WHEN face % 2 = 0 THEN o.theta ELSE 0.0 END FROM rim x JOIN mpsi n ON {key("n.level", "n.g0 // 2", "n.g1 // 2")} = {key("x.level + 1", "o0", "o1")}
    JOIN mlinks o ON {_link("o")} = {key("x.level", "x.g0", "x.g1")} * 2 + face // 2
    WHERE CASE face WHEN 0 THEN n.g0 % 2 = 0 WHEN 1 THEN n.g0 % 2 = 1 WHEN 2 THEN n.g1 % 2 = 0 ELSE n.g1 % 2 = 1 END GROUP BY x.level, x.g0, x.g1, face, o.theta),
across AS (SELECT g.level, g.g0, g.g1, face, side, g.re * cos(a) - g.im * sin(a) AS re, g.re * sin(a) + g.im * cos(a) AS im, p.re AS own_re, p.im AS own_im FROM ghosts g JOIN mpsi p ON {key('p.level', 'p.g0', 'p.g1')} = {key('g.level', 'g.g0', 'g.g1')})"""


def mesh_psi(m):
    return m.select("level", *SPEC.g, F.col("u").alias("re"), ((F.col("u") * 3 + F.col("g0")) % 7).alias("im"))


@query("cov_face_fluxes_u1", f"WITH {_ACROSS} SELECT level, g0, g1, face, side, {sql6('(1 - 2 * (face % 2)) * (re - own_re)')} AS re, {sql6('(1 - 2 * (face % 2)) * (im - own_im)')} AS im FROM across")
def cov_face_fluxes_u1(spark, sf_dir):
    """Covariant gradients times areas at faces between levels; in two dimensions spacing and area cancel."""
    m = mesh(spark, sf_dir)
    out = gauge.covariant_face_fluxes(mesh_psi(m), mesh_links(m), SPEC)
    return out.select("level", *SPEC.g, "face", "side", *(r6(F.col(c)).alias(c) for c in ("re", "im")))


_SAME_LEVEL = f"""dirs AS (SELECT * FROM (VALUES (0, 1, 1, 0), (0, -1, -1, 0), (1, 1, 0, 1), (1, -1, 0, -1)) f(mu, side, dx, dy)),
beside AS (SELECT p.level, p.g0, p.g1, mu, side, (p.g0 + dx + ({N} << p.level)) % ({N} << p.level) AS o0, (p.g1 + dy + ({N} << p.level)) % ({N} << p.level) AS o1 FROM mpsi p, dirs),
brought AS (SELECT x.level, x.g0, x.g1, n.re * cos(l.theta) - n.im * sin(l.theta) AS re, n.re * sin(l.theta) + n.im * cos(l.theta) AS im FROM beside x JOIN mpsi n ON {key("n.level", "n.g0", "n.g1")} = {key("x.level", "o0", "o1")}
    JOIN mlinks l ON {_link("l")} = {key("x.level", "x.g0", "x.g1")} * 2 + x.mu WHERE side = 1
  UNION ALL SELECT x.level, x.g0, x.g1, n.re * cos(l.theta) + n.im * sin(l.theta), n.im * cos(l.theta) - n.re * sin(l.theta) FROM beside x JOIN mpsi n ON {key("n.level", "n.g0", "n.g1")} = {key("x.level", "o0", "o1")}
    JOIN mlinks l ON {_link("l")} = {key("x.level", "o0", "o1")} * 2 + x.mu WHERE side = -1),
lap AS (SELECT p.level, p.g0, p.g1, p.re, p.im, (coalesce(s.re, 0) - 4 * p.re) * pow(4, p.level) AS lr, (coalesce(s.im, 0) - 4 * p.im) * pow(4, p.level) AS li FROM mpsi p LEFT JOIN
  (SELECT level, g0, g1, sum(re) AS re, sum(im) AS im FROM (SELECT level, g0, g1, re, im FROM brought UNION ALL SELECT level, g0, g1, re, im FROM across) GROUP BY 1, 2, 3) s ON s.level = p.level AND s.g0 = p.g0 AND s.g1 = p.g1)"""


@query("cov_laplacian_levels", f"WITH {_ACROSS}, {_SAME_LEVEL} SELECT level, g0, g1, {sql6('lr')} AS re, {sql6('li')} AS im FROM lap")
def cov_laplacian_levels(spark, sf_dir):
    m = mesh(spark, sf_dir)
    return gauge.covariant_laplacian(mesh_psi(m), mesh_links(m), SPEC, levels=True).withColumns({c: r6(F.col(c)) for c in ("re", "im")})


_REFLUXED = f"""{_ACROSS}, {_SAME_LEVEL}, kept AS (SELECT *, re + 0.05 * lr / 2 AS nr, im + 0.05 * li / 2 AS ni FROM lap),
flux AS (SELECT level, g0, g1, face, side, -0.025 * (1 - 2 * (face % 2)) * (re - own_re) AS fr, -0.025 * (1 - 2 * (face % 2)) * (im - own_im) AS fi FROM across),
register AS (SELECT level, g0, g1, face, -fr AS rr, -fi AS ri FROM flux WHERE side = 'coarse' UNION ALL SELECT CAST(x.level - 1 AS INTEGER), x.o0 // 2, x.o1 // 2, xor(x.face, 1), fr, fi FROM rim x JOIN flux f ON f.side = 'fine' AND f.level = x.level AND f.g0 = x.g0 AND f.g1 = x.g1 AND f.face = x.face),
signed AS (SELECT level, g0, g1, sum(CASE WHEN face % 2 = 0 THEN -rr ELSE rr END) AS rr, sum(CASE WHEN face % 2 = 0 THEN -ri ELSE ri END) AS ri FROM register GROUP BY 1, 2, 3),
stepped AS (SELECT k.level, k.g0, k.g1, nr + coalesce(rr, 0) * pow(4, k.level) AS re, ni + coalesce(ri, 0) * pow(4, k.level) AS im FROM kept k LEFT JOIN signed s ON s.level = k.level AND s.g0 = k.g0 AND s.g1 = k.g1),
norm AS (SELECT sqrt(sum((re * re + im * im) / pow(4, level))) AS n FROM stepped)"""


@query("imaginary_step_levels", f"WITH {_REFLUXED} SELECT level, g0, g1, {sql6('re / n')} AS re, {sql6('im / n')} AS im FROM stepped, norm")
def imaginary_step_levels(spark, sf_dir):
    """A step of imaginary time on the mesh of two levels, corrected by the fluxes between them and normalized."""
    from meshlark.plans import evolution

    m = mesh(spark, sf_dir)
    out = evolution.evolve_adaptive(mesh_psi(m), mesh_links(m), SPEC, 1.0, F.lit(0.0), 0.05, 1)
    return out.select("level", *SPEC.g, *(r6(F.col(c)).alias(c) for c in ("re", "im")))


_AT = "sqrt(pow(g0 - 16, 2) + pow(g1 - 16, 2)"


@query("coulomb_potential", f"WITH {CELLS} SELECT g0, g1, {sql6(f'-1 / {_AT} + 0.25)')} AS v FROM cells")
def coulomb_potential(spark, sf_dir):
    return cells(spark, sf_dir).select("g0", "g1", r6(potential()).alias("v"))


@query("yukawa_potential", f"WITH {CELLS} SELECT g0, g1, {sql6(f'CASE WHEN g0 = 16 AND g1 = 16 THEN 0 ELSE -2 * exp(-0.5 * {_AT})) / {_AT}) END')} AS v FROM cells")
def yukawa_potential(spark, sf_dir):
    return cells(spark, sf_dir).select("g0", "g1", r6(gauge.yukawa(2.0, 0.5, (16.0, 16.0))(A.positions(SPEC), A.spacing(SPEC))).alias("v"))


@query("many_centers", f"WITH {CELLS} SELECT g0, g1, {sql6('-1 / sqrt(pow(g0 - 8, 2) + pow(g1 - 8, 2) + 0.25) - 1 / sqrt(pow(g0 - 24, 2) + pow(g1 - 20, 2) + 0.25)')} AS v FROM cells")
def many_centers(spark, sf_dir):
    v = gauge.many_centers([gauge.coulomb(1.0, F.lit(0.5), (8.0, 8.0)), gauge.coulomb(1.0, F.lit(0.5), (24.0, 20.0))])
    return cells(spark, sf_dir).select("g0", "g1", r6(v(A.positions(SPEC), A.spacing(SPEC))).alias("v"))
