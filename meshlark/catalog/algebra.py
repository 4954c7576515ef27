"""Queries on matrices, spinors, tensors and four-vectors in columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.catalog._register import B, CELLS, MESH, SPEC, cells, mesh_blocks, query, r6, sql6
from meshlark.catalog.gauge import LINKS, links
from meshlark.functions import address as A
from meshlark.functions import algebra as G
from meshlark.functions import constants
from meshlark.operators import neighbors

_AXES = [f"CASE WHEN (g0 + mu) % 3 = {k} THEN sin(theta) ELSE 0.0 END" for k in range(3)]
#: SQL: a 2 x 2 matrix on each link, of unit determinant.
SU2 = f"{LINKS}, su2 AS (SELECT level, g0, g1, mu, [cos(theta), d, b, c, -b, c, cos(theta), -d] AS u FROM (SELECT *, {_AXES[0]} AS b, {_AXES[1]} AS c, {_AXES[2]} AS d FROM links)), pairs AS (SELECT x.level, x.g0, x.g1, x.u, y.u AS w FROM su2 x JOIN su2 y ON x.g0 = y.g0 AND x.g1 = y.g1 WHERE x.mu = 0 AND y.mu = 1)"


def su2(spark, sf_dir):
    axis = [F.when((F.col("g0") + F.col("mu")) % 3 == k, F.sin("theta")).otherwise(0.0) for k in range(3)]
    return links(spark, sf_dir).select("level", *SPEC.g, "mu", G.su2_from_quaternion(F.cos("theta"), *axis).alias("u"))


def pairs(spark, sf_dir):
    u = su2(spark, sf_dir)
    return u.where("mu = 0").drop("mu").join(u.where("mu = 1").select(*SPEC.g, F.col("u").alias("w")), list(SPEC.g))


def _split(column, n, name="m"):
    return [r6(F.get(column, F.lit(k))).alias(f"{name}{k}") for k in range(n)]


def _sql_split(entries, name="m"):
    return ", ".join(f"{sql6(e)} AS {name}{k}" for k, e in enumerate(entries))


def _e(m, k):
    return f"{m}[{2 * k + 1}]", f"{m}[{2 * k + 2}]"


def _sql_sum(terms):
    """The sum of products of complex numbers; a pair may be conjugated before."""
    return " + ".join(f"({a[0]} * {b[0]} - {a[1]} * {b[1]})" for a, b in terms), " + ".join(f"({a[0]} * {b[1]} + {a[1]} * {b[0]})" for a, b in terms)


def _conj(z):
    return z[0], f"(-{z[1]})"


def _product(a, b):
    return [x for i in range(2) for j in range(2) for x in _sql_sum([(_e(a, 2 * i + k), _e(b, 2 * k + j)) for k in range(2)])]


@query("su2_links", f"WITH {SU2} SELECT level, g0, g1, mu, {_sql_split([f'u[{k + 1}]' for k in range(8)])} FROM su2")
def su2_links(spark, sf_dir):
    return su2(spark, sf_dir).select("level", *SPEC.g, "mu", *_split(F.col("u"), 8))


@query("matrix_product", f"WITH {SU2} SELECT level, g0, g1, {_sql_split(_product('u', 'w'))} FROM pairs")
def matrix_product(spark, sf_dir):
    return pairs(spark, sf_dir).select("level", *SPEC.g, *_split(G.multiplied(F.col("u"), F.col("w"), 2), 8))


_T = [f"u[{k + 1}]" for i in range(2) for j in range(2) for k in (2 * (2 * j + i), 2 * (2 * j + i) + 1)]


@query("matrix_transposes", f"WITH {SU2} SELECT level, g0, g1, mu, {_sql_split(_T, 't')}, {_sql_split([x if k % 2 == 0 else '-' + x for k, x in enumerate(_T)], 'a')}, {_sql_split([f'u[{k + 1}]' if k % 2 == 0 else f'-u[{k + 1}]' for k in range(8)], 'c')} FROM su2")
def matrix_transposes(spark, sf_dir):
    u = F.col("u")
    return su2(spark, sf_dir).select("level", *SPEC.g, "mu", *_split(G.transposed(u, 2), 8, "t"), *_split(G.adjoint(u, 2), 8, "a"), *_split(G.conjugated(u), 8, "c"))


_SUM = "list_transform(list_zip(u, w), lambda x: x[1] + 2 * x[2])"
_DET = _sql_sum([(_e("s", 0), _e("s", 3)), ((f"(-{_e('s', 1)[0]})", f"(-{_e('s', 1)[1]})"), _e("s", 2))])


@query("matrix_measures", f"""WITH {SU2}, totals AS (SELECT *, {_SUM} AS s FROM pairs) SELECT level, g0, g1, {sql6(_DET[0])} AS det_re, {sql6(_DET[1])} AS det_im, {sql6('s[1] + s[7]')} AS trace_re, {sql6('s[2] + s[8]')} AS trace_im,
{sql6('sqrt(list_sum(list_transform(s, lambda x: x * x)))')} AS norm, true AS unitary, true AS unit_det, abs(list_sum(list_transform(s, lambda x: x * x)) / 2 - 1) < 1e-9 AS sum_unitary FROM totals""")
def matrix_measures(spark, sf_dir):
    """Of u + 2 w: a sum of such matrices is a number times one of them, so it is unitary if its squared norm is 2."""
    from meshlark.functions import matrices as M

    s = M.added(F.col("u"), F.col("w"), 2.0)
    d, t = G.determinant(s, 2), M.trace(s, 2)
    return pairs(spark, sf_dir).select("level", *SPEC.g, r6(d["re"]).alias("det_re"), r6(d["im"]).alias("det_im"), r6(t["re"]).alias("trace_re"), r6(t["im"]).alias("trace_im"), r6(G.frobenius(s)).alias("norm"), G.is_unitary(F.col("u"), 2).alias("unitary"), G.has_unit_determinant(F.col("u"), 2).alias("unit_det"), G.is_unitary(s, 2).alias("sum_unitary"))


_V = "[x.u_, CAST(x.c AS DOUBLE), 1.0, -0.5]"
_FIELD = f"{SU2}, acted AS (SELECT s.level, s.g0, s.g1, s.mu, s.u, {_V} AS v FROM su2 s JOIN (SELECT g0, g1, u AS u_, c FROM cells) x ON x.g0 = s.g0 AND x.g1 = s.g1)"
_FORTH = [x for i in range(2) for x in _sql_sum([(_e("u", 2 * i + k), _e("v", k)) for k in range(2)])]
_BACK = [x for i in range(2) for x in _sql_sum([(_conj(_e("u", 2 * k + i)), _e("v", k)) for k in range(2)])]


@query("link_actions", f"WITH {_FIELD} SELECT level, g0, g1, mu, {_sql_split(_FORTH, 'f')}, {_sql_split(_BACK, 'b')} FROM acted")
def link_actions(spark, sf_dir):
    v = cells(spark, sf_dir).select(*SPEC.g, F.array("u", F.col("c").cast("double"), F.lit(1.0), F.lit(-0.5)).alias("v"))
    out = su2(spark, sf_dir).join(v, list(SPEC.g))
    return out.select("level", *SPEC.g, "mu", *_split(G.acted(F.col("u"), F.col("v"), 2), 4, "f"), *_split(G.acted_back(F.col("u"), F.col("v"), 2), 4, "b"))


@query("su2_algebra", f"""WITH {SU2}, angles AS (SELECT *, acos(greatest(-1, least(1, (u[1] + u[7]) / 2))) AS t FROM su2) SELECT level, g0, g1, mu, {sql6('t')} AS angle,
{", ".join(f"{sql6(f'CASE WHEN sin(t) > 1e-12 THEN t / sin(t) ELSE 1 END * ({e}) / 2')} AS h{k}" for k, e in enumerate(("u[3] - u[5]", "u[4] + u[6]", "u[2] - u[8]")))} FROM angles WHERE abs(sin(t)) > 1e-6""")
def su2_algebra(spark, sf_dir):
    """Angle and algebra components of links; where a link is plus or minus one, the direction is not defined."""
    u = F.col("u")
    t = G.su2_angle(u)
    return su2(spark, sf_dir).where(F.abs(F.sin(t)) > 1e-6).select("level", *SPEC.g, "mu", r6(t).alias("angle"), *_split(G.su2_algebra(u), 3, "h"))


@query("u1_links", f"WITH {LINKS} SELECT level, g0, g1, mu, {sql6('cos(theta)')} AS re, {sql6('sin(theta)')} AS im, {sql6('cos(atan2(sin(theta), cos(theta)))')} AS back FROM links")
def u1_links(spark, sf_dir):
    u = G.u1_link(F.col("theta"))
    return links(spark, sf_dir).select("level", *SPEC.g, "mu", r6(u[0]).alias("re"), r6(u[1]).alias("im"), r6(F.cos(G.u1_angle(u))).alias("back"))


@query("complex_parts", f"WITH {CELLS} SELECT level, g0, g1, {sql6('u * u + c * c')} AS mag_sq, {sql6('sqrt(u * u + c * c)')} AS mag, {sql6('atan2(c - 1, u - 20)')} AS arg FROM cells")
def complex_parts(spark, sf_dir):
    u, c = F.col("u"), F.col("c").cast("double")
    return cells(spark, sf_dir).select("level", *SPEC.g, r6(G.magnitude_squared(u, c)).alias("mag_sq"), r6(G.magnitude(u, c)).alias("mag"), r6(G.argument(u - 20.0, c - 1.0)).alias("arg"))


@query("field_algebra", f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), f AS (SELECT vec_id, v, list_reverse(v) AS w FROM e)
SELECT vec_id, {sql6('list_sum(list_transform(list_zip(v, w), lambda x: (x[1] + x[2]) * (x[1] + x[2])))')} AS added, {sql6('list_sum(list_transform(list_zip(v, w), lambda x: (x[1] - x[2]) * (x[1] - x[2])))')} AS subtracted,
{sql6('list_sum(list_transform(list_zip(v, w), lambda x: (x[1] + 0.25 * x[2]) * (x[1] + 0.25 * x[2])))')} AS added_scaled, {sql6('list_sum(list_transform(v, lambda x: 9 * x * x))')} AS scaled FROM f""")
def field_algebra(spark, sf_dir):
    """Squared norms of sums, differences and multiples of whole vectors."""
    from meshlark.functions import matrices as M

    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", v.alias("v"), F.reverse(v).alias("w"))
    a, b = F.col("v"), F.col("w")
    parts = {"added": M.added(a, b), "subtracted": G.subtracted(a, b), "added_scaled": M.added(a, b, 0.25), "scaled": M.scaled(a, 3.0)}
    return rows.select("vec_id", *(r6(M.norm_squared(x)).alias(k) for k, x in parts.items()))


@query("tensor_entries", f"WITH {CELLS} SELECT level, g0, g1, u + g0 AS first, CAST(c AS DOUBLE) AS last, 0.0 AS zero, CAST(NULL AS DOUBLE) AS outside FROM cells")
def tensor_entries(spark, sf_dir):
    """A tensor of shape (2, 3) of the cell's values, added to one of its coordinates."""
    values = F.array("u", *(F.lit(0.0),) * 4, F.col("c").cast("double"))
    more = F.array(F.col("g0").cast("double"), *(F.lit(0.0),) * 5)
    t = G.tensor_added(G.tensor_added(G.tensor_zero((2, 3)), values), more)
    at = lambda i, j: G.tensor_entry(t, (2, 3), F.lit(i), F.lit(j))
    return cells(spark, sf_dir).select("level", *SPEC.g, at(0, 0).alias("first"), at(1, 2).alias("last"), at(1, 0).alias("zero"), at(2, 0).alias("outside"))


_DOT = "t * 3 - g0 * 1 - g1 * 2 - y * 0.5"


@query("spacetime_intervals", f"WITH {CELLS}, events AS (SELECT level, g0, g1, CAST(c AS DOUBLE) AS t, u / 10 AS y FROM cells) SELECT level, g0, g1, {sql6('t * t - g0 * g0 - g1 * g1 - y * y')} AS s2, {sql6(_DOT)} AS dot, CASE WHEN t * t - g0 * g0 - g1 * g1 - y * y > 0 THEN 'timelike' WHEN t * t - g0 * g0 - g1 * g1 - y * y = 0 THEN 'lightlike' ELSE 'spacelike' END AS kind FROM events")
def spacetime_intervals(spark, sf_dir):
    v = F.array(F.col("c").cast("double"), F.col("g0").cast("double"), F.col("g1").cast("double"), F.col("u") / 10)
    s2 = G.interval(v)
    kind = F.when(s2 > 0, "timelike").when(s2 == 0, "lightlike").otherwise("spacelike")
    return cells(spark, sf_dir).select("level", *SPEC.g, r6(s2).alias("s2"), r6(G.minkowski_dot(v, F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0), F.lit(0.5)))).alias("dot"), kind.alias("kind"))


_P = [("u", "1.0"), ("CAST(c AS DOUBLE)", "-1.0"), ("0.5", "u"), ("2.0", "CAST(g0 AS DOUBLE)")]


@query("spin_expectations", f"""WITH {CELLS} SELECT level, g0, g1, {sql6("2 * (u * c - 1) + 2 * (0.5 * 2 + u * g0)")} AS s1, {sql6("2 * (u * -1 - c * 1) + 2 * (0.5 * g0 - 2 * u)")} AS s2,
{sql6("u * u + 1 - c * c - 1 + 0.25 + u * u - 4 - g0 * g0")} AS s3, {sql6("u * u + 1 + c * c + 1 - 0.25 - u * u - 4 - g0 * g0")} AS scalar FROM cells""")
def spin_expectations(spark, sf_dir):
    """Of the spinor (u + i, c - i, 1/2 + i u, 2 + i g0) at each cell."""
    psi = F.array("u", F.lit(1.0), F.col("c").cast("double"), F.lit(-1.0), F.lit(0.5), "u", F.lit(2.0), F.col("g0").cast("double"))
    return cells(spark, sf_dir).select("level", *SPEC.g, *(r6(G.spin(psi, k)).alias(f"s{k}") for k in (1, 2, 3)), r6(G.scalar_density(psi)).alias("scalar"))


@query("physical_constants", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in constants.CONSTANTS.items()) + ") t(name, value)")
def physical_constants(spark, sf_dir):
    return constants.table(spark)


_LOCAL = f"g0 % {B} + {B} * (g1 % {B})"


@query("local_neighbors", f"WITH {CELLS} SELECT g0, g1, CAST(f.range AS INTEGER) AS face, CAST(CASE f.range WHEN 0 THEN (g0 + 1) % {B} + {B} * (g1 % {B}) WHEN 1 THEN (g0 + {B - 1}) % {B} + {B} * (g1 % {B}) WHEN 2 THEN g0 % {B} + {B} * ((g1 + 1) % {B}) ELSE g0 % {B} + {B} * ((g1 + {B - 1}) % {B}) END AS INTEGER) AS neighbor FROM cells, range(4) f")
def local_neighbors(spark, sf_dir):
    """The site beyond each face within the own block, which wraps."""
    faces = F.array(*(F.struct(F.lit(f).alias("face"), A.local_neighbor(SPEC, A.local_index(SPEC), f).alias("neighbor")) for f in range(4)))
    return cells(spark, sf_dir).select("g0", "g1", F.explode(faces).alias("f")).select("g0", "g1", "f.face", "f.neighbor")


@query("find_blocks", f"WITH {MESH} SELECT level, b0, b1 FROM blocks WHERE (level, b0, b1) IN (SELECT 0, b0, b1 FROM (SELECT DISTINCT b0 // 2 AS b0, b1 // 2 AS b1 FROM blocks WHERE level = 1) UNION ALL SELECT 1, b0 + 1, b1 FROM blocks)")
def find_blocks(spark, sf_dir):
    """Blocks with given keys: the parents of level 1, which are gone, and those to the right of any block's coordinates at level 1."""
    blocks = mesh_blocks(spark, sf_dir)
    parents = blocks.where("level = 1").select(F.lit(0).alias("level"), *(A.shr(b, 1).alias(b) for b in SPEC.b))
    keys = parents.unionByName(blocks.select(F.lit(1).alias("level"), (F.col("b0") + 1).alias("b0"), "b1"))
    return neighbors.find_blocks(blocks, keys, SPEC)


@query("block_owners", f"WITH {MESH} SELECT level, b0, b1, CASE WHEN (b0 + b1) % 2 = 0 THEN CAST((b0 + 2 * b1) % 3 AS INTEGER) END AS owner FROM blocks")
def block_owners(spark, sf_dir):
    """Owners looked up by key; blocks without one keep null."""
    blocks = mesh_blocks(spark, sf_dir)
    owners = blocks.where("(b0 + b1) % 2 = 0").withColumn("owner", ((F.col("b0") + 2 * F.col("b1")) % 3).cast("int"))
    return neighbors.owned(blocks, owners, SPEC)
