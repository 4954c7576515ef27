"""Queries on Dirac spinors and SU(2) links."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.catalog._register import N, SPEC, query, r6, sql6, table
from meshlark.catalog.algebra import SU2, su2
from meshlark.operators import special_unitary as SU
from meshlark.plans import spinors as P
from meshlark.sources.lattice import lattice
from meshlark.spec import MeshSpec

#: The lattice of spinors: as many sites as the reference rate for one application is stated for.
S = 16
SPEC4 = MeshSpec((S,) * 4, 8, True, 0.5, 2)
MASS, DT = 1.25, 0.02
_KEYS = ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
_POTENTIAL = "-1 / sqrt(pow((g1 - 8) * 0.5, 2) + pow((g2 - 8) * 0.5, 2) + pow((g3 - 8) * 0.5, 2) + 0.25)"

#: SQL: one row for each component of the spinor at each site, links as angles, and the non-zero entries of the alpha matrices.
SPINORS = f"""sites AS (SELECT a.range AS g0, b.range AS g1, c.range AS g2, d.range AS g3 FROM range({S}) a, range({S}) b, range({S}) c, range({S}) d),
sums AS (SELECT {", ".join(f"{k} % {S} AS g{d}" for d, k in enumerate(_KEYS))}, sum(l_quantity) AS u, count(*) AS c FROM lineitem GROUP BY 1, 2, 3, 4),
grid AS (SELECT s.*, coalesce(x.u, 0) AS u, coalesce(x.c, 0) AS c FROM sites s LEFT JOIN sums x ON s.g0 = x.g0 AND s.g1 = x.g1 AND s.g2 = x.g2 AND s.g3 = x.g3),
psi AS (SELECT g0, g1, g2, g3, CAST(t.range AS INTEGER) AS t, CASE t.range WHEN 0 THEN u WHEN 1 THEN c WHEN 2 THEN g1 ELSE 1 END / 10.0 AS re, CASE t.range WHEN 0 THEN c WHEN 1 THEN g2 WHEN 2 THEN u ELSE g3 END / 10.0 AS im, {_POTENTIAL} AS v FROM grid, range(4) t),
angles AS (SELECT g0, g1, g2, g3, m.range + 1 AS mu, ((c + 3 * m.range + g1 + 2 * g2 + g3) % 8) * 0.1 AS theta FROM grid, range(3) m),
alpha AS (SELECT * FROM (VALUES (1, 0, 3, 1, 0), (1, 1, 2, 1, 0), (1, 2, 1, 1, 0), (1, 3, 0, 1, 0), (2, 0, 3, 0, -1), (2, 1, 2, 0, 1), (2, 2, 1, 0, -1), (2, 3, 0, 0, 1), (3, 0, 2, 1, 0), (3, 1, 3, -1, 0), (3, 2, 0, 1, 0), (3, 3, 1, -1, 0)) a(mu, r, t, ar, ai))"""


def _applied(source: str, name: str, shift: float) -> str:
    """SQL: name = (H - shift) source, of rows g0 ... g3, t, re, im, v."""
    at = lambda sign: ", ".join(f"(x.g{d} + {S} + {sign} * (x.mu = {d})::INT) % {S} AS n{d}" for d in range(4))
    same = lambda a, b: " AND ".join(f"{a}.g{d} = {b}.n{d}" for d in range(4))
    return f"""{name}_beside AS (SELECT x.g0, x.g1, x.g2, x.g3, x.mu, 1 AS side, x.theta AS a, {at(1)} FROM angles x UNION ALL
  SELECT x.g0, x.g1, x.g2, x.g3, x.mu, -1, -l.theta, x.n0, x.n1, x.n2, x.n3 FROM (SELECT x.*, {at(-1)} FROM angles x) x JOIN angles l ON {same("l", "x")} AND l.mu = x.mu),
{name}_d AS (SELECT b.g0, b.g1, b.g2, b.g3, b.mu, p.t, sum(b.side * (p.re * cos(a) - p.im * sin(a))) / (2 * {SPEC4.spacing}) AS re, sum(b.side * (p.re * sin(a) + p.im * cos(a))) / (2 * {SPEC4.spacing}) AS im FROM {name}_beside b JOIN {source} p ON {same("p", "b")} GROUP BY 1, 2, 3, 4, 5, 6),
{name}_k AS (SELECT g0, g1, g2, g3, r AS t, sum(ar * im + ai * re) AS re, sum(ai * im - ar * re) AS im FROM {name}_d d JOIN alpha a ON a.mu = d.mu AND a.t = d.t GROUP BY 1, 2, 3, 4, 5),
{name} AS (SELECT p.g0, p.g1, p.g2, p.g3, p.t, k.re + (CASE WHEN p.t < 2 THEN {MASS} ELSE -{MASS} END + v - {shift}) * p.re AS re, k.im + (CASE WHEN p.t < 2 THEN {MASS} ELSE -{MASS} END + v - {shift}) * p.im AS im, v
  FROM {source} p JOIN {name}_k k ON k.g0 = p.g0 AND k.g1 = p.g1 AND k.g2 = p.g2 AND k.g3 = p.g3 AND k.t = p.t)"""


def _wide(source: str) -> str:
    parts = ", ".join(f"{sql6(f'max(CASE WHEN t = {k} THEN {c} END)')} AS {c}{k}" for k in range(4) for c in ("re", "im"))
    return f"SELECT CAST(0 AS INTEGER) AS level, g0, g1, g2, g3, {parts} FROM {source} GROUP BY 2, 3, 4, 5"


def grid(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*_KEYS, "l_quantity")
    return lattice(rows, SPEC4, _KEYS, "l_quantity")


def psi(spark, sf_dir):
    u, c, g1, g2, g3 = (F.col(x).cast("double") for x in ("u", "c", "g1", "g2", "g3"))
    return grid(spark, sf_dir).select("level", *SPEC4.g, F.transform(F.array(u, c, c, g2, g1, u, F.lit(1.0), g3), lambda x: x / 10.0).alias("v"))


def links(spark, sf_dir):
    rows = grid(spark, sf_dir).select("level", *SPEC4.g, "c", F.explode(F.array(*(F.lit(m) for m in (1, 2, 3)))).alias("mu"))
    theta = ((F.col("c") + 3 * (F.col("mu") - 1) + F.col("g1") + 2 * F.col("g2") + F.col("g3")) % 8) * 0.1
    return rows.select("level", *SPEC4.g, "mu", F.array(F.cos(theta), F.sin(theta)).alias("u"))


def potential():
    r2 = sum((((F.col(f"g{d}") - 8) * 0.5) * ((F.col(f"g{d}") - 8) * 0.5) for d in (1, 2, 3)), F.lit(0.0))
    return -1 / F.sqrt(r2 + 0.25)


def _columns(df):
    return df.select("level", *SPEC4.g, *(r6(F.get("v", F.lit(2 * k + i))).alias(f"{c}{k}") for k in range(4) for i, c in enumerate(("re", "im"))))


@query("dirac_apply", f"WITH {SPINORS}, {_applied('psi', 'h', 0.0)} {_wide('h')}")
def dirac_apply(spark, sf_dir):
    """H psi on 16^4 sites with U(1) links and a Coulomb potential."""
    return _columns(SU.dirac(psi(spark, sf_dir), links(spark, sf_dir), SPEC4, 1, MASS, potential()))


@query("dirac_step", f"WITH {SPINORS}, {_applied('psi', 'h', MASS)}, {_applied('h', 'hh', MASS)}, stepped AS (SELECT p.g0, p.g1, p.g2, p.g3, p.t, p.re - {DT} * k.re AS re, p.im - {DT} * k.im AS im FROM psi p JOIN hh k ON k.g0 = p.g0 AND k.g1 = p.g1 AND k.g2 = p.g2 AND k.g3 = p.g3 AND k.t = p.t) {_wide('stepped')}")
def dirac_step(spark, sf_dir):
    """psi - dt (H - m)^2 psi."""
    return _columns(SU.dirac_step(psi(spark, sf_dir), links(spark, sf_dir), SPEC4, 1, MASS, potential(), DT))


@query("dirac_energy", f"WITH {SPINORS}, {_applied('psi', 'h', 0.0)} SELECT round(sum(p.re * h.re + p.im * h.im) * pow({SPEC4.spacing}, 4), 3) + 0.0 AS energy, round(sum(p.re * p.re + p.im * p.im) * pow({SPEC4.spacing}, 4), 3) + 0.0 AS norm_sq FROM psi p JOIN h ON h.g0 = p.g0 AND h.g1 = p.g1 AND h.g2 = p.g2 AND h.g3 = p.g3 AND h.t = p.t")
def dirac_energy(spark, sf_dir):
    p, u = psi(spark, sf_dir), links(spark, sf_dir)
    h = SU.dirac(p, u, SPEC4, 1, MASS, potential())
    e, n = SU.spinor_energy(p, h, SPEC4), SU.spinor_norm(p, SPEC4)
    return e.crossJoin(F.broadcast(n)).select((F.round("energy", 3) + F.lit(0.0)).alias("energy"), (F.round("norm_sq", 3) + F.lit(0.0)).alias("norm_sq"))


@query("dirac_evolved", f"WITH {SPINORS}, {_applied('psi', 'h', MASS)}, {_applied('h', 'hh', MASS)}, stepped AS (SELECT p.g0, p.g1, p.g2, p.g3, p.t, p.v, p.re - {DT} * k.re AS re, p.im - {DT} * k.im AS im FROM psi p JOIN hh k ON k.g0 = p.g0 AND k.g1 = p.g1 AND k.g2 = p.g2 AND k.g3 = p.g3 AND k.t = p.t), norm AS (SELECT sqrt(sum(re * re + im * im) * pow({SPEC4.spacing}, 4)) AS n FROM stepped), scaled AS (SELECT g0, g1, g2, g3, t, re / n AS re, im / n AS im FROM stepped, norm) {_wide('scaled')}")
def dirac_evolved(spark, sf_dir):
    """One step of imaginary time, normalized."""
    return _columns(P.evolve(psi(spark, sf_dir), links(spark, sf_dir), SPEC4, 1, MASS, potential(), DT, 1))


def _mul(a: str, b: str, adjoint: bool = False) -> str:
    """SQL: the product of two 2 x 2 matrices, the second one adjoint or not, as a list of eight."""
    out = []
    for i in range(2):
        for j in range(2):
            re, im = [], []
            for k in range(2):
                p, q = 2 * (2 * i + k), 2 * (2 * j + k if adjoint else 2 * k + j)
                s = "-" if adjoint else ""
                re.append(f"{a}[{p + 1}] * {b}[{q + 1}] - {a}[{p + 2}] * ({s}{b}[{q + 2}])")
                im.append(f"{a}[{p + 1}] * ({s}{b}[{q + 2}]) + {a}[{p + 2}] * {b}[{q + 1}]")
            out += [" + ".join(f"({x})" for x in re), " + ".join(f"({x})" for x in im)]
    return "[" + ", ".join(out) + "]"


#: SQL: plaquette matrices U0(x) U1(x + 0) U0(x + 1)+ U1(x)+.
SU2_PLAQ = f"""{SU2}, corner AS (SELECT x.level, x.g0, x.g1, x.u AS a, b.u AS b, c.u AS c, d.u AS d FROM su2 x JOIN su2 b ON b.mu = 1 AND b.g0 = (x.g0 + 1) % {N} AND b.g1 = x.g1 JOIN su2 c ON c.mu = 0 AND c.g0 = x.g0 AND c.g1 = (x.g1 + 1) % {N} JOIN su2 d ON d.mu = 1 AND d.g0 = x.g0 AND d.g1 = x.g1 WHERE x.mu = 0),
half AS (SELECT level, g0, g1, {_mul("a", "b")} AS ab, {_mul("d", "c")} AS dc FROM corner), plaq2 AS (SELECT level, g0, g1, {_mul("ab", "dc", True)} AS p FROM half)"""


@query("plaquette_su2", f"WITH {SU2_PLAQ} SELECT level, g0, g1, {', '.join(f'{sql6(f'p[{k + 1}]')} AS p{k}' for k in range(8))} FROM plaq2")
def plaquette_su2(spark, sf_dir):
    out = SU.plaquettes(su2(spark, sf_dir), SPEC, 2)
    return out.select("level", *SPEC.g, *(r6(F.get("p", F.lit(k))).alias(f"p{k}") for k in range(8)))


@query("wilson_action_su2", f"WITH {SU2_PLAQ} SELECT {sql6('sum(2.5 * (2 - (p[1] + p[7])))')} AS action FROM plaq2")
def wilson_action_su2(spark, sf_dir):
    return SU.wilson_action(su2(spark, sf_dir), SPEC, 2, 2.5).select(r6(F.col("action")).alias("action"))

