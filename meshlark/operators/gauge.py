"""U(1) gauge fields as angles on links: plaquettes, action, forces, covariant Laplacian, Hamiltonian. Built-in functions only.

links: level, g0 ..., mu, theta. A link that is missing is the identity. Each link sends itself to the plaquettes it is part
of, each plaquette to its links, so every operator is one or two aggregations and no chain of shifted joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.operators._common import merged, moved
from meshlark.operators.measure import norm_squared
from meshlark.spec import MeshSpec


def planes(spec: MeshSpec) -> list[tuple[int, int]]:
    return [(m, n) for m in range(spec.nd) for n in range(m + 1, spec.nd)]


def plaquettes(links: DataFrame, spec: MeshSpec) -> DataFrame:
    """level, g0 ..., mu, nu, angle: the angle round each plaquette whose corner has links; mu < nu."""
    sent = []
    for m, n in planes(spec):
        here = [F.col(g).alias(g) for g in spec.g]
        for of, at, sign in ((m, here, 1.0), (n, here, -1.0), (m, moved(spec, n, -1), -1.0), (n, moved(spec, m, -1), 1.0)):
            sent.append(F.when(F.col("mu") == of, F.struct(*at, F.lit(m).alias("mu"), F.lit(n).alias("nu"), (sign * F.col("theta")).alias("a"), F.lit(at is here).alias("own"))))
    rows = links.select("level", F.explode(F.filter(F.array(*sent), lambda x: x.isNotNull())).alias("s")).select("level", "s.*").where(A.inside(A.cols(spec.g)))
    out = rows.groupBy("level", *spec.g, "mu", "nu").agg(F.sum("a").alias("angle"), F.max("own").alias("own"))
    return out.where("own").drop("own")


def block_plaquettes(links: DataFrame, spec: MeshSpec) -> DataFrame:
    """level, b0 ..., avg: the mean of cos(angle) over all plaquettes of a block."""
    return plaquettes(links, spec).groupBy("level", *A.block_coords(spec)).agg(F.avg(F.cos("angle")).alias("avg"))


def average_plaquette(links: DataFrame, spec: MeshSpec) -> DataFrame:
    """avg: the mean over blocks, each with weight 1; 1 without links."""
    return block_plaquettes(links, spec).agg(F.coalesce(F.avg("avg"), F.lit(1.0)).alias("avg"))


def wilson_action(links: DataFrame, spec: MeshSpec, beta: float) -> DataFrame:
    """action: beta x (1 - cos) summed over plaquettes."""
    return plaquettes(links, spec).agg(F.coalesce(F.sum(beta * (1.0 - F.cos("angle"))), F.lit(0.0)).alias("action"))


def forces(links: DataFrame, spec: MeshSpec, beta: float) -> DataFrame:
    """level, g0 ..., mu, f = -beta Im(U staple), all staples counted."""
    sent = []
    for m, n in planes(spec):
        here = [F.col(g).alias(g) for g in spec.g]
        for of, at, sign in ((m, here, 1.0), (n, here, -1.0), (m, moved(spec, n, 1), -1.0), (n, moved(spec, m, 1), 1.0)):
            sent.append(F.when((F.col("mu") == m) & (F.col("nu") == n), F.struct(*at, F.lit(of).alias("mu"), (sign * F.sin("angle")).alias("s"))))
    rows = plaquettes(links, spec).select("level", F.explode(F.filter(F.array(*sent), lambda x: x.isNotNull())).alias("t")).select("level", "t.*")
    return rows.where(A.inside(A.cols(spec.g))).groupBy("level", *spec.g, "mu").agg((-beta * F.sum("s")).alias("f"))


def staples(links: DataFrame, spec: MeshSpec) -> DataFrame:
    """level, g0 ..., mu, re, im: the sum of the staples of each link; U staple is the sum of its plaquettes."""
    sent = []
    for m, n in planes(spec):
        here = [F.col(g).alias(g) for g in spec.g]
        for of, at, sign in ((m, here, 1.0), (n, here, -1.0), (m, moved(spec, n, 1), -1.0), (n, moved(spec, m, 1), 1.0)):
            sent.append(F.when((F.col("mu") == m) & (F.col("nu") == n), F.struct(*at, F.lit(of).alias("mu"), F.cos("angle").alias("c"), (sign * F.sin("angle")).alias("s"))))
    rows = plaquettes(links, spec).select("level", F.explode(F.filter(F.array(*sent), lambda x: x.isNotNull())).alias("t")).select("level", "t.*").where(A.inside(A.cols(spec.g)))
    loops = rows.groupBy("level", *spec.g, "mu").agg(F.sum("c").alias("c"), F.sum("s").alias("s")).join(merged(links.select("level", *spec.g, "mu", "theta")), ["level", *spec.g, "mu"])
    re = F.col("c") * F.cos("theta") + F.col("s") * F.sin("theta")
    return loops.select("level", *spec.g, "mu", re.alias("re"), (F.col("s") * F.cos("theta") - F.col("c") * F.sin("theta")).alias("im"))


def transported(psi: DataFrame, links: DataFrame, spec: MeshSpec) -> DataFrame:
    """level, g0 ..., mu, side, re, im: at each cell U psi(x + mu) (side 1) and U+ psi(x - mu) (side -1). psi: level, g0 ..., re, im."""
    kinds = []
    for m in range(spec.nd):
        kinds.append(F.struct(*moved(spec, m, -1), F.lit(m).alias("mu"), F.lit(1).alias("side")))  # the link begins at the target
        kinds.append(F.struct(*(F.col(g).alias(g) for g in spec.g), F.lit(m).alias("mu"), F.lit(-1).alias("side")))  # at the sender
    rows = psi.select("level", F.explode(F.array(*kinds)).alias("k"), "re", "im").select("level", "k.*", "re", "im").where(A.inside(A.cols(spec.g)))
    linked = rows.join(merged(links.select("level", *spec.g, "mu", "theta")), ["level", *spec.g, "mu"], "left")
    angle = F.coalesce("theta", F.lit(0.0)) * F.col("side")
    turned = linked.select("level", *spec.g, "mu", "side", (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)).alias("re"), (F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)).alias("im"))
    step = lambda d: F.when((F.col("side") == -1) & (F.col("mu") == d), 1).otherwise(0)
    target = A.wrap(spec, [F.col(g) + step(d) for d, g in enumerate(spec.g)], F.col("level"))
    return turned.select("level", *(c.alias(g) for c, g in zip(target, spec.g, strict=True)), "mu", "side", "re", "im").where(A.inside(A.cols(spec.g)))


def transported_across(psi: DataFrame, links: DataFrame, spec: MeshSpec) -> DataFrame:
    """level, g0 ..., face, kind, mu, side, re, im, own_re, own_im: what lies beyond faces between levels, brought to the cell inside.

    On + faces by the cell's own link, on - faces by the adjoint of the covering coarse cell's link; beyond a - face to a
    finer level there is no such link, which counts as the identity.
    """
    from meshlark.operators.halo import COARSER, FINER, halo

    field = psi.select("level", *spec.g, F.struct("re", "im").alias("u"))
    mean = lambda c: F.when(F.count(c) > 0, F.struct(F.avg(c["re"]).alias("re"), F.avg(c["im"]).alias("im")))
    ghosts = halo(field, spec, "u", (COARSER, FINER), restrict=mean, own="own")
    ghosts = ghosts.withColumn("mu", A.shr("face", 1)).withColumn("side", 1 - 2 * (F.col("face") % 2))
    back, coarse = F.col("side") == -1, F.col("kind") == COARSER
    below = A.wrap(spec, [F.col(g) - F.when(F.col("mu") == d, 1).otherwise(0) for d, g in enumerate(spec.g)], F.col("level"))
    at_level = F.when(~back, F.col("level")).when(coarse, F.col("level") - 1).otherwise(-1)
    places = [F.when(back, A.shr(c, 1)).otherwise(F.col(g)).alias(f"l{d}") for d, (c, g) in enumerate(zip(below, spec.g, strict=True))]
    keys = ["l_level", *(f"l{d}" for d in range(spec.nd)), "mu"]
    there = links.select(F.col("level").alias("l_level"), *(F.col(g).alias(f"l{d}") for d, g in enumerate(spec.g)), "mu", "theta")
    found = ghosts.select("*", at_level.alias("l_level"), *places).join(merged(there), keys, "left")
    angle = F.coalesce("theta", F.lit(0.0)) * F.col("side")
    re, im = F.col("u.re"), F.col("u.im")
    return found.select("level", *spec.g, "face", "kind", "mu", "side", (re * F.cos(angle) - im * F.sin(angle)).alias("re"), (re * F.sin(angle) + im * F.cos(angle)).alias("im"), F.col("own.re").alias("own_re"), F.col("own.im").alias("own_im"))


def covariant_face_fluxes(psi: DataFrame, links: DataFrame, spec: MeshSpec, scale: float = 1.0) -> DataFrame:
    """level, g0 ..., face, side ('coarse' or 'fine'), re, im: scale times the covariant gradient along +d times the area, at faces between levels."""
    from meshlark.operators.halo import FINER

    h = A.spacing(spec)
    factor = scale * F.col("side") * F.pow(h, F.lit(float(spec.nd - 2)))
    out = transported_across(psi, links, spec)
    return out.select("level", *spec.g, "face", *((factor * (F.col(c) - F.col(f"own_{c}"))).alias(c) for c in ("re", "im")), F.when(F.col("kind") == FINER, "coarse").otherwise("fine").alias("side"))


def covariant_laplacian(psi: DataFrame, links: DataFrame, spec: MeshSpec, levels: bool = False) -> DataFrame:
    """psi's cells with re, im of [sum of transported neighbours - 2 nd psi] / h^2; levels: also over faces between levels."""
    return beside_laplacian(psi, links, spec, levels).select("level", *spec.g, F.col("_re").alias("re"), F.col("_im").alias("im"))


def beside_laplacian(psi: DataFrame, links: DataFrame, spec: MeshSpec, levels: bool = False) -> DataFrame:
    """psi's cells with their own re, im and, as _re, _im, the covariant Laplacian: one aggregation, no join of the two."""
    h = A.spacing(spec)
    none = [F.lit(None).cast("double").alias(f"own_{c}") for c in ("re", "im")]
    own = psi.select("level", *spec.g, *((-2.0 * spec.nd * F.col(c)).alias(c) for c in ("re", "im")), *(F.col(c).alias(f"own_{c}") for c in ("re", "im")), F.lit(True).alias("own"))
    every = own.unionByName(transported(psi, links, spec).select("level", *spec.g, "re", "im", *none, F.lit(False).alias("own")))
    if levels:
        every = every.unionByName(transported_across(psi, links, spec).select("level", *spec.g, "re", "im", *none, F.lit(False).alias("own")))
    out = every.groupBy("level", *spec.g).agg(*(F.sum(c).alias(c) for c in ("re", "im")), *(F.max(f"own_{c}").alias(f"own_{c}") for c in ("re", "im")), F.max("own").alias("own")).where("own")
    return out.select("level", *spec.g, *(F.col(f"own_{c}").alias(c) for c in ("re", "im")), *((F.col(c) / (h * h)).alias(f"_{c}") for c in ("re", "im")))


def covariant_derivative(psi: DataFrame, links: DataFrame, spec: MeshSpec) -> DataFrame:
    """level, g0 ..., mu, re, im of [U psi(x + mu) - U+ psi(x - mu)] / 2h."""
    h = A.spacing(spec)
    return transported(psi, links, spec).groupBy("level", *spec.g, "mu").agg(*((F.sum(F.col("side") * F.col(c))).alias(c) for c in ("re", "im"))).select("level", *spec.g, "mu", *((F.col(c) / (2.0 * h)).alias(c) for c in ("re", "im")))


def hamiltonian(psi: DataFrame, links: DataFrame, spec: MeshSpec, mass: float, potential: Column, levels: bool = False) -> DataFrame:
    """psi's cells with re, im of H psi = -lap / 2m + V psi. potential: an expression on level and g0 ..."""
    return beside_hamiltonian(psi, links, spec, mass, potential, levels).select("level", *spec.g, F.col("_re").alias("re"), F.col("_im").alias("im"))


def beside_hamiltonian(psi: DataFrame, links: DataFrame, spec: MeshSpec, mass: float, potential: Column, levels: bool = False) -> DataFrame:
    """psi's cells with their own re, im and, as _re, _im, H psi."""
    out = beside_laplacian(psi, links, spec, levels)
    return out.withColumns({f"_{c}": -F.col(f"_{c}") / (2.0 * mass) + potential * F.col(c) for c in ("re", "im")})


def energy(psi: DataFrame, h_psi: DataFrame, spec: MeshSpec, normalize: bool = True) -> DataFrame:
    """energy: Re <psi, H psi> over <psi, psi>, 0 without a norm; not divided if normalize is off."""
    both = psi.join(merged(h_psi.withColumnsRenamed({"re": "_re", "im": "_im"})), ["level", *spec.g])
    v = A.cell_volume(spec)
    sums = both.agg(F.sum((F.col("re") * F.col("_re") + F.col("im") * F.col("_im")) * v).alias("e"), F.sum((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * v).alias("n"))
    return sums.select((F.when(F.col("n") > 0, F.col("e") / F.col("n")).otherwise(0.0) if normalize else F.coalesce("e", F.lit(0.0))).alias("energy"))


def norm(psi: DataFrame, spec: MeshSpec) -> DataFrame:
    return norm_squared(psi, spec, F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def link_halo(links: DataFrame, spec: MeshSpec, blocks: DataFrame) -> DataFrame:
    """level, b0 ..., face, face_idx, mu, theta: the links beyond the faces, of the same level, halved from a coarser one
    (normal links: the first half on + faces, nothing on - faces), combined from a finer one (normal: mean, tangential: product).
    A block without the cell beyond has no row."""
    from meshlark.operators.halo import COARSER, FINER, SAME, halo, rim
    from meshlark.operators.transfer import half_angle

    wide = links.groupBy("level", *spec.g).agg(F.map_from_entries(F.collect_list(F.struct("mu", "theta"))).alias("u"))
    near = halo(wide, spec, "u", (SAME, COARSER))
    flat = near.select("level", *spec.b, "face", "face_idx", "kind", F.explode("u").alias("mu", "theta"))
    normal = F.col("mu") == F.floor(F.col("face") / 2)
    coarse = F.when(normal & (F.col("face") % 2 == 1), 0.0).otherwise(half_angle(F.col("theta")))
    out = flat.select("level", *spec.b, "face", "face_idx", "mu", F.when(F.col("kind") == COARSER, coarse).otherwise(F.col("theta")).alias("theta"))
    fine = links.select("level", *spec.g, "mu", "theta").where("level > 0")
    faces = [F.when(F.col(spec.g[f // 2]).bitwiseAND(F.lit(1)) == f % 2, F.lit(f)) for f in range(spec.faces)]
    o = [f"o{d}" for d in range(spec.nd)]
    sent = fine.select((F.col("level") - 1).alias("level"), *(A.shr(g, 1).alias(k) for g, k in zip(spec.g, o, strict=True)), F.explode(F.filter(F.array(*faces), lambda x: x.isNotNull())).alias("face"), "mu", "theta", *spec.g)
    along = F.element_at(F.array(*(F.col(g) for g in spec.g)), F.col("mu") + 1) % 2
    corner = sum(((F.col(g) % 2 != 0) & (F.col("mu") != d) & (F.floor(F.col("face") / 2) != d)).cast("int") for d, g in enumerate(spec.g))
    is_normal = F.col("mu") == F.floor(F.col("face") / 2)
    mean = F.atan2(F.avg(F.when(is_normal, F.sin("theta"))), F.avg(F.when(is_normal, F.cos("theta"))))
    per = sent.groupBy("level", *o, "face", "mu").agg(F.when(F.first("mu") == F.floor(F.first("face") / 2), mean).otherwise(F.sum(F.when(corner == 0, F.col("theta")))).alias("theta"), F.count(along).alias("_n")).drop("_n")
    return out.unionByName(rim(blocks_cells(wide, spec), spec).join(merged(per), ["level", *o, "face"]).select("level", *spec.b, "face", "face_idx", "mu", "theta")).join(blocks.select("level", *spec.b), ["level", *spec.b], "left_semi")


def blocks_cells(df: DataFrame, spec: MeshSpec) -> DataFrame:
    return df.select("level", *spec.g)


def synced_links(cells: DataFrame, links: DataFrame, spec: MeshSpec) -> DataFrame:
    """A link in each direction at each cell: the given one, or the identity where there is none."""
    every = cells.select("level", *spec.g, F.explode(F.array(*(F.lit(m) for m in range(spec.nd)))).alias("mu"))
    return every.join(merged(links.select("level", *spec.g, "mu", "theta")), ["level", *spec.g, "mu"], "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))


def coulomb(alpha: float, soft: Column, center: tuple[float, ...] | None = None):
    """Potential -alpha / sqrt(r^2 + soft^2) as a function of positions and spacing."""
    return lambda x, h: -alpha / F.sqrt(_r2(x, center) + soft * soft)


def yukawa(g: float, mu: float, center: tuple[float, ...] | None = None):
    """Potential -g exp(-mu r) / r; 0 at the center itself."""

    def value(x, h):
        r = F.sqrt(_r2(x, center))
        return F.when(r > 0, -g * F.exp(-mu * r) / r).otherwise(0.0)

    return value


def many_centers(parts: list):
    return lambda x, h: sum((p(x, h) for p in parts), F.lit(0.0))


def _r2(x: list[Column], center: tuple[float, ...] | None) -> Column:
    return sum(((c - F.lit(float(o))) * (c - F.lit(float(o))) for c, o in zip(x, center or (0.0,) * len(x), strict=True)), F.lit(0.0))
