"""Halo exchange: what lies beyond the faces of blocks, from the same, a coarser or a finer level.

Every cell is offered under its own key and, folded by face, under that of the coarser cell that covers it: one aggregation.
The rim (places one beyond a face) looks under its own and the coarser key: one join with the aggregated offers, which
are dealt by that key already. So all three kinds together cost one shuffle of each side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.operators._common import merged
from meshlark.spec import MeshSpec

#: How a ghost came about.
SAME, COARSER, FINER = "same", "coarser", "finer"


def rim(cells: DataFrame, spec: MeshSpec, *keep: Column) -> DataFrame:
    """level, b0 ..., face, face_idx, g0 ... (the cell inside), o0 ... (the place beyond, wrapped) and keep, of all block faces."""
    faces = []
    for f in range(spec.faces):
        at = A.cols(spec.g)
        at[f // 2] = at[f // 2] + (-1 if f % 2 else 1)
        wrapped = A.wrap(spec, at, F.col("level"))
        faces.append(F.when(A.on_face(spec, f) & A.inside(wrapped), F.struct(F.lit(f).alias("face"), A.face_index(spec, f).alias("face_idx"), *(c.alias(f"o{d}") for d, c in enumerate(wrapped)))))
    out = cells.select("level", *spec.g, *keep, F.explode(F.filter(F.array(*faces), lambda x: x.isNotNull())).alias("f"))
    return out.select("level", *A.block_coords(spec), *spec.g, *(c for c in out.columns if c not in ("level", "f", *spec.g)), "f.*")


def _offers(cells: DataFrame, spec: MeshSpec, value: str, keys: list[str], finer: bool, restrict: Callable[[Column], Column]) -> DataFrame:
    """k_level, k0 ..., _own (the cell there) and _fine, for each face what restrict makes of the finer cells that touch it."""
    own = F.struct(F.col("level").alias("k_level"), *(F.col(g).alias(k) for g, k in zip(spec.g, keys, strict=True)), F.lit(True).alias("_is_own"))
    up = F.struct((F.col("level") - 1).alias("k_level"), *(A.shr(g, 1).alias(k) for g, k in zip(spec.g, keys, strict=True)), F.lit(False).alias("_is_own"))
    sent = F.array(own, F.when(F.col("level") > 0, up)) if finer else F.array(own)
    rows = cells.select(F.explode(F.filter(sent, lambda x: x.isNotNull())).alias("k"), F.col(value).alias("_v"), *(A.shr(g, 0).bitwiseAND(F.lit(1)).alias(f"_bit{d}") for d, g in enumerate(spec.g)))
    folded = [restrict(F.when(~F.col("k._is_own") & (F.col(f"_bit{f // 2}") == f % 2), F.col("_v"))) for f in range(spec.faces)] if finer else []
    return rows.groupBy("k.k_level", *(F.col(f"k.{k}").alias(k) for k in keys)).agg(F.first(F.when(F.col("k._is_own"), F.col("_v")), ignorenulls=True).alias("_own"), *(c.alias(f"_fine{f}") for f, c in enumerate(folded)))


def halo(cells: DataFrame, spec: MeshSpec, value: str = "u", kinds: tuple[str, ...] = (SAME, COARSER, FINER), prolong: Callable[[Column], Column] = lambda u: u, restrict: Callable[[Column], Column] = F.avg, compat_offset: bool = False, own: str | None = None) -> DataFrame:
    """level, b0 ..., face, face_idx, g0 ..., value, kind: one ghost for each place beyond a face that some cell covers.

    From a coarser level the covering cell is taken (prolong), from a finer one the mean (restrict) of the cells that touch
    the face. Ghosts start at nothing at each exchange. compat_offset: fine blocks all see the lower part of the coarse face.
    own: the name of a further column, the value of the cell inside.
    """
    keys = [f"k{d}" for d in range(spec.nd)]
    edge = rim(cells, spec, *([F.col(value).alias(own)] if own else []))
    offers = _offers(cells, spec, value, keys, FINER in kinds, restrict)
    same = F.struct(F.col("level").alias("k_level"), *(F.col(f"o{d}").alias(k) for d, k in enumerate(keys)), F.lit(False).alias("_up"))
    looked = []
    for d in range(spec.nd):
        half = A.shr(f"o{d}", 1)
        if compat_offset:
            low = A.shl(A.shr(half, spec.shift), spec.shift) + A.shr(F.col(f"o{d}").bitwiseAND(F.lit(spec.block_size - 1)), 1)
            half = F.when(A.shr("face", 1) == d, half).otherwise(low)
        looked.append(half)
    up = F.struct((F.col("level") - 1).alias("k_level"), *(c.alias(k) for c, k in zip(looked, keys, strict=True)), F.lit(True).alias("_up"))
    wanted = F.array(*([same] if SAME in kinds or FINER in kinds else []), *([F.when(F.col("level") > 0, up)] if COARSER in kinds else []))
    lookups = edge.select("*", F.explode(F.filter(wanted, lambda x: x.isNotNull())).alias("k")).select("*", "k.*").drop("k", *(f"o{d}" for d in range(spec.nd)))
    found = lookups.join(merged(offers), ["k_level", *keys])
    ghosts = [F.when(F.col("_up"), F.struct(prolong(F.col("_own")).alias("v"), F.lit(COARSER).alias("kind")))] if COARSER in kinds else []
    if SAME in kinds:
        ghosts.append(F.when(~F.col("_up"), F.struct(F.col("_own").alias("v"), F.lit(SAME).alias("kind"))))
    if FINER in kinds:
        fine = F.coalesce(*(F.when(F.col("face") == f, F.col(f"_fine{f}")) for f in range(spec.faces)))
        ghosts.append(F.when(~F.col("_up"), F.struct(fine.alias("v"), F.lit(FINER).alias("kind"))))
    out = found.select("level", *spec.b, "face", "face_idx", *spec.g, *([own] if own else []), F.explode(F.filter(F.array(*ghosts), lambda x: x["v"].isNotNull())).alias("g"))
    return out.select("level", *spec.b, "face", "face_idx", *spec.g, F.col("g.v").alias(value), F.col("g.kind").alias("kind"), *([own] if own else []))
