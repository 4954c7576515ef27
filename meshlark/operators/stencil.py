"""Kernels on cells: Laplacian, heat and diffusion steps, block gradients, and block kernels in numpy.

Neighbours are not joined one by one: every cell sends its value to the places around it and one aggregation sums them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.operators._common import to_neighbors
from meshlark.operators.halo import COARSER, FINER, halo
from meshlark.spec import MeshSpec


def neighbor_sum(cells: DataFrame, spec: MeshSpec, value: str = "u", levels: bool = False) -> DataFrame:
    """level, g0 ..., the value and nb, the sum over its 2 nd neighbours; what lies beyond an open boundary is 0.

    levels: also over faces between levels, by halo exchange.
    """
    own = cells.select("level", *spec.g, F.col(value).alias("_u"), F.lit(0.0).alias("_n"))
    sent = to_neighbors(cells, spec, F.col(value).alias("_n")).select("level", *spec.g, F.lit(None).cast("double").alias("_u"), "_n")
    every = own.unionByName(sent)
    if levels:
        across = halo(cells, spec, value, (COARSER, FINER))
        every = every.unionByName(across.select("level", *spec.g, F.lit(None).cast("double").alias("_u"), F.col(value).alias("_n")))
    out = every.groupBy("level", *spec.g).agg(F.max("_u").alias(value), F.sum("_n").alias("nb"))
    return out.where(F.col(value).isNotNull())


def laplacian(cells: DataFrame, spec: MeshSpec, value: str = "u", levels: bool = False) -> DataFrame:
    """level, g0 ..., value and lap = (sum of neighbours - 2 nd u) / h^2."""
    h = A.spacing(spec)
    return neighbor_sum(cells, spec, value, levels).select("level", *spec.g, value, ((F.col("nb") - 2.0 * spec.nd * F.col(value)) / (h * h)).alias("lap"))


def heat_step(cells: DataFrame, spec: MeshSpec, alpha: float, dt: float, value: str = "u", levels: bool = False) -> DataFrame:
    """u + alpha dt (sum of neighbours - 2 nd u); spacing plays no part."""
    nb = neighbor_sum(cells, spec, value, levels)
    return nb.select("level", *spec.g, (F.col(value) + alpha * dt * (F.col("nb") - 2.0 * spec.nd * F.col(value))).alias(value))


def diffusion_step(cells: DataFrame, spec: MeshSpec, alpha: float, dt: float, value: str = "u", levels: bool = False) -> DataFrame:
    """u + alpha dt lap."""
    return laplacian(cells, spec, value, levels).select("level", *spec.g, (F.col(value) + alpha * dt * F.col("lap")).alias(value))


def block_gradient(cells: DataFrame, spec: MeshSpec, value: str = "u") -> DataFrame:
    """level, b0 ..., grad: the largest |u(x + d) - u(x)| over the cells x off the block's faces; 0 where there is none."""
    none = F.lit(None).cast("double")
    ahead = to_neighbors(cells, spec, F.col(value).alias("_n")).where("side = 1").select("level", *spec.g, none.alias("_u"), "_n")
    every = cells.select("level", *spec.g, F.col(value).alias("_u"), none.alias("_n")).unionByName(ahead)
    per = every.groupBy("level", *spec.g).agg(F.max("_u").alias("_u"), F.min("_n").alias("_low"), F.max("_n").alias("_high")).where(F.col("_u").isNotNull())
    step = F.when(~A.on_boundary(spec), F.greatest(F.col("_high") - F.col("_u"), F.col("_u") - F.col("_low")))
    return per.groupBy("level", *A.block_coords(spec)).agg(F.coalesce(F.max(step), F.lit(0.0)).alias("grad"))


def apply_kernel(cells: DataFrame, spec: MeshSpec, kernel: Callable[[np.ndarray, dict[int, np.ndarray], int], np.ndarray], value: str = "u") -> DataFrame:
    """A block kernel: kernel(u, ghosts by face, level) -> new u, arrays of shape (B,) * nd with dimension 0 first.

    Ghosts that nothing covers are 0. A patch of neighbouring blocks and their ghosts, at most about 2^14 cells, meets in one
    call, so that what a call costs is shared by its blocks.
    """
    shape, face_shape = (spec.block_size,) * spec.nd, (spec.block_size,) * (spec.nd - 1)
    own = cells.select("level", *A.block_coords(spec), A.local_index(spec).alias("i"), F.lit(-1).alias("face"), F.col(value).alias("v"))
    beyond = halo(cells, spec, value).select("level", *spec.b, F.col("face_idx").alias("i"), "face", F.col(value).alias("v"))
    names, g, faces = spec.b, spec.g, spec.faces
    patch = max(0, (14 - spec.shift * spec.nd) // spec.nd)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        level = int(pdf["level"].iloc[0])
        b, face, i, v = pdf[names].to_numpy(), pdf["face"].to_numpy(), pdf["i"].to_numpy(), pdf["v"].to_numpy(np.float64)
        at = np.zeros(len(b), np.int64)  # the block's place in the patch
        for d in range(len(names)):
            at = (at << patch) | (b[:, d] & ((1 << patch) - 1))
        places, block = np.unique(at, return_inverse=True)
        inside = face == -1
        u = np.zeros((len(places), int(np.prod(shape))))
        u[block[inside], i[inside]] = v[inside]
        ghost = np.zeros((faces, len(places), max(1, int(np.prod(face_shape)))))
        ghost[face[~inside], block[~inside], i[~inside]] = v[~inside]
        new = np.empty_like(u)
        for k in range(len(places)):
            around = {f: ghost[f, k].reshape(face_shape, order="F") for f in range(faces)}
            new[k] = np.asarray(kernel(u[k].reshape(shape, order="F"), around, level)).reshape(-1, order="F")
        mine, site = b[inside], i[inside]
        out = {"level": np.full(len(site), level, np.int32)}
        for d, n in enumerate(g):
            out[n] = mine[:, d] * shape[0] + site // shape[0] ** d % shape[0]
        return pd.DataFrame(out | {value: new[block[inside], site]})

    schema = f"level int, {', '.join(f'{n} long' for n in g)}, {value} double"
    patches = [A.shr(n, patch).alias(f"p{d}") for d, n in enumerate(names)]
    return own.unionByName(beyond).groupBy("level", *patches).applyInPandas(run, schema)


#: Cells of the arrays in which tiles are relaxed: those of a tile, and at most those with its ghosts.
TILE, ROOM = 1 << 14, 1 << 22


def _tile_shift(spec: MeshSpec) -> int:
    """log2 of a tile's side: whole blocks, at most TILE cells beyond the first."""
    return max(spec.shift, (TILE.bit_length() - 1) // spec.nd)


def sweeps_at_once(spec: MeshSpec) -> int:
    """How many sweeps a tile can make from one exchange, as many ghosts deep; 0 if one layer of ghosts has no room."""
    side = 1 << _tile_shift(spec)
    return max((w for w in range(1, spec.block_size + 1) if (side + 2 * w) ** spec.nd <= ROOM), default=0)


def _in_tiles(cells: DataFrame, spec: MeshSpec, value: str, kind: int, deep: int) -> DataFrame:
    """level, t0 ... (tile), p0 ... (place from the tile's corner), _kind, _v: every cell in its tile and, up to `deep` beyond its sides, in others."""
    shift, last = _tile_shift(spec), F.lit((1 << _tile_shift(spec)) - 1)
    t, p = [f"t{d}" for d in range(spec.nd)], [f"p{d}" for d in range(spec.nd)]
    held = cells.where(F.col(value).isNotNull()).select("level", *spec.g, F.lit(kind).alias("_kind"), F.col(value).cast("double").alias("_v"))
    own = held.select("level", *(A.shr(g, shift).alias(n) for g, n in zip(spec.g, t, strict=True)), *(F.col(g).bitwiseAND(last).alias(n) for g, n in zip(spec.g, p, strict=True)), "_kind", "_v")
    near, rim = F.lit(False), held
    for d, g in enumerate(spec.g):
        at = F.col(g).bitwiseAND(last)
        near = near | (at < deep) | (at > last - deep) | (F.col(g) >= A.extent(spec, d, F.col("level")) - deep)
    rim = rim.where(near)
    for d, g in enumerate(spec.g):
        n, places = A.extent(spec, d, F.col("level")), []
        for turn in (-1, 0, 1) if spec.periodic[d] else (0,):
            image = F.col(g) + turn * n
            for by in (-1, 0, 1):
                tile = A.shr(image, shift) + by
                start = A.shl(tile, shift)
                there = (tile >= 0) & (start < n) & (image >= start - deep) & (image < F.least(start + last + 1, n) + deep)
                places.append(F.when(there, F.struct(tile.alias(t[d]), (image - start).alias(p[d]), F.lit(turn == 0 and by == 0).alias(f"_home{d}"))))
        rim = rim.select("*", F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())).alias("_x")).select("*", "_x.*").drop("_x")
    home = F.lit(True)
    for d in range(spec.nd):
        home = home & F.col(f"_home{d}")
    return own.unionByName(rim.where(~home).select(*own.columns))


def relaxed(u: DataFrame, f: DataFrame, spec: MeshSpec, sweeps: int, weight: float = 0.8, residual: bool = False) -> DataFrame:
    """u after weighted Jacobi sweeps of lap u = f, or then f - lap u; cells that u and f both have, what else lies around counts as 0.

    Tiles meet with as many layers of ghosts as there are sweeps (residual: one more), so one exchange serves them all.
    """
    deep = sweeps + bool(residual)
    if not 0 < deep <= sweeps_at_once(spec):
        raise ValueError("as many sweeps as sweeps_at_once() allows, one at least")
    side, nd, g, sites, spacing = 1 << _tile_shift(spec), spec.nd, spec.g, spec.sites, spec.spacing
    t, p = [f"t{d}" for d in range(nd)], [f"p{d}" for d in range(nd)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        level, corner = int(key[0]), [int(k) * side for k in key[1:]]
        h2 = (spacing / 2**level) ** 2
        at = pdf[p].to_numpy() + deep
        field, has = np.zeros((2, *(side + 2 * deep,) * nd)), np.zeros((2, *(side + 2 * deep,) * nd), bool)
        where = (pdf["_kind"].to_numpy(), *(at[:, d] for d in range(nd)))
        field[where], has[where] = pdf["_v"].to_numpy(), True
        now, both = field[0], has[0] & has[1]

        def lap(x: np.ndarray) -> np.ndarray:
            out = -2.0 * nd * x
            for d in range(nd):
                low, high = (np.s_[:],) * d + (np.s_[:-1],), (np.s_[:],) * d + (np.s_[1:],)
                out[high] += x[low]
                out[low] += x[high]
            return out / h2

        for _ in range(sweeps):
            now = np.where(both, now + weight * h2 / (2.0 * nd) * (lap(now) - field[1]), 0.0)
        if residual:
            now = field[1] - lap(now)
        inner = tuple(slice(deep, deep + min(side, (sites[d] << level) - corner[d])) for d in range(nd))
        cells = np.nonzero(both[inner])
        return pd.DataFrame({"level": np.full(len(cells[0]), level, np.int32)} | {n: c + o for n, c, o in zip(g, cells, corner, strict=True)} | {"u": now[inner][cells]})

    rows = _in_tiles(u, spec, "u", 0, deep).unionByName(_in_tiles(f, spec, "u", 1, deep))
    return rows.groupBy("level", *t).applyInPandas(run, f"level int, {', '.join(f'{n} long' for n in g)}, u double")


def with_potential(cells: DataFrame, spec: MeshSpec, potential: Callable[[list[Column], Column], Column]) -> DataFrame:
    """cells and v, the potential at their places: potential(positions, spacing)."""
    return cells.withColumn("v", potential(A.positions(spec), A.spacing(spec)))


__all__ = ["Iterator", "apply_kernel", "block_gradient", "diffusion_step", "heat_step", "laplacian", "neighbor_sum", "relaxed", "sweeps_at_once", "with_potential"]
