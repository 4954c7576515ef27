"""Addresses as column expressions: blocks, local and face indices, positions, wrapping, Morton keys.

A cell is keyed by its level and its site coordinates at that level; block, parent and neighbours follow by shifts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshlark.spec import MeshSpec


def shl(x: Column | str, by: Column | int) -> Column:
    """x << by; by may be a column."""
    return F.call_function("shiftleft", F.col(x) if isinstance(x, str) else x, by if isinstance(by, Column) else F.lit(by))


def shr(x: Column | str, by: Column | int) -> Column:
    """x >> by; by may be a column."""
    return F.call_function("shiftright", F.col(x) if isinstance(x, str) else x, by if isinstance(by, Column) else F.lit(by))


def cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def block_coords(spec: MeshSpec, g: list[Column] | None = None) -> list[Column]:
    """Block coordinates of a cell, named b0, b1 ..."""
    return [shr(c, spec.shift).alias(n) for c, n in zip(g or cols(spec.g), spec.b, strict=True)]


def local_coords(spec: MeshSpec, g: list[Column] | None = None) -> list[Column]:
    return [c.bitwiseAND(F.lit(spec.block_size - 1)) for c in (g or cols(spec.g))]


def _mixed_radix(digits: list[Column], base: int) -> Column:
    return reduce(Column.__add__, [x * F.lit(base**k) for k, x in enumerate(digits)], F.lit(0)).cast("int")


def local_index(spec: MeshSpec, g: list[Column] | None = None) -> Column:
    """Site index in the block, dimension 0 fastest."""
    return _mixed_radix(local_coords(spec, g), spec.block_size)


def local_from_index(spec: MeshSpec, index: Column) -> list[Column]:
    return [shr(index, spec.shift * d).bitwiseAND(F.lit(spec.block_size - 1)) for d in range(spec.nd)]


def local_neighbor(spec: MeshSpec, index: Column, face: int) -> Column:
    """Index of the site beyond a face within the own block, which wraps; only sites off the face have their true neighbour there."""
    x = local_from_index(spec, index)
    x[face // 2] = (x[face // 2] + (-1 if face % 2 else 1)).bitwiseAND(F.lit(spec.block_size - 1))
    return _mixed_radix(x, spec.block_size)


def face_index(spec: MeshSpec, face: int, g: list[Column] | None = None) -> Column:
    """Index on a face: the other dimensions in ascending order."""
    return _mixed_radix([x for d, x in enumerate(local_coords(spec, g)) if d != face // 2], spec.block_size)


def on_face(spec: MeshSpec, face: int, g: list[Column] | None = None) -> Column:
    """Whether a cell lies on a face of its block; face 2d is +d, 2d + 1 is -d."""
    return local_coords(spec, g)[face // 2] == (0 if face % 2 else spec.block_size - 1)


def on_boundary(spec: MeshSpec, g: list[Column] | None = None) -> Column:
    return reduce(Column.__or__, [on_face(spec, f, g) for f in range(spec.faces)])


def global_coords(spec: MeshSpec, index: Column, b: list[Column] | None = None) -> list[Column]:
    """Cell coordinates of a site of a block."""
    return [(shl(c, spec.shift) + x).alias(n) for c, x, n in zip(b or cols(spec.b), local_from_index(spec, index), spec.g, strict=True)]


def spacing(spec: MeshSpec, level: Column | None = None) -> Column:
    return F.lit(spec.spacing) / F.pow(F.lit(2.0), F.col("level") if level is None else level)


def cell_volume(spec: MeshSpec, level: Column | None = None) -> Column:
    return F.pow(spacing(spec, level), F.lit(float(spec.nd)))


def positions(spec: MeshSpec, level: Column | None = None, g: list[Column] | None = None) -> list[Column]:
    """Physical place of a cell's corner."""
    return [(c * spacing(spec, level)).alias(f"x{d}") for d, c in enumerate(g or cols(spec.g))]


def block_extent(spec: MeshSpec, level: Column | None = None) -> Column:
    return spacing(spec, level) * spec.block_size


def block_of_position(spec: MeshSpec, x: list[Column], level: Column) -> list[Column]:
    """Block coordinates of a physical place at a level."""
    return [F.floor(c / block_extent(spec, level)).alias(n) for c, n in zip(x, spec.b, strict=True)]


def extent(spec: MeshSpec, d: int, level: Column) -> Column:
    """Cells of dimension d at a level."""
    return shl(F.lit(spec.sites[d]).cast("long"), level)


def wrap(spec: MeshSpec, g: list[Column], level: Column) -> list[Column]:
    """Coordinates back in the domain; null beyond an open boundary."""
    out = []
    for d, c in enumerate(g):
        n = extent(spec, d, level)
        out.append(F.pmod(c, n) if spec.periodic[d] else F.when((c >= 0) & (c < n), c))
    return out


def wrap_position(spec: MeshSpec, x: list[Column]) -> list[Column]:
    """Physical places back in the domain; null beyond an open boundary."""
    out = []
    for d, c in enumerate(x):
        size = F.lit(spec.sites[d] * spec.spacing)
        out.append(c - F.floor(c / size) * size if spec.periodic[d] else F.when((c >= 0) & (c < size), c))
    return out


def inside(coords: list[Column]) -> Column:
    return reduce(Column.__and__, [c.isNotNull() for c in coords])


def morton_encode(coords: list[Column], bits: int) -> Column:
    """Bits of the coordinates interleaved: bit k of dimension d becomes bit k * nd + d."""
    nd = len(coords)
    if bits * nd > 62:
        raise ValueError("Morton keys are limited to 62 bits")
    parts = [shl(shr(c.cast("long"), k).bitwiseAND(F.lit(1)), k * nd + d) for d, c in enumerate(coords) for k in range(bits)]
    return reduce(Column.bitwiseOR, parts)


def morton_decode(key: Column, nd: int, bits: int) -> list[Column]:
    return [reduce(Column.bitwiseOR, [shl(shr(key, k * nd + d).bitwiseAND(F.lit(1)), k) for k in range(bits)]) for d in range(nd)]


def block_morton(spec: MeshSpec, level: Column | None = None, b: list[Column] | None = None) -> Column:
    """Ordering key of blocks of all levels: that of the block's first descendant at the finest level."""
    up = F.lit(spec.max_level) - (F.col("level") if level is None else level)
    bits = spec.coord_bits + spec.max_level
    return morton_encode([shl(c.cast("long"), up.cast("int")) for c in (b or cols(spec.b))], bits)


def block_morton_compat(spec: MeshSpec, level: Column | None = None, b: list[Column] | None = None, max_bits: int = 12) -> Column:
    """The per-level key: coordinates shifted up by the level, interleaved in as many bits as the level adds. Not unique in large domains."""
    lv = (F.col("level") if level is None else level).cast("int")
    mask = shl(F.lit(1).cast("long"), F.lit(spec.coord_bits) + lv) - 1
    return morton_encode([shl(c.cast("long"), lv).bitwiseAND(mask) for c in (b or cols(spec.b))], min(max_bits, 62 // spec.nd))
