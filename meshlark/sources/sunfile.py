"""The .sun lattice file: a header, then blocks with density, links, plaquettes and the full field, by flags."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file format.
MAGIC, VERSION = b"SUN\0", 1
HEADER, BLOCK = struct.Struct("<4sIIIIIdII"), struct.Struct("<B7x4Q")
DENSITY, LINKS, PLAQUETTES, FULL_FIELD = 1, 2, 4, 8

SCHEMA = "path string, time_slice int, block int, block_size int, n_gauge int, n_field int, level int, origin array<long>, spacing double, density array<double>, field array<double>, links array<double>, plaquettes array<double>"


def lengths(flags: int, block_size: int, n_gauge: int, n_field: int) -> list[tuple[str, int]]:
    """Names and numbers of doubles of a block's parts, in file order."""
    v = block_size**4
    parts = [("density", DENSITY, v), ("field", FULL_FIELD, 2 * v * n_field), ("links", LINKS, 4 * v * (1 if n_gauge == 1 else 2 * n_gauge**2)), ("plaquettes", PLAQUETTES, 6 * v)]
    return [(name, n) for name, flag, n in parts if flags & flag]


def parse(path: str, data: bytes) -> Iterator[dict]:
    if len(data) < HEADER.size:
        raise ValueError(f"{path}: too short for a header")
    magic, version, n_blocks, size, n_gauge, n_field, base, time_slice, flags = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError(f"{path}: not a .sun file")
    if version != VERSION:
        raise ValueError(f"{path}: unsupported version {version}")
    at = HEADER.size
    for k in range(n_blocks):
        if at + BLOCK.size > len(data):
            raise ValueError(f"{path}: too short for block {k}")
        level, *origin = BLOCK.unpack_from(data, at)
        at += BLOCK.size
        row = {"path": path, "time_slice": time_slice, "block": k, "block_size": size, "n_gauge": n_gauge, "n_field": n_field, "level": level, "origin": origin, "spacing": base / 2**level}
        for name, n in lengths(flags, size, n_gauge, n_field):
            if at + 8 * n > len(data):
                raise ValueError(f"{path}: block {k} ends within its {name}")
            row[name] = np.frombuffer(data, "<f8", n, at)
            at += 8 * n
        yield row


def read_sun(spark: SparkSession, path: str) -> DataFrame:
    """One row a block of all .sun files below a path (glob allowed); parts that a file lacks are null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sun").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"path": pa.string(), "spacing": pa.float64(), "origin": pa.list_(pa.int64()), **{c: pa.list_(pa.float64()) for c in ("density", "field", "links", "plaquettes")}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for row in parse(p, data.as_py()):  # a block at a time
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], kinds.get(n, pa.int32())) for n in names], names=names)

    return files.mapInArrow(run, SCHEMA)


def frames(files: DataFrame) -> DataFrame:
    """files with frame, the four digits before the extension of their path."""
    return files.withColumn("frame", F.try_to_number(F.regexp_extract("path", r"(\d{4})\.sun$", 1), F.lit("9999")).cast("int"))


def cells(blocks: DataFrame) -> DataFrame:
    """level, g0 ... g3 and density of every site, dimension 0 fastest."""
    rows = blocks.select("path", "level", "origin", "block_size", F.posexplode("density").alias("i", "density"))
    b = F.col("block_size")
    digit = lambda d: F.floor(F.col("i") / F.pow(b, F.lit(d))) % b
    return rows.select("path", "level", *((F.get("origin", F.lit(d)) + digit(d)).cast("long").alias(f"g{d}") for d in range(4)), "density")


def encode(rows: list[dict], base_spacing: float, time_slice: int = 0) -> bytes:
    """A file of blocks (level, origin, block_size, n_gauge, n_field and the parts; all with the same parts)."""
    first = rows[0]
    present = {"density": DENSITY, "field": FULL_FIELD, "links": LINKS, "plaquettes": PLAQUETTES}
    flags = sum(flag for name, flag in present.items() if first.get(name) is not None)
    out = [HEADER.pack(MAGIC, VERSION, len(rows), first["block_size"], first["n_gauge"], first["n_field"], base_spacing, time_slice, flags)]
    for row in rows:
        out.append(BLOCK.pack(row["level"], *row["origin"]))
        for name, n in lengths(flags, row["block_size"], row["n_gauge"], row["n_field"]):
            body = np.asarray(row[name], "<f8")
            if len(body) != n:
                raise ValueError(f"{name} has {len(body)} numbers, not {n}")
            out.append(body.tobytes())
    return b"".join(out)


def encoded(blocks: DataFrame, base_spacing: float) -> DataFrame:
    """path and content of a file for each block; a file holds one block, as generated samples do."""
    schema = "path string, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["path"] for r in rows], pa.string()), pa.array([encode([r], base_spacing, r["time_slice"]) for r in rows], pa.binary())], names=["path", "content"])

    return blocks.mapInArrow(run, schema)


def field_slices(blocks: DataFrame, t: int = 0) -> DataFrame:
    """path, block, x: the full field of each block as 2 n_field planes of floats, real parts first."""
    n = F.col("n_field") * 2
    order = F.sequence(F.lit(0), n - 1)
    source = lambda c: F.when(c < F.col("n_field"), 2 * c).otherwise(2 * (c - F.col("n_field")) + 1)
    per = F.transform(order, lambda c: F.transform(F.sequence(F.lit(0), F.pow(F.col("block_size"), F.lit(4)).cast("int") - 1), lambda s: F.get("field", s * n + source(c)).cast("float")))
    return blocks.where(F.col("field").isNotNull()).select("path", "block", "level", "origin", per.alias("x"))
