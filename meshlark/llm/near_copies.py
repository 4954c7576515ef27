"""One document of each group of near copies: SimHash candidates, exact Jaccard check, connected components.

At a similarity of 0.8 two fingerprints differ in about 15 % of their bits, so candidates come from fingerprints of 256
bits, hung below random masks of the hierarchical index, and are then held against their shingle sets. Of crowded nodes
the closest pairs are compared first; then all others whose ends these have not connected, in tiles, so that each text
goes to a tile once and not once a pair. The number of masks follows from the number of texts, so that a pair at 0.8 is
found as often at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm._common import stored
from meshlark.llm.simhash import SEED, candidates, components, fingerprints, random_masks, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
WORDS, RADIUS = 4, 55
#: Share of the pairs at exactly the least similarity that no mask may bring together; closer pairs are missed less.
MISSED = 0.01


def similar_pairs(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Of pairs (a, b) of ids of texts (id, text) those whose sets of `size`-word shingles have a Jaccard similarity of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text"), batch.column("text_b"), strict=True):
                p, q = (np.unique(shingle_hashes(t.as_py() or b"", size, SEED)) for t in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    text = texts.select(F.col("id").alias("a"), F.col("text").cast("binary").alias("text"))
    both = pairs.join(text, "a").join(text.withColumnsRenamed({"a": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text", "text_b").mapInArrow(run, "a long, b long")


#: Hashes of the texts on either side of a block of pairs.
HELD = 1 << 17


def _common(a: list[np.ndarray], b: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many hashes the sets a[p] and b[q] have in common, for each of the pairs p, q."""
    (x, row_x), (y, row_y) = ((np.concatenate(s), np.repeat(np.arange(len(s)), [len(t) for t in s])) for s in (a, b))
    shared = np.intersect1d(x, y)
    bits = []
    for values, row, n in ((x, row_x, len(a)), (y, row_y, len(b))):
        at = np.searchsorted(shared, values)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == values[hit]
        at, ends = at[hit], np.searchsorted(row[hit], np.arange(n + 1))
        table = np.zeros((n, -(-len(shared) // 64) * 8), np.uint8)
        for k in range(n):
            line = np.zeros(table.shape[1] * 8, np.uint8)
            line[at[ends[k] : ends[k + 1]]] = 1
            table[k] = np.packbits(line)
        bits.append(table.view(np.uint64))
    step = max(1, (1 << 20) // max(1, bits[0].shape[1]))
    return np.concatenate([np.bitwise_count(bits[0][p[k : k + step]] & bits[1][q[k : k + step]]).sum(-1, dtype=np.int64) for k in range(0, len(p), step)])


def _joined(rows: pa.Table, masks: list[list[int]], radius: int, least: float) -> pa.Table:
    """Pairs of groups of a tile (mask, side, id, grp, fp, hashes) that a pair of texts of `least` similarity joins.

    Held against each other are all texts of different groups within the radius that agree under this mask and no earlier one.
    """
    fps = np.asarray(rows["fp"].combine_chunks().flatten()).reshape(rows.num_rows, -1).view(np.uint64)
    sets = [np.frombuffer(h.as_py(), np.uint64) for h in rows["hashes"]]
    size = np.array([len(h) for h in sets])
    group, side, ids = np.asarray(rows["grp"]).copy(), np.asarray(rows["side"]), np.asarray(rows["id"])
    twice = np.isin(ids, ids[side == 0]) & np.isin(ids, ids[side == 1])
    earlier = np.zeros((rows["mask"][0].as_py(), fps.shape[1]), np.uint64)
    for k, bit in ((k, bit) for k in range(len(earlier)) for bit in masks[k]):
        earlier[k, bit // 64] |= np.uint64(1 << bit % 64)

    def blocks(s: int) -> list[np.ndarray]:
        own = np.flatnonzero(side == s)
        return np.split(own, np.flatnonzero(np.diff(np.cumsum(size[own]) // HELD)) + 1)

    out = []
    for x in blocks(0):
        for y in blocks(1):
            p, q = np.nonzero((group[x][:, None] != group[y]) & ~((twice[x][:, None] & twice[y]) & (ids[x][:, None] > ids[y])))
            differ = fps[x[p]] ^ fps[y[q]]
            near = np.bitwise_count(differ).sum(-1, dtype=np.int64) <= radius
            for mask in earlier:
                near[near] = ((differ[near] & mask) != 0).any(-1)
            p, q = p[near], q[near]
            if not len(p):
                continue
            both = _common([sets[k] for k in x], [sets[k] for k in y], p, q)
            p, q = x[p], y[q]
            alike = both >= least * (size[p] + size[q] - both)
            for a, b in zip(p[alike].tolist(), q[alike].tolist(), strict=True):
                if group[a] != group[b]:
                    out.append((group[a], group[b]))
                    group[group == group[b]] = group[a]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def joined_groups(tiles: DataFrame, roots: DataFrame, prints: DataFrame, texts: DataFrame, masks: list[list[int]], size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of groups, named by their roots (id, root) or by a text's own id, that pairs of texts in tiles join; exact for all pairs in tiles."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or b"", size, SEED)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "hashes"])

    ends = tiles.select("part", "mask", F.lit(0).alias("side"), F.explode("ids").alias("id")).unionAll(tiles.select("part", "mask", F.lit(1).alias("side"), F.explode("ids_b").alias("id")))
    rows = stored(ends.join(roots, "id", "left").select("part", "mask", "side", "id", F.coalesce("root", "id").alias("grp")))
    mixed = rows.groupBy("part").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("part")
    rows = stored(rows.join(mixed, "part", "left_semi"))
    sets = texts.join(rows.select("id").distinct(), "id", "left_semi").select("id", F.col("text").cast("binary").alias("text")).mapInArrow(hashed, "id long, hashes binary")
    full = rows.join(prints, "id").join(stored(sets), "id").select("part", "mask", "side", "id", "grp", "fp", "hashes")
    return full.groupBy("part").applyInArrow(lambda t: _joined(t, masks, RADIUS, least), "a long, b long")


def masks_for(texts: int, least: float = SIMILARITY, missed: float = MISSED) -> list[list[int]]:
    """Masks below which about 32 of `texts` unrelated fingerprints meet, and a pair at `least` at least once but for `missed`."""
    width = min(48, max(8, math.ceil(math.log2(max(texts, 2))) - 5))
    agree = (1 - math.acos(2 * least / (1 + least)) / math.pi) ** width
    return random_masks(math.ceil(math.log(missed) / math.log1p(-agree)), width, 64 * WORDS)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest id, nulls last.

    Equal texts are one group (null counts as empty); so are texts that pairs of `least` similarity connect. Among rows
    that share the smallest id and text one stays, whichever it is.
    """
    key = F.xxhash64(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    row = F.struct(*(F.col(c) for c in docs.columns))
    one = stored(docs.select(key.alias("id"), F.struct(F.col(id_col).isNull(), F.col(id_col)).alias("rank"), row.alias("doc")).groupBy("id").agg(F.min_by("doc", "rank").alias("doc")))
    texts = one.select("id", F.col("doc")[text_col].alias("text"), F.col("doc")[id_col].alias("doc_id"))
    prints = stored(fingerprints(texts, size, words=WORDS, keep=("id",), distinct=True))
    masks = masks_for(prints.count())
    pairs, tiles = candidates(prints, RADIUS, masks)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = stored(components(similar_pairs(stored(pairs), texts, size, least)))
    joined = stored(joined_groups(tiles, roots, prints, texts, masks, size, least))
    if not joined.isEmpty():
        roots = stored(components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionAll(joined)))
    members = roots.select("id", "root").unionAll(roots.select(F.col("root").alias("id"), "root").distinct())
    ranked = members.join(texts.select("id", "doc_id"), "id").select("id", "root", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("id")).alias("rank"))
    best = ranked.groupBy("root").agg(F.min("rank").alias("best"))
    gone = ranked.join(best, "root").where(F.col("rank") != F.col("best")).select("id")
    return one.join(gone, "id", "left_anti").select("doc.*")
