"""SimHash near-duplicates by a hierarchical index over Gray-ordered fingerprints.

Upper nodes of the index are shared masked bit patterns: for a few masks, all fingerprints that agree under the mask hang
below one node. There they are sorted by Gray rank and cut into leaves; a node over some leaves keeps the bits on which
all its fingerprints agree, and a pair of nodes is dropped as soon as the differences of those bits, which only grow
further down, exceed the radius. With masks from pairs of five blocks, no pair at three differing bits is lost.

Documents with the same fingerprint are one entry of the index, so groups of copies cost nothing here.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm._common import partitions, stored

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
LEAF = 64
#: Fingerprints below one mask that a task holds at once; larger nodes are split and their parts compared in pairs.
PART = 4096
#: Nearest rows of each row that a node over LEAF rows names besides its spanning forest.
FEW = 4
#: Rows on either side of a tile of pairs that a node did not name.
TILE = 512
_BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `size` words (of the whole text, if it has fewer; none for no words), A-Z in lower case."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half the hashes; zero for none."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS_OF for k in range(8)])
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, words: int = 1, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), distinct: bool = False) -> DataFrame:
    """keep columns and fp, an array of `words` longs: the k-th is the fingerprint of the hashes mixed anew k times.

    With distinct, each shingle votes once, however often it occurs, as in a Jaccard similarity of sets. A null or blank text has fingerprint zero.
    """
    spread = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1)) for k in range(words)]
    rows = docs.select(*keep, F.col(text_col).cast("binary").alias("_text"))
    schema = rows.select(*keep).withColumn("fp", F.array().cast("array<long>")).schema

    def mixed(h: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return h
        x = h * spread[k]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("_text"):
                h = shingle_hashes(text.as_py() or b"", size, seed)
                h = np.unique(h) if distinct else h
                out.append([majority(mixed(h, k)) for k in range(words)])
            fp = pa.array([[x - 2**64 if x >= 2**63 else x for x in row] for row in out], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fp], names=[*keep, "fp"])

    return rows.mapInArrow(run, schema)


def block_masks(radius: int = RADIUS, equal: int = 2, bits: int = BITS) -> list[list[int]]:
    """Masks (lists of bits): any two fingerprints at `radius` or fewer differences agree under one of them at least."""
    edges = np.linspace(0, bits, radius + equal + 1).astype(int)
    blocks = [list(range(a, b)) for a, b in itertools.pairwise(edges)]
    return [sum(chosen, []) for chosen in itertools.combinations(blocks, equal)]


def random_masks(n: int, width: int, bits: int, seed: int = SEED) -> list[list[int]]:
    """n masks of `width` bits each, for radii that no small set of blocks covers; recall has to be measured.

    Masks are cut from one random order of all bits after the other, so neighbouring masks share no bit and few differing
    bits cannot spoil many of them: a pair is missed no more often than by independent masks.
    """
    dice, masks = np.random.default_rng(seed), []
    while len(masks) < n:
        order = dice.permutation(bits)
        masks += [sorted(order[at : at + width].tolist()) for at in range(0, bits - width + 1, width)]
    return masks[:n]


def _gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _near(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (of a and later rows of a, if b is None) at `radius` or fewer differing bits, and how many differ.

    Rows are in Gray order; leaves of LEAF rows whose common bits differ too much are left out whole.
    """
    other = a if b is None else b

    def nodes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(x), LEAF)
        return np.bitwise_and.reduceat(x, at, axis=0), np.bitwise_or.reduceat(x, at, axis=0)

    (ones_a, any_a), (ones_b, any_b) = nodes(a), nodes(other)
    least = np.bitwise_count((ones_a[:, None] & ~any_b[None]) | (ones_b[None] & ~any_a[:, None])).sum(-1, dtype=np.int64)
    found_a, found_b, found_d = [], [], []
    for i, j in zip(*np.nonzero(least <= radius), strict=True):
        if b is None and j < i:
            continue
        x, y = a[i * LEAF : (i + 1) * LEAF], other[j * LEAF : (j + 1) * LEAF]
        d = _differences(x[:, None], y[None])
        p, q = np.nonzero(d <= radius)
        d, p, q = d[p, q].astype(np.int16), p + i * LEAF, q + j * LEAF
        if b is None:
            d, p, q = d[q > p], p[q > p], q[q > p]
        found_a.append(p)
        found_b.append(q)
        found_d.append(d)
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int16)
    return np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_d)


def _forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected to by the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, label[p], low)
        np.minimum.at(new, label[q], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _closest(n: int, p: np.ndarray, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the pairs of a minimum spanning forest of n nodes (p, q at distance d) and of each node's FEW nearest ones."""
    order = np.argsort(d, kind="stable")
    label, chosen, open_ = np.arange(n), np.zeros(len(p), bool), order
    while len(open_):  # each tree takes its shortest way out
        best = np.full(n, len(open_))
        for ends in (p, q):
            np.minimum.at(best, label[ends[open_]], np.arange(len(open_)))
        took = open_[np.unique(best[best < len(open_)])]
        chosen[took] = True
        label = _forest(n, label[p[took]], label[q[took]])[label]
        open_ = open_[label[p[open_]] != label[q[open_]]]
    ends, at = np.concatenate((p[order], q[order])), np.concatenate((order, order))
    near = np.argsort(ends * (int(d.max()) + 1) + d[at], kind="stable")
    ends = ends[near]
    chosen[at[near[np.arange(len(ends)) - np.searchsorted(ends, ends) < FEW]]] = True
    return np.flatnonzero(chosen)


def _links(a: np.ndarray, ids_a: np.ndarray, b: np.ndarray | None, ids_b: np.ndarray | None, radius: int, spans: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Pairs of ids, and tiles that hold all other near pairs.

    With spans, the pairs are a spanning forest of all near pairs, and no tile is needed; else a minimum spanning forest and
    each row's nearest few. A tile is two lists of ids, and a pair that was not named has one end in either.
    """
    p, q, d = _near(a, b, radius)
    if not len(p):
        return p, q, []
    ids = ids_a if b is None else np.concatenate((ids_a, ids_b))
    if b is not None:
        q = q + len(a)
    if spans:
        root = _forest(len(ids), p, q)
        own = np.flatnonzero(root != np.arange(len(ids)))
        return ids[own], ids[root[own]], []
    at = _closest(len(ids), p, q, d)
    rest = np.ones(len(p), bool)
    rest[at] = False
    return ids[p[at]], ids[q[at]], _tiles(ids, p[rest], q[rest])


def _tiles(ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two lists of at most TILE ids for each two runs of TILE rows that some of the pairs join: the ends of these pairs."""
    runs = len(ids) // TILE + 1
    tile = p // TILE * runs + q // TILE
    order = np.argsort(tile, kind="stable")
    cut = np.flatnonzero(np.diff(tile[order])) + 1
    return [(ids[np.unique(p[at])], ids[np.unique(q[at])]) for at in np.split(order, cut) if len(at)]


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int32()), ("key", pa.int64()), ("part", pa.string()), ("ids", pa.list_(pa.int64())), ("fps", pa.list_(pa.int64())), ("ones", pa.list_(pa.int64())), ("zeros", pa.list_(pa.int64())), ("ids_b", pa.list_(pa.int64()))])
_EDGE_SQL = "a long, b long, mask int, key long, part string, ids array<long>, fps array<long>, ones array<long>, zeros array<long>, ids_b array<long>"


def _linked(mask: int, p: np.ndarray, q: np.ndarray, tiles: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Pairs of ids and the tiles below a mask; the first ids of a tile's lists tell it from all others."""
    pairs = pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), *(pa.nulls(len(p), f.type) for f in list(_EDGE)[2:])], schema=_EDGE)
    rows = [{"mask": mask, "part": uuid.uuid5(uuid.NAMESPACE_OID, f"tile {mask},{x[0]},{y[0]}").hex, "ids": x.tolist(), "ids_b": y.tolist()} for x, y in tiles]
    return pa.concat_batches([pairs, pa.RecordBatch.from_pylist(rows, schema=_EDGE)])


def _keyed(batches: Iterator[pa.RecordBatch], masks: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n = np.asarray(batch.column("id")), batch.num_rows
        fp = np.asarray(batch.column("fp").flatten()).reshape(n, -1).view(np.uint64) if n else np.empty((0, 1), np.uint64)
        for k, mask in enumerate(masks):
            key, hidden = np.zeros(n, np.uint64), np.zeros(fp.shape[1], np.uint64)
            for at, bit in enumerate(mask):
                word, shift = divmod(bit, 64)
                key |= ((fp[:, word] >> np.uint64(shift)) & np.uint64(1)) << np.uint64(at)
                hidden[word] |= np.uint64(1 << shift)
            rank = _gray_rank(fp[:, 0] & ~hidden[0]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(key.view(np.int64)), pa.array(rank), pa.array(ids), batch.column("fp")], names=["mask", "key", "rank", "id", "fp"])


def _scan(batches: Iterator[pa.RecordBatch], radius: int, spans: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order of (mask, key, rank): links and tiles within nodes; and the parts of nodes that other parts or tasks may share."""
    held: list[np.ndarray] = []
    first = True

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        n = batch.num_rows
        return [np.asarray(batch.column("mask")).astype(np.int64), np.asarray(batch.column("key")), np.asarray(batch.column("id")), np.asarray(batch.column("fp").flatten()).reshape(n, -1).view(np.uint64)]

    def parts(mask: int, key: int, ids: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(ids), PART):
            x = fps[lo : lo + PART]
            yield _linked(mask, *_links(x, ids[lo : lo + PART], None, None, radius, spans))
            row = {"mask": mask, "key": key, "part": uuid.uuid5(uuid.NAMESPACE_OID, f"{mask},{key},{ids[lo]}").hex, "ids": ids[lo : lo + PART].tolist(), "fps": x.view(np.int64).ravel().tolist()}
            row |= {"ones": np.bitwise_and.reduce(x, 0).view(np.int64).tolist(), "zeros": (~np.bitwise_or.reduce(x, 0)).view(np.int64).tolist()}
            yield pa.RecordBatch.from_pylist([row], schema=_EDGE)

    def nodes(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal first
        mask, key, ids, fps = cols
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(ids)]))
        edge = np.zeros(len(starts), bool)  # nodes that may go on in another task
        edge[0], edge[-1] = first, last
        first = False
        size = ends - starts
        for k in np.flatnonzero(edge | (size > LEAF)):
            s = slice(starts[k], ends[k])
            if edge[k] or size[k] > PART:
                yield from parts(int(mask[starts[k]]), int(key[starts[k]]), ids[s], fps[s])
            else:
                yield _linked(int(mask[starts[k]]), *_links(fps[s], ids[s], None, None, radius, spans))
        small = np.repeat(~edge & (size <= LEAF) & (size > 1), size)  # all small nodes at once: each row with the s-th after it
        node = np.repeat(np.arange(len(starts)), size)[small]
        fps, ids, got_p, got_q = fps[small], ids[small], [], []
        for s in range(1, int(size[~edge & (size <= LEAF)].max(initial=1))):
            at = np.flatnonzero(node[s:] == node[:-s])
            at = at[_differences(fps[at], fps[at + s]) <= radius]
            got_p.append(at)
            got_q.append(at + s)
        if got_p and sum(map(len, got_p)):
            p, q = np.concatenate(got_p), np.concatenate(got_q)
            if spans:
                root = _forest(len(ids), p, q)
                p = np.flatnonzero(root != np.arange(len(ids)))
                q = root[p]
            yield _linked(0, ids[p], ids[q], [])

    def join(pieces: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*pieces, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        held = join([held, columns(batch)]) if held else columns(batch)
        same = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        done = int(same[-1]) + 1 if len(same) else 0
        if done:
            yield from nodes([c[:done] for c in held], False)
            held = [c[done:].copy() for c in held]
        elif len(held[0]) > 16 * PART:  # one huge node: hand on its beginning in parts
            keep = len(held[0]) // PART * PART
            yield from parts(int(held[0][0]), int(held[1][0]), held[2][:keep], held[3][:keep])
            held, first = [c[keep:].copy() for c in held], True
    if held and len(held[0]):
        yield from nodes(held, True)


def candidates(entries: DataFrame, radius: int = RADIUS, masks: list[list[int]] | None = None, spans: bool = False) -> tuple[DataFrame, DataFrame]:
    """For an exact check: pairs (a, b) of ids of entries (id long, distinct; fp), and tiles (part, mask, ids, ids_b).

    All pairs at `radius` or fewer differing bits that agree under a mask are named or have one end in either list of a
    tile of the first such mask. Small nodes name all; of larger ones a minimum spanning forest (closest pairs first) and
    each row's nearest few are named, and the rest is in tiles. entries is read twice: store it first.
    """
    masks = masks or block_masks(radius)
    spark = entries.sparkSession
    keyed = entries.select("id", "fp").mapInArrow(lambda b: _keyed(b, masks), "mask int, key long, rank long, id long, fp array<long>")
    ordered = keyed.repartitionByRange(partitions(spark), "mask", "key", "rank", "id").sortWithinPartitions("mask", "key", "rank", "id")
    found = stored(ordered.mapInArrow(lambda b: _scan(b, radius, spans), _EDGE_SQL))
    split = found.where(F.col("ones").isNotNull())
    heads = split.select("mask", "key", "part", "ones", "zeros")
    other = heads.select("mask", "key", *(F.col(c).alias(f"{c}_b") for c in ("part", "ones", "zeros")))
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseAND(v))), F.lit(0), lambda t, v: t + v)
    pairs = heads.join(other, ["mask", "key"]).where((F.col("part") < F.col("part_b")) & (differ("ones", "zeros_b") + differ("zeros", "ones_b") <= radius))
    body = split.select("part", "ids", "fps")
    both = pairs.select("mask", "part", "part_b").join(body, "part").join(body.select(F.col("part").alias("part_b"), F.col("ids").alias("ids_b"), F.col("fps").alias("fps_b")), "part_b")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, ids_b = (np.array(row[c], np.int64) for c in ("ids", "ids_b"))
                x, y = (np.array(row[c], np.int64).view(np.uint64).reshape(len(i), -1) for c, i in (("fps", ids), ("fps_b", ids_b)))
                yield _linked(row["mask"], *_links(x, ids, y, ids_b, radius, spans))

    met = both.select("mask", "ids", "fps", "ids_b", "fps_b").mapInArrow(across, _EDGE_SQL)
    every = found.unionByName(met if spans else stored(met))
    return every.where(F.col("a").isNotNull()).select("a", "b"), every.where(F.col("ids_b").isNotNull()).select("part", "mask", "ids", "ids_b")


def links(entries: DataFrame, radius: int = RADIUS, masks: list[list[int]] | None = None) -> DataFrame:
    """Enough pairs (a, b) of ids of entries (id long, distinct; fp) to connect what pairs at `radius` or fewer differing bits do. Store entries first."""
    return candidates(entries, radius, masks, spans=True)[0]


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) for each id in pairs (a, b): the smallest id that it is connected to.

    Each round links every id to the smallest of its neighbours, then every neighbour to that one, until nothing
    changes; rounds are few, as paths halve at least, and each is written, so nothing is computed twice.
    """
    edges = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        ends = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        larger = ends.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(larger.unionAll(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = stored(small.where("u <> v").distinct())
        if after.count() == edges.count() and after.exceptAll(edges).isEmpty():
            return after.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("root"))
        edges = after


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """Per document (doc_id, text): doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable.

    Links join fingerprints at `radius` or fewer differing bits, so equal ones always. Null and blank texts share
    fingerprint zero. A null doc_id belongs to a component but never names one, unless all its ids are null.
    """
    fps = stored(fingerprints(docs, size, seed).select("doc_id", F.get("fp", F.lit(0)).alias("fp")))
    entries = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(entries.select(F.col("fp").alias("id"), F.array("fp").alias("fp")), radius))
    rooted = entries.join(root, entries["fp"] == root["id"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


__all__ = ["block_masks", "candidates", "components", "fingerprints", "links", "near_duplicates", "random_masks"]
