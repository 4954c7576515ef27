"""Exact top-k by inner product with a pivot table.

Distances of every vector to the pivots are computed once and stored with it: the pivot table. For a query q and a
candidate x the largest |d(q, p) - d(x, p)| over the pivots p bounds d(q, x) from below, hence the inner product from above.

Vectors are dealt into blocks by their nearest pivot, so the distances of a block to each pivot lie in a narrow interval.
A query first meets one block of its own pivot, which gives a k-th best score to beat. Block pairs whose intervals leave no
bound above that are dropped, a query is sent on only to the blocks of open pairs that its own distances leave open, and
there candidates are evaluated in the order of their own bound until none left reaches the k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshlark.llm._common import stored

PIVOTS = 32
#: The pivots come from a sample of at most this many vectors; they affect the speed alone.
PIVOT_SAMPLE = 1000
#: Rows of a block, about: what a task holds of either side. A candidate is copied once for each QUERY_BLOCK queries that its block is open to.
QUERY_BLOCK, CANDIDATE_BLOCK = 16384, 32768
#: Queries and candidates whose bounds are held at once, and candidates evaluated at a time.
TILE, STEP = 4096, 512
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first pivots from a bounded sample of `v`."""
    sample = np.array([r["v"] for r in vectors.select("v").limit(PIVOT_SAMPLE).collect()], dtype=np.float64)
    if not len(sample):
        return np.empty((0, 0))
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """id and v = floor(scale * component) as longs; vectors that are null, or hold null, NaN or infinity, and null ids are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(usable).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors (id, v), dim, norm (squared), far (distances to the pivots; all 0 for vectors of another length) and home, the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dim = batch.num_rows, np.asarray(batch.column("v").value_lengths())
            flat, off = np.asarray(batch.column("v").flatten()).astype(np.float64), np.concatenate(([0], np.cumsum(dim)))
            norm, far = np.array([(flat[a:b] ** 2).sum() for a, b in zip(off[:-1], off[1:], strict=True)]), np.zeros((n, max(len(pivots), 1)))
            own = np.flatnonzero(dim == pivots.shape[1]) if len(pivots) else np.empty(0, int)
            if len(own):
                x = flat[(off[own][:, None] + np.arange(pivots.shape[1])).ravel()].reshape(len(own), -1)
                far[own] = np.sqrt(np.maximum(norm[own][:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0))
            columns = [pa.array(dim.astype(np.int32)), pa.array(norm), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * far.shape[1]), pa.array(far.ravel())), pa.array(far.argmin(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), *columns], names=["id", "v", "dim", "norm", "far", "home"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v array<long>, dim int, norm double, far array<double>, home int")


def _bound(norms: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What an inner product can be at most, from the sum of the squared norms and the least distance; roundings only raise it."""
    low = np.maximum(low * (1 - 1e-6) - 1e-3, 0)
    return (norms - low * low) / 2 * (1 + 1e-9) + 1


def _best(q: dict[str, np.ndarray], c: dict[str, np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (id, v, norm, far, floor) its best k of the candidates that reach its floor: (query id, ids, scores)."""
    for i in range(len(q["id"])):
        low = np.zeros(len(c["id"]))
        for p in range(c["far"].shape[1]):
            np.maximum(low, np.abs(c["far"][:, p] - q["far"][i, p]), out=low)
        bound = _bound(q["norm"][i] + c["norm"], low)
        open_ = np.flatnonzero((bound >= q["floor"][i]) & (c["id"] != q["id"][i]))
        order = open_[np.argsort(-bound[open_], kind="stable")]
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            if len(scores) >= k and bound[part[0]] < scores[k - 1]:
                break  # ties go to the smaller id, so a bound that equals the k-th score is still evaluated
            ids, scores = np.concatenate((ids, c["id"][part])), np.concatenate((scores, c["v"][part] @ q["v"][i]))
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
        yield int(q["id"][i]), ids, scores


def _meet(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The best k candidates (right) of each query (left), tile by tile of the candidates; all rows have one dim."""
    if not left.num_rows or not right.num_rows:
        return _FOUND.empty_table()

    def arrays(t: pa.Table) -> dict[str, np.ndarray]:
        t = t.combine_chunks()
        wide = lambda c: np.asarray(t[c].combine_chunks().flatten()).reshape(t.num_rows, -1)
        out = {"id": np.asarray(t["id"]), "norm": np.asarray(t["norm"]), "v": wide("v"), "far": wide("far")}
        return out | ({"floor": t["floor"].fill_null(-np.inf).to_numpy().copy()} if "floor" in t.column_names else {})

    q, c = arrays(left), arrays(right)
    order = np.argsort(c["far"][:, 0], kind="stable")
    c, out = {n: x[order] for n, x in c.items()}, []
    for at in range(0, len(order), TILE):
        tile = {n: x[at : at + TILE] for n, x in c.items()}
        lo, hi = tile["far"].min(0), tile["far"].max(0)
        low = np.maximum(lo - q["far"], q["far"] - hi).max(1)
        open_ = np.flatnonzero(_bound(q["norm"] + tile["norm"].max(), np.maximum(low, 0)) >= q["floor"])
        found = list(_best({n: x[open_] for n, x in q.items()}, tile, k))
        for i, (_, _, scores) in zip(open_.tolist(), found, strict=True):
            if len(scores) == k:
                q["floor"][i] = max(q["floor"][i], scores[-1])
        out += [x for x in found if len(x[1])]
    if not out:
        return _FOUND.empty_table()
    columns = [np.concatenate([np.full(len(ids), i) for i, ids, _ in out]), np.concatenate([ids for _, ids, _ in out]), np.concatenate([s for _, _, s in out])]
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """rows and their block: home, and a salt for as many blocks of about `size` rows as the home needs."""
    counts = rows.groupBy("dim", "home").agg(F.ceil(F.count("*") / size).alias("_n"))
    return rows.join(counts, ["dim", "home"]).withColumn(name, F.struct("home", F.pmod(F.xxhash64("id", "v"), F.col("_n")).alias("part"), F.col("_n").alias("parts"))).drop("_n")


def _extent(rows: DataFrame, block: str, pivots: int, *more: Column) -> DataFrame:
    """dim, block, norm, and lo and hi, the intervals of distances to each pivot."""
    far = [F.get("far", F.lit(p)) for p in range(pivots)]
    array = lambda f: F.array(*(f(x) for x in far))
    return rows.groupBy("dim", block).agg(F.max("norm").alias("norm"), array(F.min).alias("lo"), array(F.max).alias("hi"), *more)


def _least_gap(lo: str, hi: str, lo_c: str, hi_c: str, pivots: int) -> Column:
    """The least distance that intervals of distances to the pivots leave; roundings only lower it."""
    at = lambda c, p: F.get(c, F.lit(p))
    gaps = [F.greatest(at(lo_c, p) - at(hi, p), at(lo, p) - at(hi_c, p), F.lit(0.0)) for p in range(pivots)]
    return F.greatest(reduce(F.greatest, gaps) * (1 - 1e-6) - 1e-3, F.lit(0.0))


def _reaches(low: Column) -> Column:
    floor = F.coalesce("floor", F.lit(float("-inf")))
    return (F.col("norm") + F.col("norm_c") - low * low) / 2 * (1 + 1e-9) + 1 >= floor


def open_pairs(queries: DataFrame, candidates: DataFrame, pivots: int) -> DataFrame:
    """dim, qb, cb, n, and norm_c, lo_c, hi_c of cb: the pairs of blocks in which some candidate may reach the k-th best score (floor) of one of the n queries.

    One row a block is on either side, and only the open pairs are carried on.
    """
    q = _extent(queries, "qb", pivots, F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("floor"), F.count("*").alias("n"))
    c = _extent(candidates, "cb", pivots).withColumnsRenamed({"norm": "norm_c", "lo": "lo_c", "hi": "hi_c"})
    return q.join(c, "dim").where(_reaches(_least_gap("lo", "hi", "lo_c", "hi_c", pivots))).select("dim", "qb", "cb", "n", "norm_c", "lo_c", "hi_c")


def top_k(vectors: DataFrame, query_ids, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with every other vector.

    vectors: id, v (longs). query_ids: a condition on `id`. Vectors of another length than the query's are no
    candidates of it. A row is no candidate of a query with its own id; among repeated ids each row counts. Fewer than
    k candidates give fewer rows, no queries and empty tables none. Scores must stay below 2^63.
    """
    pivots = choose_pivots(vectors.where(F.size("v") == F.lit(first["n"])) if (first := vectors.select(F.size("v").alias("n")).first()) else vectors)
    table, n, columns = stored(pivot_table(vectors, pivots)), max(len(pivots), 1), ("id", "v", "norm", "far")
    candidates = stored(_dealt(table, CANDIDATE_BLOCK, "cb"))
    queries = _dealt(table.where(query_ids), QUERY_BLOCK, "qb")
    sizes = candidates.select("dim", "home", "cb.parts").distinct()
    near = queries.join(sizes, ["dim", "home"]).withColumn("cb", F.struct("home", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "parts"))
    first_met = near.withColumn("floor", F.lit(None).cast("double")).groupBy("dim", "cb").cogroup(candidates.groupBy("dim", "cb"))
    floors = _ranked(first_met.applyInArrow(lambda a, b: _meet(a, b, k), "query_id long, vec_id long, score long"), k).where(F.col("rank") == k)
    floors = floors.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"))  # repeated ids: each row has its own
    queries = stored(queries.join(floors, queries["id"] == floors["query_id"], "left").drop("query_id"))
    pairs = stored(open_pairs(queries, candidates, n))
    # A block's queries come in chunks, so that it is copied no more often than it needs to.
    chunks = pairs.groupBy("dim", "cb").agg(F.ceil(F.sum("n") / QUERY_BLOCK).alias("chunks"))
    sent = queries.join(pairs.drop("n"), ["dim", "qb"]).where(_reaches(_least_gap("far", "far", "lo_c", "hi_c", n))).select("dim", "cb", *columns, "floor")
    left = sent.join(chunks, ["dim", "cb"]).withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.col("chunks"))).groupBy("dim", "cb", "chunk")
    right = candidates.join(chunks, ["dim", "cb"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("dim", "cb", "chunk", *columns).groupBy("dim", "cb", "chunk")
    met = left.cogroup(right).applyInArrow(lambda a, b: _meet(a, b, k), "query_id long, vec_id long, score long")
    return _ranked(met, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
