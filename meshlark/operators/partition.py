"""Block order, owners and balance. Orders over all blocks are prefix sums over key ranges, not one sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshlark.functions import address as A
from meshlark.operators._common import written
from meshlark.spec import MeshSpec

#: Leading bits of a Morton key that make a range.
RANGE_BITS = 12


def entropy_weights(cells: DataFrame, spec: MeshSpec, square: Column, min_weight: float = 1e-12) -> DataFrame:
    """level, b0 ..., weight: -sum p ln p over the block's cells, p their share of the whole sum of squares, min_weight at least.

    If that sum is not positive, weights are 1.
    """
    rows = cells.select("level", *A.block_coords(spec), square.alias("_w"))
    whole = rows.agg(F.sum("_w").alias("_total"))
    p = F.col("_w") / F.col("_total")
    out = rows.crossJoin(F.broadcast(whole)).groupBy("level", *spec.b).agg(F.sum(F.when((F.col("_total") > 0) & (p > 0), -p * F.ln(p)).otherwise(0.0)).alias("e"), F.first("_total").alias("_total"))
    return out.select("level", *spec.b, F.when(F.col("_total") > 0, F.greatest(F.when(F.isnan("e"), min_weight).otherwise(F.col("e")), F.lit(min_weight))).otherwise(F.lit(max(1.0, min_weight))).alias("weight"))


def balance(blocks: DataFrame, ranks: int) -> DataFrame:
    """One row: totals, maxima, means over all ranks and imbalances of weight and count. blocks: owner, weight."""
    per = blocks.groupBy("owner").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    out = per.agg(F.sum("w").alias("total_weight"), F.max("w").alias("max_weight"), F.sum("n").alias("total_blocks"), F.max("n").alias("max_blocks"))
    w, n = F.col("total_weight") / ranks, F.col("total_blocks") / ranks
    return out.select("total_weight", "max_weight", w.alias("avg_weight"), F.when(w > 0, (F.col("max_weight") - w) / w).otherwise(0.0).alias("weight_imbalance"), "total_blocks", "max_blocks", n.alias("avg_blocks"), F.when(n > 0, (F.col("max_blocks") - n) / n).otherwise(0.0).alias("count_imbalance"))


def ordered(blocks: DataFrame, spec: MeshSpec, *sums: str) -> DataFrame:
    """blocks with morton, rank (from 0, by Morton key and level) and, for each named column, its sum up to and with the row."""
    bits = spec.nd * (spec.coord_bits + spec.max_level)
    rows = blocks.withColumn("morton", A.block_morton(spec)).withColumn("_range", A.shr("morton", max(0, bits - RANGE_BITS)))
    per = rows.groupBy("_range").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # at most 2^RANGE_BITS rows
    per = per.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0.0)).alias(f"_t_{c}") for c in sums))
    own = W.partitionBy("_range").orderBy("morton", "level")
    out = rows.join(F.broadcast(per), "_range").withColumn("rank", F.col("_n") + F.row_number().over(own) - 1)
    return out.withColumns({f"{c}_upto": F.col(f"_t_{c}") + F.sum(c).over(own) for c in sums}).drop("_range", "_n", *(f"_t_{c}" for c in sums))


def contiguous_owners(blocks: DataFrame, spec: MeshSpec, ranks: int) -> DataFrame:
    """blocks with morton, rank and owner: equal counts along the Morton order, the first owners taking one more."""
    n = blocks.agg(F.count("*").alias("_count"))
    out = ordered(blocks, spec).crossJoin(F.broadcast(n))
    base, more = F.floor(F.col("_count") / ranks), F.col("_count") % ranks
    at = F.col("rank")
    owner = F.when(at < more * (base + 1), F.floor(at / (base + 1))).otherwise(more + F.floor((at - more * (base + 1)) / F.greatest(base, F.lit(1))))
    return out.withColumn("owner", owner.cast("int")).drop("_count")


def weighted_owners(blocks: DataFrame, spec: MeshSpec, ranks: int) -> DataFrame:
    """blocks (level, b0 ..., weight) with morton, rank and owner: along the Morton order each owner takes blocks while the sum
    stays within its share of what is left, one at least, and leaves one for every later owner; the last takes the rest.

    Every cut is one aggregation over the prefix sums, which are written in order of the ranks; the driver sees one row an owner.
    """
    found = blocks.agg(F.sum("weight").alias("w"), F.count("*").alias("n")).first()
    n = found["n"]
    usable = found["w"] is not None and 0 < found["w"] < float("inf")
    rows = written(ordered(blocks.withColumn("_w", F.col("weight") if usable else F.lit(1.0)), spec, "_w").orderBy("rank"))
    cuts, start, used, whole = [], 0, 0.0, found["w"] if usable else float(n)
    for k in range(ranks - 1):
        left = n - start
        if left <= 0:
            break
        keep = ranks - k - 1 if left >= ranks - k else 0
        limit, most = used + (whole - used) / (ranks - k), max(n - keep, start + 1)
        taken = F.when((F.col("_w_upto") <= limit * (1 + 1e-12)) | (F.col("rank") == start), F.struct("rank", "_w_upto"))
        end = rows.where((F.col("rank") >= start) & (F.col("rank") < most)).agg(F.max(taken).alias("m")).first()["m"]
        start, used = end["rank"] + 1, end["_w_upto"]
        cuts.append(start)
    owner = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c <= F.col("rank"))) if cuts else F.lit(0)
    return rows.withColumn("owner", owner.cast("int")).drop("_w", "_w_upto")


def repartition(cells: DataFrame, owners: DataFrame, spec: MeshSpec, ranks: int) -> DataFrame:
    """cells with owner, each owner's rows in the partition of its number."""
    keyed = cells.select("*", *A.block_coords(spec)).join(owners.select("level", *spec.b, "owner"), ["level", *spec.b])
    return keyed.drop(*spec.b).repartitionById(ranks, "owner")


def repartition_if_needed(cells: DataFrame, blocks: DataFrame, spec: MeshSpec, ranks: int, weight_limit: float = 0.1, count_limit: float = 0.1) -> tuple[DataFrame, bool]:
    """(blocks with owners, whether they were dealt anew); blocks: level, b0 ..., owner, weight."""
    now = balance(blocks, ranks).first()
    if now["weight_imbalance"] <= weight_limit and now["count_imbalance"] <= count_limit:
        return blocks, False
    return weighted_owners(blocks.drop("owner"), spec, ranks), True
