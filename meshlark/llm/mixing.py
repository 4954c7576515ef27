"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

Complete epochs of a source come first; the rest of its target is filled with documents in the order of their
exponential keys, -ln(u) / quality, by a prefix sum of their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshlark.llm._common import partitions, stored, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is taken more often than this.
MOST_EPOCHS = 3


def quality(text: Column) -> Column:
    """A document's quality weight in (0, 1]: 1 / (1 + 20 x the share of symbol characters)."""
    n = F.greatest(F.length(text), F.lit(1))
    symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>!]+", ""))
    return F.coalesce(1.0 / (1.0 + 20.0 * symbols / n), F.lit(1.0))


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns' values alone: 52 bits of their MD5."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source (src, src_null): source_size and target. sizes: src, src_null, size.

    Water filling: sources in order of cap / weight; those below the level keep their cap, the others get level x weight.
    """
    per = sizes.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy("src_null", "src")) - 1
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "src_null", "src")
    upto, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(every).cast("double"),
        "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
        "capped": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
    })
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left_weight"))
    per = per.withColumn("above", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("above"), F.struct(F.col("capped"), F.col("level")))).over(every)["level"]
    return per.withColumn("level", level).select("src_null", "src", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def sized(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, src, src_null, size, key and row, a number that tells rows apart once this is stored."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("src"), F.col(source_col).isNull().alias("src_null"),
        F.size(words(text)).cast("long").alias("size"), (-F.log(uniform(F.lit(seed), F.col(id_col), text)) / quality(text)).alias("key"), F.monotonically_increasing_id().alias("row"), *extra,
    )


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """rows of sized() with source_size, target and taken. rows is read three times: store it first.

    A document of the fractional part is taken if the middle of its words lies within the target, so a source misses
    its target by half a document at most. A source with no words has target 0. A null source is a source of its own,
    last in order. Equal keys are ordered by doc_id, then size; rows that agree in all of these are alike. Documents
    are dealt by range of (source, key, doc_id, size, row) and summed by (source, range), so no source, whatever its
    share, its keys or its repeated rows, is ordered in one task. Empty tables give empty ones.
    """
    order = ["src_null", "src", "key", "doc_id", "size", "row"]
    slim = rows.select(*order).repartitionByRange(partitions(rows.sparkSession), *order)
    slim = stored(slim.withColumn("range", F.spark_partition_id()))
    keys = ["src_null", "src", "range"]
    sums = slim.groupBy(*keys).agg(F.sum("size").alias("range_size"))
    before = F.sum("range_size").over(W.partitionBy("src_null", "src").orderBy("range")) - F.col("range_size")
    ranges = sums.withColumn("before", before).join(source_targets(rows, weights, most), ["src_null", "src"]).drop("range_size")
    within = F.sum("size").over(W.partitionBy(*keys).orderBy(*order[2:]).rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = slim.join(ranges, keys).withColumn("epochs", epochs).withColumn("prefix", F.col("before") + within)
    more = (F.col("prefix") + F.col("size") / 2 <= F.col("target") - F.col("epochs") * F.col("source_size")) & (F.col("epochs") < most)
    copies = F.col("epochs") + F.when(more, 1).otherwise(0)
    taken = out.select("row", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))
    return rows.join(taken, "row").drop("row")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, **columns) -> DataFrame:
    """Per document of docs: doc_id, size, source_size, target, taken and what `extra` names."""
    return mix(stored(sized(docs, **columns)), weights, most).drop("src", "src_null", "key")
