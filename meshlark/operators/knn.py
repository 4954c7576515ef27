"""Nearest neighbours by Euclidean distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(v: Column, q: Column) -> Column:
    to = lambda a: F.transform(a, lambda x: x.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(to(v), to(q), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def search(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """id and dist of the k vectors nearest to one query, ties to the smaller id: a top-k of each partition, then of those."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(F.col(id_col).alias("id"), distance(F.col(vector_col), q).alias("dist")).orderBy("dist", "id").limit(k)
