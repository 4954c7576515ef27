"""Checkpoints of meshes: Parquet tables and the specification beside them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.spec import MeshSpec

VERSION = 1


class CheckpointError(ValueError):
    """A checkpoint that does not fit what is asked for."""


@dataclass(frozen=True)
class Schedule:
    """Which steps are written."""

    interval: int
    start: int = 0
    enabled: bool = True

    def due(self, step: Column) -> Column:
        return F.lit(self.enabled and self.interval > 0) & (step >= self.start) & (F.pmod(step - self.start, F.lit(max(self.interval, 1))) == 0)

    def is_due(self, step: int) -> bool:
        return self.enabled and self.interval > 0 and step >= self.start and (step - self.start) % self.interval == 0


def step_path(folder: str, step: int, prefix: str = "checkpoint") -> str:
    return f"{folder.rstrip('/')}/{prefix}/step={step}"


def write(folder: str, step: int, spec: MeshSpec, **tables: DataFrame) -> str:
    """Writes cells, links ... of a step; the tables are split by level, so a reader of one level reads no other."""
    path = step_path(folder, step)
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        (out.partitionBy("level") if "level" in df.columns else out).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    meta = json.dumps({"version": VERSION, "spec": asdict(spec), "tables": sorted(tables)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")
    return path


def read(spark: SparkSession, folder: str, step: int, spec: MeshSpec) -> dict[str, DataFrame]:
    """The tables of a step, after its specification is held against spec."""
    path = step_path(folder, step)
    meta = json.loads(spark.read.text(f"{path}/spec").first()["value"])
    if meta.get("version") != VERSION:
        raise CheckpointError(f"unsupported version {meta.get('version')}")
    want = json.loads(json.dumps(asdict(spec)))
    for key, value in want.items():
        if meta["spec"].get(key) != value:
            raise CheckpointError(f"{key} is {meta['spec'].get(key)} in the checkpoint, not {value}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
