"""Partitioned tables with atomic versions.

A version is a manifest: which folder holds each partition. An upsert writes the partitions it touches to a new folder and
then publishes a manifest that points to them and, for all others, to the folders of the version before. Publishing is the
rename of one small file, so readers see a version whole or not at all; what a killed write leaves is in no manifest.
A reader that has opened a version keeps it while later ones are published. A stream's batch number is part of the manifest,
so a batch that is run again changes nothing.

One writer at a time: a second one that publishes the same version fails. The manifest is read and written through the
file system that Spark uses, and holds an entry a partition.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    fs, p = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in listed(spark, f"{path}/manifests") if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default of the last one; None for a table that has none yet."""
    if version is None:
        have = versions(spark, path)
        if not have:
            return None
        version = have[-1]
    text = spark.read.option("wholetext", True).text(f"{path}/manifests/{version}.json").first()[0]
    return json.loads(text)


def publish(spark: SparkSession, path: str, found: dict) -> None:
    """Make a manifest visible under its version; fails if that version is there."""
    fs, to = file_system(spark, f"{path}/manifests/{found['version']}.json")
    _, draft = file_system(spark, f"{path}/manifests/{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    if fs.exists(to) or not fs.rename(draft, to):
        fs.delete(draft, False)
        raise RuntimeError(f"version {found['version']} of {path} has been published by another writer")


def read(spark: SparkSession, path: str, version: int | None = None, only: list[str] | None = None) -> DataFrame | None:
    """The rows of a version, or of some of its partitions; None for a table without versions."""
    found = manifest(spark, path, version)
    if found is None:
        return None
    schema = StructType.fromJson(found["schema"])
    folders = [folder for name, folder in found["parts"].items() if only is None or name in only]
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def write_parts(rows: DataFrame, path: str, by: str) -> dict[str, str]:
    """Write rows to a new folder, a subfolder for each value of ``by`` (not null), and return these."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    key = F.sha2(F.col(by).cast("string"), 256)  # a name that any file system takes
    names = {r["h"]: r["v"] for r in rows.select(F.col(by).cast("string").alias("v"), key.alias("h")).distinct().collect()}  # partitions touched
    rows.withColumn("_part", key).repartition("_part").write.partitionBy("_part").parquet(f"{path}/{folder}")
    return {names[h]: f"{folder}/_part={h}" for h in names if f"_part={h}" in set(listed(spark, f"{path}/{folder}"))}


def latest(old: DataFrame, new: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """Of the rows of a key the one with the greatest ``order``, the new one on ties or without an order; of equal new rows the largest."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = [F.desc_nulls_last(order)] if order else []
    over = Window.partitionBy(*keys).orderBy(*first, F.desc("_new"), F.desc(F.to_json(F.struct(*old.columns))))
    return both.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n", "_new")


def upsert(path: str, fresh: DataFrame, keys: list[str], by: str, order: str | None = None, stream: str | None = None, batch: int | None = None) -> int:
    """Merge rows into the partitions they touch and publish the next version, whose number is returned.

    With a ``stream`` and its ``batch`` number, a batch that has been merged is skipped. With an ``order`` column batches may
    arrive in any sequence. Rows whose ``by`` is null are refused.
    """
    spark = fresh.sparkSession
    before = manifest(spark, path) or {"version": 0, "schema": json.loads(fresh.schema.json()), "parts": {}, "batches": {}}
    if stream is not None and batch in before["batches"].get(stream, []):
        return before["version"]
    schema = StructType.fromJson(before["schema"])
    fresh = fresh.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
    names = [r[0] for r in fresh.select(F.col(by).cast("string")).distinct().collect()]  # partitions touched
    if None in names:
        raise ValueError(f"{by} is null in some rows")
    parts = before["parts"]
    if names:
        old = read(spark, path, before["version"], names) if parts else spark.createDataFrame([], schema)
        parts = parts | write_parts(latest(old, fresh, keys, order), path, by)
    batches = dict(before["batches"])
    if stream is not None:
        batches[stream] = [*batches.get(stream, []), batch][-1000:]
    publish(spark, path, {"version": before["version"] + 1, "schema": before["schema"], "parts": parts, "batches": batches})
    return before["version"] + 1


def clean(spark: SparkSession, path: str, keep: int = 10) -> None:
    """Forget all but the last ``keep`` versions, and delete folders that none of these refers to. No write may be under way."""
    have = versions(spark, path)
    for old in have[:-keep]:
        fs, p = file_system(spark, f"{path}/manifests/{old}.json")
        fs.delete(p, False)
    used = {f.split("/")[1] for v in have[-keep:] for f in manifest(spark, path, v)["parts"].values()}
    for folder in set(listed(spark, f"{path}/data")) - used:
        fs, p = file_system(spark, f"{path}/data/{folder}")
        fs.delete(p, True)
