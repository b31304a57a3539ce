"""The list of dismissed pairs as a table that is added to, and pruned while others add to it.

Below `home`: `added` has the entries as they were added; `version-<id>` what a pruning kept, `taken-<id>` the files of `added`
that it has read, and `pointer` a row for each version. The list is the newest version with the added files that it
hasn't taken. A pruning writes its version whole before its pointer row, and only files that it read are taken, so entries
added meanwhile stay, and one that fails changes nothing. Prunings exclude each other (the command that runs them is one at a time).
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators.ignore import ENTRY, live_entries

POINTER = "at bigint, name string"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_ignored(entries: DataFrame, home: str) -> None:
    """Adds entries; columns that are missing are null."""
    columns = [c.split()[0] for c in ENTRY.split(", ")]
    have = entries.columns
    entries.select(*[(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in (x.split() for x in ENTRY.split(", "))]).select(*columns).write.mode("append").parquet(f"{home}/added")


def _current(spark: SparkSession, home: str) -> str | None:
    if not exists(spark, f"{home}/pointer"):
        return None
    newest = spark.read.schema(POINTER).json(f"{home}/pointer").orderBy(F.desc("at"), F.desc("name")).first()  # a row for each pruning
    return newest["name"] if newest else None


def _snapshot(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame]:
    """(entries, files): the list as its files are now, and the added files that it was read from, those taken before included."""
    name, files = _current(spark, home), spark.createDataFrame([], "file string")
    rows = spark.createDataFrame([], ENTRY)
    if exists(spark, f"{home}/added"):
        # the files are listed here, once: what is added later belongs to neither result
        added = spark.read.schema(ENTRY).parquet(f"{home}/added").withColumn("file", F.col("_metadata.file_name"))
        files = added.select("file").distinct()
        if name is not None:
            added = added.join(spark.read.schema("file string").parquet(f"{home}/taken-{name}"), "file", "left_anti")
        rows = added.drop("file")
    if name is not None:
        rows = rows.unionByName(spark.read.schema(ENTRY).parquet(f"{home}/version-{name}"))
    return rows, files


def read_ignored(spark: SparkSession, home: str) -> DataFrame:
    """The list of dismissed pairs; empty where nothing was added yet."""
    return _snapshot(spark, home)[0]


def prune_ignored(spark: SparkSession, home: str, records: DataFrame) -> DataFrame:
    """Leaves out entries whose records are gone or look different now, for good. The list as it is then."""
    rows, files = _snapshot(spark, home)
    name = uuid.uuid4().hex
    files.write.parquet(f"{home}/taken-{name}")
    live_entries(rows, records).write.parquet(f"{home}/version-{name}")
    spark.createDataFrame([(time.time_ns(), name)], POINTER).coalesce(1).write.mode("append").json(f"{home}/pointer")
    return read_ignored(spark, home)
