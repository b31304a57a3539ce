"""Helpers shared by the training-data operators: table access, shared storage, prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colophon.operators.components import shared_home

#: ASCII white space, the separators of the word pattern [^\x20\x09-\x0D]+, as a Java regular expression.
SPACES = r"[ \t\n\x0B\f\r]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a parquet table; other columns are never read."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def written(frame: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: the lineage ends there, so that a lost
    executor costs no earlier work, and values such as row numbers are fixed."""
    spark = frame.sparkSession
    path = f"{shared_home(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._written_to = path
    return out


def discard(frame: DataFrame) -> None:
    """Deletes a table that `written` returned and nothing reads any more."""
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(frame._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_scan(frame: DataFrame) -> bool:
    """True for rows read from Parquet files, at most filtered and projected: each stands at a place of its own there, which `_metadata` tells."""
    plan = frame._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    known = plan.nodeName() == "LogicalRelation" and "_metadata" not in frame.columns
    return known and next(iter(frame.inputFiles()), "").endswith(".parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in small parts: few texts, signatures or sets are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def numbered(frame: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Adds `name`, the place of every row in an order, from 0. Rows are dealt by range, sorted and written under `label`; a row's place is
    the number of rows in the ranges before (a row for each range) and its own in its range."""
    row = F.monotonically_increasing_id()
    ordered = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", row)
    placed = written(ordered.withColumns({"__part": F.shiftright("__row", 33), "__at": F.col("__row").bitwiseAND((1 << 33) - 1)}).drop("__row"), label)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def buckets_of(frame: DataFrame, bucket: Column, groups: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds exclusive running totals over a whole table without one large window.

    sums maps an output name to the amount that it adds up. Rows are dealt into buckets by `bucket`; a
    total for each bucket and group (few rows) gives where the bucket starts, and a window inside the
    bucket does the rest. Order inside a group is bucket, then the columns __order (an array of names
    that the caller provides as column `__order`).
    """
    keyed = frame.withColumn("__bucket", bucket)
    for name, amount in sums.items():
        keyed = keyed.withColumn(f"__add_{name}", amount)
    totals = keyed.groupBy(*groups, "__bucket").agg(*[F.sum(f"__add_{n}").alias(f"__tot_{n}") for n in sums])
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)],
        F.col("__bucket").alias("__b"),
        *[F.coalesce(F.sum(f"__tot_{n}").over(before), F.lit(0)).cast("long").alias(f"__at_{n}") for n in sums],
    )
    on = F.col("__bucket") == F.col("__b")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*groups, "__bucket").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(starts, on)
    for name in sums:
        out = out.withColumn(name, F.col(f"__at_{name}") + F.coalesce(F.sum(f"__add_{name}").over(inside), F.lit(0)).cast("long"))
    return out.drop("__bucket", "__b", *[f"__g{i}" for i in range(len(groups))], *[f"__{p}_{n}" for n in sums for p in ("add", "at")])
