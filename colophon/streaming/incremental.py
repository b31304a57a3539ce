"""Incremental duplicates: a stream of records against the catalog so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colophon.sources.catalog import load_records, prepare


def exact_matches(batch: DataFrame, known: DataFrame) -> DataFrame:
    """id, match_id, reason of new records that share an ISBN, or author and title, with a known one of their type."""
    new, old = batch, known.select(*[F.col(c).alias(f"k_{c}") for c in ("id", "isbn_key", "title_key", "author_keys", "book_type", "families")])
    same_type = (F.col("book_type") > 0) == (F.col("k_book_type") > 0)
    by_isbn = new.join(old, F.col("isbn_key") == F.col("k_isbn_key")).filter(same_type & F.arrays_overlap("families", "k_families"))
    by_title = new.filter("title_key <> ''").join(old, F.col("title_key") == F.col("k_title_key")).filter(same_type & F.arrays_overlap("author_keys", "k_author_keys"))
    rows = by_isbn.select("id", F.col("k_id").alias("match_id"), F.lit("isbn").alias("reason")).union(
        by_title.select("id", F.col("k_id").alias("match_id"), F.lit("fuzzy_metadata").alias("reason"))
    )
    return rows.filter("id <> match_id").groupBy("id", "match_id").agg(F.max("reason").alias("reason"))


def watch(records: DataFrame, known_path: str, matches_path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that matches each micro-batch of raw records and then adds it to the known ones.

    Each batch writes its own folder by number, so a batch that is repeated after a failure overwrites itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        prepared = prepare(load_records(batch))
        folder = f"{known_path}/batch={number}"
        prepared.write.mode("overwrite").parquet(folder)
        new = spark.read.parquet(folder)
        known = spark.read.option("basePath", known_path).parquet(known_path).filter(F.col("batch") <= number)
        exact_matches(new, known).write.mode("overwrite").parquet(f"{matches_path}/batch={number}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
