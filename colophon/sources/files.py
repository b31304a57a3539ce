"""Files of a library, listed by Spark, and their states: readable, missing or unreadable.

A library has a folder for each author, in it one for each book, `title (id)`, and in that the book's files, named by
format. The listing goes level by level: a level's folders are rows, dealt out by their path, and each task lists
its own. So neither a folder of many authors nor an author of many books is one task's, and the driver lists nothing.
Paths may be in any file system that pyarrow opens.

What can't be told is not taken for missing: a book whose folder can't be listed is unreadable, and so is any book that is
nowhere found while an author's folder can't be listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators.components import by_shuffle

READABLE, MISSING, UNREADABLE = "readable", "missing", "unreadable"


def _listed(folders: DataFrame, root: str, probe: bool = False) -> DataFrame:
    """parent, path, folder, size and state of what is in the folders; one row without a path for a folder that can't be listed."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk = fs.FileSystem.from_uri(root)[0]
        for batch in batches:
            rows = []
            for parent in batch.column(0).to_pylist():
                try:
                    found = disk.get_file_info(fs.FileSelector(parent))
                except OSError:
                    rows.append((parent, None, False, None, UNREADABLE))
                    continue
                for x in found:
                    state = READABLE
                    if probe and x.is_file:
                        try:
                            with disk.open_input_stream(x.path) as stream:
                                stream.read(1)
                        except OSError:
                            state = UNREADABLE
                    rows.append((parent, x.path, not x.is_file, x.size if x.is_file else None, state))
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string())
            columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["parent", "path", "folder", "size", "state"])

    return folders.repartition("path").mapInArrow(look, "parent string, path string, folder boolean, size long, state string")


def library_files(spark: SparkSession, root: str, probe: bool = True) -> DataFrame:
    """book, format, path, size and state of every file of the library at `root`.

    A row without a format stands for a book's folder that can't be listed; without a book, for another folder. With `probe` a file
    is readable only if it opens. A folder in a file's place is unreadable.
    """
    base = fs.FileSystem.from_uri(root)[1]
    authors = _listed(spark.createDataFrame([(base,)], "path string"), root)
    books = _listed(authors.filter("folder").select("path"), root)
    files = _listed(books.filter("folder").select("path"), root, probe)
    lost = authors.filter("path IS NULL").unionByName(books.filter("path IS NULL"))
    number = F.regexp_extract("parent", r"\((\d+)\)$", 1)
    name = F.substring_index("path", "/", -1)
    kind = F.when(name.contains("."), F.upper(F.substring_index(name, ".", -1)))
    state = F.when(F.col("folder"), UNREADABLE).otherwise(F.col("state"))
    each = files.select(F.when(number != "", number.cast("long")).alias("book"), kind.alias("format"), "path", "size", state.alias("state"))
    none = lambda k: F.lit(None).cast(k)
    return each.unionByName(lost.select(none("long").alias("book"), none("string").alias("format"), "path", none("long").alias("size"), "state"))


def file_states(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """book, format, size and state of every wanted(book, format), by what library_files has found."""
    found = files.filter("format IS NOT NULL").groupBy("book", "format").agg(F.max(F.when(F.col("state") == READABLE, F.col("size"))).alias("size"))
    lost = files.filter(f"book IS NOT NULL AND format IS NULL AND state = '{UNREADABLE}'").select("book").distinct().withColumn("lost", F.lit(True))
    seen = files.filter("book IS NOT NULL").select("book").distinct().withColumn("seen", F.lit(True))
    unknown = files.filter("book IS NULL AND path IS NULL").agg((F.count("*") > 0).alias("unknown")).withColumn("one", F.lit(1))
    rows = wanted.select("book", F.upper("format").alias("format")).distinct().withColumn("one", F.lit(1))
    rows = rows.join(by_shuffle(found.withColumn("there", F.lit(True))), ["book", "format"], "left").join(by_shuffle(lost), "book", "left").join(by_shuffle(seen), "book", "left").join(F.broadcast(unknown), "one")
    unsure = F.col("lost").isNotNull() | (F.col("unknown") & F.col("seen").isNull())
    state = F.when(F.col("size").isNotNull(), READABLE).when(F.col("there").isNotNull() | unsure, UNREADABLE).otherwise(MISSING)
    return rows.select("book", "format", "size", state.alias("state"))


def sized(records: DataFrame, states: DataFrame) -> DataFrame:
    """Records whose size is the sum of their readable files, 0 without any."""
    sums = states.filter(F.col("state") == READABLE).groupBy(F.col("book").alias("id")).agg(F.sum("size").alias("__size"))
    return records.join(by_shuffle(sums), "id", "left").withColumn("size", F.coalesce("__size", F.lit(0)).cast("long")).select(*records.columns)


def on_disk(states: DataFrame) -> DataFrame:
    """book and format of files that may be there: those that can't be read count, so that nothing unsure is deleted."""
    return states.filter(F.col("state") != MISSING).select("book", "format")


def unreadable_books(states: DataFrame) -> DataFrame:
    """id of the books none of whose files can be told to be there or not."""
    return states.groupBy(F.col("book").alias("id")).agg(F.bool_and(F.col("state") == UNREADABLE).alias("all")).filter("all").select("id")


def write_files(files: DataFrame, root: str) -> int:
    """Writes files(path, content) below `root`, each row's by the task that has it; a null content makes a folder. The number written.

    A file appears whole, under its name, when it is closed; a task that is run again writes the same files anew.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = fs.FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = f"{base}/{path}"
                disk.create_dir(whole if content is None else whole.rpartition("/")[0], recursive=True)
                if content is not None:
                    with disk.open_output_stream(f"{whole}.part") as out:
                        out.write(content)
                    disk.move(f"{whole}.part", whole)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
