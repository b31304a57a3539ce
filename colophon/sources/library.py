"""Libraries in SQLite as a Spark data source: each table is read in ranges of book ids, and ids asked for are pushed down.

A library is one database or a folder of them with different books (`*.db`), in a folder that all executors mount. A task
opens its database read-only and reads its range; list columns are put together by Spark's joins (`library_records`).
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from colophon.operators.components import by_shuffle
from colophon.sources.catalog import library_records

FORMAT = "sqlite_library"
#: Book ids of a partition.
RANGE = 50_000
#: Ranges of a database, beyond which they are made longer than asked for, up to RANGE: tasks of few books cost more to start than to run.
MOST_RANGES = 16
#: The tables of a library. For each its columns, the book's column, and the SQL that yields them.
LINKS = {"authors": ("authors", "author", "name"), "tags": ("tags", "tag", "name"), "languages": ("languages", "lang_code", "lang_code"), "publishers": ("publishers", "publisher", "name"), "series": ("series", "series", "name"), "ratings": ("ratings", "rating", "rating")}
TABLES = {
    "books": ("id long, title string, series_index double, pubdate string, timestamp string, has_cover boolean, isbn string, path string", "id", "SELECT id, title, series_index, pubdate, timestamp, has_cover, isbn, path FROM books"),
    "comments": ("book long, text string", "book", "SELECT book, text FROM comments"),
    "data": ("book long, format string, name string, size long", "book", "SELECT book, format, name, uncompressed_size AS size FROM data"),
    **{
        t: (f"book long, link_id long, name {'double' if t == 'ratings' else 'string'}", "book", f"SELECT l.book AS book, l.id AS link_id, x.{value} AS name FROM books_{t}_link l JOIN {t} x ON x.id = l.{link}")
        for t, (_, link, value) in LINKS.items()
    },
}
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _local(path: str) -> str:
    return path.removeprefix("file://")


def databases(path: str) -> list[str]:
    path = _local(path)
    return sorted(glob.glob(f"{glob.escape(path)}/*.db")) if os.path.isdir(path) else [path]


def _open(database: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{database}?mode=ro", uri=True)


@dataclass
class Range(InputPartition):
    database: str
    least: int
    most: int
    #: The ids asked for in the range; None: all.
    ids: list[int] | None = None


class LibraryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.rows = options["path"], options.get("table", "books"), int(options.get("range", RANGE))
        self.columns, self.key, self.sql = TABLES[self.table]
        self.ids: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and lists of ids; others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.key,):
                ids = {f.value}
            elif isinstance(f, In) and f.attribute == (self.key,):
                ids = set(f.value)
            else:
                yield f
                continue
            ids = {i for i in ids if i is not None}
            self.ids = ids if self.ids is None else self.ids & ids

    def partitions(self) -> list[Range]:
        out = []
        for database in databases(self.path):
            with _open(database) as c:
                least, most = c.execute("SELECT min(id), max(id) FROM books").fetchone()
            if least is None:
                continue
            rows = max(self.rows, min(RANGE, -(-(most - least + 1) // MOST_RANGES)))
            if self.ids is None:
                out += [Range(database, i, min(i + rows - 1, most)) for i in range(least, most + 1, rows)]
                continue
            # only ranges that hold an id that is asked for
            held: dict[int, list[int]] = {}
            for i in sorted(self.ids):
                if least <= i <= most:
                    held.setdefault((i - least) // rows, []).append(i)
            out += [Range(database, ids[0], ids[-1], ids) for ids in held.values()]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fields = [c.split() for c in self.columns.split(", ")]
        schema = pa.schema([(n, _KINDS[k]) for n, k in fields])
        with _open(part.database) as c:
            # a table of the ids: a list of any length is one join
            wanted = ""
            if part.ids is not None:
                c.execute("CREATE TEMP TABLE wanted (id INTEGER PRIMARY KEY)")
                c.executemany("INSERT INTO wanted VALUES (?)", [(i,) for i in part.ids])
                wanted = f" AND {self.key} IN (SELECT id FROM wanted)"
            cursor = c.execute(f"SELECT * FROM ({self.sql}) WHERE {self.key} BETWEEN ? AND ?{wanted}", (part.least, part.most))
            while rows := cursor.fetchmany(8192):
                columns = [[bool(v) if k == "boolean" and v is not None else v for v in column] for column, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


class LibrarySource(DataSource):
    """Options: path, table (a name of TABLES), range (book ids of a partition)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TABLES[self.options.get("table", "books")][0]

    def reader(self, schema) -> DataSourceReader:
        return LibraryReader(self.options)


def read_table(spark: SparkSession, path: str, name: str, ids: list[int] | None = None, rows: int = RANGE) -> DataFrame:
    """A table of a library; with ids, only their rows are read from the database."""
    spark.dataSource.register(LibrarySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses sources that push filters otherwise
    frame = spark.read.format(FORMAT).option("table", name).option("range", str(rows)).load(path)
    return frame if ids is None else frame.filter(F.col(TABLES[name][1]).isin(ids))


def read_library(spark: SparkSession, path: str, ids: list[int] | None = None, rows: int = RANGE) -> DataFrame:
    """Raw catalog records of a library: its books with their lists, files, first publisher, series and rating, and comments."""
    read = lambda name: read_table(spark, path, name, ids, rows)
    books = read("books")
    for name, kept in (("publishers", "publisher"), ("series", "series"), ("ratings", "rating")):
        first = read(name).groupBy("book").agg(F.min(F.struct("link_id", "name"))["name"].alias(kept))
        books = books.join(by_shuffle(first), books["id"] == first["book"], "left").drop("book")
    said = read("comments").groupBy("book").agg(F.min("text").alias("comments"))
    books = books.join(by_shuffle(said), books["id"] == said["book"], "left").drop("book")
    return library_records(books, {n: read(n) for n in ("authors", "tags", "languages")}, read("data"))


#: What a database of a library holds.
_DDL = [
    "CREATE TABLE books (id INTEGER PRIMARY KEY, title TEXT, series_index REAL, pubdate TEXT, timestamp TEXT, has_cover INTEGER, isbn TEXT, path TEXT)",
    "CREATE TABLE comments (id INTEGER PRIMARY KEY, book INTEGER, text TEXT)",
    "CREATE TABLE data (id INTEGER PRIMARY KEY, book INTEGER, format TEXT, name TEXT, uncompressed_size INTEGER)",
    "CREATE INDEX data_book ON data (book)",
    "CREATE INDEX comments_book ON comments (book)",
] + [
    s
    for t, (_, link, value) in LINKS.items()
    for s in (f"CREATE TABLE {t} (id INTEGER PRIMARY KEY, {value} UNIQUE)", f"CREATE TABLE books_{t}_link (id INTEGER PRIMARY KEY, book INTEGER, {link} INTEGER)", f"CREATE INDEX {t}_book ON books_{t}_link (book)")
]
#: Columns that hold one value of a link table.
SINGLE = {"publishers": "publisher", "series": "series", "ratings": "rating"}


def write_library(records: DataFrame, path: str, parts: int = 4) -> None:
    """Writes catalog records as a library of `parts` databases with ranges of ids; each task writes its own, under its name when it is whole.

    A record's size goes to its first format; a rating of 0 is none.
    """
    columns = ["id", "title", "series_index", "pubdate", "added", "has_cover", "isbn", "authors", "tags", "languages", "publisher", "series", "rating", "comments", "formats", "size"]
    home = _local(path)
    os.makedirs(home, exist_ok=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{home}/part-{task.partitionId():05d}"
        draft = f"{name}.{task.taskAttemptId()}"
        n = 0
        with sqlite3.connect(draft) as c:
            for s in _DDL:
                c.execute(s)
            for batch in batches:
                for r in batch.to_pylist():
                    n += 1
                    book = r["id"]
                    c.execute("INSERT INTO books VALUES (?, ?, ?, ?, ?, ?, ?, ?)", (book, r["title"], r["series_index"], r["pubdate"], r["added"], r["has_cover"], r["isbn"], f"{(r['authors'] or ['unknown'])[0]}/book ({book})"))
                    for table, (_, link, value) in LINKS.items():
                        listed = [r[SINGLE[table]]] if table in SINGLE else r[table]
                        for v in listed or []:
                            if v:
                                c.execute(f"INSERT OR IGNORE INTO {table} ({value}) VALUES (?)", (v,))
                                c.execute(f"INSERT INTO books_{table}_link (book, {link}) SELECT ?, id FROM {table} WHERE {value} = ?", (book, v))
                    if r["comments"]:
                        c.execute("INSERT INTO comments (book, text) VALUES (?, ?)", (book, r["comments"]))
                    c.executemany("INSERT INTO data (book, format, name, uncompressed_size) VALUES (?, ?, ?, ?)", [(book, f, "book", r["size"] if i == 0 else 0) for i, f in enumerate(r["formats"])])
        c.close()
        os.replace(draft, f"{name}.db")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    records.select(*columns).repartitionByRange(parts, "id").mapInArrow(put, "n long").agg(F.sum("n")).first()
