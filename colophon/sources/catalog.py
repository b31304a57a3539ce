"""Catalog sources: records from tables, and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colophon.functions import isbn as I
from colophon.functions import metadata as M
from colophon.functions import text as T
from colophon.operators.components import by_shuffle

TEXT = ("title", "isbn", "isbn10", "isbn13", "comments", "series", "publisher", "pubdate", "added", "collector_name")
LISTS = ("authors", "formats", "tags", "languages", "translators")
COLUMNS = {
    **{"id": "bigint"},
    **dict.fromkeys(TEXT, "string"),
    **dict.fromkeys(LISTS, "array<string>"),
    **{"size": "bigint", "series_index": "double", "rating": "double", "has_cover": "boolean", "sole": "boolean", "collector_id": "bigint", "book_type": "int"},
}


#: Hosts' other names for a column; the first with something in it counts.
ALIASES = {"formats": ("formats", "available_formats"), "authors": ("authors", "author"), "tags": ("tags", "tag"), "added": ("added", "timestamp"), "has_cover": ("has_cover", "cover"), "collector_name": ("collector_name", "collector"), "book_type": ("#book_type", "book_type")}


def _list(value: Column, kind: str) -> Column:
    as_list = value.cast("array<string>") if kind.startswith("array") else F.array(value.cast("string"))
    return F.filter(F.coalesce(as_list, F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False)))


def _physical(value: Column, kind: str) -> Column:
    """1, 0 or null: texts are physical if they say so, numbers and truth values unless they are zero."""
    if kind == "string":
        return F.when(value.isNotNull(), F.trim(value).isin("1", "true", "True", "实体书").cast("int"))
    return F.when(value.isNotNull(), (value.cast("double") != 0).cast("int"))


def load_records(raw: DataFrame, ids: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Catalog records with every default filled in, so that null logic reaches no predicate.

    raw needs an id; other columns are optional and may come under the names that hosts use (ALIASES), as lists or
    single texts. Rows without an id are left out. ids restricts by a semi-join; most keeps the first so many by id (a
    scan limit).
    """
    have = dict(raw.dtypes)
    out: list[Column] = []
    for name, kind in COLUMNS.items():
        there = [(F.col(f"`{n}`"), have[n], n) for n in ALIASES.get(name, (name,)) if n in have]
        if name in LISTS:
            lists = [_list(c, k) for c, k, _ in there]
            filled = [F.when(F.size(x) > 0, x) for x in lists]
            value = F.coalesce(*filled, F.array().cast("array<string>"))
            value = F.transform(value, F.upper) if name == "formats" else value
        elif name in TEXT:
            timed = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if k.startswith("timestamp") else c.cast("string") for c, k, _ in there]
            value = F.coalesce(*[F.nullif(c, F.lit("")) for c in timed], F.lit(""))
        elif name == "book_type":
            value = F.coalesce(*[_physical(c, k) for c, k, _ in there], F.lit(0))
        elif name in ("has_cover", "sole"):
            value = F.coalesce(*[(c != "") if k == "string" else c.cast("boolean") for c, k, _ in there], F.lit(False))
        elif name in ("size", "rating"):
            value = F.coalesce(*[c.try_cast(kind) for c, _, _ in there], F.lit(0).cast(kind))
        else:
            value = F.coalesce(*[c.try_cast(kind) for c, _, _ in there], F.lit(None).cast(kind))
        out.append(value.alias(name))
    rows = raw.filter("id IS NOT NULL").select(*out).withColumn("comments_present", M.has_text(F.col("comments")))
    rows = rows if ids is None else rows.join(by_shuffle(ids.select("id").distinct()), "id", "left_semi")
    return rows if most is None else rows.orderBy("id").limit(most)


def load_notes(raw: DataFrame, wanted: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row: missing (wanted ids without a record) and no_format_path (formats of records without a file).

    wanted: id; files: book, format. Without them nothing is known to be missing.
    """
    loaded = load_records(raw, wanted)
    none = lambda f: f.limit(0)
    lost = none(loaded) if wanted is None else wanted.select("id").distinct().join(by_shuffle(loaded), "id", "left_anti")
    each = loaded.select(F.col("id").alias("book"), F.explode("formats").alias("format"))
    bare = none(each) if files is None else each.join(by_shuffle(files.select("book", F.upper("format").alias("format")).distinct()), ["book", "format"], "left_anti")
    count = lambda f, name: f.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    return count(lost, "missing").join(count(bare, "no_format_path"), "one").drop("one")


def prepare(records: DataFrame) -> DataFrame:
    """Adds title_key, title_core_key, author_keys, isbn_key, families, meta_score and missing."""
    # what the expressions below read many times is a column first
    slots = {f"__{c}": I.normalize_isbn(F.col(c)) for c in ("isbn", "isbn10", "isbn13")}
    normal = records.withColumns({"__normal": T.nfkc(F.coalesce("title", F.lit(""))), **slots})
    return normal.select(
        *records.columns,
        T.key_of(F.col("__normal")).alias("title_key"),
        T.key_of(T.core_of(F.col("__normal"))).alias("title_core_key"),
        T.author_keys(F.col("authors")).alias("author_keys"),
        I.key_of_slots(F.col("__isbn"), F.col("__isbn10"), F.col("__isbn13")).alias("isbn_key"),
        M.families_of(F.col("formats")).alias("families"),
        M.meta_score(F.col).alias("meta_score"),
        M.missing_fields(F.col).alias("missing"),
    )


def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog over `documents` and `labels`, used by the queries."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    d = F.col("doc_id")
    body = F.lpad(F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 7), 16, 10), 9, "0")
    sum10 = sum((F.substring(body, i + 1, 1).cast("int") * (10 - i) for i in range(9)), F.lit(0))
    check10 = F.pmod(11 - sum10 % 11, F.lit(11))
    as_digit = lambda c: F.when(c == 10, "X").otherwise(c.cast("string"))
    sum13 = sum((F.substring(body, i + 1, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(9)), F.lit(9 + 7 * 3 + 8))
    check13 = F.pmod(10 - sum13 % 10, F.lit(10)).cast("string")
    hyphened = F.concat_ws("-", F.lit("978"), F.substring(body, 1, 1), F.substring(body, 2, 3), F.substring(body, 5, 5), check13)
    isbn = (
        F.when(d % 3 == 0, "")
        .when(d % 17 == 0, F.concat(body, as_digit(F.pmod(check10 + 1, F.lit(11)))))
        .when(d % 5 == 1, hyphened)
        .otherwise(F.concat(body, as_digit(check10)))
    )
    forms = (
        F.when(d % 5 == 0, F.array(F.lit("epub")))
        .when(d % 5 == 1, F.array(F.lit("EPUB"), F.lit("PDF")))
        .when(d % 5 == 2, F.array(F.lit("PDF")))
        .when(d % 5 == 3, F.array(F.lit("MP3")))
    )
    # texts stay where they are read: the join moves what is made from them
    own = docs.select("doc_id", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), isbn.alias("isbn"), "lang", "source", "n_chars")
    raw = own.join(by_shuffle(labels), "doc_id", "left").select(
        d.alias("id"),
        "title",
        F.when(F.col("source").isNotNull(), F.array("source")).alias("authors"),
        F.col("n_chars").alias("size"),
        F.when(F.col("lang").isNotNull(), F.array("lang")).alias("languages"),
        F.col("quality").cast("double").alias("rating"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("has_cover"),
        forms.alias("available_formats"),
        F.when(d % 11 == 0, 1).otherwise(0).alias("book_type"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), d.cast("int")), "yyyy-MM-dd'T'HH:mm:ss").alias("added"),
        "isbn",
    )
    return load_records(raw)


def page_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog over `pages`: the title element as title, the host as author (few hosts, large blocks)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    raw = pages.select(
        F.col("page_id").alias("id"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.array(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("authors"),
        F.octet_length("html").alias("size"),
        F.array(F.lit("EPUB")).alias("formats"),
    )
    return load_records(raw)


def library_records(books: DataFrame, links: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """Raw records from a library's link tables.

    links: name of a list column -> (book, link_id, name), kept in link order. files: (book, format, name, size).
    """
    out = books
    for name, frame in links.items():
        each = frame.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("link_id", "name"))).alias("l")).select("book", F.col("l.name").alias(name))
        out = out.join(by_shuffle(each), out["id"] == each["book"], "left").drop("book")
    sums = files.groupBy("book").agg(F.array_sort(F.collect_set(F.upper("format"))).alias("formats"), F.sum("size").alias("size"))
    return out.join(by_shuffle(sums), out["id"] == sums["book"], "left").drop("book")


#: Groups of a report's part: a lookup reads one part, a page few.
PART = 10_000


def write_report(frame: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes one version of a report; readers see it only when the writer has committed.

    Rows with an index are written in parts of PART places, sorted, so that a place or a page is found by its part.
    """
    if "index" in frame.columns:
        dealt = frame.withColumn("part", F.call_function("div", F.col("index"), F.lit(PART)))
        dealt.repartition("part").sortWithinPartitions("part", "index").write.mode("overwrite").partitionBy("part").format(form).save(path)
    else:
        frame.write.mode("overwrite").format(form).save(path)


def read_report(spark: SparkSession, path: str, form: str = "parquet", index: int | list[int] | None = None) -> DataFrame:
    """A report, or its groups at a place or some places: only their parts are opened."""
    frame = spark.read.format(form).load(path)
    if index is not None:
        wanted = index if isinstance(index, list) else [index]
        frame = frame.filter(F.col("index").isin(wanted))
        frame = frame.filter(F.col("part").isin(sorted({i // PART for i in wanted}))) if "part" in frame.columns else frame
    return frame.drop("part")


def read_page(spark: SparkSession, path: str, page: int, size: int, form: str = "parquet") -> DataFrame:
    """A page of a whole report in order: the parts that hold it are read, nothing else is sorted."""
    first = max(0, page) * size
    frame = spark.read.format(form).load(path).filter((F.col("index") >= first) & (F.col("index") < first + size))
    return frame.filter(F.col("part").between(first // PART, (first + size - 1) // PART)).drop("part").orderBy("index")


def write_members(rows: DataFrame, path: str) -> None:
    """Writes a report's member table in parts of PART places. Rows are dealt by ranges of place and id, so a large group fills many files, each in order."""
    dealt = rows.withColumns({"part": F.call_function("div", F.col("index"), F.lit(PART)), "id": F.col("e.id")})
    dealt.repartitionByRange("index", "id").sortWithinPartitions("part", "index", "id").write.mode("overwrite").partitionBy("part").parquet(path)


def read_members(spark: SparkSession, path: str, index: int | None = None, after: int | None = None, size: int | None = None) -> DataFrame:
    """The member table; of the group at a place only; the first `size` of its members behind the id `after`.

    A page goes on behind the last id of the page before it. Place and id are pushed into the scan, which skips files and row groups by their
    ranges, so a page of a large group reads about what it returns.
    """
    rows = spark.read.parquet(path)
    if index is not None:
        rows = rows.filter((F.col("part") == index // PART) & (F.col("index") == index))
    if after is not None:
        rows = rows.filter(F.col("id") > after)
    rows = rows.select("index", "group_id", "keeper_id", "id", "e")
    return rows if size is None else rows.orderBy("index", "id").limit(size)


MARKER = "task_id string, generated_at string, path string, group_count bigint"


def write_latest(spark: SparkSession, path: str, task_id: str, generated_at: str, report_path: str, groups: int) -> None:
    """Writes the pointer to the newest report."""
    spark.createDataFrame([(task_id, generated_at, report_path, groups)], MARKER).coalesce(1).write.mode("overwrite").json(path)


def latest_report(spark: SparkSession, path: str, task_id: str | None = None, generated_at: str | None = None) -> DataFrame:
    """The pointer, or nothing unless task and time agree with what is asked for."""
    rows = spark.read.schema(MARKER).json(path)
    for name, value in (("task_id", task_id), ("generated_at", generated_at)):
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows


def kept_reports(reports: DataFrame, keep: int = 5) -> DataFrame:
    """reports(path, mtime, protected) with pruned: all but the newest `keep`; protected ones stay besides."""
    newest = F.row_number().over(Window.orderBy(F.desc("mtime"), F.desc("path")))
    ranked = reports.filter("NOT protected").select("path", newest.alias("place"))
    return reports.join(by_shuffle(ranked), "path", "left").select(
        "path", "mtime", "protected", F.coalesce(F.col("place") > max(1, keep), F.lit(False)).alias("pruned")
    )


def report_folders(spark: SparkSession, home: str) -> DataFrame:
    """path, mtime and protected of the reports below `home`; the one that the pointer tells of is protected."""
    place = spark._jvm.org.apache.hadoop.fs.Path(home)
    disk = place.getFileSystem(spark._jsc.hadoopConfiguration())
    below = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x, "report")
    found = [(x.getPath().toString(), x.getModificationTime()) for x in (disk.listStatus(place) if disk.exists(place) else []) if x.isDirectory() and disk.exists(below(x.getPath()))]
    pointer = spark._jvm.org.apache.hadoop.fs.Path(place, "latest")
    marked = latest_report(spark, pointer.toString()).select("path").collect() if disk.exists(pointer) else []  # one row
    kept = {disk.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(r["path"])).toString() for r in marked}
    return spark.createDataFrame([(p, t, p in kept) for p, t in found], "path string, mtime bigint, protected boolean")


def prune_reports(spark: SparkSession, home: str, keep: int = 5) -> list[str]:
    """Deletes all reports below `home` but the newest `keep` and the one that the pointer tells of; the paths of those deleted."""
    pruned = sorted(r["path"] for r in kept_reports(report_folders(spark, home), keep).filter("pruned").collect())  # a row for each report folder
    for path in pruned:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return pruned
