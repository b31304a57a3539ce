"""Files and libraries as sources, reports by place, scans as tasks, and series counted without their pairs."""

import os
import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from test_engine import BASE, SCHEMA, records, row

from colophon.operators import candidates as C
from colophon.operators import ledger, views
from colophon.plans import tasks as K
from colophon.sources import catalog, dismissals, files, library

# ---- series


def brute_serial(frame):
    """Pairs of records of the listed key pairs."""
    sizes = frame.select("block", "title_key", "m")
    pairs = C.serial_key_pairs(frame).join(sizes.toDF("block", "key_a", "ma"), ["block", "key_a"]).join(sizes.toDF("block", "key_b", "mb"), ["block", "key_b"])
    return pairs.agg(F.coalesce(F.sum(F.col("ma") * F.col("mb")), F.lit(0))).first()[0]


@pytest.mark.parametrize("seed", range(4))
def test_serial_pairs_are_counted(spark, seed):
    rng = random.Random(seed)
    stems = ["weekly", "weekl", "三体", "a", "vol", "weekly1"]
    keys = {(rng.choice("xy"), rng.choice(stems) + rng.choice(["", "1", "2", "12", "第一卷", "上", "a", "ii", "2024"])) for _ in range(60)}
    frame = spark.createDataFrame([(b, k, rng.randrange(1, 5)) for b, k in sorted(keys)], "block string, title_key string, m long")
    assert C.serial_pair_count(frame).first()[0] == brute_serial(frame) > 0


def test_a_long_series(spark):
    """200,000 volumes of one weekly: two thousand million pairs, none of which is listed."""
    n = 200_000
    frame = spark.range(1, n + 1).select(F.lit("b").alias("block"), F.concat(F.lit("weekly"), F.lpad("id", 6, "0")).alias("title_key"), F.lit(1).cast("long").alias("m"))
    counted = C.serial_pair_count(frame)
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert counted.first()[0] == n * (n - 1) // 2


# ---- files


def test_listing(spark, tmp_path):
    made = [("ann/one (1)/book.epub", "12345"), ("ann/one (1)/book.pdf", ""), ("ann/one (1)/cover.jpg", "x"), ("ann/two (2)/book.epub", None), ("bob/no number/book.epub", "y"), ("bob/long (3)/x.tar.GZ", "zz"), ("bob/empty (4)", None)]
    assert files.write_files(spark.createDataFrame(made, "path string, content string").repartition(3), str(tmp_path)) == len(made)
    files.write_files(spark.createDataFrame(made, "path string, content string"), f"file://{tmp_path}")  # once more: the same files
    found = files.library_files(spark, str(tmp_path))
    rows = sorted((r["book"] or 0, r["format"], r["size"], r["state"]) for r in found.collect())
    assert rows == [(0, "EPUB", 1, "readable"), (1, "EPUB", 5, "readable"), (1, "JPG", 1, "readable"), (1, "PDF", 0, "readable"), (2, "EPUB", None, "unreadable"), (3, "GZ", 2, "readable")]
    wanted = spark.createDataFrame([(1, "epub"), (1, "PDF"), (1, "MOBI"), (2, "EPUB"), (3, "GZ"), (4, "EPUB"), (9, "EPUB")], "book long, format string")
    states = files.file_states(wanted, found)
    told = {(r["book"], r["format"]): r["state"] for r in states.collect()}
    assert told == {(1, "EPUB"): "readable", (1, "PDF"): "readable", (1, "MOBI"): "missing", (2, "EPUB"): "unreadable", (3, "GZ"): "readable", (4, "EPUB"): "missing", (9, "EPUB"): "missing"}
    assert sorted((r["book"], r["format"]) for r in files.on_disk(states).collect()) == [(1, "EPUB"), (1, "PDF"), (2, "EPUB"), (3, "GZ")]
    assert [r["id"] for r in files.unreadable_books(states).collect()] == [2]
    library_of = records(spark, [row(1, "a", size=99), row(2, "b", size=99), row(9, "c", size=99)])
    assert {r["id"]: r["size"] for r in files.sized(library_of, states).collect()} == {1: 5, 2: 0, 9: 0}
    assert files.library_files(spark, f"{tmp_path}/nowhere").collect()[0]["state"] == "unreadable"


def test_what_cannot_be_listed_is_not_missing(spark):
    wanted = spark.createDataFrame([(1, "EPUB"), (2, "EPUB"), (3, "EPUB")], "book long, format string")
    schema = "book long, format string, path string, size long, state string"
    lost_book = spark.createDataFrame([(1, "PDF", "p", 1, "readable"), (2, None, None, None, "unreadable")], schema)
    assert {r["book"]: r["state"] for r in files.file_states(wanted, lost_book).collect()} == {1: "missing", 2: "unreadable", 3: "missing"}
    lost_author = spark.createDataFrame([(1, "PDF", "p", 1, "readable"), (None, None, None, None, "unreadable")], schema)
    assert {r["book"]: r["state"] for r in files.file_states(wanted, lost_author).collect()} == {1: "missing", 2: "unreadable", 3: "unreadable"}
    none = spark.createDataFrame([], schema)
    assert {r["state"] for r in files.file_states(wanted, none).collect()} == {"missing"}


def test_missing_files_let_a_source_go(spark):
    """Nothing to copy is no failure; a file that may be there and was not copied is."""
    now = records(spark, [row(1, "a", formats=["EPUB"]), *[row(i, "a", formats=["EPUB", "PDF"]) for i in (2, 3, 4)], row(5, "a", formats=["EPUB"])])
    steps = spark.createDataFrame([(i, 1) for i in (2, 3, 4, 5)], "source_id long, target_id long")
    copied = spark.createDataFrame([(2, False), (3, False), (4, True), (5, True)], "source_id long, ok boolean")
    states = spark.createDataFrame([(2, "PDF", "missing"), (3, "PDF", "unreadable"), (4, "PDF", "readable")], "book long, format string, state string")
    got = {r["source_id"]: (r["error"], r["note"]) for r in ledger.step_status(steps, now, copied, states).collect()}
    assert got == {2: (None, "format_files_missing"), 3: ("merge.copy_failed", None), 4: (None, None), 5: (None, "no_new_formats")}


# ---- libraries


def test_library(spark, tmp_path):
    raw = spark.createDataFrame(
        [(i, f"t{i}", ["b", "a"][: i % 3], ["x", "y"][: i % 2], "en" if i % 4 else None, f"p{i % 3}" if i % 5 else "", i % 6, "said" if i == 7 else "", ["EPUB", "PDF"][: i % 3], 100 + i) for i in range(5, 60)],
        "id long, title string, authors array<string>, tags array<string>, languages string, publisher string, rating int, comments string, formats array<string>, size long",
    )
    made = catalog.load_records(raw)
    library.write_library(made, str(tmp_path / "lib"), 3)
    assert len(library.databases(str(tmp_path / "lib"))) == 3
    columns = ["id", "title", "authors", "tags", "languages", "publisher", "rating", "comments", "formats"]
    want = {r["id"]: r for r in made.select(*columns).collect()}
    back = catalog.load_records(library.read_library(spark, str(tmp_path / "lib"), rows=7))
    assert {r["id"]: r for r in back.select(*columns).collect()} == want
    assert {r["id"]: r["size"] for r in back.collect()} == {i: 100 + i if i % 3 else 0 for i in want}
    some = library.read_table(spark, str(tmp_path / "lib"), "books", [6, 50, 51, 1000], rows=7)
    assert sorted(r["id"] for r in some.collect()) == [6, 50, 51]
    assert some.rdd.getNumPartitions() == 2
    assert sorted(r["id"] for r in library.read_library(spark, str(tmp_path / "lib"), [7]).collect()) == [7]
    assert library.read_table(spark, str(tmp_path / "lib"), "books").filter("id > 50").count() == 9


def test_ids_are_pushed_down(tmp_path):
    path = tmp_path / "one.db"
    with sqlite3.connect(path) as c:
        for s in library._DDL:
            c.execute(s)
        c.executemany("INSERT INTO books (id, title) VALUES (?, 't')", [(i,) for i in range(1, 1001)])
    c.close()
    reader = library.LibraryReader({"path": f"file://{path}", "table": "books", "range": "100"})
    assert len(reader.partitions()) == 10
    kept = list(reader.pushFilters([In(("id",), (5, 250, 251, 99999)), GreaterThan(("id",), 3), EqualTo(("title",), "t")]))
    assert len(kept) == 2
    parts = reader.partitions()
    assert [p.ids for p in parts] == [[5], [250, 251]]
    assert [v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()] == [5, 250, 251]
    fine = library.LibraryReader({"path": f"file://{path}", "table": "books", "range": "2"})
    assert len(fine.partitions()) == library.MOST_RANGES  # as many, however many books there are
    assert [v for p in fine.partitions() for b in fine.read(p) for v in b.column(0).to_pylist()] == list(range(1, 1001))
    list(reader.pushFilters([EqualTo(("id",), 250)]))
    assert [p.ids for p in reader.partitions()] == [[250]]
    with sqlite3.connect(tmp_path / "none.db") as c:
        for s in library._DDL:
            c.execute(s)
    c.close()
    assert library.LibraryReader({"path": str(tmp_path / "none.db")}).partitions() == []


# ---- reports by place


def test_lookup_opens_one_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "PART", 10)
    report = spark.range(95).select(F.col("id").alias("index"), F.concat(F.lit("g"), "id").alias("group_id")).repartition(4)
    for form in ("parquet", "json"):
        path = f"{tmp_path}/{form}"
        catalog.write_report(report, path, form)
        one = catalog.read_report(spark, path, form, index=37)
        assert sorted(one.columns) == ["group_id", "index"] and [r["group_id"] for r in one.collect()] == ["g37"]
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "part" in plan.partition("PartitionFilters: ")[2].partition("]")[0]
        assert form == "json" or "index" in plan.partition("PushedFilters: ")[2].partition("]")[0]
        assert one.select(F.input_file_name()).distinct().count() == 1
        assert [r["index"] for r in catalog.read_page(spark, path, 3, 8, form).collect()] == list(range(24, 32))
        assert [r["index"] for r in catalog.read_page(spark, path, 11, 8, form).collect()] == list(range(88, 95))
        assert catalog.read_page(spark, path, 50, 8, form).count() == 0
        assert sorted(r["index"] for r in catalog.read_report(spark, path, form, [3, 94, 95]).collect()) == [3, 94]
        assert catalog.read_report(spark, path, form).count() == 95


def test_old_reports_are_deleted(spark, tmp_path):
    """All but the newest and the one that the pointer tells of; other folders stay."""
    home = f"{tmp_path}/reports"
    assert catalog.prune_reports(spark, home) == []
    for i in range(5):
        catalog.write_report(spark.range(2).withColumnRenamed("id", "index"), f"{home}/t{i}/report")
        os.utime(f"{home}/t{i}", (1000 + i, 1000 + i))
    os.makedirs(f"{home}/other")
    catalog.write_latest(spark, f"{home}/latest", "t1", "now", f"{home}/t1", 2)
    pruned = catalog.prune_reports(spark, home, 2)
    assert [p.rpartition("/")[2] for p in pruned] == ["t0", "t2"]
    assert sorted(os.listdir(home)) == ["latest", "other", "t1", "t3", "t4"]
    assert catalog.prune_reports(spark, home, 2) == []


# ---- search and dismissals


def test_search_by_postings(spark, tmp_path):
    """The index and the scan of all groups find the same, keywords across members' borders and short ones included."""
    rng = random.Random(3)
    rows = [(i, i, [{"title": "".join(rng.choice("abcé 三体B") for _ in range(rng.randrange(9))), "authors": [rng.choice(["Ann B", "c", ""])]} for _ in range(rng.randrange(1, 4))]) for i in range(300)]
    report = spark.createDataFrame(rows, "index long, group_id long, entries array<struct<title string, authors array<string>>>").cache()
    views.write_postings(report, str(tmp_path / "postings"))
    postings = spark.read.parquet(str(tmp_path / "postings"))
    for keyword in (None, " ", "a", "三体", "ann", "ANN B", "b c", "三体b", "abab", "nn b", "zzz", "aaaa"):
        want = sorted(r["index"] for r in views.by_keyword(report, keyword).collect())
        assert sorted(r["index"] for r in views.by_keyword(report, keyword, postings).collect()) == want
    plan = views.by_keyword(report, "ann b", postings)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.partition("PartitionFilters: ")[2].partition("]")[0] and "gram" in plan.partition("PushedFilters: ")[2].partition("]")[0]


def test_dismissals_are_pruned_in_place(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "dismissed")
    now = records(spark, [row(i, f"t{i}") for i in range(1, 9)])
    assert dismissals.read_ignored(spark, home).count() == 0 and dismissals.prune_ignored(spark, home, now).count() == 0
    pairs = lambda *ab: spark.createDataFrame(ab, "a long, b long").withColumns({"a_sig": F.lit(None).cast("string")})
    got = lambda: sorted((r["a"], r["b"]) for r in dismissals.read_ignored(spark, home).collect())
    dismissals.append_ignored(pairs((1, 2), (3, 99), (3, 4)), home)
    assert got() == [(1, 2), (3, 4), (3, 99)]
    whole = dismissals.live_entries

    def meanwhile(entries, known):
        """Others add entries while the pruning runs."""
        dismissals.append_ignored(pairs((5, 6), (7, 99)), home)
        return whole(entries, known)

    monkeypatch.setattr(dismissals, "live_entries", meanwhile)
    dismissals.prune_ignored(spark, home, now)
    assert got() == [(1, 2), (3, 4), (5, 6), (7, 99)]

    def fails(entries, known):
        raise RuntimeError

    monkeypatch.setattr(dismissals, "live_entries", fails)
    with pytest.raises(RuntimeError):
        dismissals.prune_ignored(spark, home, now)
    assert got() == [(1, 2), (3, 4), (5, 6), (7, 99)]
    monkeypatch.setattr(dismissals, "live_entries", whole)
    dismissals.prune_ignored(spark, home, now)
    assert got() == [(1, 2), (3, 4), (5, 6)]
    dismissals.append_ignored(pairs((1, 2)), home)
    assert got() == [(1, 2), (1, 2), (3, 4), (5, 6)]


# ---- scans as tasks


def test_one_scan_at_a_time_while_cancelling(spark, tmp_path, monkeypatch):
    """A scan that is told to stop between two jobs goes no further, and none starts beside it until it has ended."""
    raw = spark.createDataFrame(BASE, SCHEMA)
    tasks = K.Tasks(spark, str(tmp_path))
    inside, whole = [], K.run_scan

    def slow(records, *args, step, **more):
        def told(name, rows=None):
            if name == "records":  # no job is running now
                tasks.cancel()
                assert tasks.progress()["status"] == "cancelling"
                with pytest.raises(K.Refused, match="task.running"):
                    tasks.start(raw)
            inside.append(name)
            step(name, rows)

        return whole(records, *args, step=told, **more)

    monkeypatch.setattr(K, "run_scan", slow)
    first = tasks.start(raw)
    first.thread.join()
    assert (first.status, first.error, inside) == ("cancelled", None, ["records"])
    assert not tasks.running()
    with pytest.raises(K.Refused):
        tasks.cancel()
    monkeypatch.setattr(K, "run_scan", whole)
    second = tasks.start(raw)
    second.thread.join()
    assert second.status == "completed"


def test_progress_rises(spark, tmp_path):
    raw = spark.createDataFrame(BASE, SCHEMA)
    tasks = K.Tasks(spark, str(tmp_path))
    task, seen = tasks.start(raw), []
    while task.thread.is_alive():
        seen.append(tasks.progress())
        time.sleep(0.1)
    last = tasks.progress()
    assert (last["status"], last["progress"], last["progress_data"]["records"], last["progress_data"]["phase"]) == ("completed", 100, 5, "done")
    steps = [s["progress"] for s in seen if s["status"] == "running"]
    assert len({s for s in steps if 0 < s < 100}) >= 3
    floors = [max((p for p in K.STEPS.values() if p <= s), default=0) for s in steps]
    assert floors == sorted(floors)
