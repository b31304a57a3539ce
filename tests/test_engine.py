"""Scans, views and commands over small catalogs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from colophon.operators import candidates as C
from colophon.operators import groups as G
from colophon.operators import ignore, ledger, views
from colophon.operators.components import connected_components
from colophon.plans.scan import run_scan
from colophon.sources import catalog
from colophon.streaming import incremental

SCHEMA = "id long, title string, authors array<string>, formats array<string>, isbn string, size long, added string, book_type string"


def records(spark, rows):
    return catalog.load_records(spark.createDataFrame(rows, SCHEMA))


def row(i, title, author="甲", formats=("epub",), isbn="", size=1000, added="2026-01-01", kind="0"):
    return (i, title, [author] if author else [], list(formats), isbn, size, added, kind)


BASE = [
    row(1, "三体", "刘慈欣", ["EPUB", "MOBI"], "9787536692930", 300),
    row(2, "三体（全集）", "刘慈欣", ["EPUB", "PDF"], "", 100, "2026-05-01"),
    row(3, "To Live", "余华", ["EPUB"], "9787506365437", 50, "2026-02-01"),
    row(4, "活着", "余华", ["EPUB"], "978-7-5063-6543-7", 70, "2026-03-01"),
    row(5, "完全无关的书", "另一个人", ["EPUB"]),
]


@pytest.fixture(scope="module")
def base(spark):
    return run_scan(records(spark, BASE))


def sets_of(scan):
    return sorted(tuple(r["members"]) for r in scan.report.select("members").collect())


def test_base_library(base):
    assert sets_of(base) == [(1, 2), (3, 4)]
    rows = {tuple(r["members"]): r for r in base.report.collect()}
    assert rows[(3, 4)]["confidence"] == "strong" and rows[(3, 4)]["index"] == 0
    assert rows[(1, 2)]["reclaimable_bytes"] == 100


def test_report_members_are_whole(base):
    members = {e["id"]: e for r in base.report.collect() for e in r["entries"]}
    assert (members[1]["isbn"], members[4]["added"], members[2]["languages"]) == ("9787536692930", "2026-03-01", [])
    assert {"tags", "series", "publisher", "rating", "has_cover", "collector_name", "book_type", "translators"} <= set(members[1].asDict())


def test_dismissed_pair_keeps_others(spark):
    more = [*BASE, row(6, "活着", "余华")]
    prepared = catalog.prepare(records(spark, more))
    pair = spark.createDataFrame([(4, 3)], "a long, b long")
    empty = spark.createDataFrame([], ignore.ENTRY)
    entries = ignore.add_ignored(empty, pair, prepared, "now")
    assert [(r["a"], r["b"]) for r in entries.collect()] == [(3, 4)]
    assert sets_of(run_scan(records(spark, more), ignored=entries)) == [(1, 2), (4, 6)]
    changed = [r if r[0] != 4 else row(4, "活着 改", "余华", isbn="9787506365437") for r in more]
    assert ignore.live_entries(entries, records(spark, changed)).count() == 0
    assert ignore.add_ignored(entries, pair, prepared, "later").count() == 1
    assert ignore.remove_ignored(entries, pair).count() == 0 and ignore.remove_ignored(entries).count() == 0


def test_types_never_mix(spark):
    rows = [row(1, "甲书", isbn="9787506365437"), row(2, "甲书", isbn="9787506365437", kind="实体书")]
    prepared = catalog.prepare(records(spark, rows))
    assert C.candidate_pairs(prepared).count() == 0
    assert C.scan_stats(prepared).first()["skipped_cross_type"] == 1
    physical = [row(1, "活着", formats=(), kind="1"), row(2, "活着（精装）", formats=(), kind="true")]
    assert sets_of(run_scan(records(spark, physical))) == [(1, 2)]


def test_families_gate_isbn_only(spark):
    rows = [row(1, "x one", "a", ["epub"], "9787506365437"), row(2, "y two", "b", ["mp3"], "9787506365437")]
    assert C.candidate_pairs(catalog.prepare(records(spark, rows))).count() == 0


def test_bucket_cap_is_counted(spark):
    prepared = catalog.prepare(records(spark, [row(i, f"书名{chr(0x4E00 + i)}") for i in range(20)]))
    assert C.candidate_pairs(prepared, max_bucket=5).count() == 0
    stats = C.scan_stats(prepared, max_bucket=5).first()
    assert (stats["skipped_buckets"], stats["skipped_books"], stats["comparisons"]) == (1, 20, 0)


def test_large_blocks_are_compared(spark, tmp_path):
    """The registered queries over one source of more rows than the reference's cap of 3000."""
    from colophon.plans.queries import QUERIES

    digest = F.md5(F.col("id").cast("string").cast("binary"))
    near = F.md5(F.lit("near").cast("binary"))
    title = F.when(F.col("id").isin(1, 3000), "the same first line").when(F.col("id") == 2, near).when(F.col("id") == 2999, F.concat(near, F.lit("x"))).otherwise(digest)
    text = F.concat(title, F.lit("\n"), digest)
    docs = spark.range(3001).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src").alias("source"), F.length(text).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    assert {(r["a"], r["b"]) for r in QUERIES["candidate_pairs"](spark, str(tmp_path)).collect()} == {(1, 1), (2, 2999)}
    assert {(r["id"], r["group_id"]) for r in QUERIES["components"](spark, str(tmp_path)).collect()} == {(1, 1), (3000, 1), (2, 2), (2999, 2)}
    stats = QUERIES["scan_stats"](spark, str(tmp_path)).first()
    assert (stats["comparisons"], stats["skipped_buckets"], stats["skipped_books"]) == (3001 * 3000 // 2, 0, 0)


def test_left_out_pairs_are_counted(spark):
    rows = [*BASE, row(6, "活着", "余华"), row(7, "苗疆蛊事1", "南无"), row(8, "苗疆蛊事2", "南无"), row(9, "甲书", "丙"), row(10, "甲书", "丙", kind="实体书")]
    all_records = records(spark, rows)
    prepared = catalog.prepare(all_records)
    entries = ignore.add_ignored(spark.createDataFrame([], ignore.ENTRY), spark.createDataFrame([(4, 3), (1, 2), (1, 99)], "a long, b long"), prepared, "now")
    entries = entries.withColumn("a_sig", F.when(F.col("a") == 1, "other").otherwise(F.col("a_sig")))
    scan = run_scan(all_records, ignored=entries)
    stats = scan.stats().first()
    assert (stats["ignored_excluded"], stats["ignored_stale"], stats["threshold"]) == (1, 2, 0.85)
    total = G.report_summary(scan.report, scan.stats()).first()
    assert (total["serial_excluded"], total["cross_type_excluded"], total["ignored_excluded"], total["ignored_stale"]) == (1, 1, 1, 2)
    total = G.report_summary(scan.report, run_scan(all_records).stats()).first()
    assert (total["ignored_excluded"], total["ignored_stale"]) == (0, 0)


def test_no_author_is_one_block(spark):
    prepared = catalog.prepare(records(spark, [row(1, "same", None), row(2, "same", None)]))
    assert C.scan_stats(prepared).first()["comparisons"] == 1
    assert [(r["similarity"], r["n_pairs"]) for r in C.candidate_pairs(prepared).collect()] == [(1.0, 1)]
    assert [(r["a"], r["b"]) for r in C.record_pairs(prepared).collect()] == [(1, 2)]


def test_joins_equal_brute_force(spark):
    """The inverted-index joins find what scoring every pair finds, notes and volumes included."""
    from colophon.functions import text as T

    rng = random.Random(3)
    stems = ["三体", "苗疆蛊事", "the long road", "the long roads", "鲁迅全集", "活着的意义"]
    ends = ["", "1", "2", "（全本）", "（上）", "（修订版）", " vol.2", "（第一部 开端）", "(illustrated)"]
    rows = [row(i, rng.choice(stems) + rng.choice(ends), rng.choice("ab")) for i in range(60)]
    prepared = catalog.prepare(records(spark, rows)).cache()
    found = {(r["a"], r["b"]): round(r["similarity"], 9) for r in C.record_pairs(prepared, 0.6).collect()}
    l, r = (prepared.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "title_key", "title_core_key", "author_keys")]) for s in "lr")
    score = T.variant_score(F.col("title_key_l"), F.col("title_key_r"), F.col("title_core_key_l"), F.col("title_core_key_r"))
    every = l.join(r, F.col("id_l") < F.col("id_r")).filter(F.arrays_overlap("author_keys_l", "author_keys_r")).select("id_l", "id_r", score.alias("s"))
    every = {(x["id_l"], x["id_r"]): round(x["s"], 9) for x in every.collect() if x["s"] >= 0.6}
    assert found == every
    # links between classes stand for the same pairs
    links, classes = C.candidates(prepared, 0.6)
    of = {}
    for x in classes.filter("kind = 'title'").collect():
        of.setdefault(x["rep"], []).append(x["id"])
    stood = {}
    for x in links.collect():
        pairs = itertools.combinations(sorted(of[x["a"]]), 2) if x["a"] == x["b"] else ((min(p), max(p)) for p in itertools.product(of[x["a"]], of[x["b"]]))
        pairs = list(pairs)
        assert len(pairs) == x["n_pairs"]
        stood |= dict.fromkeys(pairs, round(x["similarity"], 9))
    assert stood == every


def test_links_count_isbns(spark):
    """How many pairs of a link share an ISBN, and how many have two that differ, from counts alone."""
    rng = random.Random(4)
    codes = ["", "9787506365437", "9787536692930", "0306406152"]
    rows = [row(i, rng.choice(["the long road", "the long roads"]), "a", rng.choice([["epub"], ["mp3"], ["epub", "mp3"], []]), rng.choice(codes), kind=rng.choice("001")) for i in range(60)]
    prepared = catalog.prepare(records(spark, rows)).cache()
    titles = C.title_classes(prepared)
    of = {r["id"]: r for r in titles.collect()}
    want = {}
    for x, y in itertools.combinations(sorted(of), 2):
        a, b = of[x], of[y]
        key = (min(a["rep"], b["rep"]), max(a["rep"], b["rep"]))
        coded = bool(a["isbn_key"] and b["isbn_key"])
        same = coded and a["isbn_key"] == b["isbn_key"]
        n, i, d = want.get(key, (0, 0, 0))
        want[key] = (n + 1, i + (same and bool(set(a["families"]) & set(b["families"]))), d + (coded and not same))
    links = C.title_links(titles, 0.8)
    assert {(r["a"], r["b"]): (r["n_pairs"], r["n_isbn"], r["n_differ"]) for r in links.collect()} == want
    shared = sum(len(set(p["families"]) & set(q["families"])) > 0 for p, q in itertools.combinations([r for r in of.values() if r["isbn_key"]], 2) if p["isbn_key"] == q["isbn_key"])
    assert C.isbn_links(C.isbn_classes(prepared)).agg(F.sum("n_pairs")).first()[0] == shared
    # every record alone: the same pairs, one by one
    listed = C.record_pairs(prepared, 0.8)
    total, classes = C.candidate_pairs(prepared, 0.8), listed.groupBy("reasons").count()
    assert listed.count() == total.agg(F.sum("n_pairs")).first()[0] and classes.count() >= 2


def test_a_large_group_of_copies(spark):
    """Ten thousand records of one ISBN and title, and a chain of near titles: linear work, one component each."""
    copies = spark.range(10_000).select(F.col("id"), F.lit("the same long title").alias("title"), F.array(F.lit("a")).alias("authors"), F.array(F.lit("EPUB")).alias("formats"), F.lit("9787506365437").alias("isbn"))
    scan = run_scan(catalog.load_records(copies))
    assert scan.pairs.count() == 1 and scan.pairs.first()["n_pairs"] == 10_000 * 9_999 // 2
    only = scan.report.first()
    assert (only["member_count"], only["index"], only["group_id"]) == (10_000, 0, 0)
    star = spark.range(1, 10_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(20_000, 20_300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = connected_components(star.union(chain)).groupBy("component").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, 10_000), (20_000, 301)]


def test_places_of_many_groups(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 3]), rng.choice([2, 2, 2, 3]), rng.choice([0.9123, 0.95, 1.0])) for i in range(500)]
    got = {r["group_id"]: r["index"] for r in G.with_index(spark.createDataFrame(rows, "group_id long, rank int, member_count long, max_similarity double")).collect()}
    order = sorted(rows, key=lambda r: (-r[1], -r[2], -r[3], r[0]))
    assert got == {r[0]: i for i, r in enumerate(order)}


def test_rounding_as_the_language_does(spark):
    from colophon.functions.metadata import rounded4

    rng = random.Random(7)
    values = [2 * k / m for m in (32, 160, 800, 4000, 20_000, 7, 13) for k in range(1, m // 2)][::3] + [rng.random() for _ in range(2000)] + [0.0, 1.0, 0.94995]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", rounded4(F.col("x")).alias("y")).collect()
    assert all(r["y"] == round(r["x"], 4) for r in got)


@pytest.mark.parametrize(("value", "kind", "want"), [(1.0, "double", 1), (2, "int", 1), (0, "int", 0), (True, "boolean", 1), (" 1 ", "string", 1), ("2", "string", 0), (None, "int", 0)])
def test_book_types(spark, value, kind, want):
    raw = spark.createDataFrame([(1, value)], f"id long, `#book_type` {kind}")
    assert catalog.load_records(raw).first()["book_type"] == want
    both = spark.createDataFrame([(1, value, 1)], f"id long, `#book_type` {kind}, book_type int")
    assert catalog.load_records(both).first()["book_type"] == (1 if value is None else want)


def test_host_names_fall_back(spark):
    raw = spark.createDataFrame([(1, [], "b", None, "t"), (2, ["a"], "b", ["x"], "t"), (3, None, None, [], None)], "id long, authors array<string>, author string, tags array<string>, tag string")
    got = {r["id"]: (r["authors"], r["tags"]) for r in catalog.load_records(raw).collect()}
    assert got == {1: (["b"], ["t"]), 2: (["a"], ["x"]), 3: ([], [])}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in rows} == {x: find(x) for x in parent}


def test_contraction_shrinks(spark):
    """A million ids around a hub that isn't the smallest, chains in order, and loops: rounds have fewer and fewer edges; their tables go."""
    import os

    home = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    hub = spark.range(1_000_000).filter("id <> 777").select(F.lit(777).cast("long").alias("a"), F.col("id").alias("b"))
    chains = spark.range(2_000_000, 2_004_000).filter("id % 500 <> 499").select("id", F.col("id") + 1)
    loops = spark.range(3_000_000, 3_000_010).select("id", F.col("id"))
    left, before = [], set(os.listdir(home))
    found = connected_components(hub.union(chains).union(loops), left)
    got = {r["component"]: r["count"] for r in found.groupBy("component").count().collect()}
    assert got == {0: 1_000_000} | {2_000_000 + 500 * i: 500 for i in range(8)} | {3_000_000 + i: 1 for i in range(10)}
    assert left[1] <= 4000 and left == sorted(left, reverse=True) and left[-1] == 0 and len(left) < 24
    assert {name.partition("-")[0] for name in set(os.listdir(home)) - before} == {"components"}
    assert connected_components(hub.limit(0)).count() == 0


def test_rules_and_manual(base, spark):
    keep = lambda rule: {r["group_id"]: r["keeper_id"] for r in G.keepers(base.members, rule).collect()}
    assert keep("oldest")[1] == 1 and keep("newest")[1] == 2 and keep("size")[3] == 4
    assert keep("nonsense") == keep("metadata")
    manual = spark.createDataFrame([(1, 2), (3, 99)], "group_id long, manual_id long")
    rows = {r["group_id"]: (r["keeper_id"], r["rule"]) for r in G.keepers(base.members, "size", manual).collect()}
    assert rows == {1: (2, "manual"), 3: (4, "size")}


def test_merge_is_a_transition(base, spark):
    keep = spark.createDataFrame([(1, 1)], "group_id long, keeper_id long")
    plan = ledger.merge_plan(base.members, keep)
    step = plan.first()
    assert (step["source_id"], step["moved_formats"], step["dropped_formats"]) == (2, ["PDF"], ["EPUB"])
    after = {r["id"]: r["formats"] for r in ledger.apply_merge(base.records, plan).collect()}
    assert 2 not in after and after[1] == ["EPUB", "MOBI", "PDF"]
    failed = spark.createDataFrame([(2,)], "source_id long")
    assert ledger.apply_merge(base.records, plan, failed).count() == 5
    merged = ledger.merge_ledger(plan, base.report, "now")
    gone = ledger.gone_ids(merged, spark.createDataFrame([(0,)], "id long"))
    assert [r["id"] for r in gone.collect()] == [2]
    assert [r["title"] for r in ledger.removed_titles(merged).collect()] == ["三体（全集）"]
    assert ledger.failed_titles(merged).count() == 0
    empty = spark.createDataFrame([], ignore.ENTRY)
    assert [r["group_id"] for r in views.visible_groups(base.report, gone, empty).collect()] == [3]


@pytest.mark.parametrize(
    ("keeper", "sources", "error"),
    [(1, None, None), (9, None, "keeper.not_in_group"), (1, [], "merge.nothing"), (1, [1], "source.is_keeper"), (1, [7], "source.not_in_group"), (1, [True], "params.invalid")],
)
def test_plan_errors(base, keeper, sources, error):
    assert ledger.plan_errors(base.members.filter("group_id = 1"), keeper, sources) == error


def test_pages_and_search(base):
    assert views.page_of(base.report, "x", "y").count() == 2
    assert [r["group_id"] for r in views.page_of(base.report, 1, 1).collect()] == [1]
    assert [r["group_id"] for r in views.by_keyword(base.report, "LIVE").collect()] == [3]
    assert views.by_confidence(base.report, "weak").count() == 0
    assert views.by_confidence(base.report, None).count() == 2


def test_member_table(base, spark, tmp_path):
    """Views over a member table are those over nested entries."""
    slim = G.slim_report(base.members, base.pairs)
    catalog.write_members(G.member_rows(base.members, slim), f"{tmp_path}/members")
    rows = catalog.read_members(spark, f"{tmp_path}/members")
    gone, none = spark.createDataFrame([(4,)], "id long"), spark.createDataFrame([], "a long, b long")
    for left in (gone, gone.limit(0)):
        nested = views.visible_groups(base.report, left, none).drop("entries")
        assert sorted(map(str, views.visible_groups(slim, left, none, rows).select(*nested.columns).collect())) == sorted(map(str, nested.collect()))
        for mine, its in zip(views.group_detail(slim, left, none, members=rows), views.group_detail(base.report, left, none), strict=True):
            assert sorted(map(str, mine.collect())) == sorted(map(str, its.select(*mine.columns).collect()))


def test_members_of_a_large_group(spark, tmp_path):
    """One group of 300,000 members: no task holds it, and a page of it reads few of its rows."""
    n = 300_000
    raw = spark.range(n).select("id", F.lit("one title").alias("title"), F.array(F.lit("a")).alias("authors"), (F.col("id") % 100).alias("size"), F.array(F.lit("EPUB")).alias("formats"))
    members = catalog.prepare(catalog.load_records(raw)).withColumn("group_id", F.lit(0).cast("long"))
    report = spark.createDataFrame([(0, 0, 99)], "index long, group_id long, keeper_id long")
    rows = G.member_rows(members, report)
    catalog.write_members(rows, f"{tmp_path}/members")
    page = catalog.read_members(spark, f"{tmp_path}/members", 0, after=150_000, size=50)
    assert [r["id"] for r in page.collect()] == list(range(150_001, 150_051))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,150000)" in plan and "EqualTo(index,0)" in plan
    first = G.first_members(catalog.read_members(spark, f"{tmp_path}/members"))
    assert [e["id"] for e in first.first()["first"]] == [0, 1] and "collect_list" not in first._jdf.queryExecution().toString()
    assert catalog.read_members(spark, f"{tmp_path}/members", 7).count() == 0


def test_sink_and_source(base, spark, tmp_path):
    for form in ("parquet", "json"):
        catalog.write_report(base.report, f"{tmp_path}/{form}", form)
        assert catalog.read_report(spark, f"{tmp_path}/{form}", form, index=1).first()["group_id"] == 1


def test_link_tables(spark):
    books = spark.createDataFrame([(1, "x"), (2, "y")], "id long, title string")
    authors = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "book long, link_id long, name string")
    files = spark.createDataFrame([(1, "epub", "x", 5), (1, "pdf", "x", 7)], "book long, format string, name string, size long")
    rows = {r["id"]: r for r in catalog.load_records(catalog.library_records(books, {"authors": authors}, files)).collect()}
    assert (rows[1]["authors"], rows[1]["formats"], rows[1]["size"]) == (["a", "b"], ["EPUB", "PDF"], 12)
    assert (rows[2]["authors"], rows[2]["formats"], rows[2]["size"]) == ([], [], 0)


def test_empty_catalog(spark):
    scan = run_scan(records(spark, []))
    assert scan.report.count() == 0
    assert G.report_summary(scan.report).first()["group_count"] == 0


def test_stream(spark, tmp_path):
    raw = spark.createDataFrame(BASE, SCHEMA)
    raw.filter("id <= 3").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    args = (f"{tmp_path}/known", f"{tmp_path}/matches", f"{tmp_path}/checkpoint")
    incremental.watch(stream(), *args).awaitTermination()
    raw.filter("id > 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    incremental.watch(stream(), *args).awaitTermination()
    found = {(r["id"], r["match_id"]) for r in spark.read.parquet(args[1]).collect()}
    assert found == {(4, 3)}


def test_all_pairs_of_a_group(spark):
    members = spark.createDataFrame([(1, i) for i in range(5)], "group_id long, id long")
    assert {(r["a"], r["b"]) for r in ignore.pairs_in(members).collect()} == set(itertools.combinations(range(5), 2))


def test_step_codes(spark):
    now = spark.createDataFrame([(1, ["EPUB"]), (2, ["PDF"]), (3, ["EPUB"])], "id long, formats array<string>")
    steps = spark.createDataFrame([(2, 1), (3, 1), (1, 1), (9, 1), (2, 8)], "source_id long, target_id long")
    got = sorted((r["source_id"], r["target_id"], r["error"], r["note"]) for r in ledger.step_status(steps, now).collect())
    assert got == [(1, 1, "merge.same_book", None), (2, 1, None, None), (2, 8, "merge.target_missing", None), (3, 1, None, "no_new_formats"), (9, 1, "merge.source_missing", None)]
    copied = spark.createDataFrame([(2, False)], "source_id long, ok boolean")
    failed = ledger.step_status(steps.filter("source_id = 2 AND target_id = 1"), now, copied)
    assert failed.first()["error"] == "merge.copy_failed"
    assert ledger.merge_outcome(failed).first()["err"] == "merge.failed"
    assert ledger.merge_outcome(ledger.step_status(steps.filter("source_id = 9"), now)).first()["err"] == "group.already_merged"


def test_marker(spark, tmp_path):
    catalog.write_latest(spark, f"{tmp_path}/m", "t1", "now", "/reports/1", 7)
    assert catalog.latest_report(spark, f"{tmp_path}/m", "t1", "now").first()["group_count"] == 7
    assert catalog.latest_report(spark, f"{tmp_path}/m", "t2").count() == 0


def test_scan_limit_and_subset(spark):
    raw = spark.createDataFrame(BASE, SCHEMA)
    assert [r["id"] for r in catalog.load_records(raw, most=2).collect()] == [1, 2]
    ids = spark.createDataFrame([(5,), (5,), (77,)], "id long")
    assert [r["id"] for r in catalog.load_records(raw, ids).collect()] == [5]


def test_tasks(spark, tmp_path):
    """One scan at a time, its progress, its pointer after a restart, and what is refused."""
    from colophon.plans.tasks import Refused, Tasks, scope

    raw = spark.createDataFrame(BASE, SCHEMA)
    assert scope(records(spark, BASE))["total_books"] == 5
    tasks = Tasks(spark, str(tmp_path))
    for call in (tasks.progress, tasks.cancel, lambda: tasks.start(raw, [True])):
        with pytest.raises(Refused):
            call()
    task = tasks.start(raw, [1, 2, 5], threshold=85)
    with pytest.raises(Refused, match="task.running"):
        tasks.start(raw)
    task.thread.join()
    assert tasks.progress()["status"] == "completed" and task.summary["group_count"] == 1 and task.threshold == 0.85
    again = Tasks(spark, str(tmp_path)).progress()
    assert again["restored"] and again["task_id"] == task.task_id and again["summary"]["group_count"] == 1
    none = tasks.start(raw, [77])
    none.thread.join()
    assert (none.status, none.error) == ("failed", "scope.empty")
    other = tasks.start(raw)
    tasks.cancel()
    other.thread.join()
    assert other.status in ("cancelled", "completed")


def test_group_detail(base, spark):
    entries = spark.createDataFrame([], ignore.ENTRY)
    gone = spark.createDataFrame([(4,)], "id long")
    groups, rows = views.group_detail(base.report, gone, entries, "newest")
    got = {r["group_id"]: r for r in groups.collect()}
    assert (got[1]["keeper_id"], got[1]["rule"], got[1]["members"]) == (2, "newest", [1, 2])
    assert (got[3]["keeper_id"], got[3]["members"], got[3]["member_count"]) == (3, [3], 1)
    cells = {(r["group_id"], r["field"]): r for r in rows.collect()}
    assert not any(g == 3 for g, _ in cells) and cells[(1, "size")]["label"] == "体积" and len(cells[(1, "size")]["cells"]) == 2
    one, _ = views.group_detail(base.report, gone, entries, index=0)
    assert [r["group_id"] for r in one.collect()] == [3]
    assert base.report.first()["protected"] == [] and {r["confidence_label"] for r in base.report.collect()} <= {"确定", "很可能", "存疑"}


def test_request_errors_agree_with_one_by_one(base, spark):
    cases = [(1, None), (9, None), (1, []), (1, [1]), (1, [7]), (1, [2]), (2, None)]
    live = base.members.filter("id <> 2")
    for now in (base.members, live):
        requests = spark.createDataFrame([(n, 1, k, s) for n, (k, s) in enumerate(cases)], "request long, group_id long, keeper_id long, source_ids array<long>")
        got = {r["request"]: r["error"] for r in ledger.request_errors(requests, base.members, now).collect()}
        group = lambda f: f.filter("group_id = 1")
        assert got == {n: ledger.plan_errors(group(now), k, s, group(base.members)) for n, (k, s) in enumerate(cases)}


def test_ignore_whole_groups(base, spark):
    entries, gone = spark.createDataFrame([], ignore.ENTRY), spark.createDataFrame([], "id long")
    indexes = spark.createDataFrame([(0,), (0,), (9,)], "index long")
    new, counts = ignore.ignore_groups(entries, base.report, gone, indexes, base.records, "now")
    assert [(r["a"], r["b"]) for r in new.collect()] == [(3, 4)]
    assert tuple(counts.first()) == (1, 1, 1)
    assert tuple(ignore.ignore_groups(new, base.report, gone, indexes, base.records, "later")[1].first()) == (0, 1, 1)
    assert tuple(ignore.ignore_groups(entries, base.report, gone, indexes.filter("index > 5"), base.records, "now")[1].first()) == (0, 0, 1)


def test_dismissing_a_group_of_any_size_counts_without_pairs(base, spark):
    """200,000 members are twenty billion pairs: their number comes from the group's size and the dismissed pairs in it."""
    n = 200_000
    report = spark.range(n).groupBy().agg(F.collect_list("id").alias("members")).selectExpr("0L AS index", "5L AS group_id", "members")
    entries = spark.createDataFrame([(1, 2), (9, 3), (3, 9), (4, n + 1)], "a long, b long").selectExpr("a", "b", *[f"'' AS {c}" for c in ("at", "a_title", "b_title", "a_sig", "b_sig")])
    counts = ignore.ignore_groups(entries, report, spark.range(1).toDF("id"), spark.range(1).toDF("index"), base.records, "now")[1]
    assert tuple(counts.first()) == ((n - 1) * (n - 2) // 2 - 2, 1, 0)


def test_tables_that_grow_are_not_broadcast(base, spark):
    """Spark broadcasts what has small files, as these have; only a row for each partition or block may be."""
    import re

    joins = lambda f: re.findall(r"(SortMerge|BroadcastHash|BroadcastNestedLoop)Join(?: \[(\w+)#)?", f._jdf.queryExecution().executedPlan().toString())
    texts = spark.createDataFrame([(i, "b", 3, f"a title {i}") for i in range(9)], "tid long, block string, n int, text string")
    frames = [
        C.near_texts(texts, 0.85), C.title_links(C.title_classes(base.records)), C.isbn_links(C.isbn_classes(base.records)),
        base.report, G.diff_rows(base.members), G.keeper_reasons(base.members), ignore.group_counts(base.members, spark.createDataFrame([], ignore.ENTRY)),
        ledger.merge_plan(base.members, G.keepers(base.members)),
    ]
    for found in map(joins, frames):
        assert ("SortMerge" in {kind for kind, _ in found}) and all(kind == "SortMerge" or key in ("__part", "block") for kind, key in found)


def test_long_texts_that_are_unlike_are_ruled_out_by_their_sketches(spark):
    """Sets of very many grams fill the small sketch; all pairs with a rare gram in common were sent whole sets."""
    import random

    r = random.Random(5)
    base = [f"{i:05x}"[-3:] + "\x001" for i in range(4000)]
    mixed = lambda share: [g if r.random() < share else f"{g}{r.random()}" for g in base]
    rows = [(i, len(base), mixed(0.97 if i < 3 else 0.7)) for i in range(12)] + [(12, 9, base[:9]), (13, 9, base[9:18])]
    sets = spark.createDataFrame(rows, "tid long, m int, grams array<string>")
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0]]
    found = {tuple(x) for x in C._possible(spark.createDataFrame(pairs, "tid_a long, tid_b long"), sets, 0.85).collect()}
    dice = lambda a, b: 2 * len({*rows[a][2]} & {*rows[b][2]}) / (rows[a][1] + rows[b][1])
    near = {p for p in pairs if dice(*p) >= 0.85}
    assert {(0, 1), (0, 2), (1, 2)} <= near <= found
    assert len({p for p in found if max(p) < 12} - near) < 10
    # sets of few grams are left to the small sketch
    assert all(p in found for p in pairs if p[1] >= 12)


def test_pairs_of_a_large_group_are_made_by_many_tasks(spark):
    members = spark.range(3000).selectExpr("if(id < 2500, 0L, 1L) AS group_id", "id").union(spark.range(5000, 5003).selectExpr("2L", "id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = ignore.pairs_in(members).groupBy("group_id", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_if(F.col("a") < F.col("b")).alias("ordered"), F.count_distinct("a", "b").alias("different")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    found = {g: sum(r["n"] for r in made if r["group_id"] == g) for g in range(3)}
    assert found == {0: 2500 * 2499 // 2, 1: 500 * 499 // 2, 2: 3}
    assert all(r["n"] == r["ordered"] == r["different"] for r in made)
    assert max(r["n"] for r in made if r["group_id"] == 0) < 0.8 * found[0]


def _dice(a, b, n):
    from collections import Counter

    ga, gb = (Counter([t] if len(t) < n else [t[i : i + n] for i in range(len(t) - n + 1)]) for t in (a, b))
    return 2.0 * sum((ga & gb).values()) / (sum(ga.values()) + sum(gb.values()))


def _texts_of_few_words(r, length, n):
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    return ["".join(r.choice(words) for _ in range(length)) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.6, 0.85, 1.0])
def test_near_texts_equal_brute_force(spark, threshold):
    """Short texts, repeats, letters beyond the first plane, and long texts whose sets are dealt into parts, on both sides of a halving."""
    r = random.Random(int(threshold * 100))
    texts = ["a", "ab", "abc", "abcd", "aaaa", "aaaaaaaaaa", "aaaaaaaaaaa", "三体全集", "三体全", "𠀀𠀁𠀂𠀃", "𠀀𠀁𠀂𠀄", "\x00ab", "ab\x00ab", "aabaacaa", "aacaabaa"]
    for length in (4, 12, 50, 90, 115, 230, 460):
        for base in _texts_of_few_words(r, length, 4):
            cut = max(1, len(base) // r.choice((5, 8, 20, 60)))
            texts += [base, base[cut:], base[:-cut] + base[:cut], base + base[:cut]]
    rows = [(i, block, n, t) for i, (block, n, t) in enumerate((b, n, t) for b, n, every in (("x", 3, texts), ("x", 2, texts[:60]), ("y", 3, texts[::7])) for t in every)]
    near = {(a[0], b[0]): d for a, b in itertools.combinations(rows, 2) if a[1:3] == b[1:3] and (d := _dice(a[3], b[3], a[2])) >= threshold - 1e-9}
    assert len(near) > (0 if threshold == 1 else 100)
    found = C.near_texts(spark.createDataFrame(rows, "tid long, block string, n int, text string"), threshold).collect()
    assert {(x["tid_a"], x["tid_b"]): x["dice"] for x in found} == near and len(found) == len(near)


def test_long_texts_that_are_unlike_do_not_meet(spark):
    """Long texts of one vocabulary have rare tokens in common and fill a small sketch: nearly all of their pairs were moved to be held against the wide one."""
    r = random.Random(3)
    texts = _texts_of_few_words(r, 700, 60)
    texts += [t[100:] for t in texts[:5]]
    sets = C.S.gram_sets(spark.createDataFrame([(i, "b", 3, t) for i, t in enumerate(texts)], "tid long, block string, n int, text string"), lambda m: C._at_least(m, 0.85))
    found = {tuple(x) for x in C._found(sets, 0.85).collect()}
    assert {(i, 60 + i) for i in range(5)} <= found and len(found) < 30  # of 2080
    assert all(x["size"] < 4 * C.S.PART for x in sets.select("size").collect())


def test_the_pairing_deletes_its_tables(spark, base):
    """Texts and their grams stayed in the shared folder until it was cleared."""
    from pathlib import Path

    from colophon.operators.components import shared_home

    there = lambda: {p.name for p in Path(shared_home(spark).removeprefix("file:")).iterdir()}
    before = there()
    links = C.title_links(C.title_classes(base.records))
    assert not {n for n in there() - before if n.startswith(("texts", "grams"))}
    assert links.count() > 0


def test_a_scan_pairs_once(base, spark, monkeypatch):
    """What a scan left out was counted by pairing all its titles anew."""
    dismissed = ignore.add_ignored(spark.createDataFrame([], ignore.ENTRY), spark.createDataFrame([(1, 2)], "a long, b long"), base.records, "now")
    again = run_scan(records(spark, BASE), ignored=dismissed)
    wanted = C.scan_stats(base.records).first().asDict()
    monkeypatch.setattr(C, "title_links", None)
    assert wanted.items() <= base.stats().first().asDict().items() and wanted.items() <= again.stats().first().asDict().items()
