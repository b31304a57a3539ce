"""The list of dismissed pairs: anti-joins, liveness and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.functions.metadata import signature
from colophon.operators.components import by_shuffle

MOST_GROUPS = 10_000
#: Members of a part of a group: pairs are listed by two parts at a time.
PART = 1000
ENTRY = "a bigint, b bigint, at string, a_title string, b_title string, a_sig string, b_sig string"


def canonical(entries: DataFrame) -> DataFrame:
    """The entries with the smaller id first."""
    swap = F.col("a") > F.col("b")
    out = {}
    for x, y in (("a", "b"), ("a_title", "b_title"), ("a_sig", "b_sig")):
        if x in entries.columns:
            out |= {x: F.when(swap, F.col(y)).otherwise(F.col(x)), y: F.when(swap, F.col(x)).otherwise(F.col(y))}
    return entries.withColumns(out)


def signatures(records: DataFrame) -> DataFrame:
    return records.select("id", "title", signature(F.col("title"), F.col("authors"), F.col("size")).alias("sig"))


def live_entries(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Entries whose records both exist and look as they did; one without signatures only needs the records."""
    sigs = signatures(records)
    a, b = sigs.select(F.col("id").alias("a"), F.col("sig").alias("now_a")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("now_b"))
    same = lambda old, now: F.coalesce(F.col(old) == F.col(now), F.lit(True))
    return canonical(entries).join(by_shuffle(a), "a").join(by_shuffle(b), "b").filter(same("a_sig", "now_a") & same("b_sig", "now_b")).select(*entries.columns)


def filter_pairs(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """The pairs that are not dismissed."""
    return pairs.join(by_shuffle(canonical(entries).select("a", "b").distinct()), ["a", "b"], "left_anti")


def dismissed_pairs(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    return pairs.join(by_shuffle(canonical(entries).select("a", "b").distinct()), ["a", "b"], "left_semi")


def pairs_in(members: DataFrame) -> DataFrame:
    """All pairs a < b of each group: what dismissing a whole group means.

    A group is dealt into parts of some PART members, and two parts (or one with itself) meet under a key of their own, so that a
    large group's pairs are made by many tasks.
    """
    parts = members.groupBy("group_id").agg(F.ceil(F.count("*") / PART).alias("parts"))
    each = members.join(by_shuffle(parts), "group_id").select("group_id", "id", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    left = each.select("group_id", F.col("id").alias("x"), F.col("part").alias("p"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("q"))
    right = each.select("group_id", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), "part")).alias("p"), F.col("part").alias("q"))
    met = left.join(by_shuffle(right), ["group_id", "p", "q"]).filter("x <> y AND (p < q OR x < y)")
    return met.select("group_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def group_counts(members: DataFrame, entries: DataFrame) -> DataFrame:
    """group_id, pairs, ignored: from group sizes and a join of the entries, without listing pairs."""
    sizes = members.groupBy("group_id").agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("pairs"))
    of = members.select("group_id", "id")
    hit = canonical(entries).select("a", "b").distinct().join(by_shuffle(of.withColumnRenamed("id", "a")), "a").join(by_shuffle(of.toDF("g", "b")), "b").filter("group_id = g")
    return sizes.join(by_shuffle(hit.groupBy("group_id").agg(F.count("*").alias("ignored"))), "group_id", "left").select("group_id", "pairs", F.coalesce("ignored", F.lit(0)).alias("ignored"))


def add_ignored(entries: DataFrame, pairs: DataFrame, records: DataFrame, at: str) -> DataFrame:
    """The list with the pairs appended, each once."""
    sigs = signatures(records)
    a = sigs.select(F.col("id").alias("a"), F.col("title").alias("a_title"), F.col("sig").alias("a_sig"))
    b = sigs.select(F.col("id").alias("b"), F.col("title").alias("b_title"), F.col("sig").alias("b_sig"))
    new = canonical(pairs.select("a", "b")).distinct().filter("a <> b").join(by_shuffle(canonical(entries).select("a", "b")), ["a", "b"], "left_anti")
    rows = new.join(by_shuffle(a), "a", "left").join(by_shuffle(b), "b", "left").withColumn("at", F.lit(at))
    return entries.unionByName(rows.select(*entries.columns))


def ignore_groups(entries: DataFrame, report: DataFrame, gone: DataFrame, indexes: DataFrame, records: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(the list with all pairs of the groups at the indexes, one row of counts: added, groups, skipped).

    The counts come from group sizes and the entries inside the groups; pairs are listed only where the list is read.

    Groups that are not in the report, or have fewer than two members left, are skipped; pairs never cross groups. More
    than MOST_GROUPS indexes are refused.
    """
    asked = indexes.select("index").distinct()
    if asked.count() > MOST_GROUPS:
        raise ValueError("limit.exceeded")
    each = report.join(asked, "index").select("group_id", F.explode("members").alias("id"))
    live = each.join(by_shuffle(gone.select("id").distinct()), "id", "left_anti")
    enough = live.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1")
    whole = live.join(by_shuffle(enough.select("group_id")), "group_id", "left_semi")
    new = add_ignored(entries, pairs_in(whole), records, at)
    one = lambda f, *values: f.agg(*values).withColumn("one", F.lit(1))
    sums = one(group_counts(whole, entries), F.coalesce(F.sum(F.col("pairs") - F.col("ignored")), F.lit(0)).cast("long").alias("added"), F.count("*").alias("groups"))
    counts = sums.join(one(asked, F.count("*").alias("asked")), "one")
    return new, counts.select("added", "groups", (F.col("asked") - F.col("groups")).alias("skipped"))


def remove_ignored(entries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The list without the pairs; without any if none are named."""
    return entries.limit(0) if pairs is None else entries.join(by_shuffle(canonical(pairs.select("a", "b"))), ["a", "b"], "left_anti").select(*entries.columns)


def ignored_rows(entries: DataFrame, page: int = 0, size: int = 50) -> DataFrame:
    """One page of the list, newest first."""
    return entries.orderBy(F.desc("at"), F.desc("a"), F.desc("b")).offset(page * size).limit(size)
