"""List views over a report: visibility, filters, search and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.text import grams
from colophon.operators.components import by_shuffle
from colophon.operators.groups import PREVIEW, diff_rows, diff_summary, first_members, keeper_reasons, keepers
from colophon.operators.ignore import group_counts

MOST_PAGE = 10_000
#: Characters of a gram, and buckets of the grams, in a search index.
GRAM, BUCKETS = 3, 64


def _each(report: DataFrame, members: DataFrame | None) -> DataFrame:
    """group_id, index, keeper_id and e of the members of a report's groups: its entries, or the rows of a member table."""
    if members is None:
        return report.select("group_id", "index", "keeper_id", F.explode("entries").alias("e"))
    return members.select("group_id", "e").join(by_shuffle(report.select("group_id", "index", "keeper_id")), "group_id")


def visible_groups(report: DataFrame, gone: DataFrame, entries: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Groups with two members left that are not dismissed altogether, recomputed from the members left.

    Byte counts are recomputed while the keeper is left, else they stay. members: the member table of a slim report.
    """
    each = _each(report, members).drop("index")
    live = each.join(by_shuffle(gone.select(F.col("id").alias("gone_id")).distinct()), F.col("e.id") == F.col("gone_id"), "left_anti")
    kept = live.filter("e.id = keeper_id").select(F.col("group_id").alias("g"), F.col("e.formats").alias("kept_formats"))
    other = F.col("e.id") != F.col("keeper_id")
    contained = (F.size("e.formats") > 0) & (F.size(F.array_except("e.formats", "kept_formats")) == 0)
    now = live.join(by_shuffle(kept), F.col("group_id") == F.col("g"), "left").groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.count("g").alias("k"),
        F.sum(F.when(other, F.col("e.size")).otherwise(0)).alias("reclaim"),
        F.sum(F.when(other & contained, F.col("e.size")).otherwise(0)).alias("waste"),
    )
    counts = group_counts(live.select("group_id", F.col("e.id").alias("id")), entries)
    rows = report.join(by_shuffle(now), "group_id").join(by_shuffle(counts), "group_id").filter("n >= 2 AND ignored < pairs").join(by_shuffle(first_members(live)), "group_id")
    new = {
        "stale_count": F.col("member_count") - F.col("n"),
        "ignored_pairs": F.col("ignored"),
        "titles": F.transform("first", lambda e: e["title"]),
        "authors": F.transform("first", lambda e: e["author"]),
        "preview_truncated": F.col("n") > PREVIEW,
        "live_count": F.col("n"),
        "reclaimable_bytes": F.when(F.col("k") > 0, F.col("reclaim")).otherwise(F.col("reclaimable_bytes")),
        "disk_waste_bytes": F.when(F.col("k") > 0, F.col("waste")).otherwise(F.col("disk_waste_bytes")),
    }
    return rows.withColumns(new).drop("first", "n", "k", "reclaim", "waste", "pairs", "ignored")


def group_detail(report: DataFrame, gone: DataFrame, entries: DataFrame, rule: str | None = None, index: int | None = None, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, rows): each group, or the one at an index, by the members that are left, and its difference table.

    groups: group_id, index, members, member_count, ignored_pairs, keeper_id, rule, reasons, shared (fields that agree). With a rule,
    or where members are gone, keeper and differences are those of the members that are left.
    """
    chosen = report if index is None else report.filter(F.col("index") == index)
    each = _each(chosen, members).select("group_id", "index", "e.*")
    live = each.join(by_shuffle(gone.select("id").distinct()), "id", "left_anti")
    keep, why = keepers(live, rule or "metadata"), keeper_reasons(live, rule or "metadata")
    counts = group_counts(live.select("group_id", "id"), entries).select("group_id", F.col("ignored").alias("ignored_pairs"))
    now = live.groupBy("group_id", "index").agg(F.array_sort(F.collect_list("id")).alias("members"), F.count("*").alias("member_count"))
    shared = diff_summary(live).select("group_id", "shared")
    groups = now.join(by_shuffle(counts), "group_id").join(by_shuffle(keep), "group_id").join(by_shuffle(why.select("group_id", "reasons")), "group_id", "left").join(by_shuffle(shared), "group_id", "left")
    return groups, diff_rows(live)


def by_confidence(report: DataFrame, wanted: str | None) -> DataFrame:
    """Groups of the tiers in a comma-separated list; all without one."""
    return report.filter(F.col("confidence").isin(*wanted.split(","))) if wanted else report


def _sought(keyword: str | None) -> str:
    return (keyword or "").strip().lower()


def _said(entries: str = "entries") -> Column:
    """The titles and authors of all members of a group, in lower case: what is searched."""
    text = F.transform(entries, lambda e: F.concat_ws(" ", e["title"], F.array_join(e["authors"], " ")))
    return F.lower(F.array_join(text, " "))


def by_keyword(report: DataFrame, keyword: str | None, postings: DataFrame | None = None) -> DataFrame:
    """Groups with the keyword in the titles or authors of any member of the report, in any case.

    With postings only groups that have all of the keyword's grams are looked at; a keyword shorter than a gram
    is looked for in all groups.
    """
    sought = _sought(keyword)
    if not sought:
        return report
    if postings is not None and len(sought) >= GRAM:
        listed = sorted({sought[i : i + GRAM] for i in range(len(sought) - GRAM + 1)})
        buckets = F.array_distinct(F.transform(F.array(*map(F.lit, listed)), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS))))
        wanted = report.sparkSession.range(1).select(buckets.alias("b")).first()["b"]  # one number for each gram of the keyword
        found = postings.filter(F.col("bucket").isin(wanted) & F.col("gram").isin(listed)).groupBy("group_id").agg(F.count_distinct("gram").alias("n"))
        report = report.join(by_shuffle(found.filter(F.col("n") == len(listed)).select("group_id")), "group_id", "left_semi")
    return report.filter(_said().contains(sought))


def keyword_postings(report: DataFrame) -> DataFrame:
    """bucket, gram and group_id: in which groups each gram of titles and authors stands."""
    each = report.select("group_id", F.explode(F.array_distinct(grams(_said(), GRAM))).alias("gram"))
    return each.select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).alias("bucket"), "gram", "group_id")


def write_postings(report: DataFrame, path: str) -> None:
    """Writes the postings by bucket, sorted by gram: a keyword's are found in the buckets of its grams."""
    rows = keyword_postings(report)
    rows.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def groups_view(
    report: DataFrame, gone: DataFrame, entries: DataFrame, generated_at: str, confidence: str | None = None, keyword: str | None = None, page: object = 0, size: object = 50,
    postings: DataFrame | None = None,
) -> DataFrame:
    """A page of the list of groups: those still visible, of the tiers and with the keyword that are asked for, as they are now.

    Each row has total (groups that were found) and signature (of the whole report). A page beyond the end has no rows. The keyword is looked
    for in all members of the report, those that are gone included.
    """
    found = page_of(by_keyword(by_confidence(visible_groups(report, gone, entries), confidence), keyword, postings), page, size)
    # one row for the whole report
    return found.withColumn("one", F.lit(1)).join(F.broadcast(report_signature(report, generated_at).withColumn("one", F.lit(1))), "one").drop("one")


def page_of(report: DataFrame, page: object = 0, size: object = 50) -> DataFrame:
    """One page by index, with the number of rows before paging as `total`; bad numbers give the defaults."""

    def number(value: object, default: int, low: int, high: int) -> int:
        try:
            return min(high, max(low, int(value)))  # type: ignore[call-overload]
        except (TypeError, ValueError):
            return default

    p, s = number(page, 0, 0, 2**31 // MOST_PAGE), number(size, 50, 1, MOST_PAGE)
    total = report.agg(F.count("*").alias("total")).select(F.lit(1).alias("one"), "total")  # a single row
    return report.orderBy("index").offset(p * s).limit(s).withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")


def report_signature(report: DataFrame, generated_at: str) -> DataFrame:
    return report.agg(F.concat_ws("|", F.lit(generated_at), F.count("*").cast("string")).alias("signature"))
