"""Duplicate groups, keepers, differences and reports over catalog records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.functions import metadata as M
from colophon.operators.components import by_shuffle, connected_components, stage

RULES = ("metadata", "formats", "size", "oldest", "newest")
PREVIEW = 2
# The compared fields in order, what kind of value a cell holds, and which have a best member.
DIFF_FIELDS = ("size", "formats", "isbn", "metadata", "cover", "added", "rating", "tags", "series", "publisher", "languages", "translators", "collector", "sole", "book_type")
KINDS = {"size": "bytes", "metadata": "score", "rating": "rating", "cover": "bool", "sole": "bool", "book_type": "enum"}
BEST_FIELDS = ("size", "metadata", "formats", "rating", "tags", "cover")
DIFF_LABELS = dict(zip(DIFF_FIELDS, ("体积", "格式", "ISBN", "元数据", "封面", "入库时间", "评分", "标签", "系列", "出版社", "语言", "译者", "收藏者", "私有", "书目类型"), strict=True))
NONE_SHOWN = "—"
# what a report tells of a member besides id, title, author, authors, size, formats, meta_score and missing
MORE_FIELDS = ("added", "isbn", "isbn13", "isbn10", "comments_present", "tags", "series", "series_index", "publisher", "pubdate", "languages", "rating", "has_cover", "collector_id", "collector_name", "sole", "book_type", "translators")


def rank_of(reasons: Column) -> Column:
    """The rank of the strongest reason in a list."""
    out = F.lit(0)
    for name, rank in sorted(M.RANKS.items(), key=lambda x: x[1]):
        out = F.when(F.array_contains(reasons, name), rank).otherwise(out)
    return out


def group_members(records: DataFrame, links: DataFrame, classes: DataFrame) -> DataFrame:
    """group_id (smallest id) with the record of every member of a component of candidate links.

    links: kind, a, b; classes: kind, rep, id. All records of a linked class belong together.
    """
    linked = links.select("kind", F.col("a").alias("rep")).union(links.select("kind", "b")).distinct()
    inside = classes.join(by_shuffle(linked), ["kind", "rep"]).filter("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    edges = links.filter("a <> b").select("a", "b").union(inside)
    return connected_components(edges).withColumnRenamed("component", "group_id").join(by_shuffle(records), "id")


def group_summary(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each group, with its place in the report (index)."""
    of = members.select(F.col("id").alias("a"), "group_id")
    found = links.join(by_shuffle(of), "a").groupBy("group_id").agg(
        F.array_distinct(F.flatten(F.collect_set("reasons"))).alias("r"), M.rounded4(F.max("similarity")).alias("max_similarity")
    )
    order = F.transform(F.reverse(F.array_sort(F.transform("r", lambda x: F.struct(rank_of(F.array(x)).alias("k"), x.alias("x"))))), lambda s: s["x"])
    totals = members.groupBy("group_id").agg(
        F.array_sort(F.collect_set("id")).alias("members"),
        F.count("*").alias("member_count"),
        F.sum("size").alias("bytes_total"),
        F.max("size").alias("bytes_max"),
    )
    tier = M.confidence(rank_of(F.col("r")), F.col("max_similarity"))
    rows = totals.join(by_shuffle(found), "group_id").select(
        "group_id",
        "members",
        order.alias("reasons"),
        rank_of(F.col("r")).alias("rank"),
        "max_similarity",
        "member_count",
        "bytes_total",
        "bytes_max",
        (F.col("bytes_total") - F.col("bytes_max")).alias("bytes_over_max"),
        tier.alias("confidence"),
    )
    return with_index(rows)


def with_index(groups: DataFrame) -> DataFrame:
    """Adds index: the place by rank, size, similarity, then smallest id.

    The groups are range-partitioned by that order and written; a group's place is its partition's start (a sum
    over a row for each partition) and its place inside, which its row number has.
    """
    order = [F.desc("rank"), F.desc("member_count"), F.desc("max_similarity"), F.asc("group_id")]
    ordered = groups.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    placed = stage(ordered.withColumns({"__part": F.shiftright("__row", 33), "__at": F.col("__row").bitwiseAND((1 << 33) - 1)}), "ordered-groups")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    # a row for each partition of the range
    return placed.join(F.broadcast(starts), "__part").withColumn("index", (F.col("__start") + F.col("__at")).cast("long")).drop("__part", "__at", "__row", "__start")


def rule_order(rule: str) -> list[Column]:
    """The measures of a keep rule, the larger the better; the smallest id decides ties."""
    score, count, size = F.coalesce("meta_score", F.lit(0)), F.size("formats"), F.coalesce("size", F.lit(0))
    added = M.added_micros(F.col("added"))
    by = {
        "metadata": [score, count, size, -added],
        "formats": [count, score, size],
        "size": [size, score, count],
        "oldest": [-added, score],
        "newest": [added, score],
    }
    return [*by.get(rule, by["metadata"]), -F.col("id")]


def keepers(members: DataFrame, rule: str = "metadata", manual: DataFrame | None = None) -> DataFrame:
    """group_id, keeper_id, rule; manual(group_id, manual_id) comes first where that id is a member.

    The best member is an aggregate, so a group of any size is summed where its members are read.
    """
    chosen = F.lit(False)
    if manual is not None:
        members = members.join(by_shuffle(manual), "group_id", "left")
        chosen = F.coalesce(F.col("id") == F.col("manual_id"), F.lit(False))
    place = F.struct(chosen.alias("chosen"), *[c.alias(f"by{i}") for i, c in enumerate(rule_order(rule))])
    best = members.groupBy("group_id").agg(F.max(F.struct(place.alias("place"), "id")).alias("best"))
    used = rule if rule in RULES else "metadata"
    return best.select("group_id", F.col("best.id").alias("keeper_id"), F.when(F.col("best.place.chosen"), "manual").otherwise(used).alias("rule"))


def keeper_reasons(members: DataFrame, rule: str = "metadata") -> DataFrame:
    """group_id, keeper_id and reasons: in what the keeper is better than some other member."""
    keep = keepers(members, rule).select("group_id", "keeper_id")
    all_of = members.join(by_shuffle(keep), "group_id")
    other = F.col("id") != F.col("keeper_id")
    own = lambda c: F.max(F.when(~other, c))
    least = lambda c: F.min(F.when(other, c))
    has_isbn = (F.coalesce("isbn", F.lit("")) != "").cast("int")
    micros = M.added_micros(F.col("added"))
    rows = all_of.groupBy("group_id", "keeper_id").agg(
        own(F.col("meta_score")).alias("s"), least(F.col("meta_score")).alias("s0"), own(F.size("formats")).alias("f"), least(F.size("formats")).alias("f0"),
        own(F.col("size")).alias("z"), least(F.col("size")).alias("z0"), own(has_isbn).alias("i"), least(has_isbn).alias("i0"), own(micros).alias("t"),
    )
    better = lambda x: (F.col(x) > 0) & (F.col(f"{x}0") < F.col(x))
    timed = [F.when(F.col("t") != 0, rule)] if rule in ("newest", "oldest") else []
    codes = F.filter(F.array(*timed, F.when(better("s"), "metadata"), F.when(better("f"), "formats"), F.when(better("z"), "size"), F.when(better("i"), "isbn")), lambda x: x.isNotNull())
    return rows.select("group_id", "keeper_id", F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("added"))).alias("reasons"))


def group_bytes(members: DataFrame, keep: DataFrame) -> DataFrame:
    """group_id, keeper_id, reclaimable_bytes (all but the keeper), disk_waste_bytes (those whose formats the keeper has)."""
    kept = keep.join(by_shuffle(members.select(F.col("id").alias("keeper_id"), "group_id", F.col("formats").alias("kept_formats"))), ["group_id", "keeper_id"])
    rows = members.join(by_shuffle(kept.select("group_id", "keeper_id", "kept_formats")), "group_id")
    other = F.col("id") != F.col("keeper_id")
    contained = (F.size("formats") > 0) & (F.size(F.array_except("formats", "kept_formats")) == 0)
    return rows.groupBy("group_id", "keeper_id").agg(
        F.sum(F.when(other, F.col("size")).otherwise(0)).alias("reclaimable_bytes"), F.sum(F.when(other & contained, F.col("size")).otherwise(0)).alias("disk_waste_bytes")
    )


def _listed(c: str, order: bool) -> Column:
    values = F.array_sort(F.col(c)) if order else F.col(c)
    return F.when(F.size(F.col(c)) > 0, F.array_join(values, "、")).otherwise(NONE_SHOWN)


def _diff_values(shown: bool) -> dict[str, Column]:
    """Each field as text: what is compared, or what a cell shows."""
    text = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(NONE_SHOWN) if shown else F.coalesce(c, F.lit(""))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("string")
    code = F.coalesce(F.nullif("isbn", F.lit("")), F.nullif("isbn13", F.lit("")), F.nullif("isbn10", F.lit("")), F.lit(""))
    return {
        "size": F.col("size").cast("string"),
        "formats": _listed("formats", True),
        "isbn": text("isbn") if shown else code,
        "metadata": F.col("meta_score").cast("string"),
        "cover": flag("has_cover"),
        "added": F.when(F.col("added") != "", F.replace(F.substring("added", 1, 19), F.lit("T"), F.lit(" "))).otherwise(NONE_SHOWN) if shown else F.col("added"),
        "rating": F.col("rating").cast("int").cast("string") if shown else F.col("rating").cast("string"),
        "tags": _listed("tags", not shown),
        "series": text("series"),
        "publisher": text("publisher"),
        "languages": _listed("languages", not shown),
        "translators": _listed("translators", not shown),
        "collector": F.lit(NONE_SHOWN) if shown else F.coalesce(F.nullif("collector_name", F.lit("")), F.col("collector_id").cast("string"), F.lit("")),
        "sole": flag("sole"),
        "book_type": F.when(F.col("book_type") > 0, "1").otherwise("0"),
    }


def diff_cells(members: DataFrame) -> DataFrame:
    """group_id, field, id, compared, shown, kind and measure: a row for each member and field."""
    compared, shown = _diff_values(False), _diff_values(True)
    measure = {"size": F.col("size"), "metadata": F.col("meta_score"), "formats": F.size("formats"), "rating": F.col("rating"), "tags": F.size("tags"), "cover": F.col("has_cover").cast("int")}
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"), F.lit(f).alias("field"), compared[f].alias("compared"), shown[f].alias("shown"), F.lit(KINDS.get(f, "text")).alias("kind"),
                (measure[f].cast("double") if f in measure else F.lit(None).cast("double")).alias("measure"),
            )
            for i, f in enumerate(DIFF_FIELDS)
        ]
    )
    return members.select("group_id", "id", F.explode(cells).alias("c")).select("group_id", "id", "c.*")


def diff_fields(members: DataFrame) -> DataFrame:
    """group_id, field, place, shared and best_id (the only member with the highest measure; else null)."""
    cells = diff_cells(members)
    top = cells.groupBy("group_id", "field", "place").agg((F.min("compared") == F.max("compared")).alias("shared"), F.max("measure").alias("top"))
    holders = cells.filter("measure IS NOT NULL").groupBy("group_id", "field", "measure").agg(F.count("*").alias("n"), F.min("id").alias("holder"))
    held = holders.select(F.col("group_id").alias("g"), F.col("field").alias("f"), F.col("measure").alias("m"), "n", "holder")
    joined = top.join(by_shuffle(held), (F.col("group_id") == F.col("g")) & (F.col("field") == F.col("f")) & (F.col("top") == F.col("m")), "left")
    return joined.select("group_id", "field", "place", "shared", F.when(F.col("n") == 1, F.col("holder")).alias("best_id"))


def diff_rows(members: DataFrame) -> DataFrame:
    """group_id, field, best_id and cells (by id) of the fields that differ."""
    cells = diff_cells(members).groupBy("group_id", "field").agg(F.array_sort(F.collect_list(F.struct("id", "kind", "shown"))).alias("cells"))
    label = F.element_at(F.create_map(*[F.lit(x) for pair in DIFF_LABELS.items() for x in pair]), F.col("field"))
    return diff_fields(members).filter("NOT shared").join(by_shuffle(cells), ["group_id", "field"]).select("group_id", "field", label.alias("label"), "place", "best_id", "cells")


def diff_summary(members: DataFrame) -> DataFrame:
    """group_id, shared (field names in order) and summary: more than four are abbreviated to three."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "field"))), lambda s: s["field"])
    shared = diff_fields(members).filter("shared").groupBy("group_id").agg(names.alias("shared"))
    every = F.concat(F.lit("same: "), F.array_join("shared", ", "))
    short = F.concat(F.lit("same but for the rows below: "), F.array_join(F.slice("shared", 1, 3), ", "), F.lit(" and "), (F.size("shared") - 3).cast("string"), F.lit(" more"))
    return shared.select("group_id", "shared", F.when(F.size("shared") > 4, short).otherwise(every).alias("summary"))


def _member() -> Column:
    author = F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("author")
    return F.struct("id", "title", author, "authors", "size", F.array_sort("formats").alias("formats"), "meta_score", "missing", *MORE_FIELDS)


def slim_report(members: DataFrame, pairs: DataFrame, rule: str = "metadata") -> DataFrame:
    """Groups by index with keeper and byte counts, and of the members their ids only: `member_rows` has the rest."""
    label = F.element_at(F.create_map(*[F.lit(x) for pair in M.CONFIDENCE_LABELS.items() for x in pair]), F.col("confidence"))
    # no source tells of readers' data yet, so nothing is protected
    more = {"confidence_label": label, "protected": F.array().cast("array<bigint>")}
    return group_summary(members, pairs).join(by_shuffle(group_bytes(members, keepers(members, rule))), "group_id").withColumns(more)


def member_rows(members: DataFrame, report: DataFrame) -> DataFrame:
    """index, group_id, keeper_id and e (what a report tells of a member): a row for each member, so that a group of any size is many rows."""
    return members.select("group_id", _member().alias("e")).join(by_shuffle(report.select("index", "group_id", "keeper_id")), "group_id")


def first_members(rows: DataFrame) -> DataFrame:
    """group_id and first, the PREVIEW members with the smallest ids: minima, one after the other, so no group is listed."""
    found = rows.groupBy("group_id").agg(F.min("e").alias("e0"))
    for k in range(1, PREVIEW):
        rest = rows.select("group_id", "e").join(by_shuffle(found.select("group_id", F.col(f"e{k - 1}.id").alias("last"))), "group_id").filter("e.id > last")
        found = found.join(by_shuffle(rest.groupBy("group_id").agg(F.min("e").alias(f"e{k}"))), "group_id", "left")
    return found.select("group_id", F.array_compact(F.array(*[f"e{k}" for k in range(PREVIEW)])).alias("first"))


def build_report(members: DataFrame, pairs: DataFrame, rule: str = "metadata") -> DataFrame:
    """The slim report with all members of a group in its row (entries), for catalogs whose groups are small."""
    listed = members.groupBy("group_id").agg(F.array_sort(F.collect_list(_member())).alias("entries"))
    return slim_report(members, pairs, rule).join(by_shuffle(listed), "group_id")


def report_summary(report: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """One row of totals; with the stats of its scan, also how many pairs were left out and why."""
    totals = report.agg(
        F.count("*").alias("group_count"),
        F.coalesce(F.sum(F.col("member_count") - 1), F.lit(0)).alias("extra_copies"),
        F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"),
        F.coalesce(F.sum("disk_waste_bytes"), F.lit(0)).alias("disk_waste_bytes"),
        F.count_if(F.col("confidence") == "strong").alias("strong_groups"),
        F.count_if(F.col("confidence") == "weak").alias("weak_groups"),
    )
    if stats is None:
        return totals
    names = {"skipped_serial": "serial_excluded", "skipped_cross_type": "cross_type_excluded"}
    left_out = stats.select(*[F.col(c).alias(names.get(c, c)) for c in stats.columns], F.lit(1).alias("one"))
    return totals.withColumn("one", F.lit(1)).join(left_out, "one").drop("one")


def report_header(summary: DataFrame, generated_at: str, scope_note: str = "") -> DataFrame:
    """The summary with when and of what the report is."""
    return summary.withColumns({"generated_at": F.lit(generated_at), "scope_note": F.lit(scope_note)})


def index_preview(report: DataFrame) -> DataFrame:
    """The light projection for lists: the first two titles and authors, and whether there are more."""
    first = F.slice("entries", 1, PREVIEW)
    return report.select(
        "index", "group_id", "members", F.transform(first, lambda e: e["title"]).alias("titles"), F.transform(first, lambda e: e["author"]).alias("authors"),
        (F.size("entries") > PREVIEW).alias("preview_truncated"), "keeper_id", "confidence", "member_count", "reclaimable_bytes", "disk_waste_bytes",
    )
