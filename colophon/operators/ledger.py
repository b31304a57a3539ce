"""Commands as transitions from tables to tables: merge plans, merges, deletions and their ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.operators.components import by_shuffle
from colophon.sources.files import on_disk


def gone_ids(merged: DataFrame, deleted: DataFrame) -> DataFrame:
    """Ids that the ledgers merged(removed_ids) and deleted(id) have taken out; id 0 is never read as deleted."""
    return merged.select(F.explode("removed_ids").alias("id")).union(deleted.filter("id IS NOT NULL AND id <> 0").select("id")).distinct()


def removed_titles(merged: DataFrame) -> DataFrame:
    return merged.select("index", F.explode("removed").alias("r")).select("index", "r.id", "r.title")


def failed_titles(merged: DataFrame) -> DataFrame:
    """Steps of merges that ended in an error."""
    return merged.select("index", F.explode("steps").alias("s")).filter("s.error IS NOT NULL").select(
        "index", F.col("s.source_id").alias("id"), F.col("s.source_title").alias("title"), F.col("s.error").alias("error")
    )


def plan_errors(members: DataFrame, keeper_id: int, source_ids: list[int] | None, index_members: DataFrame | None = None) -> str | None:
    """The first rule that a request breaks, or None. members: live members of one group (id, ...)."""
    live = {r["id"] for r in members.select("id").limit(10_001).collect()}  # a group's ids in a command; checked below
    was = live if index_members is None else {r["id"] for r in index_members.select("id").limit(10_001).collect()}
    if len(live) > 10_000:
        return "limit.exceeded"
    if len(live) < 2:
        return "group.already_merged"
    if keeper_id not in was:
        return "keeper.not_in_group"
    if keeper_id not in live:
        return "keeper.missing"
    if source_ids is not None:
        if any(isinstance(i, bool) or not isinstance(i, int) for i in source_ids):
            return "params.invalid"
        if not source_ids:
            return "merge.nothing"
        if keeper_id in source_ids:
            return "source.is_keeper"
        if set(source_ids) - live:
            return "source.not_in_group"
    return None


def request_errors(requests: DataFrame, members: DataFrame, live: DataFrame) -> DataFrame:
    """request and error: the first rule that each merge request breaks, null if none; what `plan_errors` says of one.

    requests: request, group_id, keeper_id, source_ids (null: all others). members, live: group_id and id of the report's
    members and of those that are left.
    """
    was = members.groupBy("group_id").agg(F.collect_set("id").alias("was"))
    now = live.groupBy("group_id").agg(F.collect_set("id").alias("now"))
    rows = requests.join(by_shuffle(was), "group_id", "left").join(by_shuffle(now), "group_id", "left")
    inside = lambda c: F.coalesce(F.array_contains(c, F.col("keeper_id")), F.lit(False))
    sources = F.col("source_ids")
    error = (
        F.when(F.coalesce(F.size("now"), F.lit(0)) < 2, "group.already_merged")
        .when(~inside("was"), "keeper.not_in_group")
        .when(~inside("now"), "keeper.missing")
        .when(sources.isNotNull() & (F.size(sources) == 0), "merge.nothing")
        .when(inside(sources), "source.is_keeper")
        .when(sources.isNotNull() & (F.size(F.array_except(sources, "now")) > 0), "source.not_in_group")
    )
    return rows.select("request", error.alias("error"))


def existence(ids: DataFrame, records: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """id and there: true, false, or null for an id that could not be read, which is not the same as gone."""
    rows = ids.select("id").distinct().join(by_shuffle(records.select("id", F.lit(True).alias("found"))), "id", "left")
    if unreadable is None:
        return rows.select("id", F.coalesce("found", F.lit(False)).alias("there"))
    unread = unreadable.select("id", F.lit(True).alias("unread")).distinct()
    return rows.join(by_shuffle(unread), "id", "left").select("id", F.when(F.col("unread").isNull(), F.coalesce("found", F.lit(False))).alias("there"))


def merge_plan(members: DataFrame, keep: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """group_id, keeper_id, source_id, source_title, moved_formats, dropped_formats, size: a step for each source.

    sources(id) limits the steps; each compares with the keeper's formats as they are now.
    """
    target = members.select(F.col("id").alias("keeper_id"), "group_id", F.col("formats").alias("kept_formats"))
    rows = members.join(by_shuffle(keep.select("group_id", "keeper_id")), "group_id").filter("id <> keeper_id")
    if sources is not None:
        rows = rows.join(by_shuffle(sources.select("id").distinct()), "id", "left_semi")
    return rows.join(by_shuffle(target), ["group_id", "keeper_id"]).select(
        "group_id",
        "keeper_id",
        F.col("id").alias("source_id"),
        F.col("title").alias("source_title"),
        F.array_sort(F.array_except("formats", "kept_formats")).alias("moved_formats"),
        F.array_sort(F.array_intersect("formats", "kept_formats")).alias("dropped_formats"),
        "size",
    )


def step_status(steps: DataFrame, records: DataFrame, copied: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """steps(source_id, target_id) with error (null if the step may run) and note, against the records as they are now.

    copied(source_id, ok) tells how copying files went; a source is deleted only after its files were copied. states(book,
    format, state): those of files; a source none of whose new formats may be there has nothing to copy and may go, one with any
    that was not copied may not.
    """
    side = lambda s: records.select(F.col("id").alias(f"{s}_id"), F.col("formats").alias(f"{s}_formats"))
    rows = steps.join(by_shuffle(side("source")), "source_id", "left").join(by_shuffle(side("target")), "target_id", "left")
    if copied is not None:
        rows = rows.join(by_shuffle(copied.select("source_id", F.col("ok"))), "source_id", "left")
    else:
        rows = rows.withColumn("ok", F.lit(True))
    error = (
        F.when(F.col("source_id") == F.col("target_id"), "merge.same_book")
        .when(F.col("source_formats").isNull(), "merge.source_missing")
        .when(F.col("target_formats").isNull(), "merge.target_missing")
        .when(~F.coalesce("ok", F.lit(True)), "merge.copy_failed")
    )
    fresh = F.array_except("source_formats", "target_formats")
    note = F.when(F.size(fresh) == 0, "no_new_formats")
    if states is not None:
        there = on_disk(states).groupBy(F.col("book").alias("source_id")).agg(F.collect_set("format").alias("there"))
        rows = rows.join(by_shuffle(there), "source_id", "left")
        none = ~F.coalesce(F.arrays_overlap(fresh, F.col("there")), F.lit(False)) & (F.size(fresh) > 0)
        error = F.when(~none | (error != "merge.copy_failed"), error)
        note = note.when(none, "format_files_missing")
    return rows.select("source_id", "target_id", error.alias("error"), F.when(error.isNull(), note).alias("note"))


def merge_outcome(status: DataFrame, *by: str) -> DataFrame:
    """One code for all steps, or for each value of `by`: ok, or group.already_merged / merge.failed where every step failed."""
    missing, failed, n = F.count_if(F.col("error") == "merge.source_missing"), F.count("error"), F.count("*")
    return status.groupBy(*by).agg(F.when(n == missing, "group.already_merged").when(n == failed, "merge.failed").otherwise("ok").alias("err"))


def plan_totals(plan: DataFrame) -> DataFrame:
    """group_id, steps, moved_total, dropped_total, reclaimable_bytes, disk_waste_bytes of a plan."""
    wasted = (F.size("dropped_formats") > 0) & (F.size("moved_formats") == 0)
    return plan.groupBy("group_id").agg(
        F.count("*").alias("steps"),
        F.sum(F.size("moved_formats")).alias("moved_total"),
        F.sum(F.size("dropped_formats")).alias("dropped_total"),
        F.sum("size").alias("reclaimable_bytes"),
        F.sum(F.when(wasted, F.col("size")).otherwise(0)).alias("disk_waste_bytes"),
    )


def apply_merge(records: DataFrame, plan: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The catalog after the plan: keepers have the formats that were moved to them, sources are gone.

    failed(source_id): sources whose files could not be copied; they stay as they are.
    """
    done = plan if failed is None else plan.join(by_shuffle(failed.select("source_id")), "source_id", "left_anti")
    gained = done.groupBy("keeper_id").agg(F.array_distinct(F.flatten(F.collect_list("moved_formats"))).alias("gained"))
    left = records.join(by_shuffle(done.select(F.col("source_id").alias("id"))), "id", "left_anti").join(by_shuffle(gained), F.col("id") == F.col("keeper_id"), "left")
    formats = F.when(F.col("gained").isNull(), F.col("formats")).otherwise(F.array_sort(F.array_union("formats", "gained")))
    return left.withColumn("formats", formats).select(*records.columns)


def merge_ledger(plan: DataFrame, index: DataFrame, at: str, status: DataFrame | None = None) -> DataFrame:
    """A ledger row for each merged group: index, keeper_id, removed_ids, removed and steps.

    status(source_id, error): how the steps went; one with an error removes nothing.
    """
    told = plan.withColumn("error", F.lit(None).cast("string")) if status is None else plan.join(by_shuffle(status.select("source_id", "error")), "source_id", "left")
    done = F.col("error").isNull()
    step = F.struct("source_id", "source_title", "moved_formats", done.alias("deleted"), "error")
    rows = told.groupBy("group_id", "keeper_id").agg(
        F.array_sort(F.collect_list(F.when(done, F.col("source_id")))).alias("removed_ids"),
        F.array_sort(F.collect_list(F.when(done, F.struct(F.col("source_id").alias("id"), F.col("source_title").alias("title"))))).alias("removed"),
        F.array_sort(F.collect_list(step)).alias("steps"),
    )
    return rows.join(by_shuffle(index.select("group_id", "index")), "group_id").withColumn("at", F.lit(at)).select("at", "index", "keeper_id", "removed_ids", "removed", "steps")


def apply_delete(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(by_shuffle(ids.select("id").distinct()), "id", "left_anti").select(*records.columns)


def delete_ledger(members: DataFrame, ids: DataFrame, index: DataFrame, at: str) -> DataFrame:
    """id, title, at, index of the deleted members; ids outside of any group are not deleted."""
    rows = members.select("group_id", "id", "title").join(by_shuffle(ids.select("id").distinct()), "id")
    return rows.join(by_shuffle(index.select("group_id", "index")), "group_id").select("id", "title", F.lit(at).alias("at"), "index")
