"""The full scan: records to report, as one lazy lineage but for the components and the pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.functions.metadata import DEFAULT_THRESHOLD, normalize_threshold
from colophon.operators import candidates, groups, ignore
from colophon.operators.components import stage
from colophon.sources.catalog import prepare


@dataclass
class Scan:
    records: DataFrame
    #: Candidate links between classes of records, and the classes' records.
    pairs: DataFrame
    classes: DataFrame
    members: DataFrame
    report: DataFrame
    threshold: float
    max_bucket: int | None
    excluded: DataFrame
    stale: DataFrame
    #: Title classes, ISBN links and title links that the pairs were made of.
    compared: tuple[DataFrame, DataFrame, DataFrame]

    def stats(self) -> DataFrame:
        """One row: what the scan compared and left out, dismissed pairs and stale dismissals included."""
        counted = lambda f, name: f.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
        stats = candidates.stats_of(*self.compared, self.max_bucket).withColumn("one", F.lit(1))
        for rows, name in ((self.records, "scanned_books"), (self.excluded, "ignored_excluded"), (self.stale, "ignored_stale")):
            stats = stats.join(counted(rows, name), "one")
        return stats.drop("one").withColumn("threshold", F.lit(self.threshold))


def run_scan(
    records: DataFrame, threshold: object = DEFAULT_THRESHOLD, ignored: DataFrame | None = None, rule: str = "metadata", max_bucket: int | None = None,
    step: Callable[..., None] = lambda name, rows=None: None,
) -> Scan:
    """Scans catalog records for duplicates; dismissed pairs are removed before grouping.

    Records of a live dismissal are classes of their own, so that a dismissed pair is a link. step is told when a part of
    the scan has ended, and how many rows it gave; what it raises ends the scan.
    """
    prepared = stage(prepare(records), "records")  # read by several joins: keys are computed once
    step("records", prepared.count())
    threshold = normalize_threshold(threshold)
    live = None if ignored is None else stage(ignore.live_entries(ignored, prepared), "live")
    pinned = None if live is None else live.select(F.col("a").alias("id")).union(live.select("b"))
    titles, isbns, by_isbn, by_title = candidates.matches(prepared, threshold, max_bucket, pinned)
    found, classes = candidates.candidate_links(by_isbn, by_title), candidates.memberships(titles, isbns)
    if live is None:
        pairs = stage(found, "pairs")
        excluded = stale = pairs.select("a", "b").limit(0)
    else:
        found = stage(found, "found")
        pairs = stage(ignore.filter_pairs(found, live), "pairs")
        excluded = ignore.dismissed_pairs(found, live).select("a", "b")
        stale = ignore.canonical(ignored).select("a", "b").exceptAll(ignore.canonical(live).select("a", "b"))
    step("pairs", pairs.count())
    members = stage(groups.group_members(prepared, pairs, classes), "members")
    step("members", members.count())
    return Scan(prepared, pairs, classes, members, groups.build_report(members, pairs, rule), threshold, max_bucket, excluded, stale, (titles, by_isbn, by_title))
