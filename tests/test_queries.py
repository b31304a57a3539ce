"""Every core query against its SQL, over the smallest tables."""

import pytest
from conftest import DATA

from colophon.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, same_as_sql, name):
    same_as_sql(Q.QUERIES[name](spark, DATA), Q.ORACLES[name])


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_names_are_bound_once():
    """Queries read the module's names when they run: one that is bound again changes the queries above it."""
    import ast
    from pathlib import Path

    bound = [t.id for n in ast.parse(Path(Q.__file__).read_text()).body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
    assert len(bound) == len(set(bound))


def test_views_read_the_written_report(spark):
    """A report that is planned anew wherever a view reads it costs the driver a plan of the whole report each time."""
    report = Q.whole_report(spark, DATA)
    assert Q.whole_report(spark, DATA) is report
    for name in ("report_groups", "index_preview", "visible_groups", "groups_view", "group_detail", "group_detail_rows", "ignore_batch_counts"):
        read = Q.QUERIES[name](spark, DATA).inputFiles()
        assert any("/report-" in f for f in read) and not any("/members-" in f or "/ordered-groups-" in f for f in read), name
