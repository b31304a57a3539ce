"""The training-data queries that SQL can express, against it: over the smallest tables, and over odd ones."""

import duckdb
import pytest
from conftest import DATA, _plain

from colophon.llm import queries as Q

TABLES = {
    "documents": (
        "doc_id long, text string, lang string, source string, n_words string, `__row_id` long, number long",
        [
            (i, t, "en", s, "clash", 1, 1)
            for i, (t, s) in enumerate(
                [
                    (None, "a"), ("", None), (" \t\n ", "a"), ("one", "b"), ("one", "b"), ("Home | About | Contact\nall RIGHTS reserved\n", "c"), ("a b c a b c a b c\n" * 30, "c"),
                    (" ".join(f"word{i % 977}" for i in range(9000)), "b"), ("\u00fcn\u00ef <|endoftext|> \u0130 J\u030c \u2581x  y", "c"), (" ".join(f"w{i}" for i in range(400)), "d"),
                    (" ".join(f"W{i}" for i in range(400)), "d"), (" ".join(f"w{i}" for i in range(380)), "e"), (" ".join(f"v{i}." for i in range(300)), None),
                ]
            )
        ]
        + [(3, "one", "en", "b", None, 2, 2), (3, "quite another text of a few words", "en", "b", None, 2, 2), (None, " ".join(f"w{i}" for i in range(400)), None, "d", None, 3, 3), (None, "x", None, None, None, 3, 3)],
    ),
    "pages": (
        "page_id long, url string, html string",
        [(i, f"http://www.a.com/{i % 3}?utm_source=x#t", f"<html>{i % 4}</html>") for i in range(0, 240, 3)]
        + [(21, "https://a.com/0", "again"), (21, "https://a.com/0", "and again"), (21, None, None), (None, "https://a.com/1", "y"), (None, None, None), (7, "https://b.com/", None), (8, "https://b.com", None)],
    ),
    "embeddings": ("vec_id long, embedding array<float>", [(i % 60, [float(i % 7) - 3, float(i % 5), 0.25 * (i % 3)]) for i in range(130)] + [(50, None), (50, [1.0, None, 2.0]), (100, [0.5, 0.5, 0.5])]),
    "conversations": (
        "conv_id long, turn long, role string, text string",
        [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(9)] + [(-1, 0, "user", "mine"), (-1, 1, "assistant", "<|im_end|>"), (2, None, None, None), (2, None, None, None), (2, 1, "a&lt;|", ""), (3, 0, "assistant", None)],
    ),
}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, same_as_sql, name):
    same_as_sql(Q.QUERIES[name](spark, DATA), Q.ORACLES[name])


@pytest.fixture(scope="module", params=["odd", "empty"])
def odd_tables(spark, tmp_path_factory, request):
    home = tmp_path_factory.mktemp(request.param)
    con = duckdb.connect()
    for name, (schema, rows) in TABLES.items():
        frame = spark.createDataFrame(rows if request.param == "odd" else [], schema)
        frame.repartition(3).write.parquet(f"{home}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{home}/{name}.parquet/*.parquet'")
    return str(home), con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_odd_tables(spark, odd_tables, name):
    """Nulls, repeated ids and rows, clashing names, the control conversation's own id, and no rows at all."""
    home, con = odd_tables
    frame, cursor = Q.QUERIES[name](spark, home), con.execute(Q.ORACLES[name])
    names, columns = [d[0] for d in cursor.description], sorted(frame.columns)
    assert sorted(names) == columns
    mine = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in frame.collect())
    assert mine == sorted(repr(tuple(_plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
