"""The engine's queries by name, and the SQL that states the same result for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colophon.functions import isbn as I
from colophon.functions import metadata as M
from colophon.functions import text as T
from colophon.operators import candidates as C
from colophon.operators import groups as G
from colophon.operators import ignore, ledger, views
from colophon.operators.components import by_shuffle, shared_home, stage
from colophon.plans import oracle as O
from colophon.plans.scan import Scan, run_scan
from colophon.sources import catalog, dismissals
from colophon.sources import files as library
from colophon.sources import library as sqlite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def joined(c: str | Column) -> Column:
    return F.array_join(c, ",")


def fixture(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Literal rows as a projection of the JVM: no Python source, no size to check."""
    cells = lambda r: F.struct(*[F.lit(v).cast("string").alias(n) for v, n in zip(r, names, strict=True)])
    return spark.range(1).select(F.explode(F.array(*[cells(r) for r in rows])).alias("r")).select("r.*")


#: Results that several queries read, by what they were made of. A scan writes its report once and views read it; a
#: table that changes (its size or time) is scanned anew.
_KEPT: dict[tuple, object] = {}
MOST_KEPT = 6


def forget() -> None:
    """The next query makes anew what others have made."""
    _KEPT.clear()


def _once(name: str, spark: SparkSession, sf_dir: str, make: Callable):
    key: tuple = (name, spark.sparkContext.applicationId)
    for t in ("documents", "labels"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        key += (str(path), files.getContentSummary(path).getLength(), files.getFileStatus(path).getModificationTime())
    if key not in _KEPT:
        while len(_KEPT) >= MOST_KEPT:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[key] = make(spark, sf_dir)
    return _KEPT[key]


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("prepared", spark, sf_dir, lambda spark, sf_dir: stage(catalog.prepare(catalog.document_catalog(spark, sf_dir)), "records"))


def scan(spark: SparkSession, sf_dir: str) -> Scan:
    return _once("scan", spark, sf_dir, lambda spark, sf_dir: run_scan(catalog.document_catalog(spark, sf_dir)))


def whole_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's report, written once: a view that reads it several times would plan and make all of it as often."""
    return _once("report", spark, sf_dir, lambda spark, sf_dir: stage(scan(spark, sf_dir).report, "report"))


def mixed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog and some odd books: beyond ASCII, of several authors, with notes and volume marks."""
    names = ["id", "title", "authors", "isbn", "formats", "book_type"]
    kinds = ["long", "string", "array<string>", "string", "array<string>", "int"]
    cell = lambda v, k: (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(k)
    rows = [F.struct(*[cell(v, k).alias(n) for v, n, k in zip(r, names, kinds, strict=True)]) for r in O.ODD_BOOKS]
    odd = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumns({"size": 1000 - F.col("id"), "added": F.lit("2026-01-01T00:00:00")})
    return catalog.document_catalog(spark, sf_dir).unionByName(catalog.load_records(odd))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("mixed", spark, sf_dir, lambda spark, sf_dir: stage(catalog.prepare(mixed_catalog(spark, sf_dir)), "records"))


MIXED_PAIRS = O.pairs_over(O.MIXED)
MIXED_GROUPS = O.groups_over(MIXED_PAIRS)


# ---- records and scalar functions


@query(O.over(O.CATALOG, "SELECT id, title, array_to_string(authors, ',') AS authors, array_to_string(formats, ',') AS formats, size, array_to_string(languages, ',') AS languages, rating, has_cover, book_type, added, isbn FROM catalog"))
def catalog_scan(spark, sf_dir):
    r = catalog.document_catalog(spark, sf_dir)
    return r.select("id", "title", joined("authors").alias("authors"), joined("formats").alias("formats"), "size", joined("languages").alias("languages"), "rating", "has_cover", "book_type", "added", "isbn")


@query(O.over(O.CATALOG, "SELECT id, title_key FROM prepared UNION ALL SELECT -1 - page_id, " + O.key("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + " FROM pages"))
def title_key(spark, sf_dir):
    pages = catalog.page_catalog(spark, sf_dir).select((-1 - F.col("id")).alias("id"), T.title_key(F.col("title")).alias("title_key"))
    return prepared(spark, sf_dir).select("id", "title_key").union(pages)


@query(O.over(O.MIXED, f"SELECT id, trim({O.core('title')}) AS core FROM catalog"))
def title_core(spark, sf_dir):
    return mixed_catalog(spark, sf_dir).select("id", T.title_core(F.col("title")).alias("core"))


@query(O.over(O.MIXED, "SELECT id, array_to_string(list_sort(author_keys), ',') AS author_keys FROM prepared"))
def author_keys(spark, sf_dir):
    return mixed(spark, sf_dir).select("id", joined(F.array_sort("author_keys")).alias("author_keys"))


ISBNS = [("978-7-02-000220-9",), ("0-306-40615-2",), ("097522980x",), ("0306406153",), ("030640615",), ("9787020002207",), ("9780306406157",), ("9787020002208",), ("1234567890128",), ("",), ("none",)]
V = O.plain_isbn("s")


@query(O.over(f"{O.CATALOG.strip()}, {O.values(ISBNS, ['l'])}, w AS (SELECT l AS s FROM v UNION ALL SELECT isbn FROM catalog)", f"SELECT s, {V} AS plain, {O.valid10(V)} AS is_isbn10, {O.valid13(V)} AS is_isbn13, CASE WHEN {O.valid10(V)} THEN {O.to13(V)} END AS as_isbn13, {O.isbn_key('s')} AS isbn_key FROM w"))
def isbn_functions(spark, sf_dir):
    v = I.normalize_isbn(F.col("s"))
    rows = fixture(spark, ISBNS, ["s"]).union(catalog.document_catalog(spark, sf_dir).select("isbn"))
    return rows.select(
        "s", v.alias("plain"), I.is_isbn10(v).alias("is_isbn10"), I.is_isbn13(v).alias("is_isbn13"), F.when(I.is_isbn10(v), I.to_isbn13(v)).alias("as_isbn13"), I.isbn_key(F.col("s")).alias("isbn_key")
    )


@query(O.over(O.CATALOG, "SELECT id, isbn_key FROM prepared"))
def isbn_key(spark, sf_dir):
    return prepared(spark, sf_dir).select("id", "isbn_key")


FORMS = [("epub",), (".AZW3",), (" mp3 ",), ("cbz",), ("xyz",), (None,), ("PDF",), ("..flac",)]


@query(O.over(f"{O.CATALOG.strip()}, {O.values(FORMS, ['l'])}, w AS (SELECT l AS f FROM v UNION ALL SELECT unnest(formats) FROM catalog)", f"SELECT f, {O.family('ltrim(trim(coalesce(f, chr(0))), chr(46))')} AS family FROM w"))
def media_family(spark, sf_dir):
    rows = fixture(spark, FORMS, ["f"]).union(catalog.document_catalog(spark, sf_dir).select(F.explode("formats")))
    return rows.select("f", M.media_family(F.col("f")).alias("family"))


@query(O.over(O.CATALOG, "SELECT id, array_to_string(list_sort(families), ',') AS families FROM prepared"))
def families_of(spark, sf_dir):
    return prepared(spark, sf_dir).select("id", joined(F.array_sort("families")).alias("families"))


MARKS = [(x,) for x in ("1", "12", "第一部", "第十二部", "全13册", "上", "中", "下册", "vol10", "16jun", "20161029", "第1卷上下", "全本", "全集", "修订版", "果麦经典", "经典版", "插图版", "")]
NOTES = [(x,) for x in ("三", "上", "中册", "第一部发配", "至24卷26章", "19", "全20卷", "套装上下册", "全本", "修订版", "别册", "企鹅经典丛书第二辑上海文艺精装版", "")]


def _with_keys(literal: list[tuple], column: str, select: str) -> str:
    return O.over(f"{O.MIXED.strip()}, {O.values(literal, ['l'])}, w({column}) AS (SELECT l FROM v UNION ALL {select})", "")


@query(_with_keys(MARKS, "s", "SELECT title_key FROM prepared") + f"SELECT s, {O.serial('s')} AS serial FROM w")
def serial_marker(spark, sf_dir):
    return fixture(spark, MARKS, ["s"]).union(mixed(spark, sf_dir).select("title_key")).select("s", T.is_serial(F.col("s")).alias("serial"))


@query(_with_keys(NOTES, "s", f"SELECT {O.note('title_key', 'title_core_key')} FROM prepared UNION ALL SELECT title_key FROM prepared") + f"SELECT s, {O.serial_note('s')} AS serial FROM w")
def annotation_serial(spark, sf_dir):
    r = mixed(spark, sf_dir)
    notes = r.select(T.note_of(F.col("title_key"), F.col("title_core_key"))).union(r.select("title_key"))
    return fixture(spark, NOTES, ["s"]).union(notes).select("s", T.is_serial_note(F.col("s")).alias("serial"))


SERIES = [("德川家康第一部",), ("德川家康第十二部",), ("苗疆蛊事",), ("苗疆蛊事1",), ("苗疆蛊事全集",), ("theeconomistthu16jun",), ("theeconomistthu23jun",), ("三体",), ("三体2",), ("孙子兵法",), ("孙子兵法全本",), ("12",), ("13",), ("全金属狂潮10",), ("全金属狂潮19",)]


@query(
    O.over(
        f"{O.MIXED.strip()}, {O.values(SERIES, ['l'])}, w AS (SELECT '' AS block, l AS k FROM v UNION SELECT unnest(author_keys), title_key FROM prepared)",
        f"SELECT x.block, x.k AS key_a, y.k AS key_b FROM w x JOIN w y ON x.block = y.block AND x.k < y.k WHERE {O.by_serial('x.k', 'y.k')}",
    )
)
def serial_pairs(spark, sf_dir):
    keys = fixture(spark, SERIES, ["title_key"]).select(F.lit("").alias("block"), "title_key").union(mixed(spark, sf_dir).select(F.explode("author_keys"), "title_key"))
    return C.serial_key_pairs(keys.distinct())


TITLES = [
    ("三体", "三体全集", "三体", "三体"), ("孙子兵法", "孙子兵法全本", "孙子兵法", "孙子兵法"), ("我是猫", "我是猫果麦经典", "我是猫", "我是猫"), ("苗疆蛊事全集", "苗疆蛊事1", "苗疆蛊事", "苗疆蛊事1"),
    ("鲁迅全集全20卷", "鲁迅全集", "鲁迅全集", "鲁迅全集"), ("天龙八部一", "天龙八部一", "天龙八部", "天龙八部"), ("哈利波特harrypotter", "哈利波特", "哈利波特harrypotter", "哈利波特"), ("活着", "三体", "活着", "三体"),
    ("活着", "活着的意义", "活着", "活着的意义"), ("鳄鱼怕怕牙医怕怕", "鳄鱼怕牙医怕", "鳄鱼怕怕牙医怕怕", "鳄鱼怕牙医怕"), ("thehobbit", "thehobbitillustrated", "thehobbit", "thehobbit"), ("", "三体", "", "三体"),
]
_L = ["a", "b", "ac", "bc"]
HOST = r"regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


PAGE_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
NEIGHBOURS = f"""{O.values(TITLES, _L)}, p AS (SELECT *, lead(a) OVER (PARTITION BY host ORDER BY page_id) AS b, lead(ac) OVER (PARTITION BY host ORDER BY page_id) AS bc
  FROM (SELECT page_id, url AS host, {O.key(PAGE_TITLE)} AS a, {O.key(O.core(PAGE_TITLE))} AS ac FROM (SELECT page_id, html, {HOST} AS url FROM pages))),
w AS (SELECT * FROM v UNION ALL SELECT a, b, ac, bc FROM p WHERE b IS NOT NULL)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, ac, bc: keys and cores of literal title pairs, and of every page and the next one of its host."""
    pages = catalog.prepare(catalog.page_catalog(spark, sf_dir)).select("id", F.get("author_keys", F.lit(0)).alias("host"), F.col("title_key").alias("a"), F.col("title_core_key").alias("ac"))
    order = Window.partitionBy("host").orderBy("id")
    both = pages.withColumns({"b": F.lead("a").over(order), "bc": F.lead("ac").over(order)}).filter("b IS NOT NULL")
    return fixture(spark, TITLES, _L).union(both.select(*_L))


@query(O.over(NEIGHBOURS, f"SELECT a, b, ({O.gram_size('a')})::INT AS size_a, ({O.gram_size('b')})::INT AS size_b, {O.dice('a', 'b', 2)} AS dice2, {O.dice('a', 'b', 3)} AS dice3, {O.containment('a', 'b')} AS containment FROM w"))
def gram_scores(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return neighbours(spark, sf_dir).select(
        "a", "b", T.gram_size(a).alias("size_a"), T.gram_size(b).alias("size_b"), T.dice(a, b, 2).alias("dice2"), T.dice(a, b, 3).alias("dice3"), T.containment(a, b).alias("containment")
    )


def _likeness(a: str, b: str) -> str:
    return f"(CASE WHEN {O.gram_size(a)} = 2 OR {O.gram_size(b)} = 2 THEN least({O.dice(a, b, 2)}, {O.containment(a, b)}) ELSE {O.dice(a, b, 3)} END)"


@query(
    O.over(
        NEIGHBOURS,
        f"""SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0.0::DOUBLE WHEN a = b THEN 1.0::DOUBLE WHEN {O.by_serial('a', 'b')} THEN 0.0::DOUBLE
        WHEN ac <> '' AND bc <> '' AND (ac <> a OR bc <> b) AND NOT ({O.serial_note(O.note('a', 'ac'))} OR {O.serial_note(O.note('b', 'bc'))} OR {O.by_serial('ac', 'bc')})
        THEN greatest({_likeness('a', 'b')}, CASE WHEN ac = bc THEN 1.0::DOUBLE ELSE {_likeness('ac', 'bc')} END) ELSE {_likeness('a', 'b')} END AS score FROM w""",
    )
)
def variant_scores(spark, sf_dir):
    c = F.col
    return neighbours(spark, sf_dir).select("a", "b", T.variant_score(c("a"), c("b"), c("ac"), c("bc")).alias("score"))


@query(O.over(O.MIXED, "SELECT id, meta_score, array_to_string(missing, ',') AS missing FROM prepared"))
def meta_score(spark, sf_dir):
    return mixed(spark, sf_dir).select("id", "meta_score", joined("missing").alias("missing"))


@query(O.over(O.CATALOG, "SELECT id, title || '|' || authors[1] || '|' || floor(size / 65536)::BIGINT AS sig FROM catalog"))
def record_signature(spark, sf_dir):
    return ignore.signatures(catalog.document_catalog(spark, sf_dir)).select("id", "sig")


# ---- candidate pairs


ISBN_LINKS = "SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, same_type, count(*) AS n_pairs FROM by_isbn JOIN isbn_class x ON x.id = by_isbn.a JOIN isbn_class y ON y.id = by_isbn.b GROUP BY 1, 2, 3"
TITLE_LINKS = """SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, max(t.similarity) AS similarity, t.same_type, count(*) AS n_pairs, count(i.a) AS n_isbn, count(*) FILTER (t.differs) AS n_differ
FROM by_title t JOIN title_class x ON x.id = t.a JOIN title_class y ON y.id = t.b LEFT JOIN by_isbn i ON i.a = t.a AND i.b = t.b GROUP BY 1, 2, 4"""
LINKS = "SELECT kind, a, b, array_to_string(reasons, ',') AS reasons, similarity, n_pairs FROM links"


@query(O.over(O.PAIRS, ISBN_LINKS))
def isbn_pairs(spark, sf_dir):
    return C.isbn_links(C.isbn_classes(prepared(spark, sf_dir)))


@query(f"SELECT {O.key(HOST)} AS block, count(*) AS size, count(*) > 12 AS skipped FROM pages GROUP BY 1")
def author_buckets(spark, sf_dir):
    return C.bucket_sizes(catalog.prepare(catalog.page_catalog(spark, sf_dir)), 12)


@query(f"SELECT count(*) AS skipped_buckets, coalesce(sum(n), 0)::BIGINT AS skipped_books FROM (SELECT count(*) AS n FROM pages GROUP BY {O.key(HOST)}) WHERE n > 12")
def skipped_buckets(spark, sf_dir):
    rows = C.bucket_sizes(catalog.prepare(catalog.page_catalog(spark, sf_dir)), 12).filter("skipped")
    return rows.agg(F.count("*").alias("skipped_buckets"), F.coalesce(F.sum("size"), F.lit(0)).alias("skipped_books"))


@query(O.over(O.PAIRS, TITLE_LINKS))
def title_pairs(spark, sf_dir):
    return C.title_links(C.title_classes(prepared(spark, sf_dir)))


@query(O.over(O.PAIRS, LINKS))
def candidate_pairs(spark, sf_dir):
    return C.candidate_pairs(prepared(spark, sf_dir)).withColumn("reasons", joined("reasons"))


@query(O.over(O.PAIRS, "SELECT 'isbn' AS kind, rep, id FROM isbn_class UNION ALL SELECT 'title', rep, id FROM title_class"))
def pair_classes(spark, sf_dir):
    r = prepared(spark, sf_dir)
    return C.memberships(C.title_classes(r), C.isbn_classes(r))


@query(O.over(MIXED_PAIRS, LINKS))
def mixed_pairs(spark, sf_dir):
    return C.candidate_pairs(mixed(spark, sf_dir)).withColumn("reasons", joined("reasons"))


PAGE_PAIRS = O.pairs_over(
    f"prepared AS (SELECT page_id AS id, {O.key(PAGE_TITLE)} AS title_key, {O.key(O.core(PAGE_TITLE))} AS title_core_key, [{O.key(HOST)}] AS author_keys, NULL::VARCHAR AS isbn_key, 0 AS book_type, ['ebook'] AS families FROM pages)"
)


@query(O.over(PAGE_PAIRS, LINKS))
def page_pairs(spark, sf_dir):
    return C.candidate_pairs(catalog.prepare(catalog.page_catalog(spark, sf_dir))).withColumn("reasons", joined("reasons"))


@query(O.over(PAGE_PAIRS.replace("), m AS (SELECT", "), m AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY block) AS size FROM (SELECT", 1).replace(" FROM prepared),\nkk", " FROM prepared)) WHERE size <= 12),\nkk", 1), LINKS))
def page_pairs_capped(spark, sf_dir):
    return C.candidate_pairs(catalog.prepare(catalog.page_catalog(spark, sf_dir)), max_bucket=12).withColumn("reasons", joined("reasons"))


@query(
    O.over(
        O.PAIRS,
        """SELECT (SELECT count(*) FROM tried WHERE NOT serial) AS comparisons, 0::BIGINT AS skipped_buckets, 0::BIGINT AS skipped_books, NULL::BIGINT AS max_bucket,
        (SELECT count(*) FROM tried WHERE serial) AS skipped_serial, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM matches WHERE NOT same_type)) AS skipped_cross_type""",
    )
)
def scan_stats(spark, sf_dir):
    return C.scan_stats(prepared(spark, sf_dir))


# ---- groups


@query(O.over(O.GROUPS, "SELECT id, group_id FROM components"))
def components(spark, sf_dir):
    s = scan(spark, sf_dir)
    return s.members.select("id", "group_id")


@query(
    O.over(
        O.GROUPS,
        "SELECT index, group_id, array_to_string(ids, ',') AS members, array_to_string(reasons, ',') AS reasons, rank, max_similarity, member_count, bytes_total, bytes_max, bytes_total - bytes_max AS bytes_over_max, confidence FROM groups",
    )
)
def groups(spark, sf_dir):
    s = scan(spark, sf_dir)
    return G.group_summary(s.members, s.pairs).withColumns({"members": joined("members"), "reasons": joined("reasons")})


def _keeper_sql(order: str) -> str:
    return O.over(O.GROUPS, f"SELECT group_id, id AS keeper_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {order}, id) AS n FROM members) WHERE n = 1")


def _keeper(rule: str, order: str) -> None:
    def run(spark, sf_dir):
        return G.keepers(scan(spark, sf_dir).members, rule).select("group_id", "keeper_id")

    run.__name__ = f"keeper_{rule}"
    query(_keeper_sql(order))(run)


_keeper("metadata", "meta_score DESC, len(formats) DESC, size DESC, added")
_keeper("formats", "len(formats) DESC, meta_score DESC, size DESC")
_keeper("size", "size DESC, meta_score DESC, len(formats) DESC")
_keeper("oldest", "added, meta_score DESC")
_keeper("newest", "added DESC, meta_score DESC")


@query(O.over(O.GROUPS, "SELECT group_id, max(id) AS keeper_id, 'manual' AS rule FROM members GROUP BY group_id"))
def keeper_manual(spark, sf_dir):
    m = scan(spark, sf_dir).members
    return G.keepers(m, "metadata", m.groupBy("group_id").agg(F.max("id").alias("manual_id")))


@query(
    O.over(
        O.GROUPS,
        """SELECT group_id, keeper_id, CASE WHEN s || f || z || i = '' THEN 'added' ELSE rtrim(s || f || z || i, ',') END AS reasons FROM (
        SELECT k.group_id, keeper_id, CASE WHEN k.s > 0 AND min(m.meta_score) < k.s THEN 'metadata,' ELSE '' END AS s, CASE WHEN k.f > 0 AND min(len(m.formats)) < k.f THEN 'formats,' ELSE '' END AS f,
          CASE WHEN k.z > 0 AND min(m.size) < k.z THEN 'size,' ELSE '' END AS z, CASE WHEN k.i <> '' AND min(m.isbn) = '' THEN 'isbn,' ELSE '' END AS i
        FROM (SELECT group_id, id AS keeper_id, meta_score AS s, len(formats) AS f, size AS z, isbn AS i FROM ranked WHERE place = 1) k
        JOIN members m ON m.group_id = k.group_id AND m.id <> keeper_id GROUP BY k.group_id, keeper_id, k.s, k.f, k.z, k.i)""",
    )
)
def keeper_reasons(spark, sf_dir):
    return G.keeper_reasons(scan(spark, sf_dir).members).withColumn("reasons", joined("reasons"))


@query(O.over(O.GROUPS, "SELECT group_id, keeper_id, reclaimable_bytes, disk_waste_bytes FROM bytes_of"))
def group_bytes(spark, sf_dir):
    m = scan(spark, sf_dir).members
    return G.group_bytes(m, G.keepers(m))


CELLS = """cells AS (
  SELECT group_id, id, 'size' AS field, size::VARCHAR AS v, size::DOUBLE AS x FROM members
  UNION ALL SELECT group_id, id, 'formats', array_to_string(list_sort(formats), '、'), len(formats) FROM members
  UNION ALL SELECT group_id, id, 'isbn', isbn, NULL FROM members
  UNION ALL SELECT group_id, id, 'metadata', meta_score::VARCHAR, meta_score FROM members
  UNION ALL SELECT group_id, id, 'cover', has_cover::VARCHAR, has_cover::INT FROM members
  UNION ALL SELECT group_id, id, 'added', added, NULL FROM members
  UNION ALL SELECT group_id, id, 'rating', rating::VARCHAR, rating FROM members
  UNION ALL SELECT group_id, id, 'tags', '—', 0 FROM members
  UNION ALL SELECT group_id, id, unnest(['series', 'publisher', 'translators', 'collector', 'sole']), '', NULL FROM members
  UNION ALL SELECT group_id, id, 'languages', array_to_string(languages, '、'), NULL FROM members
  UNION ALL SELECT group_id, id, 'book_type', book_type::VARCHAR, NULL FROM members
), fields AS (
  SELECT group_id, field, count(DISTINCT v) = 1 AS shared, CASE WHEN max(x) IS NOT NULL AND count(*) FILTER (x = top) = 1 THEN min(id) FILTER (x = top) END AS best_id
  FROM (SELECT *, max(x) OVER (PARTITION BY group_id, field) AS top FROM cells) GROUP BY group_id, field
)"""


@query(O.over(O.GROUPS.strip() + ", " + CELLS, "SELECT group_id, field, shared, coalesce(best_id, -1) AS best_id FROM fields"))
def diff_shared(spark, sf_dir):
    return G.diff_fields(scan(spark, sf_dir).members).drop("place").withColumn("best_id", F.coalesce("best_id", F.lit(-1)))


@query(
    O.over(
        O.GROUPS.strip() + ", " + CELLS,
        """SELECT group_id, field, string_agg(id || '=' || CASE WHEN field = 'rating' THEN x::INT::VARCHAR WHEN field = 'added' THEN replace(v, 'T', ' ') WHEN v = '' THEN '—' ELSE v END, ';' ORDER BY id) AS cells
        FROM cells JOIN fields USING (group_id, field) WHERE NOT shared GROUP BY group_id, field""",
    )
)
def diff_rows(spark, sf_dir):
    rows = G.diff_rows(scan(spark, sf_dir).members)
    return rows.select("group_id", "field", F.array_join(F.transform("cells", lambda x: F.concat(x["id"].cast("string"), F.lit("="), x["shown"])), ";").alias("cells"))


@query(O.over(O.GROUPS.strip() + ", " + CELLS, "SELECT group_id, count(*) FILTER (shared) AS n_shared FROM fields GROUP BY group_id"))
def diff_summary(spark, sf_dir):
    return G.diff_summary(scan(spark, sf_dir).members).select("group_id", F.size("shared").cast("long").alias("n_shared"))


TIERS = [(str(r), s) for r in (0, 1, 2, 3) for s in ("0.9", "0.94995", "0.94996", "0.95", "1.0")]


@query(
    O.over(
        f"{MIXED_PAIRS.strip()}, {O.values([(int(r), s) for r, s in TIERS], ['rank', 'sim'])}, w AS (SELECT rank, sim::DOUBLE AS sim FROM v UNION ALL SELECT CASE kind WHEN 'isbn' THEN 3 ELSE 1 END, similarity FROM links)",
        f"SELECT rank, sim, {O.rounded4('sim')} AS shown, CASE WHEN rank >= 3 THEN 'strong' WHEN rank = 2 OR (rank = 1 AND {O.rounded4('sim')} >= 0.95) THEN 'likely' ELSE 'weak' END AS tier FROM w",
    )
)
def confidence_tiers(spark, sf_dir):
    rows = fixture(spark, TIERS, ["rank", "sim"]).select(F.col("rank").cast("int").alias("rank"), F.col("sim").cast("double").alias("sim"))
    links = C.candidate_pairs(mixed(spark, sf_dir)).select(F.when(F.col("kind") == "isbn", 3).otherwise(1), "similarity")
    return rows.union(links).select("rank", "sim", M.rounded4(F.col("sim")).alias("shown"), M.confidence(F.col("rank"), F.col("sim")).alias("tier"))


# ---- reports and views


@query(
    O.over(
        O.GROUPS,
        """SELECT count(*) AS group_count, sum(member_count - 1)::BIGINT AS extra_copies, sum(reclaimable_bytes)::BIGINT AS reclaimable_bytes, sum(disk_waste_bytes)::BIGINT AS disk_waste_bytes,
        count(*) FILTER (confidence = 'strong') AS strong_groups, count(*) FILTER (confidence = 'weak') AS weak_groups FROM report""",
    )
)
def report_summary(spark, sf_dir):
    return G.report_summary(whole_report(spark, sf_dir))


_REPORT = "index, group_id, array_to_string(ids, ',') AS members, confidence, keeper_id, reclaimable_bytes, disk_waste_bytes"


def _flat(report: DataFrame) -> DataFrame:
    return report.select("index", "group_id", joined("members").alias("members"), "confidence", "keeper_id", "reclaimable_bytes", "disk_waste_bytes")


@query(O.over(O.GROUPS, f"SELECT {_REPORT} FROM report"))
def report_groups(spark, sf_dir):
    return _flat(whole_report(spark, sf_dir))


@query(
    O.over(
        O.GROUPS,
        """SELECT index, string_agg(title, '|' ORDER BY n) FILTER (n <= 2) AS titles, string_agg(authors[1], '|' ORDER BY n) FILTER (n <= 2) AS authors, count(*) > 2 AS preview_truncated
        FROM (SELECT group_id, title, authors, row_number() OVER (PARTITION BY group_id ORDER BY id) AS n FROM members) JOIN groups USING (group_id) GROUP BY index""",
    )
)
def index_preview(spark, sf_dir):
    rows = G.index_preview(whole_report(spark, sf_dir))
    return rows.select("index", F.array_join("titles", "|").alias("titles"), F.array_join("authors", "|").alias("authors"), "preview_truncated")


@query(O.over(O.GROUPS, f"SELECT {_REPORT} FROM report WHERE confidence IN ('strong', 'likely')"))
def list_filter_confidence(spark, sf_dir):
    return _flat(views.by_confidence(whole_report(spark, sf_dir), "strong,likely"))


@query(O.over(O.GROUPS, f"SELECT {_REPORT} FROM report WHERE group_id IN (SELECT group_id FROM members WHERE contains(lower(title || ' ' || array_to_string(authors, ' ')), 'the'))"))
def list_keyword(spark, sf_dir):
    """The groups with a keyword, found by a written index of grams."""
    report, home = whole_report(spark, sf_dir), f"{shared_home(spark)}/postings-{uuid.uuid4().hex}"
    views.write_postings(report, home)
    return _flat(views.by_keyword(report, " The ", spark.read.parquet(home)))


@query(O.over(O.GROUPS, "SELECT index, group_id, (SELECT count(*) FROM report) AS total FROM report ORDER BY index LIMIT 20 OFFSET 20"))
def list_page(spark, sf_dir):
    return views.page_of(whole_report(spark, sf_dir).select("index", "group_id"), "1", 20)


def dismissed(records: DataFrame) -> DataFrame:
    """A list of dismissed neighbours: (id, id + 20) for every tenth record; every second one remembers another title."""
    sigs = ignore.signatures(records)
    a, b = sigs.toDF("a", "a_title", "a_sig").filter("a % 10 = 0"), sigs.toDF("b", "b_title", "b_sig")
    rows = a.join(by_shuffle(b), F.col("b") == F.col("a") + 20)
    return rows.select("a", "b", F.lit("2026-01-01").alias("at"), "a_title", "b_title", F.when(F.col("a") % 20 == 0, F.col("a_sig")).otherwise("other").alias("a_sig"), "b_sig")


@query("SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 20 WHERE x.doc_id % 20 = 0")
def ignore_live(spark, sf_dir):
    records = catalog.document_catalog(spark, sf_dir)
    return ignore.live_entries(dismissed(records), records).select("a", "b")


#: Records of some dismissed pair (id, id + 20) whose ids 10 divides.
PINNED = "(id % 10 = 0 AND (id + 20 IN (SELECT doc_id FROM documents) OR id - 20 IN (SELECT doc_id FROM documents)))"


@query(O.over(O.pairs_over(O.CATALOG, PINNED), LINKS + " WHERE NOT (a % 10 = 0 AND b = a + 20)"))
def ignore_filter(spark, sf_dir):
    records = prepared(spark, sf_dir)
    entries = dismissed(records)
    links, _ = C.candidates(records, pinned=entries.select(F.col("a").alias("id")).union(entries.select("b")))
    return ignore.filter_pairs(links, entries).select("kind", "a", "b", joined("reasons").alias("reasons"), "similarity", "n_pairs")


@query(O.over(O.GROUPS, "SELECT x.group_id, count(*) AS pairs, count(*) FILTER (x.id % 10 = 0 AND y.id = x.id + 20) AS ignored FROM members x JOIN members y ON x.group_id = y.group_id AND x.id < y.id GROUP BY x.group_id"))
def ignore_counts(spark, sf_dir):
    s = scan(spark, sf_dir)
    return ignore.group_counts(s.members, dismissed(s.records))


GONE = "id % 7 = 0"


VISIBLE = (
    O.GROUPS.strip()
    + """, live AS (SELECT * FROM members WHERE id % 7 <> 0), n AS (SELECT group_id, count(*) AS n FROM live GROUP BY group_id HAVING count(*) >= 2),
        c AS (SELECT x.group_id, count(*) AS pairs, count(*) FILTER (x.id % 10 = 0 AND y.id = x.id + 20) AS ignored FROM live x JOIN live y ON x.group_id = y.group_id AND x.id < y.id GROUP BY x.group_id),
        w AS (SELECT group_id, bool_or(id = keeper_id) AS k, sum(CASE WHEN id <> keeper_id THEN size ELSE 0 END)::BIGINT AS reclaim,
          sum(CASE WHEN id <> keeper_id AND len(formats) > 0 AND list_has_all(kept_formats, formats) THEN size ELSE 0 END)::BIGINT AS waste FROM live JOIN kept USING (group_id) GROUP BY group_id),
        visible AS (SELECT r.index, r.group_id, r.confidence, r.member_count - n AS stale_count, ignored AS ignored_pairs, n AS live_count, CASE WHEN k THEN reclaim ELSE reclaimable_bytes END AS reclaimable_bytes,
          CASE WHEN k THEN waste ELSE disk_waste_bytes END AS disk_waste_bytes FROM report r JOIN n USING (group_id) JOIN c USING (group_id) JOIN w USING (group_id) WHERE ignored < pairs)"""
)


@query(O.over(VISIBLE, "SELECT * EXCLUDE (confidence) FROM visible"))
def visible_groups(spark, sf_dir):
    s = scan(spark, sf_dir)
    rows = views.visible_groups(whole_report(spark, sf_dir), s.records.filter(GONE).select("id"), dismissed(s.records))
    return rows.select("index", "group_id", "stale_count", "ignored_pairs", "live_count", "reclaimable_bytes", "disk_waste_bytes")


@query(
    O.over(
        VISIBLE,
        """, hits AS (SELECT * FROM visible WHERE confidence IN ('strong', 'likely') AND group_id IN (SELECT group_id FROM members WHERE contains(lower(title || ' ' || array_to_string(authors, ' ')), 'the')))
        SELECT * EXCLUDE (confidence), (SELECT count(*) FROM hits) AS total, (SELECT 'now|' || count(*) FROM report) AS signature FROM hits ORDER BY index LIMIT 25 OFFSET 25""",
    )
)
def groups_view(spark, sf_dir):
    """The second page of the list: visible groups of two tiers with a keyword."""
    s = scan(spark, sf_dir)
    rows = views.groups_view(whole_report(spark, sf_dir), s.records.filter(GONE).select("id"), dismissed(s.records), "now", "strong,likely", " The ", "1", 25)
    return rows.select("index", "group_id", "stale_count", "ignored_pairs", "live_count", "reclaimable_bytes", "disk_waste_bytes", "total", "signature")


def written_report(spark: SparkSession, sf_dir: str) -> str:
    home = f"{shared_home(spark)}/report-{uuid.uuid4().hex}"
    catalog.write_report(whole_report(spark, sf_dir), home)
    return home


@query(O.over(O.GROUPS, f"SELECT {_REPORT} FROM report WHERE index IN (0, 3, 11, 1000000)"))
def report_lookup(spark, sf_dir):
    """Groups by their places in a written report, one of which is not there."""
    return _flat(catalog.read_report(spark, written_report(spark, sf_dir), index=[0, 3, 11, 1_000_000]))


def written_members(spark: SparkSession, sf_dir: str) -> str:
    home = f"{shared_home(spark)}/members-{uuid.uuid4().hex}"
    s = scan(spark, sf_dir)
    catalog.write_members(G.member_rows(s.members, whole_report(spark, sf_dir)), home)
    return home


@query(O.over(O.GROUPS, "SELECT index, group_id, id, title, authors[1] AS author, size, id = keeper_id AS keeper FROM members JOIN report USING (group_id)"))
def report_members(spark, sf_dir):
    """Every member of every group, a row each, from the written member table."""
    rows = catalog.read_members(spark, written_members(spark, sf_dir))
    return rows.select("index", "group_id", "id", "e.title", "e.author", "e.size", (F.col("id") == F.col("keeper_id")).alias("keeper"))


@query(O.over(O.GROUPS, f"SELECT {_REPORT} FROM report ORDER BY index LIMIT 20 OFFSET 20"))
def report_page(spark, sf_dir):
    return _flat(catalog.read_page(spark, written_report(spark, sf_dir), 1, 20))


# ---- commands


@query(
    O.over(
        O.GROUPS,
        """SELECT group_id, id AS source_id, array_to_string(list_sort(list_filter(formats, lambda f: NOT list_contains(kept_formats, f))), ',') AS moved, array_to_string(list_sort(list_intersect(formats, kept_formats)), ',') AS dropped, size
        FROM members JOIN kept USING (group_id) WHERE id <> keeper_id""",
    )
)
def merge_plan(spark, sf_dir):
    m = scan(spark, sf_dir).members
    return ledger.merge_plan(m, G.keepers(m)).select("group_id", "source_id", joined("moved_formats").alias("moved"), joined("dropped_formats").alias("dropped"), "size")


@query(
    O.over(
        O.GROUPS,
        """SELECT group_id, count(*) AS steps, sum(len(formats) - len(list_intersect(formats, kept_formats)))::BIGINT AS moved_total, sum(len(list_intersect(formats, kept_formats)))::BIGINT AS dropped_total, sum(size)::BIGINT AS reclaimable_bytes,
        sum(CASE WHEN len(formats) > 0 AND list_has_all(kept_formats, formats) THEN size ELSE 0 END)::BIGINT AS disk_waste_bytes FROM members JOIN kept USING (group_id) WHERE id <> keeper_id GROUP BY group_id""",
    )
)
def merge_totals(spark, sf_dir):
    m = scan(spark, sf_dir).members
    return ledger.plan_totals(ledger.merge_plan(m, G.keepers(m)))


@query(
    O.over(
        O.GROUPS,
        """SELECT p.id, array_to_string(CASE WHEN g.all_formats IS NULL THEN p.formats ELSE g.all_formats END, ',') AS formats FROM prepared p
        LEFT JOIN (SELECT keeper_id, list_sort(list_distinct(flatten(list(formats)))) AS all_formats FROM members JOIN kept USING (group_id) GROUP BY keeper_id) g ON g.keeper_id = p.id
        WHERE p.id NOT IN (SELECT id FROM members JOIN kept USING (group_id) WHERE id <> keeper_id)""",
    )
)
def merge_apply(spark, sf_dir):
    s = scan(spark, sf_dir)
    plan = ledger.merge_plan(s.members, G.keepers(s.members))
    return ledger.apply_merge(s.records, plan).select("id", joined("formats").alias("formats"))


@query(
    O.over(
        O.GROUPS,
        """SELECT m.id AS source_id, keeper_id AS target_id, CASE WHEN m.id = keeper_id THEN 'merge.same_book' WHEN m.id % 7 = 0 THEN 'merge.source_missing' WHEN keeper_id % 7 = 0 THEN 'merge.target_missing' END AS error,
        CASE WHEN m.id <> keeper_id AND m.id % 7 <> 0 AND keeper_id % 7 <> 0 AND list_has_all(kept_formats, m.formats) THEN 'no_new_formats' END AS note FROM members m JOIN kept USING (group_id)""",
    )
)
def step_status(spark, sf_dir):
    s = scan(spark, sf_dir)
    steps = s.members.join(by_shuffle(G.keepers(s.members)), "group_id").select(F.col("id").alias("source_id"), F.col("keeper_id").alias("target_id"))
    return ledger.step_status(steps, s.records.filter("id % 7 <> 0"))


@query(O.over(O.GROUPS, "SELECT index, id, title FROM members JOIN groups USING (group_id) JOIN kept USING (group_id) WHERE id <> keeper_id"))
def removed_titles(spark, sf_dir):
    s = scan(spark, sf_dir)
    return ledger.removed_titles(ledger.merge_ledger(ledger.merge_plan(s.members, G.keepers(s.members)), whole_report(spark, sf_dir), "now"))


@query("SELECT x.doc_id AS a, y.doc_id AS b, '2026-01-01' AS at FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 20 WHERE x.doc_id % 10 = 0 ORDER BY a DESC LIMIT 10 OFFSET 10")
def ignored_page(spark, sf_dir):
    return ignore.ignored_rows(dismissed(catalog.document_catalog(spark, sf_dir)), 1, 10).select("a", "b", "at")


@query(O.over(O.MIXED, f"SELECT s, regexp_matches(s, '[{T.CJK}]') AS has_cjk, CASE WHEN len(s) = 0 THEN 0.0::DOUBLE ELSE len(regexp_replace(s, '[^{T.CJK}]', '', 'g'))::DOUBLE / len(s) END AS cjk_ratio, coalesce({O.squeezed('s')}, '') AS squeezed FROM (SELECT title_key AS s FROM prepared)"))
def script_functions(spark, sf_dir):
    s = F.col("s")
    return mixed(spark, sf_dir).select(F.col("title_key").alias("s")).select("s", T.has_cjk(s).alias("has_cjk"), T.cjk_ratio(s).alias("cjk_ratio"), T.squeezed(s).alias("squeezed"))


@query(O.over(O.GROUPS, "SELECT id, title, index FROM members JOIN groups USING (group_id) WHERE id % 7 = 0"))
def delete_ledger(spark, sf_dir):
    s = scan(spark, sf_dir)
    return ledger.delete_ledger(s.members, s.records.filter(GONE).select("id"), whole_report(spark, sf_dir), "now").drop("at")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0")
def delete_apply(spark, sf_dir):
    r = catalog.document_catalog(spark, sf_dir)
    return ledger.apply_delete(r, r.filter(GONE).select("id")).select("id")


@query(O.over(O.GROUPS, "SELECT id FROM members JOIN kept USING (group_id) WHERE id <> keeper_id UNION SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND doc_id <> 0"))
def ledger_gone(spark, sf_dir):
    s = scan(spark, sf_dir)
    merged = ledger.merge_ledger(ledger.merge_plan(s.members, G.keepers(s.members)), whole_report(spark, sf_dir), "now")
    return ledger.gone_ids(merged, s.records.filter(GONE).select("id"))


@query(f"""SELECT path, mtime, protected, NOT protected AND row_number() OVER (PARTITION BY protected ORDER BY mtime DESC, path DESC) > 5 AS pruned
FROM (SELECT {HOST} AS path, max(page_id) AS mtime, starts_with({HOST}, 'm.') AS protected FROM pages GROUP BY ALL)""")
def retention(spark, sf_dir):
    """Hosts as report folders, their last page as the time; mobile hosts are protected."""
    pages = catalog.page_catalog(spark, sf_dir).select(F.col("authors")[0].alias("path"), "id")
    reports = pages.groupBy("path").agg(F.max("id").alias("mtime")).withColumn("protected", F.startswith("path", F.lit("m.")))
    return catalog.kept_reports(reports, 5)


# ---- the catalog with odd books


@query(O.over(MIXED_GROUPS, "SELECT index, group_id, array_to_string(ids, ',') AS members, array_to_string(reasons, ',') AS reasons, rank, max_similarity, confidence FROM groups"))
def mixed_groups(spark, sf_dir):
    s = run_scan(mixed_catalog(spark, sf_dir))
    return s.report.select("index", "group_id", joined("members").alias("members"), joined("reasons").alias("reasons"), "rank", "max_similarity", "confidence")


# ---- details, guards and lists


@query(
    O.over(
        O.GROUPS.strip() + ", live AS (SELECT * FROM members WHERE id % 7 <> 0), " + CELLS.replace("FROM members", "FROM live"),
        """, chosen AS (SELECT group_id, id AS keeper_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY size DESC, meta_score DESC, len(formats) DESC, id) AS n FROM live) WHERE n = 1),
        i AS (SELECT x.group_id, count(*) AS n FROM live x JOIN live y ON x.group_id = y.group_id AND x.id % 10 = 0 AND y.id = x.id + 20 GROUP BY x.group_id)
        SELECT index, l.group_id, string_agg(id, ',' ORDER BY id) AS members, count(*) AS member_count, coalesce(any_value(i.n), 0) AS ignored_pairs, any_value(keeper_id) AS keeper_id, 'size' AS rule,
          (SELECT coalesce(string_agg(field, ',' ORDER BY field), '') FROM fields f WHERE f.group_id = l.group_id AND f.shared) AS shared
        FROM live l JOIN groups USING (group_id) JOIN chosen USING (group_id) LEFT JOIN i USING (group_id) GROUP BY index, l.group_id""",
    )
)
def group_detail(spark, sf_dir):
    s = scan(spark, sf_dir)
    groups, _ = views.group_detail(whole_report(spark, sf_dir), s.records.filter(GONE).select("id"), dismissed(s.records), "size")
    columns = ["index", "group_id", joined("members").alias("members"), "member_count", "ignored_pairs", "keeper_id", "rule"]
    return groups.select(*columns, F.coalesce(joined(F.array_sort("shared")), F.lit("")).alias("shared"))


@query(
    O.over(
        O.GROUPS.strip() + ", live AS (SELECT * FROM members WHERE id % 7 <> 0), " + CELLS.replace("FROM members", "FROM live"),
        "SELECT group_id, field, coalesce(best_id, -1) AS best_id, (SELECT count(*) FROM live l WHERE l.group_id = f.group_id) AS n_cells FROM fields f WHERE NOT shared",
    )
)
def group_detail_rows(spark, sf_dir):
    s = scan(spark, sf_dir)
    _, rows = views.group_detail(whole_report(spark, sf_dir), s.records.filter(GONE).select("id"), dismissed(s.records), "size")
    return rows.select("group_id", "field", F.coalesce("best_id", F.lit(-1)).alias("best_id"), F.size("cells").cast("long").alias("n_cells"))


@query(
    O.over(
        O.GROUPS,
        """SELECT count(*) AS group_count, sum(member_count - 1)::BIGINT AS extra_copies, sum(reclaimable_bytes)::BIGINT AS reclaimable_bytes, sum(disk_waste_bytes)::BIGINT AS disk_waste_bytes,
        count(*) FILTER (confidence = 'strong') AS strong_groups, count(*) FILTER (confidence = 'weak') AS weak_groups, (SELECT count(*) FROM tried WHERE NOT serial) AS comparisons, 0::BIGINT AS skipped_buckets,
        0::BIGINT AS skipped_books, NULL::BIGINT AS max_bucket, (SELECT count(*) FROM tried WHERE serial) AS serial_excluded,
        (SELECT count(*) FROM (SELECT DISTINCT a, b FROM matches WHERE NOT same_type)) AS cross_type_excluded, (SELECT count(*) FROM documents) AS scanned_books,
        0::BIGINT AS ignored_excluded, 0::BIGINT AS ignored_stale, 0.85::DOUBLE AS threshold, 'now' AS generated_at, 'all' AS scope_note FROM report""",
    )
)
def report_totals(spark, sf_dir):
    s = scan(spark, sf_dir)
    return G.report_header(G.report_summary(whole_report(spark, sf_dir), s.stats()), "now", "all")


@query("SELECT 2::BIGINT AS missing, count(*) FILTER (doc_id % 5 = 3) + count(*) FILTER (doc_id % 5 = 1) AS no_format_path FROM documents")
def load_notes(spark, sf_dir):
    """Two ids that no record has; no files of MP3, nor of a second format."""
    raw = catalog.document_catalog(spark, sf_dir)
    wanted = raw.select("id").union(spark.range(-2, 0))
    files = raw.select(F.col("id").alias("book"), F.get("formats", F.lit(0)).alias("format")).filter("format <> 'MP3'")
    return catalog.load_notes(raw, wanted, files)


BATCH = "x.group_id = y.group_id AND x.id < y.id AND NOT (x.id % 10 = 0 AND y.id = x.id + 20)"


@query(
    O.over(
        O.GROUPS,
        f""", live AS (SELECT m.* FROM members m JOIN groups USING (group_id) WHERE m.id % 7 <> 0 AND index IN (0, 1, 2, 5))
        SELECT x.id AS a, y.id AS b, x.title AS a_title, y.title AS b_title FROM live x JOIN live y ON {BATCH}""",
    )
)
def ignore_batch(spark, sf_dir):
    """The pairs that dismissing the groups at 0, 1, 2, 5 and one that is not there adds to the list."""
    s, indexes = scan(spark, sf_dir), spark.range(6).filter("id < 3 OR id = 5").union(spark.range(10**9, 10**9 + 1)).toDF("index")
    entries = dismissed(s.records)
    new, _ = ignore.ignore_groups(entries, whole_report(spark, sf_dir), s.records.filter(GONE).select("id"), indexes, s.records, "later")
    return new.filter("at = 'later'").select("a", "b", "a_title", "b_title")


@query(
    O.over(
        O.GROUPS,
        f""", live AS (SELECT m.* FROM members m JOIN groups USING (group_id) WHERE m.id % 7 <> 0 AND index IN (0, 1, 2, 5)), n AS (SELECT group_id FROM live GROUP BY group_id HAVING count(*) > 1)
        SELECT (SELECT count(*) FROM live x JOIN live y ON {BATCH}) AS added, (SELECT count(*) FROM n) AS groups, 5 - (SELECT count(*) FROM n) AS skipped""",
    )
)
def ignore_batch_counts(spark, sf_dir):
    s, indexes = scan(spark, sf_dir), spark.range(6).filter("id < 3 OR id = 5").union(spark.range(10**9, 10**9 + 1)).toDF("index")
    return ignore.ignore_groups(dismissed(s.records), whole_report(spark, sf_dir), s.records.filter(GONE).select("id"), indexes, s.records, "later")[1]


@query("SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 20 WHERE x.doc_id % 20 = 0 UNION ALL SELECT doc_id, doc_id + 1 FROM documents WHERE doc_id % 10 = 1")
def ignore_pruned(spark, sf_dir):
    """The dismissed neighbours, written and pruned in place, and what was added after that."""
    home = f"{shared_home(spark)}/dismissals-{uuid.uuid4().hex}"
    records = catalog.document_catalog(spark, sf_dir)
    dismissals.append_ignored(dismissed(records), home)
    dismissals.prune_ignored(spark, home, records)
    dismissals.append_ignored(records.filter("id % 10 = 1").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), home)
    return dismissals.read_ignored(spark, home).select("a", "b")


@query("SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 20 WHERE x.doc_id % 10 = 0 AND x.doc_id % 30 <> 0")
def unignore(spark, sf_dir):
    entries = dismissed(catalog.document_catalog(spark, sf_dir))
    undone = entries.filter("a % 30 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return ignore.remove_ignored(entries, undone).select("a", "b")


@query(
    O.over(
        O.GROUPS,
        """, live AS (SELECT group_id, id FROM members WHERE id % 7 <> 0),
        n AS (SELECT g.group_id, (SELECT count(*) FROM live l WHERE l.group_id = g.group_id) AS n, keeper_id % 7 <> 0 AS k FROM kept g)
        SELECT group_id * 8 + c AS request, CASE WHEN n < 2 THEN 'group.already_merged' WHEN c = 1 THEN 'keeper.not_in_group' WHEN NOT k THEN 'keeper.missing'
          WHEN c = 2 THEN 'merge.nothing' WHEN c = 3 THEN 'source.is_keeper' WHEN c = 4 THEN 'source.not_in_group' END AS error FROM n, range(5) t(c)""",
    )
)
def plan_guards(spark, sf_dir):
    """Five requests for each group: as recommended; a keeper from elsewhere; no source; the keeper as source; a source from elsewhere."""
    s = scan(spark, sf_dir)
    none, far = F.lit(None).cast("array<bigint>"), F.lit(-7).cast("long")
    sources = F.array(none, none, F.array().cast("array<bigint>"), F.array("keeper_id"), F.array(far))
    keep = G.keepers(s.members)
    requests = keep.select("group_id", "keeper_id", F.posexplode(sources).alias("c", "source_ids")).select(
        (F.col("group_id") * 8 + F.col("c")).alias("request"), "group_id", F.when(F.col("c") == 1, far).otherwise(F.col("keeper_id")).alias("keeper_id"), "source_ids"
    )
    return ledger.request_errors(requests, s.members, s.members.filter("id % 7 <> 0"))


STEPS = "steps AS (SELECT group_id, m.id AS source_id, keeper_id, title, CASE WHEN m.id % 7 = 0 THEN 'merge.source_missing' WHEN keeper_id % 7 = 0 THEN 'merge.target_missing' END AS error FROM members m JOIN kept USING (group_id) WHERE m.id <> keeper_id)"


def _steps(s: Scan) -> tuple[DataFrame, DataFrame]:
    plan = ledger.merge_plan(s.members, G.keepers(s.members))
    steps = plan.select("source_id", F.col("keeper_id").alias("target_id"))
    return plan, ledger.step_status(steps, s.records.filter("id % 7 <> 0")).join(by_shuffle(plan.select("source_id", "group_id")), "source_id")


@query(O.over(O.GROUPS.strip() + ", " + STEPS, "SELECT group_id, CASE WHEN count(*) = count(*) FILTER (error = 'merge.source_missing') THEN 'group.already_merged' WHEN count(*) = count(error) THEN 'merge.failed' ELSE 'ok' END AS err FROM steps GROUP BY group_id"))
def merge_outcome(spark, sf_dir):
    return ledger.merge_outcome(_steps(scan(spark, sf_dir))[1], "group_id")


@query(O.over(O.GROUPS.strip() + ", " + STEPS, "SELECT index, source_id AS id, title, error FROM steps JOIN groups USING (group_id) WHERE error IS NOT NULL"))
def failed_titles(spark, sf_dir):
    s = scan(spark, sf_dir)
    plan, status = _steps(s)
    return ledger.failed_titles(ledger.merge_ledger(plan, whole_report(spark, sf_dir), "now", status))


@query(O.over(O.GROUPS, "SELECT 'now|' || count(*) AS signature FROM report"))
def report_signature(spark, sf_dir):
    return views.report_signature(whole_report(spark, sf_dir), "now")


@query(O.over(O.GROUPS, "SELECT 't1' AS task_id, 'now' AS generated_at, 'reports/1' AS path, count(*) AS group_count FROM report"))
def latest_marker(spark, sf_dir):
    """The pointer to the newest report, written and read back."""
    home = f"{shared_home(spark)}/latest-{uuid.uuid4().hex}"
    catalog.write_latest(spark, home, "t1", "now", "reports/1", whole_report(spark, sf_dir).count())
    return catalog.latest_report(spark, home, "t1", "now")


@query(
    "SELECT doc_id AS id, CASE WHEN s >= 1024 ** 4 THEN printf('%.1f TB', floor(s / 1024 ** 4 * 10 + 0.5) / 10) WHEN s >= 1024 ** 3 THEN printf('%.1f GB', floor(s / 1024 ** 3 * 10 + 0.5) / 10) "
    "WHEN s >= 1024 ** 2 THEN printf('%.1f MB', floor(s / 1024 ** 2 * 10 + 0.5) / 10) WHEN s >= 1024 THEN printf('%.1f KB', floor(s / 1024 * 10 + 0.5) / 10) ELSE s || ' B' END AS shown "
    "FROM (SELECT doc_id, n_chars * n_chars * (doc_id % 3 + 1) AS s FROM documents)"
)
def size_labels(spark, sf_dir):
    r = catalog.document_catalog(spark, sf_dir)
    return r.select("id", T.bytes_text(F.col("size") * F.col("size") * (F.col("id") % 3 + 1)).alias("shown"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 7 <> 0 END AS there FROM documents")
def record_existence(spark, sf_dir):
    """Ids that 7 divides are gone, and those that 11 divides can't be read."""
    r = catalog.document_catalog(spark, sf_dir)
    return ledger.existence(r.select("id"), r.filter("id % 7 <> 0"), r.filter("id % 11 = 0").select("id"))


# ---- libraries and files


FORMATS_OF = "CASE doc_id % 5 WHEN 0 THEN ['EPUB'] WHEN 1 THEN ['EPUB', 'PDF'] WHEN 2 THEN ['PDF'] WHEN 3 THEN ['MP3'] ELSE []::VARCHAR[] END"
STATES = f"""states AS (
  SELECT doc_id AS id, format, CASE WHEN state = 'readable' THEN strlen(coalesce(text, '')) END AS size, state
  FROM (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 19 = 0 THEN 'unreadable' ELSE 'readable' END AS state FROM (SELECT doc_id, text, unnest({FORMATS_OF}) AS format FROM documents))
)"""


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, format, size and state of the catalog's files, which are written from `documents`: ids that 13 divides have none, and those that 19 divides a folder instead."""
    root = f"{shared_home(spark)}/library-{uuid.uuid4().hex}"
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    wanted = catalog.document_catalog(spark, sf_dir).select("id", F.coalesce(F.get("authors", F.lit(0)), F.lit("unknown")).alias("author"), F.explode("formats").alias("format"))
    path = F.format_string("%s/book (%d)/book.%s", "author", "id", F.lower("format"))
    content = F.when(F.col("id") % 19 != 0, F.coalesce("text", F.lit("")))
    library.write_files(wanted.join(by_shuffle(texts), "id").filter("id % 13 <> 0").select(path.alias("path"), content.alias("content")), root)
    return stage(library.file_states(wanted.select(F.col("id").alias("book"), "format"), library.library_files(spark, root)), "file-states")


@query(f"WITH {STATES} SELECT * FROM states")
def file_states(spark, sf_dir):
    return document_files(spark, sf_dir).withColumnRenamed("book", "id")


@query(
    f"""WITH {STATES} SELECT 2::BIGINT AS missing, count(*) FILTER (state <> 'readable') AS no_format_path, sum(size)::BIGINT AS bytes,
    (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM states WHERE state = 'unreadable')) AS known FROM states"""
)
def file_notes(spark, sf_dir):
    """What a scan notes of the files: wanted records and files that are missing, the records' bytes, and records that are there for sure."""
    states = document_files(spark, sf_dir)
    raw = catalog.document_catalog(spark, sf_dir)
    notes = catalog.load_notes(raw, raw.select("id").union(spark.range(-2, 0)), states.filter("state = 'readable'").select("book", "format"))
    known = ledger.existence(raw.select("id"), raw, library.unreadable_books(states)).agg(F.count_if("there").alias("known"))
    sums = library.sized(raw, states).agg(F.sum("size").alias("bytes"))
    one = lambda f: f.withColumn("one", F.lit(1))
    return one(notes).join(one(sums), "one").join(one(known), "one").drop("one")


@query(
    O.over(
        O.CATALOG,
        """SELECT id, title, array_to_string(authors, ',') AS authors, array_to_string(formats, ',') AS formats, CASE WHEN len(formats) = 0 THEN 0 ELSE size END AS size, array_to_string(languages, ',') AS languages,
        rating, has_cover, added, isbn FROM catalog""",
    )
)
def library_reader(spark, sf_dir):
    """The catalog, written as a library of databases and read back in ranges of ids."""
    home = f"{shared_home(spark)}/databases-{uuid.uuid4().hex}"
    sqlite.write_library(catalog.document_catalog(spark, sf_dir), home)
    rows = catalog.load_records(sqlite.read_library(spark, home, rows=200))
    return rows.select("id", "title", joined("authors").alias("authors"), joined("formats").alias("formats"), "size", joined("languages").alias("languages"), "rating", "has_cover", "added", "isbn")
