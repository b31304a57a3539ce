"""SQL fragments (DuckDB) that restate the engine's results plainly: brute force instead of joins on grams."""

from __future__ import annotations

from colophon.functions import text as T
from colophon.functions.metadata import UNKNOWN_AUTHORS

DROPPED = r"[\p{P}\p{Z}\s]"
NOTES = r"(?:[（(\[][^）)\]]*[）)\]]\s*)+$"


def key(x: str) -> str:
    return f"lower(regexp_replace({x}, '{DROPPED}', '', 'g'))"


def core(x: str) -> str:
    return f"regexp_replace(trim({x}), '{NOTES}', '')"


def family(x: str) -> str:
    return (
        f"CASE WHEN lower({x}) IN ('m4b','mp3','m4a','opus','ogg','flac') THEN 'audiobook' WHEN lower({x}) IN ('cbz','cbr','cb7','cbx') THEN 'comic' "
        f"WHEN lower({x}) IN ('epub','pdf','mobi','azw','azw3','fb2','kepub','txt','docx') THEN 'ebook' ELSE 'unknown' END"
    )


def plain_isbn(x: str) -> str:
    return f"nullif(upper(regexp_replace({x}, '[^0-9Xx]', '', 'g')), '')"


def _digits(v: str, n: int, weight: str) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: (CASE WHEN substr({v}, i, 1) = 'X' THEN 10 ELSE coalesce(try_cast(substr({v}, i, 1) AS INT), 0) END) * {weight}))"


def valid10(v: str) -> str:
    return f"coalesce(regexp_full_match({v}, '[0-9]{{9}}[0-9X]') AND {_digits(v, 10, '(11 - i)')} % 11 = 0, false)"


def valid13(v: str) -> str:
    return f"coalesce(regexp_full_match({v}, '97[89][0-9]{{10}}') AND {_digits(v, 13, '(CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)')} % 10 = 0, false)"


def to13(v: str) -> str:
    body = f"('978' || substr({v}, 1, 9))"
    return f"({body} || ((10 - {_digits(body, 12, '(CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)')} % 10) % 10)::BIGINT::VARCHAR)"


def isbn_key(x: str) -> str:
    v = plain_isbn(x)
    return f"CASE WHEN {valid13(v)} THEN {v} WHEN {valid10(v)} THEN {to13(v)} END"


def serial(x: str) -> str:
    return f"(len({x}) BETWEEN 1 AND 16 AND regexp_matches({x}, '{T.SERIAL}'))"


def serial_note(x: str) -> str:
    return f"(len({x}) > 0 AND regexp_matches({x}, '{T.SERIAL_NOTE}'))"


def head(a: str, b: str) -> str:
    short = f"least(len({a}), len({b}))"
    return f"coalesce(nullif(coalesce(list_position(list_transform(range(1, {short} + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1)), false), 0), 0) - 1, {short})"


def by_serial(a: str, b: str) -> str:
    h = head(a, b)
    ra, rb = f"substr({a}, {h} + 1)", f"substr({b}, {h} + 1)"
    start = f"greatest(len({a}), len({b}), 16) - 16"
    far = f"{a} = {b} OR len({a}) < 2 OR len({b}) < 2 OR abs(len({a}) - len({b})) > 16 OR substr({a}, 1, {start}) <> substr({b}, 1, {start})"
    return f"CASE WHEN {far} THEN false ELSE {h} >= 2 AND ({ra} = '' OR {serial(ra)}) AND ({rb} = '' OR {serial(rb)}) END"


def note(k: str, c: str) -> str:
    return f"(CASE WHEN {c} <> '' AND starts_with({k}, {c}) THEN substr({k}, len({c}) + 1) ELSE '' END)"


def rounded4(x: str) -> str:
    """Four decimals by the exact binary value, halves to even."""
    top = f"({x} * 134217729::DOUBLE - ({x} * 134217729::DOUBLE - {x}))"
    product = f"({x} * 20000::DOUBLE)"
    lost = f"(({top} * 20000::DOUBLE - {product}) + ({x} - {top}) * 20000::DOUBLE)"
    n = f"floor({product})::BIGINT"
    half = f"CASE WHEN {lost} > 0 THEN {n} // 2 + 1 WHEN {lost} < 0 THEN {n} // 2 ELSE {n} // 2 + ({n} // 2) % 2 END"
    return f"(CASE WHEN {product} = {n} AND {n} % 2 = 1 THEN {half} ELSE ({n} + 1) // 2 END)::DOUBLE / 10000::DOUBLE"


def gram_size(x: str) -> str:
    cjk = f"len(regexp_replace({x}, '[^{T.CJK}]', '', 'g'))"
    return f"CASE WHEN {cjk} > 0 AND {cjk} >= 0.3::DOUBLE * len({x}) THEN 2 ELSE 3 END"


def grams(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) = 0 THEN []::VARCHAR[] WHEN len({x}) < {n} THEN [{x}] ELSE list_transform(range(1, len({x}) - {n} + 2), lambda i: substr({x}, i, {n})) END"


def dice(a: str, b: str, n: int) -> str:
    ga, gb = f"({grams(a, n)})", f"({grams(b, n)})"
    both = f"coalesce(list_sum(list_transform(list_distinct({ga}), lambda g: least(len(list_filter({ga}, lambda x: x = g)), len(list_filter({gb}, lambda y: y = g))))), 0)"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both}::DOUBLE * 2 / (len({ga}) + len({gb})) END"


def squeezed(x: str) -> str:
    """RE2 has no back references: keep a character that differs from the one before."""
    return f"list_aggregate(list_transform(list_filter(range(1, len({x}) + 1), lambda i: i = 1 OR substr({x}, i, 1) <> substr({x}, i - 1, 1)), lambda i: substr({x}, i, 1)), 'string_agg', '')"


def containment(a: str, b: str) -> str:
    sa, sb = (f"list_distinct({grams('coalesce(' + squeezed(x) + chr(44) + chr(39) * 2 + ')', 2)})" for x in (a, b))
    return f"CASE WHEN least(len({sa}), len({sb})) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({sa}, {sb}))::DOUBLE / least(len({sa}), len({sb})) END"


CATALOG = f"""
raw AS (
  SELECT d.doc_id AS id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, lpad(('0x' || substr(md5(d.text), 1, 7))::BIGINT::VARCHAR, 9, '0') AS body
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), checked AS (
  SELECT *, (11 - {_digits('body', 9, '(11 - i)')} % 11) % 11 AS c10,
    (10 - (38 + {_digits('body', 9, '(CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)')}) % 10) % 10 AS c13 FROM raw
), catalog AS (
  SELECT id, string_split(coalesce(text, ''), chr(10))[1] AS title, [source] AS authors, n_chars AS size, [lang] AS languages,
    coalesce(quality, 0)::DOUBLE AS rating, coalesce(toxic, 0) = 0 AS has_cover,
    CASE id % 5 WHEN 0 THEN ['EPUB'] WHEN 1 THEN ['EPUB', 'PDF'] WHEN 2 THEN ['PDF'] WHEN 3 THEN ['MP3'] ELSE []::VARCHAR[] END AS formats,
    CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS book_type, strftime(DATE '2024-01-01' + id::INT, '%Y-%m-%dT%H:%M:%S') AS added,
    CASE WHEN id % 3 = 0 THEN '' WHEN id % 17 = 0 THEN body || CASE WHEN (c10 + 1) % 11 = 10 THEN 'X' ELSE ((c10 + 1) % 11)::BIGINT::VARCHAR END
      WHEN id % 5 = 1 THEN '978-' || substr(body, 1, 1) || '-' || substr(body, 2, 3) || '-' || substr(body, 5, 5) || '-' || c13::BIGINT::VARCHAR
      ELSE body || CASE WHEN c10 = 10 THEN 'X' ELSE c10::BIGINT::VARCHAR END END AS isbn
  FROM checked
), present AS (
  SELECT *, {key('title')} AS title_key, {key(core('title'))} AS title_core_key, list_distinct(list_filter(list_transform(flatten(list_transform(authors, lambda a: string_split_regex(a, '{T.AUTHOR_SEPARATORS}'))), lambda a: {key('a')}), lambda k: k <> '')) AS author_keys,
    {isbn_key('isbn')} AS isbn_key, list_distinct(list_transform(formats, lambda f: {family('f')})) AS families,
    list_filter([CASE WHEN trim(title) = '' THEN 'title' END, CASE WHEN NOT named THEN 'authors' END, 'comments', CASE WHEN NOT has_cover THEN 'has_cover' END, CASE WHEN len(formats) = 0 THEN 'formats' END,
      CASE WHEN isbn = '' THEN 'isbn' END, 'publisher', 'pubdate', 'tags', 'series', CASE WHEN len(languages) = 0 THEN 'languages' END, CASE WHEN rating <= 0 THEN 'rating' END], lambda x: x IS NOT NULL) AS missing,
    CASE WHEN trim(title) = '' THEN 0 ELSE 3 END + CASE WHEN named THEN 3 ELSE 0 END + CASE WHEN has_cover THEN 2 ELSE 0 END + CASE WHEN len(formats) > 0 THEN 2 ELSE 0 END
      + CASE WHEN isbn <> '' THEN 1.5 ELSE 0 END + CASE WHEN len(languages) > 0 THEN 1 ELSE 0 END + CASE WHEN rating > 0 THEN 1 ELSE 0 END AS earned
  FROM (SELECT *, len(list_filter(authors, lambda a: trim(a) <> '' AND NOT regexp_matches(lower(a), '{UNKNOWN_AUTHORS}'))) > 0 AS named FROM catalog)
), prepared AS (SELECT * EXCLUDE (earned, named), floor(earned::DOUBLE / 21.0 * 100)::INT AS meta_score FROM present)
"""

#: Records beyond ASCII, of several authors, with notes and volume marks: id, title, authors, isbn, formats, book_type.
ODD_BOOKS = [
    (-1, "三体", ["刘慈欣"], "9787536692930", ["EPUB", "MOBI"], 0), (-2, "三体（全集）", ["刘慈欣"], "", ["EPUB", "PDF"], 0), (-3, "三体（全本）", ["刘慈欣"], "", ["AZW3"], 0),
    (-4, "To Live", ["余华"], "9787506365437", ["EPUB"], 0), (-5, "活着", ["余华"], "978-7-5063-6543-7", ["EPUB"], 0), (-6, "活着（精装）", ["余华"], "", [], 1),
    (-7, "活着", ["余华"], "", [], 1), (-8, "活着的意义", ["余华"], "", ["EPUB"], 0), (-9, "完全无关的书", ["另一个人"], "", ["EPUB"], 0),
    (-10, "德川家康（第一部）", ["山冈庄八"], "", ["EPUB"], 0), (-11, "德川家康（第十二部）", ["山冈庄八"], "", ["EPUB"], 0), (-12, "苗疆蛊事（全集）", ["南无袈裟理科佛"], "", ["EPUB"], 0),
    (-13, "苗疆蛊事1", ["南无袈裟理科佛"], "", ["EPUB"], 0), (-14, "苗疆蛊事", ["南无袈裟理科佛"], "", ["EPUB"], 0), (-15, "鲁迅全集（全20卷）", ["鲁迅"], "", ["EPUB"], 0),
    (-16, "鲁迅全集", ["鲁迅"], "", ["PDF"], 0), (-17, "天龙八部（一）", ["金庸"], "", ["EPUB"], 0), (-18, "天龙八部（一）", ["金庸"], "", ["PDF"], 0), (-19, "哈利波特 Harry Potter", ["罗琳", "J. K. Rowling"], "", ["EPUB"], 0),
    (-20, "哈利波特 Harry Pottet", ["J. K. Rowling & 马爱农"], "", ["EPUB"], 0), (-21, "我是猫(果麦经典)", ["夏目漱石"], "", ["EPUB"], 0), (-22, "我是猫", ["夏目漱石", "于雷"], "", ["EPUB"], 0),
    (-23, "鳄鱼怕怕牙医怕怕", ["五味太郎"], "", ["EPUB"], 0), (-24, "鳄鱼怕怕牙医怕", ["五味太郎"], "", ["EPUB"], 0), (-25, "The Economist [Thu, 16 Jun]", [], "", ["PDF"], 0),
    (-26, "The Economist [Thu, 23 Jun]", [], "", ["PDF"], 0), (-27, "The Illustrated Book of Everyday Things (revised)", [], "", ["PDF"], 0), (-28, "The Illustrated Book of Everyday Thing", [], "", ["EPUB"], 0),
    (-29, "The Illustrated Book of Everyday Things", ["unknown"], "", ["MP3"], 0), (-30, "Anthology", ["甲；乙", "丙"], "", ["EPUB"], 0), (-31, "Anthology (new edition)", ["乙", "丙"], "", ["EPUB"], 0), (-32, "?!", ["甲"], "", ["EPUB"], 0),
]


def _shown(x: object) -> str:
    return f"[{', '.join(map(_shown, x))}]::VARCHAR[]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)


_ODD = ", ".join("(" + ", ".join(map(_shown, r)) + ")" for r in ODD_BOOKS)
#: The catalog and the odd books with it.
MIXED = CATALOG.replace(
    "  FROM checked\n), present AS (",
    f"""  FROM checked UNION ALL
  SELECT id, title, authors, 1000 - id, []::VARCHAR[], 0::DOUBLE, false, formats, book_type, '2026-01-01T00:00:00', isbn FROM (VALUES {_ODD}) t(id, title, authors, isbn, formats, book_type)
), present AS (""",
)


def pairs_over(catalog: str, pinned: str = "false") -> str:
    """CTEs up to pairs (of records) and links (of classes); records for which `pinned` holds are classes of their own."""
    return f"""
{catalog}, m AS (SELECT id, title_key, title_core_key, isbn_key, book_type, unnest(CASE WHEN len(author_keys) > 0 THEN author_keys ELSE [''] END) AS block FROM prepared),
kk AS (
  SELECT DISTINCT x.title_key AS ka, x.title_core_key AS ca, y.title_key AS kb, y.title_core_key AS cb FROM m x JOIN m y ON x.block = y.block AND x.title_key < y.title_key WHERE x.title_key <> ''
), noted AS (SELECT *, ca <> '' AND cb <> '' AND (ca <> ka OR cb <> kb) AS cores FROM kk),
text_pairs AS (SELECT ka AS p, kb AS q FROM noted UNION SELECT least(ca, cb), greatest(ca, cb) FROM noted WHERE cores AND ca <> cb),
sized AS (SELECT p, q, least({gram_size('p')}, {gram_size('q')}) AS n FROM text_pairs),
wanted AS (SELECT p AS k, n FROM sized UNION SELECT q, n FROM sized),
grams_of AS (
  SELECT k, n, g, count(*) AS c FROM (SELECT k, n, unnest(CASE n WHEN 2 THEN {grams('k', 2)} ELSE {grams('k', 3)} END) AS g FROM wanted) GROUP BY k, n, g
), n_of AS (SELECT k, n, sum(c) AS total FROM grams_of GROUP BY k, n),
shared AS (
  SELECT p, q, s.n, sum(least(x.c, y.c)) AS common FROM sized s JOIN grams_of x ON x.k = p AND x.n = s.n JOIN grams_of y ON y.k = q AND y.n = s.n AND y.g = x.g GROUP BY p, q, s.n
), likeness AS (
  SELECT s.p, s.q, CASE WHEN s.n = 2 THEN least(coalesce(common, 0)::DOUBLE * 2 / (x.total + y.total), {containment('s.p', 's.q')}) ELSE coalesce(common, 0)::DOUBLE * 2 / (x.total + y.total) END AS score
  FROM sized s LEFT JOIN shared h ON h.p = s.p AND h.q = s.q JOIN n_of x ON x.k = s.p AND x.n = s.n JOIN n_of y ON y.k = s.q AND y.n = s.n
), scored AS (
  SELECT ka, ca, kb, cb, {by_serial('ka', 'kb')} AS serial, f.score AS full_score,
    CASE WHEN cores AND NOT ({serial_note(note('ka', 'ca'))} OR {serial_note(note('kb', 'cb'))} OR {by_serial('ca', 'cb')}) THEN CASE WHEN ca = cb THEN 1.0::DOUBLE ELSE c.score END END AS core_score
  FROM noted LEFT JOIN likeness f ON f.p = ka AND f.q = kb LEFT JOIN likeness c ON c.p = least(ca, cb) AND c.q = greatest(ca, cb)
), oriented AS (
  SELECT ka, ca, kb, cb, serial, CASE WHEN serial THEN 0.0::DOUBLE ELSE greatest(full_score, coalesce(core_score, 0)) END AS score FROM scored
  UNION ALL SELECT kb, cb, ka, ca, serial, CASE WHEN serial THEN 0.0::DOUBLE ELSE greatest(full_score, coalesce(core_score, 0)) END FROM scored
), tried AS (
  SELECT x.block, x.id AS a, y.id AS b, coalesce(serial, false) AS serial, CASE WHEN x.title_key = y.title_key THEN 1.0::DOUBLE ELSE score END AS score, x.book_type = y.book_type AS same_type,
    coalesce(x.isbn_key <> y.isbn_key, false) AS differs
  FROM m x JOIN m y ON x.block = y.block AND x.id < y.id
  LEFT JOIN oriented ON ka = x.title_key AND ca = x.title_core_key AND kb = y.title_key AND cb = y.title_core_key
  WHERE x.title_key <> '' AND y.title_key <> ''
), by_title AS (
  SELECT DISTINCT a, b, CASE WHEN differs THEN ['fuzzy_metadata'] ELSE ['fuzzy_metadata', 'weak_title_only'] END AS reasons, score AS similarity, same_type, differs
  FROM tried WHERE score >= 0.85
), by_isbn AS (
  SELECT x.id AS a, y.id AS b, ['isbn'] AS reasons, 1.0::DOUBLE AS similarity, x.book_type = y.book_type AS same_type
  FROM prepared x JOIN prepared y ON x.isbn_key = y.isbn_key AND x.id < y.id AND len(list_intersect(x.families, y.families)) > 0
), matches AS (SELECT * FROM by_isbn UNION ALL SELECT a, b, reasons, similarity, same_type FROM by_title),
pairs AS (
  SELECT a, b, CASE WHEN list_contains(r, 'isbn') THEN ['isbn'] ELSE r END AS reasons, similarity
  FROM (SELECT a, b, list_sort(list_distinct(flatten(list(reasons)))) AS r, max(similarity) AS similarity FROM matches WHERE same_type GROUP BY a, b)
), title_class AS (
  SELECT id, min(id) OVER (PARTITION BY list_sort(author_keys), title_key, title_core_key, book_type, CASE WHEN {pinned} THEN id END) AS rep FROM prepared
), isbn_class AS (
  SELECT id, min(id) OVER (PARTITION BY isbn_key, list_sort(families), book_type, CASE WHEN {pinned} THEN id END) AS rep FROM prepared WHERE isbn_key IS NOT NULL
), links AS (
  SELECT 'isbn' AS kind, least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, ['isbn'] AS reasons, 1.0::DOUBLE AS similarity, count(*) AS n_pairs
  FROM pairs JOIN isbn_class x ON x.id = pairs.a JOIN isbn_class y ON y.id = pairs.b WHERE list_contains(reasons, 'isbn') GROUP BY 2, 3
  UNION ALL SELECT 'title', least(x.rep, y.rep), greatest(x.rep, y.rep), list_sort(list_distinct(flatten(list(reasons)))), max(similarity), count(*)
  FROM pairs JOIN title_class x ON x.id = pairs.a JOIN title_class y ON y.id = pairs.b WHERE NOT list_contains(reasons, 'isbn') GROUP BY 2, 3
)
"""


PAIRS = pairs_over(CATALOG)


def groups_over(pairs: str) -> str:
    return f"""
{pairs}, edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, b AS r FROM edges UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.r),
components AS (SELECT id, least(id, min(r)) AS group_id FROM reach GROUP BY id),
members AS (SELECT c.group_id, p.* FROM components c JOIN prepared p ON p.id = c.id),
found AS (
  SELECT c.group_id, list_reverse_sort(list_distinct(flatten(list(list_transform(reasons, lambda x: (CASE x WHEN 'isbn' THEN '3' WHEN 'fuzzy_metadata' THEN '1' ELSE '0' END) || x))))) AS r,
    {rounded4('max(similarity)')} AS max_similarity
  FROM pairs JOIN components c ON c.id = pairs.a GROUP BY c.group_id
), totals AS (
  SELECT group_id, list_sort(list(id)) AS ids, count(*) AS member_count, sum(size)::BIGINT AS bytes_total, max(size) AS bytes_max FROM members GROUP BY group_id
), tiers AS (
  SELECT t.*, list_transform(r, lambda x: substr(x, 2)) AS reasons, substr(r[1], 1, 1)::INT AS rank, max_similarity,
    CASE WHEN substr(r[1], 1, 1) = '3' THEN 'strong' WHEN max_similarity >= 0.95 AND substr(r[1], 1, 1) = '1' THEN 'likely' ELSE 'weak' END AS confidence
  FROM totals t JOIN found USING (group_id)
), groups AS (
  SELECT *, (row_number() OVER (ORDER BY rank DESC, member_count DESC, max_similarity DESC, group_id) - 1)::BIGINT AS index FROM tiers
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY meta_score DESC, len(formats) DESC, size DESC, added, id) AS place FROM members
), kept AS (SELECT group_id, id AS keeper_id, formats AS kept_formats FROM ranked WHERE place = 1),
bytes_of AS (
  SELECT group_id, keeper_id, sum(CASE WHEN id <> keeper_id THEN size ELSE 0 END)::BIGINT AS reclaimable_bytes,
    sum(CASE WHEN id <> keeper_id AND len(formats) > 0 AND list_has_all(kept_formats, formats) THEN size ELSE 0 END)::BIGINT AS disk_waste_bytes
  FROM members JOIN kept USING (group_id) GROUP BY group_id, keeper_id
), report AS (SELECT g.*, keeper_id, reclaimable_bytes, disk_waste_bytes FROM groups g JOIN bytes_of USING (group_id))
"""


GROUPS = groups_over(PAIRS)


def over(ctes: str, select: str) -> str:
    """The select (which may start with more CTEs, after a comma) over the CTEs."""
    return f"WITH RECURSIVE {ctes.strip()} {select}" if "reach AS" in ctes else f"WITH {ctes.strip()} {select}"


def values(rows: list[tuple], names: list[str]) -> str:
    """A CTE `v` of literal rows."""
    shown = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"v({', '.join(names)}) AS (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)})"
