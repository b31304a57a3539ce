"""Candidate pairs, as links between classes of records.

Records that no rule tells apart form a class, represented by the smallest id: for titles those with equal
authors, title and core keys and book type, for ISBNs those with equal ISBN, format families and book type. A
link stands for all pairs between two classes (or inside one) and has their number, so that copies are
never expanded. `record_pairs` lists the pairs where they are wanted.

Titles are compared once for each pair of distinct keys of a block (author). Key pairs come from joins on the rarest
n-grams of each key, with lossless prefix, length and parity filters; only they are scored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions import gram_sets as S
from colophon.functions import text as T
from colophon.functions.metadata import DEFAULT_THRESHOLD
from colophon.operators.components import by_shuffle, discard, stage

#: Sets of so many grams fill a small sketch; those have a second one of so many words.
MANY_GRAMS, WIDE_WORDS = S.MANY, S.WIDE_WORDS


#: A class of sizes spans so many times (as a power) what two similar sets can differ by: more, and fewer rows move but more meet.
SPAN = 2


def _pinned(records: DataFrame, pinned: DataFrame | None) -> DataFrame:
    """Adds pin: the id as text of records that must stay alone in their class, else ''."""
    if pinned is None:
        return records.withColumn("pin", F.lit(""))
    ids = pinned.select("id").distinct().withColumn("__pinned", F.lit(True))
    return records.join(by_shuffle(ids), "id", "left").withColumn("pin", F.when(F.col("__pinned"), F.col("id").cast("string")).otherwise("")).drop("__pinned")


def _type(c: str = "book_type") -> Column:
    return F.col(c) > 0


def title_classes(records: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """id, rep (the class), author_keys, title_key, title_core_key, physical, isbn_key and families of every record."""
    rows = _pinned(records, pinned).select(
        "id", F.array_sort("author_keys").alias("author_keys"), "title_key", "title_core_key", _type().alias("physical"), "pin", "isbn_key", F.array_sort("families").alias("families")
    )
    by = ["author_keys", "title_key", "title_core_key", "physical", "pin"]
    return stage(rows.join(by_shuffle(rows.groupBy(*by).agg(F.min("id").alias("rep"))), by).drop("pin"), "title-classes")


def isbn_classes(records: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """id, rep, isbn_key, families and physical of every record with a valid ISBN."""
    rows = _pinned(records, pinned).filter("isbn_key IS NOT NULL").select("id", "isbn_key", F.array_sort("families").alias("families"), _type().alias("physical"), "pin")
    by = ["isbn_key", "families", "physical", "pin"]
    return stage(rows.join(by_shuffle(rows.groupBy(*by).agg(F.min("id").alias("rep"))), by).drop("pin"), "isbn-classes")


def isbn_links(classes: DataFrame) -> DataFrame:
    """a <= b (classes), same_type, n_pairs: records that share a valid ISBN and a format family."""
    each = classes.groupBy("rep", "isbn_key", "families", "physical").agg(F.count("*").alias("n"))
    side = lambda s: each.select("isbn_key", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "families", "physical", "n")])
    joined = side("a").join(by_shuffle(side("b")), "isbn_key").filter("rep_a <= rep_b AND arrays_overlap(families_a, families_b)")
    return _links(joined, "rep_a", "rep_b", "n_a", "n_b", "physical_a", "physical_b").filter("n_pairs > 0")


def _links(rows: DataFrame, a: str, b: str, n_a: str, n_b: str, type_a: str, type_b: str, *more: Column) -> DataFrame:
    inside = (F.col(n_a) * (F.col(n_a) - 1) / 2).cast("long")
    pairs = F.when(F.col(a) == F.col(b), inside).otherwise(F.col(n_a) * F.col(n_b))
    return rows.select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col(type_a) == F.col(type_b)).alias("same_type"), pairs.alias("n_pairs"), *more)


def _with_blocks(rows: DataFrame) -> DataFrame:
    """A row for each author key; rows without one share the block ''."""
    return rows.withColumn("block", F.explode(F.when(F.size("author_keys") > 0, F.col("author_keys")).otherwise(F.array(F.lit("")))))


def bucket_sizes(records: DataFrame, max_bucket: int | None = None) -> DataFrame:
    """block, size and skipped of every block; none is skipped without a max_bucket."""
    skipped = F.lit(False) if max_bucket is None else F.col("size") > max_bucket
    return _with_blocks(records.select("author_keys")).groupBy("block").agg(F.count("*").alias("size")).withColumn("skipped", skipped)


def open_blocks(classes: DataFrame, max_bucket: int | None = None) -> DataFrame:
    """block, rep, n, title_key, title_core_key, physical: the titled classes of blocks that are compared."""
    each = classes.groupBy("rep", "author_keys", "title_key", "title_core_key", "physical").agg(F.count("*").alias("n"))
    usable = bucket_sizes(classes, max_bucket).filter("size > 1 AND NOT skipped").select("block")
    # a row for each block; blocks are few and large, so this join is left to Spark
    return _with_blocks(each).filter("title_key <> ''").join(usable, "block").drop("author_keys")


def _serial_cuts(keys: DataFrame) -> DataFrame:
    """A row for each prefix of a key after which at most a volume mark follows: the columns of keys, prefix and next (the character after it).

    Two keys of a block differ by a mark only if they have such a prefix in common and next differs there; that is
    exactly one prefix.
    """
    n = F.length("title_key")
    cut = keys.filter(n >= 2).withColumn("p", F.explode(F.sequence(F.greatest(F.lit(2), n - T.SERIAL_LONGEST), n)))
    rest = F.substring(F.col("title_key"), F.col("p") + 1, n)
    cut = cut.filter((rest == "") | T.is_serial(rest))
    return cut.withColumns({"prefix": F.substring(F.col("title_key"), F.lit(1), F.col("p")), "next": F.substring(rest, 1, 1)}).drop("p")


def serial_key_pairs(keys: DataFrame) -> DataFrame:
    """block, key_a < key_b of keys that differ by a volume mark only; an equi-join on shared prefixes, for series of few volumes.

    keys: block, title_key (distinct).
    """
    cut = _serial_cuts(keys.select("block", "title_key")).select("block", "title_key", "prefix", "next")
    right = cut.toDF("block", "key_b", "prefix", "next_b")
    return cut.join(by_shuffle(right), ["block", "prefix"]).filter("title_key < key_b AND next <> next_b").select("block", F.col("title_key").alias("key_a"), "key_b")


def serial_pair_count(keys: DataFrame) -> DataFrame:
    """skipped_serial: how many pairs of records differ by a volume mark only, without listing them.

    keys: block, title_key (distinct), m (its records). Of the records under a prefix, those with the same next character
    make no pair: the pairs are half of the square of all less the squares of each next's.
    """
    square = lambda c: F.col(c).cast("decimal(19,0)") * F.col(c).cast("decimal(19,0)")
    alike = _serial_cuts(keys).groupBy("block", "prefix", "next").agg(F.sum("m").alias("m"))
    under = alike.groupBy("block", "prefix").agg(F.sum("m").alias("m"), F.sum(square("m")).alias("same"))
    pairs = F.sum(((square("m") - F.col("same")) / 2).cast("decimal(38,0)"))
    return under.agg(F.coalesce(pairs, F.lit(0)).cast("long").alias("skipped_serial"))


def _texts(keys: DataFrame) -> DataFrame:
    """block, text, is_key, is_core and n (gram size) of every text to compare, numbered by tid.

    Two texts are compared by 2-grams if either of them is mostly CJK, else by 3-grams.
    """
    flags = lambda c, key: keys.filter(F.col(c) != "").select("block", F.col(c).alias("text"), F.lit(key).alias("is_key"), F.lit(not key).alias("is_core"))
    noted = keys.filter("title_core_key <> title_key").select("block").distinct()
    cores = flags("title_core_key", False).join(noted, "block", "left_semi")
    each = flags("title_key", True).union(cores).groupBy("block", "text").agg(F.max("is_key").alias("is_key"), F.max("is_core").alias("is_core"))
    each = stage(each.withColumn("own", T.gram_size(F.col("text"))), "texts")
    han = each.groupBy("block").agg(F.min("own").alias("least")).filter("least = 2").select("block", F.lit(True).alias("han"))
    sizes = F.when(F.col("own") == 2, F.array(F.lit(2))).when(F.col("han"), F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(3)))
    rows = each.join(han, "block", "left").withColumn("n", F.explode(sizes)).drop("han")
    out = stage(rows.withColumn("tid", F.monotonically_increasing_id()), "texts")
    discard(each)
    return out


def _wide_sketches(sets: DataFrame) -> DataFrame:
    """tid, m and wide (the parity sketch of WIDE_WORDS words) of sets of MANY_GRAMS or more.

    sets: tid, m and wide, or grams that it is made of.
    """
    if "wide" in sets.columns:
        return sets.filter("wide IS NOT NULL").select("tid", "m", "wide")
    many = sets.filter(F.col("m") >= MANY_GRAMS)
    h, words = F.xxhash64("gram"), F.lit(WIDE_WORDS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.call_function("div", h, words), F.lit(64)).cast("int"))
    bits = many.select("tid", "m", F.explode("grams").alias("gram")).select("tid", "m", F.pmod(h, words).cast("int").alias("word"), bit.alias("bit"))
    # a row for each word, so that none is missing
    none = many.select("tid", "m", F.explode(F.sequence(F.lit(0), words - 1)).alias("word"), F.lit(0).cast("long").alias("bit"))
    each = bits.union(none).groupBy("tid", "m", "word").agg(F.bit_xor("bit").alias("bit"))
    return stage(each.groupBy("tid", "m").agg(F.sort_array(F.collect_list(F.struct("word", "bit"))).alias("s")).select("tid", "m", F.col("s.bit").alias("wide")), "sketches")


def _possible(found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs of found(tid_a, tid_b) that wide sketches don't rule out, so that few long texts move."""
    wide = _wide_sketches(sets)
    side = lambda s: wide.toDF(f"tid_{s}", f"m_{s}", f"wide_{s}")
    both = found.join(by_shuffle(side("a")), "tid_a", "left").join(by_shuffle(side("b")), "tid_b", "left")
    differing = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    fits = differing <= (F.col("m_a") + F.col("m_b")) * (1 - threshold) + 1e-9
    return both.filter(F.coalesce(fits, F.lit(True))).select("tid_a", "tid_b")


def _at_least(m: int, threshold: float) -> int:
    """The smallest set that one of m tokens can be similar to, and as many tokens are shared with it."""
    return math.ceil(m * threshold / (2 - threshold) - 1e-9)


def _found(sets: DataFrame, threshold: float) -> DataFrame:
    """tid_a < tid_b of sets (see gram_sets) of a block, parts of which share one of their rarest tokens and may be similar enough.

    The larger part of two, of m and s <= m tokens, looks for the smaller one. They share threshold * (m + s) / 2 tokens or more, so one is
    among the first m + 1 less that number of the larger part, and, as s <= m, among the first s + 1 - threshold * s of the smaller. Parts are
    dealt into classes of size: the larger looks into each class that may have a partner, with the tokens that the class asks
    for. What is left behind the first token that both have must do for the overlap; a pair is kept if that place rules nothing out.
    """
    words = [f"w{i}" for i in range(S.WORDS)]
    ratio = max(((2 - threshold) / threshold) ** SPAN, 1.02)
    size_class = lambda m: F.floor(F.log(m.cast("double")) / math.log(ratio)).cast("int")
    overlap = lambda m, s: F.ceil((m + s) * (threshold / 2) - 1e-9)
    m, least = F.col("size"), F.ceil(F.col("size") * threshold / (2 - threshold) - 1e-9)
    smallest = F.greatest(least, F.floor(F.pow(F.lit(ratio), F.col("class")) - 1e-6))

    def side(s: str, classes: Column, shared: Column) -> DataFrame:
        rows = sets.withColumn("class", classes)
        rows = rows.select("tid", "block", "n", "part", "size", *words, "class", F.posexplode(F.slice("first", F.lit(1), (m - shared + 1).cast("int"))).alias("at", "gram"))
        # one small number to send and sort by; what it lets through is dropped by sizes and sketches, or where pairs are confirmed
        return rows.select(F.hash("block", "n", "part", "class", "gram").alias("key"), *[F.col(c).alias(f"{c}_{s}") for c in ("tid", "size", "at", *words)])

    asked, own = side("x", F.explode(F.sequence(size_class(least), size_class(m))), overlap(m, smallest)), side("y", size_class(m), overlap(m, m))
    x, y = F.col("size_x"), F.col("size_y")
    larger = (x > y) | ((x == y) & (F.col("tid_x") > F.col("tid_y")))
    left = F.least(x - F.col("at_x"), y - F.col("at_y")) * 2.0 >= (x + y) * threshold - 1e-9
    differing = sum((F.bit_count(F.col(f"{w}_x").bitwiseXOR(F.col(f"{w}_y"))) for w in words), F.lit(0))
    met = asked.join(by_shuffle(own), "key").filter(larger & left & (differing <= (x + y) * (1 - threshold) + 1e-9))
    return met.select(F.least("tid_x", "tid_y").alias("tid_a"), F.greatest("tid_x", "tid_y").alias("tid_b")).distinct()


def near_texts(texts: DataFrame, threshold: float, temporary: list[DataFrame] | None = None) -> DataFrame:
    """Pairs of texts of a block whose n-gram Dice reaches the threshold: tid_a < tid_b and dice. `temporary` takes the tables that are read.

    texts: tid, block, n, text. Repeated grams are numbered, so multisets become sets. Each set is ordered by how rare its tokens
    are; two sets that are similar enough share one of their first few (Chaudhuri et al., 2006). A text's set is made where the text
    is read, and only its first tokens move. Of the pairs found that way, those whose sizes, places or parity sketches rule the
    threshold out are dropped in the join: a sketch has a bit for the parity of the tokens of each hash value, so differing
    bits are at most differing tokens. Long texts have a second, wider sketch, which pairs are held against before texts are sent to them.
    What is left is confirmed on the texts.
    """
    sets = stage(S.gram_sets(texts, lambda m: _at_least(m, threshold)), "grams")
    if temporary is not None:
        temporary.append(sets)
    found = _possible(_found(sets, threshold), sets, threshold)
    side = lambda s: texts.select(F.col("tid").alias(f"tid_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("block", "n", "text")])
    # keys of the join are hashes: the block is confirmed too
    both = found.join(by_shuffle(side("a")), "tid_a").join(by_shuffle(side("b")), "tid_b").filter("block_a = block_b AND n_a = n_b")
    return both.select("tid_a", "tid_b", S.dice("text_a", "text_b", "n_a").alias("dice")).filter(F.col("dice") >= threshold - 1e-9)


def scored_keys(keys: DataFrame, threshold: float) -> DataFrame:
    """block, key_a, core_a, key_b, core_b, score of different title keys that reach the threshold.

    keys: block, title_key, title_core_key (distinct). Where the keys themselves decide, the cores are null: any will do.
    """
    texts, made = _texts(keys), []
    side = lambda s: texts.select(F.col("tid").alias(f"tid_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("text", "own", "is_key", "is_core")])
    found = near_texts(texts, threshold, made).join(by_shuffle(side("a")), "tid_a").join(by_shuffle(texts.select(F.col("tid").alias("tid_b"), "block", "n", *[F.col(c).alias(f"{c}_b") for c in ("text", "own", "is_key", "is_core")])), "tid_b")
    a, b = F.col("text_a"), F.col("text_b")
    # between texts one of which is mostly CJK containment limits the score
    value = F.when(F.col("n") == 2, F.least("dice", T.containment(a, b))).otherwise(F.col("dice"))
    near = found.filter("n = 3 OR own_a = 2 OR own_b = 2").select("block", "text_a", "text_b", "is_key_a", "is_key_b", "is_core_a", "is_core_b", value.alias("score"))
    near = stage(near.filter(F.col("score") >= threshold), "near-texts")
    for table in (texts, *made):
        discard(table)
    none = F.lit(None).cast("string")
    ka, kb, ca, cb = (F.col(c) for c in ("key_a", "key_b", "core_a", "core_b"))
    full = near.filter("is_key_a AND is_key_b").select("block", F.col("text_a").alias("key_a"), none.alias("core_a"), F.col("text_b").alias("key_b"), none.alias("core_b"), "score")
    cored = keys.filter("title_core_key <> ''")
    named = lambda s: cored.select("block", F.col("title_key").alias(f"key_{s}"), F.col("title_core_key").alias(f"core_{s}"))
    cores = near.filter("is_core_a AND is_core_b").select("block", F.col("text_a").alias("core_a"), F.col("text_b").alias("core_b"), "score")
    noted = cored.filter("title_core_key <> title_key").select("block", "title_core_key").distinct()
    equal = noted.select("block", F.col("title_core_key").alias("core_a"), F.col("title_core_key").alias("core_b"), F.lit(1.0).alias("score"))
    counted = T.is_serial_note(T.note_of(ka, ca)) | T.is_serial_note(T.note_of(kb, cb)) | T.differs_by_serial(ca, cb)
    by_core = cores.union(equal).join(by_shuffle(named("a")), ["block", "core_a"]).join(by_shuffle(named("b")), ["block", "core_b"])
    by_core = by_core.filter((ka != kb) & ((ca != cb) | (ka < kb)) & ((ca != ka) | (cb != kb)) & ~counted).select("block", "key_a", "core_a", "key_b", "core_b", "score")
    return full.union(by_core).filter(~T.differs_by_serial(ka, kb))


def title_links(classes: DataFrame, threshold: float = DEFAULT_THRESHOLD, max_bucket: int | None = None) -> DataFrame:
    """a <= b (classes of one author with similar titles), similarity, same_type, n_pairs, n_isbn and n_differ.

    n_isbn: pairs that share an ISBN and a format family; n_differ: pairs with two ISBNs that differ. Both are
    counted from how many records of a class have each ISBN.
    """
    members = stage(open_blocks(classes, max_bucket), "open-blocks")
    side = lambda s: members.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "title_key", "title_core_key")])
    same = members.select("block", F.col("rep").alias("rep_a"), "title_key").join(by_shuffle(members.select("block", F.col("rep").alias("rep_b"), "title_key")), ["block", "title_key"])
    same = same.filter("rep_a <= rep_b").select("rep_a", "rep_b", F.lit(1.0).alias("similarity"))
    scored = scored_keys(members.select("block", "title_key", "title_core_key").distinct(), threshold)
    for s in ("a", "b"):
        fits = F.col(f"core_{s}").isNull() | (F.col(f"core_{s}") == F.col(f"title_core_key_{s}"))
        scored = scored.join(by_shuffle(side(s).withColumnRenamed(f"title_key_{s}", f"key_{s}")), ["block", f"key_{s}"]).filter(fits).drop(f"title_core_key_{s}")
    near = scored.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"), F.col("score").alias("similarity"))
    best = same.union(near).groupBy("rep_a", "rep_b").agg(F.max("similarity").alias("similarity"))
    sizes = classes.groupBy("rep", "physical").agg(F.count("*").alias("n"), F.count("isbn_key").alias("coded"))
    named = lambda s: sizes.toDF(f"rep_{s}", f"physical_{s}", f"n_{s}", f"coded_{s}")
    rows = best.join(by_shuffle(named("a")), "rep_a").join(by_shuffle(named("b")), "rep_b")
    coded = F.when(F.col("rep_a") == F.col("rep_b"), (F.col("coded_a") * (F.col("coded_a") - 1) / 2).cast("long")).otherwise(F.col("coded_a") * F.col("coded_b"))
    links = stage(_links(rows, "rep_a", "rep_b", "n_a", "n_b", "physical_a", "physical_b", "similarity", coded.alias("coded")).filter("n_pairs > 0"), "title-links")
    hist = classes.filter("isbn_key IS NOT NULL").groupBy("rep", "isbn_key", "families").agg(F.count("*").alias("c"))
    held = lambda s: hist.toDF(s, "isbn_key", f"families_{s}", f"c_{s}")
    alike = links.filter("coded > 0").select("a", "b").join(by_shuffle(held("a")), "a").join(by_shuffle(held("b")), ["b", "isbn_key"])
    both, overlap = F.col("c_a") * F.col("c_b"), F.arrays_overlap("families_a", "families_b")
    # inside a class each pair comes twice, and each record meets itself, whose families are the same array
    alone = (F.col("a") == F.col("b")) & (F.col("families_a") == F.col("families_b"))
    both = F.when(alone, both - F.col("c_a")).otherwise(both)
    half = lambda x: F.when(F.col("a") == F.col("b"), (x / 2).cast("long")).otherwise(x)
    counts = alike.groupBy("a", "b").agg(F.sum(both).alias("same"), F.sum(F.when(overlap, both).otherwise(0)).alias("n_isbn"))
    counts = counts.select("a", "b", half(F.col("same")).alias("same"), half(F.col("n_isbn")).alias("n_isbn"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return links.join(by_shuffle(counts), ["a", "b"], "left").select(
        "a", "b", "similarity", "same_type", "n_pairs", none("n_isbn").alias("n_isbn"), (F.col("coded") - none("same")).alias("n_differ")
    )


def candidate_links(by_isbn: DataFrame, by_title: DataFrame) -> DataFrame:
    """kind, a <= b, reasons, similarity, n_pairs: what may be the same item; never across book types.

    Pairs that share an ISBN count as that alone, as the strongest reason; a title link has the others.
    """
    left = F.col("n_pairs") - F.col("n_isbn")
    weak = F.when(left > F.col("n_differ"), F.array(F.lit("fuzzy_metadata"), F.lit("weak_title_only"))).otherwise(F.array(F.lit("fuzzy_metadata")))
    isbn = by_isbn.filter("same_type").select(F.lit("isbn").alias("kind"), "a", "b", F.array(F.lit("isbn")).alias("reasons"), F.lit(1.0).alias("similarity"), "n_pairs")
    return isbn.union(by_title.filter("same_type AND n_pairs > n_isbn").select(F.lit("title"), "a", "b", weak, "similarity", left))


def memberships(titles: DataFrame, isbns: DataFrame) -> DataFrame:
    """kind, rep, id: the records of every class."""
    return isbns.select(F.lit("isbn").alias("kind"), "rep", "id").union(titles.select(F.lit("title"), "rep", "id"))


def matches(records: DataFrame, threshold: float = DEFAULT_THRESHOLD, max_bucket: int | None = None, pinned: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(title classes, ISBN classes, ISBN links, title links) of prepared records."""
    titles, isbns = title_classes(records, pinned), isbn_classes(records, pinned)
    return titles, isbns, isbn_links(isbns), title_links(titles, threshold, max_bucket)


def candidates(records: DataFrame, threshold: float = DEFAULT_THRESHOLD, max_bucket: int | None = None, pinned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, memberships) of prepared records; pinned(id) stay alone in their classes, so that their links are pairs."""
    titles, isbns, by_isbn, by_title = matches(records, threshold, max_bucket, pinned)
    return candidate_links(by_isbn, by_title), memberships(titles, isbns)


def candidate_pairs(records: DataFrame, threshold: float = DEFAULT_THRESHOLD, max_bucket: int | None = None) -> DataFrame:
    """The candidate links of prepared records."""
    return candidates(records, threshold, max_bucket)[0]


def record_pairs(records: DataFrame, threshold: float = DEFAULT_THRESHOLD, max_bucket: int | None = None) -> DataFrame:
    """a < b, reasons, similarity: every pair of records listed, for catalogs without large groups of copies."""
    every = records.select("id")
    return candidates(records, threshold, max_bucket, every)[0].select("a", "b", "reasons", "similarity")


def scan_stats(records: DataFrame, threshold: float = DEFAULT_THRESHOLD, max_bucket: int | None = None) -> DataFrame:
    """One row: comparisons, skipped_buckets, skipped_books, max_bucket, skipped_serial, skipped_cross_type.

    Comparisons are counted without listing pairs: all pairs of keyed members of a block, less serial ones.
    """
    titles, _, by_isbn, by_title = matches(records, threshold, max_bucket)
    return stats_of(titles, by_isbn, by_title, max_bucket)


def stats_of(titles: DataFrame, by_isbn: DataFrame, by_title: DataFrame, max_bucket: int | None) -> DataFrame:
    """The row of `scan_stats` from classes and links that were made already; pinned records leave the counts as they are."""
    sizes = bucket_sizes(titles, max_bucket).filter("size > 1").agg(
        F.count_if("skipped").alias("skipped_buckets"), F.coalesce(F.sum(F.when(F.col("skipped"), F.col("size"))), F.lit(0)).alias("skipped_books"),
        F.lit(max_bucket).cast("long").alias("max_bucket"),
    )
    members = open_blocks(titles, max_bucket).groupBy("block", "title_key").agg(F.sum("n").alias("m"))
    pairs = members.groupBy("block").agg(F.sum("m").alias("m")).agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0)).cast("long").alias("pairs"))
    skipped = serial_pair_count(members)
    crossing = by_isbn.filter("NOT same_type").select("n_pairs").union(by_title.filter("NOT same_type").select(F.col("n_pairs") - F.col("n_isbn")))
    cross = crossing.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("skipped_cross_type"))
    one = lambda f: f.withColumn("k", F.lit(1))
    joined = one(sizes).join(one(pairs), "k").join(one(skipped), "k").join(one(cross), "k")
    return joined.select((F.col("pairs") - F.col("skipped_serial")).alias("comparisons"), "skipped_buckets", "skipped_books", "max_bucket", "skipped_serial", "skipped_cross_type")
