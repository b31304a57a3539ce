"""Phrase collocation mining: SPAM-style compressed position bitmaps.

A task deals the texts that it reads into shards of one language. In a shard every word has a bitmap of the places where
it stands, pieces being parted by an empty place; a bitmap is compressed to its non-empty blocks of 16 places. A
phrase's bitmap marks the places of its last word: shifted by one and intersected (AND) with the bitmap of another
word, it becomes that of the phrase longer by that word, as no shift leads from one piece into the next. Phrases are
extended depth first, a class of prefixes at a time, so few bitmaps exist at once. What is shuffled is one popcount for each shard
and phrase, and Spark sums them.

A phrase can only reach the least count if the phrases inside it do. So there is a pass for each length, and a pass
extends only what a filter of the frequent phrases of the length before lets through. The filter is a Bloom filter
of fixed size (FILTER_BITS, 8 MB): it may let through too much, never too little, so counts are exact at any size.

Scores are whole numbers made from decimals of 38 digits. The best of each language are found by a tournament: windows
over many groups, then over fewer, so that no task ranks more than its share.

Defined results: a null text counts as empty, a null language as `und`; repeated rows count as often as they
stand there; equal scores are ordered by count, then by the phrase's bytes; an empty table gives an empty table.
Whole texts are read; a text is cut into parts of about STEP bytes, at ends of pieces only.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import slices, written

LEAST, MOST_WORDS, TOP, INSIDE_PERCENT = 10, 3, 2000, 50
#: A bit for each of two hashes of a frequent phrase; a power of two.
FILTER_BITS = 1 << 26
#: Places of all shards that a task holds, bytes of a part of a text, and bitmap blocks of a class of prefixes.
SHARD_PLACES, STEP, CLASS_BLOCKS = 1 << 21, 1 << 20, 1 << 16
BLOCK = 16
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
SPLIT = re.compile(b"[" + PIECE_ENDS + b"]")
#: Lower-cases A-Z and makes every end of a piece a newline.
PLAIN = bytes(10 if c in PIECE_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Groups in which the best are looked for, one round after the other.
ROUNDS = (256, 16, 1)


class _Numbers(dict):
    """Numbers words from 1 on."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class Shard:
    """Word numbers by place; 0 parts the pieces."""

    def __init__(self) -> None:
        self.numbers, self.places = _Numbers(), array("i", [0])

    def add(self, part: bytes) -> None:
        known = self.numbers.__getitem__
        for piece in part.translate(PLAIN).split(b"\n"):
            if words := piece.split():
                self.places.extend(map(known, words))
                self.places.append(0)


def parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about STEP bytes that end with pieces."""
    at = 0
    while at < len(text):
        end = SPLIT.search(text, at + STEP)
        yield text[at : end.end() if end else len(text)]
        at = end.end() if end else len(text)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def slots(hashes: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter for each phrase; hashes has those of its words, by place in the phrase."""
    h = np.zeros_like(hashes[0])
    for x in hashes:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def bit_of(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


class Bitmaps:
    """The compressed bitmaps of a shard's words: word, block and bits, ordered by block; first: where each block begins."""

    def __init__(self, places: np.ndarray, kept: np.ndarray):
        at = np.flatnonzero(kept[places])
        key = at // BLOCK * len(kept) + places[at]
        order = np.argsort(key)
        bit = np.left_shift(1, at % BLOCK).astype(np.uint32)[order]
        key = key[order]
        del at, order
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        self.bits = np.bitwise_or.reduceat(bit, begin) if len(begin) else bit
        key = key[begin]
        self.block, self.word = (key // len(kept)).astype(np.int32), (key % len(kept)).astype(np.int32)
        self.first = np.searchsorted(self.block, np.arange(len(places) // BLOCK + 3))

    def extended(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Shift and AND: node, word, block and bits of every phrase that is longer by a word. A shift may carry into the next block."""
        moved = bits << np.uint32(1)
        stay, carry = moved & np.uint32((1 << BLOCK) - 1), moved >> np.uint32(BLOCK)
        inside, over = stay > 0, carry > 0
        node, block, bits = np.concatenate([node[inside], node[over]]), np.concatenate([block[inside], block[over] + 1]), np.concatenate([stay[inside], carry[over]])
        begin = self.first[block]
        n = self.first[block + 1] - begin
        mine = np.repeat(np.arange(len(node)), n)
        other = np.arange(len(mine)) + np.repeat(begin - np.cumsum(n) + n, n)
        both = bits[mine] & self.bits[other]
        hit = np.flatnonzero(both)
        mine, other = mine[hit], other[hit]
        return node[mine], self.word[other], block[mine], both[hit]


Frequent = Callable[[np.ndarray], np.ndarray]


def extend(maps: Bitmaps, n_words: int, phrases: np.ndarray, node: np.ndarray, block: np.ndarray, bits: np.ndarray, length: int, frequent: dict[int, Frequent]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases of `length` words, popcounts) below the given ones, depth first; node: the row of `phrases` that a block belongs to."""
    words = phrases.shape[1] + 1
    for i in range(0, len(node), CLASS_BLOCKS):
        part = slice(i, i + CLASS_BLOCKS)
        above, word, at, left = maps.extended(node[part], block[part], bits[part])
        key, which = np.unique(above.astype(np.int64) * n_words + word, return_inverse=True)
        longer = np.column_stack([phrases[key // n_words], key % n_words])
        ok = frequent[words - 1](longer[:, 1:])
        if words == length:
            counts = np.bincount(which, np.bitwise_count(left), len(key)).astype(np.int64)
            yield longer[ok], counts[ok]
            continue
        ok &= frequent[words](longer)
        on = np.flatnonzero(ok[which])
        yield from extend(maps, n_words, longer[ok], (np.cumsum(ok) - 1)[which[on]], at[on], left[on], length, frequent)


def popcounts(shard: Shard, lang: str, length: int, tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """lang, phrase and a (places in the shard) of the phrases of `length` words that may be frequent; of words all, and their sum without a phrase."""
    listed = list(shard.numbers)
    words, places = pa.array(listed, pa.binary()), np.frombuffer(shard.places, np.int32)

    def batch(phrases: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [words.take(pa.array(phrases[:, i] - 1)) for i in range(phrases.shape[1])]
        joined = (pc.binary_join_element_wise(*columns, b" ") if len(columns) > 1 else columns[0]).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int8))), joined, pa.array(counts)], ["lang", "phrase", "a"])

    if length == 1:
        counts = np.bincount(places, minlength=len(listed) + 1)[1:]
        yield batch(np.arange(1, len(listed) + 1)[:, None], counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([int(counts.sum())])], ["lang", "phrase", "a"])
        return
    hashes = np.concatenate([np.zeros(1, np.uint64), word_hashes(listed, lang)])

    def filtered(table: np.ndarray) -> Frequent:
        def frequent(phrases: np.ndarray) -> np.ndarray:
            a, b = slots([hashes[phrases[:, i]] for i in range(phrases.shape[1])], len(table) * 64)
            return bit_of(table, a) & bit_of(table, b)

        return frequent

    frequent = {n: filtered(t) for n, t in tables.items()}
    numbers = np.arange(len(listed) + 1, dtype=np.int32)
    kept = frequent[1](numbers[:, None])
    kept[0] = False
    maps = Bitmaps(places, kept)
    order = np.argsort(maps.word, kind="stable").astype(np.int32)
    for phrases, counts in extend(maps, len(kept), numbers[:, None], maps.word[order], maps.block[order], maps.bits[order], length, frequent):
        if len(counts):
            yield batch(phrases, counts)


def _counted(texts: DataFrame, length: int, tables: dict) -> DataFrame:
    """lang, phrase, a: the popcounts of all shards summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        known = {n: t.value for n, t in tables.items()}
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, shard in shards.items():
                yield from popcounts(shard, lang, length, known)
            shards.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in parts(text):
                    shard = shards.setdefault(lang, Shard())
                    held -= len(shard.places)
                    shard.add(part)
                    held += len(shard.places)
                    if held >= SHARD_PLACES:
                        yield from counted()
                        held = 0
        yield from counted()

    return texts.mapInArrow(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _filter(frequent: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of the phrases of frequent(lang, phrase); bits / 64 rows at most reach the driver."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                phrases = batch.column(1).filter(pc.equal(batch.column(0), lang)).cast(pa.binary()).to_pylist()
                split = [p.split(b" ") for p in phrases]
                both = slots([word_hashes([p[i] for p in split], lang) for i in range(len(split[0]))], bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(both).astype(np.int64))], ["slot"])

    ors = frequent.select("lang", "phrase").mapInArrow(place, "slot long").groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    rows, table = ors.toArrow(), np.zeros(bits // 64, np.int64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return table.view(np.uint64)


def phrase_counts(documents: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, filter_bits: int | None = None) -> DataFrame:
    """lang, phrase, a, words of all phrases of up to most_words words that stand `least` times or more; words 0 with no phrase: all words of the language."""
    sc = documents.sparkSession.sparkContext
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    tables: dict = {}
    found = []
    for words in range(1, most_words + 1):
        counted = _counted(texts, words, dict(tables)).filter((F.col("a") >= least) | F.col("phrase").isNull())
        found.append(written(counted.withColumn("words", F.when(F.col("phrase").isNull(), 0).otherwise(words)), f"phrases-{words}"))
        if words < most_words:
            tables[words] = sc.broadcast(_filter(found[-1].filter("words > 0"), filter_bits or FILTER_BITS))
    whole = found[0]
    for f in found[1:]:
        whole = whole.union(f)
    return whole


def _best(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first `top` rows of each language and their rank: a tournament of ROUNDS."""
    for groups in ROUNDS:
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)))
        rows = ranked.filter(F.col("rank") <= top)
    return rows


def collocations(documents: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of two words or more whose words are bound the most.

    A phrase's score is that of its weakest cut. It is dropped if a longer one around it has inside_percent of its places or more.
    """
    counts = phrase_counts(documents, least, most_words)
    candidates = counts.filter("words > 1").select("lang", "phrase", "a", "words")
    listed = F.split("phrase", " ")
    part = lambda begin, n: F.array_join(F.slice(listed, begin, n), " ")
    k = F.col("k")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), k).alias("left"), part(k + 1, F.col("words")).alias("right"))
    known = counts.filter("words > 0")
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("a").alias(f)), ["lang", side])
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), exact("l") * exact("r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    longer = candidates.filter("words > 2").withColumn("n_inside", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n_inside") + 1)))
    around = longer.select("lang", part(F.col("begin"), F.col("n_inside")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    dropped = F.coalesce(F.col("around") * 100 >= F.col("a") * inside_percent, F.lit(False))
    left = scored.join(around, ["lang", "phrase"], "left").filter(~dropped).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = _best(left, [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    n = counts.filter("words = 0").select("lang", F.col("a").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT lang, ws, unnest([1, 2, 3]) AS k FROM w),
g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM s WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
x AS (
  SELECT u.lang, u.phrase, u.k, u.a, cut, fl.f AS l, fr.f AS r, ((1000000::HUGEINT * u.a * u.a) // (fl.f::HUGEINT * fr.f))::BIGINT AS score
  FROM u JOIN f fl ON fl.lang = u.lang AND fl.phrase = array_to_string(u.ws[1:cut], ' ') JOIN f fr ON fr.lang = u.lang AND fr.phrase = array_to_string(u.ws[cut + 1:], ' ')
), b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (
  SELECT lang, phrase, max(a) AS around
  FROM (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, a FROM (SELECT lang, ws, a, unnest([1, 2]) AS i FROM c WHERE k = 3)) GROUP BY lang, phrase
), d AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE k = 3 OR around IS NULL OR 100 * around < 50 * a)
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, d.phrase) AS rank, d.phrase, a, l, r, n, score
FROM d JOIN n ON n.lang = d.lang QUALIFY rank <= 2000
"""
