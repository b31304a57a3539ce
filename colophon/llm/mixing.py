"""Mixing sources to target weights: low-discrepancy source schedule.

Slot i of the mix takes the van der Corput point of i through the sources' cumulative weights, so every
stretch of the schedule holds the sources in proportion. A slot's rank among its source's slots is a
closed form (points of an aligned block of 2^k slots form a lattice, so those in an interval are counted,
not listed): the schedule needs no shuffle, sort or window. Slot of rank r takes the r-th of its source's
equal-token blocks, which are cut from the source's documents, shuffled by a digest, laid end to end and repeated.
`mixed_documents` returns its rows in the order of the slots in which they begin, so that a table written of them
holds the sources in proportion in every stretch of it.

Sources are rows of a table, however many: only sums over them reach the driver. Running totals of words come from sums over
buckets of each source, whose number grows with the square root of the rows, so that neither the buckets nor the list
of them become large.

Defined results: a null text has size 0; a document without words takes 0; a null source is a source of
its own, the last; equal rows are separate documents, in an order that makes them interchangeable; a
source without words has target 0; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import buckets_of, is_scan, numbered, slices, words_of, written

BLOCK_WORDS, MOST_EPOCHS = 1024, 3
#: Sources that are broadcast at most, those of a bucket of running totals, and multiples of a part of the schedule.
MOST_BROADCAST, SOURCES_A_BUCKET, PART = 100_000, 4096, 1024
#: Points are integers of so many bits, and so are the borders of the sources' intervals.
BITS = 46


def reversed_bits(i: np.ndarray) -> np.ndarray:
    """The van der Corput point of each i, times 2**BITS."""
    out, i = np.zeros_like(i), i.copy()
    for k in range(BITS):
        out |= ((i >> k) & 1) << (BITS - 1 - k)
    return out


def points_below(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many of the first n points lie below x / 2**BITS.

    The numbers below n fall into one aligned block of 2^k for each bit k of n; its points are the
    multiples of 2^-k, moved by the reversed higher bits of n.
    """
    total = np.zeros_like(n)
    for k in range(BITS):
        has = (n >> k) & 1
        if not has.any():
            continue
        base = (n >> (k + 1)) << (k + 1)
        step = BITS - k
        first = reversed_bits(base)
        count = (np.maximum(x - first, 0) + (1 << step) - 1) >> step
        total += has * np.minimum(count, 1 << k)
    return total


def _shares(sizes: DataFrame, most: float = MOST_EPOCHS) -> tuple[int, int]:
    """(left, weights): a source below its limit has the target left * weight / weights; any other has `most` times its size.

    All begin as sharing by weight; those that come above their limit leave with it, until none is above. Sharing what is
    left only raises the others, so none comes back, and each round is one sum over the sources.
    """
    total, weights = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    left, beyond = total, 0
    while True:
        over = F.lit(left) * F.col("weight") / F.lit(float(weights)) > F.col("source_size") * most
        kept = sizes.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(1))).first()
        if kept[0] == beyond:
            return left, weights
        beyond, left, weights = kept[0], total - most * kept[1], kept[2]


def _sources(sized: DataFrame) -> tuple[DataFrame, int]:
    """(sources, slots of the schedule): source, sid, source_size, target, take, slots, low, high and late, a written row for each source.

    sid: its place by code point, null last. low, high: its interval of points. late: a slot after the others, for a take that
    is too small for a point of its own; else -1. However many sources there are, only sums reach the driver.
    """
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sums")
    placed = numbered(sums, [F.asc_nulls_last("source")], "sid", "mix-places").withColumn("weight", (F.col("sid") % 3 + 1).cast("long"))
    left, weights = _shares(placed)
    most = F.col("source_size") * MOST_EPOCHS
    share = F.lit(left) * F.col("weight") / F.lit(float(weights))
    taken = placed.withColumn("target", F.when(share > most, most.cast("double")).otherwise(share))
    taken = taken.withColumn("take", F.least(F.floor(F.col("target") + 0.5), most))
    total = taken.agg(F.coalesce(F.sum("take"), F.lit(0))).first()[0]
    slots = -(-total // BLOCK_WORDS)
    bucket = _div(F.col("sid"), F.lit(SOURCES_A_BUCKET))
    edged = buckets_of(taken.withColumn("__order", F.col("sid")), bucket, [], {"edge": F.col("take")}).drop("__order")
    point = lambda edge: _div(edge.cast("decimal(18,0)") * F.lit(1 << BITS).cast("decimal(15,0)"), F.lit(max(1, total)).cast("decimal(18,0)"))
    edged = edged.select("source", "sid", "source_size", "target", "take", point(F.col("edge")).alias("low"), point(F.col("edge") + F.col("take")).alias("high"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("low", "high"))
            whole = np.full(len(low), slots, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(points_below(whole, high) - points_below(whole, low))], [*batch.schema.names, "slots"])

    kind = sized.schema["source"].dataType.simpleString()
    counted = edged.mapInArrow(count, f"source {kind}, sid long, source_size long, target double, take long, low long, high long, slots long")
    lacks = (F.col("take") > 0) & (F.col("slots") == 0)
    counted = buckets_of(counted.withColumn("__order", F.col("sid")), bucket, [], {"late": lacks.cast("long")}).drop("__order")
    late = F.when(lacks, F.col("late") + slots).otherwise(-1)
    return written(counted.withColumn("late", late).withColumn("slots", F.when(lacks, 1).otherwise(F.col("slots"))), "mix-sources"), slots


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, sid and rank: which source each slot of the mix takes, and its how-manieth block.

    The points of 2^k slots are the multiples of 2^-k, each of one slot, so a source's slots are a stretch of such
    multiples. Stretches are dealt in parts of PART multiples: a source with most of the slots is many parts.
    """
    bits = max(0, (slots - 1).bit_length())
    step = BITS - bits
    first = lambda border: F.shiftright(F.col(border) + ((1 << step) - 1), step)
    stretches = sources.filter("take > 0").select("sid", "low", "high", first("low").alias("begin"), first("high").alias("end")).filter("begin < end")
    part = F.explode(F.sequence(_div(F.col("begin"), F.lit(PART)), _div(F.col("end") - 1, F.lit(PART))))
    dealt = stretches.withColumn("part", part).repartition("sid", "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sid, low, high, begin, end, part = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            begin = np.maximum(begin, part * PART)
            n = np.minimum(end, (part + 1) * PART) - begin
            row = np.repeat(np.arange(len(n)), n)
            slot = reversed_bits(np.arange(len(row)) + np.repeat(begin - np.cumsum(n) + n, n)) >> step
            row, slot = row[slot < slots], slot[slot < slots]
            rank = points_below(slot, high[row]) - points_below(slot, low[row])
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sid[row]), pa.array(rank)], ["slot", "sid", "rank"])

    regular = dealt.mapInArrow(place, "slot long, sid long, rank long")
    return regular.union(sources.filter("late >= 0").select(F.col("late").alias("slot"), "sid", F.lit(0).cast("long").alias("rank")))


def _div(a: Column, b: Column) -> Column:
    """Whole division of non-negative longs, exact where a double would not be."""
    return F.call_function("div", a, b)


def mixed_pieces(documents: DataFrame, name: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix; `name` is the column that tells rows apart, doc_id and text decide their order.

    documents: name, source, size, source_size, target, sid, at (first word in its source's order).
    pieces: sid, at, name, size, epoch, slot, rank, start and length in words: what each slot takes.
    """
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sized = written(documents.select(name, "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.md5(said.cast("binary")).alias("digest")), "mix-sizes")
    sources, n_slots = _sources(sized)
    known = sources.select(F.col("source").alias("s"), "sid", "source_size", "target", "take", "slots")
    # a row a source: few are broadcast, by their counted number; more are joined by shuffle
    known = F.broadcast(known) if sources.count() <= MOST_BROADCAST else known
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # buckets are ranges of the digest, so their number does not change the order
    digits = max(1, min(6, round(math.log(max(sized.count(), 1), 16) / 2)))
    rows = rows.withColumn("__order", F.struct("digest", name, "size"))
    laid = buckets_of(rows, F.substring("digest", 1, digits), ["sid"], {"at": F.col("size")}).drop("__order", "digest")
    laid = written(laid, "mix-order")
    # the take of a source is cut into its number of blocks; the first `odd` of them hold a word more
    each, odd = _div(F.col("take"), F.col("slots")), F.col("take") % F.col("slots")
    edge = lambda r: r * F.col("each") + F.least(r, F.col("odd"))
    wide = F.col("odd") * (F.col("each") + 1)
    block_of = lambda w: F.when(w < wide, _div(w, F.col("each") + 1)).otherwise(F.col("odd") + _div(w - wide, F.greatest(F.col("each"), F.lit(1))))
    shown = (
        laid.filter("size > 0 AND take > 0")
        .withColumns({"each": each.cast("long"), "odd": odd.cast("long")})
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1))))
        .withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("at"))
        .filter("begin < take")
        .withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("take")))
        .withColumn("rank", F.explode(F.sequence(block_of(F.col("begin")), block_of(F.col("end") - 1))))
    )
    cut = shown.withColumn("from", F.greatest("begin", edge(F.col("rank")))).withColumn("to", F.least("end", edge(F.col("rank") + 1))).filter("from < to")
    slots = schedule(sources, n_slots).toDF("slot", "slot_sid", "slot_rank")
    pieces = cut.join(slots, (F.col("sid") == F.col("slot_sid")) & (F.col("rank") == F.col("slot_rank"))).select(
        "sid", "at", name, "size", "epoch", "slot", "rank", (F.col("from") - F.col("begin")).alias("start"), (F.col("to") - F.col("from")).alias("length")
    )
    return laid, pieces


def mix_report(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every document."""
    laid, pieces = mixed_pieces(documents)
    taken = pieces.groupBy("sid", "at", "doc_id", "size").agg(F.sum("length").alias("taken"))
    with_words = laid.filter("size > 0").join(
        taken.toDF("t_sid", "t_at", "t_doc", "t_size", "taken"), (F.col("sid") == F.col("t_sid")) & (F.col("at") == F.col("t_at")), "left"
    )
    columns = ["doc_id", "size", "source_size", "target"]
    return with_words.select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(
        laid.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents as the mix takes them, all columns: a row for each time, the last of a source cut at the target.

    A document taken 2.4 times is there twice whole and once with its first words; n_chars follows the text. Rows come
    in the order of the slots in which they begin.
    """
    columns = documents.columns
    # rows are told apart by their place in the table's files, or by a number that is fixed by writing it
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    if is_scan(documents):
        numbered = documents.select(whole, F.struct("_metadata.file_path", "_metadata.row_index").alias("number"))
    else:
        numbered = written(documents.select(whole, F.monotonically_increasing_id().alias("number")), "mix-documents")
    _, pieces = mixed_pieces(numbered.select("number", *[F.col("row")[c].alias(c) for c in ("doc_id", "source", "text")]), "number")
    times = pieces.groupBy("number", "epoch", "size").agg(F.sum("length").alias("left"), F.min(F.struct("slot", "rank", "at")).alias("place"))
    rows = numbered.join(times, "number")
    spaced = F.regexp_extract_all(F.col("row.text"), F.lit(r"[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+"), F.lit(0))
    first = F.array_join(F.slice(spaced, F.lit(1), F.col("left").cast("int")), "")
    ordered = rows.withColumn("cut", F.when(F.col("left") == F.col("size"), F.col("row.text")).otherwise(first)).repartitionByRange("place").sortWithinPartitions("place")
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return ordered.select(*[new.get(c, F.col("row")[c]).alias(c) for c in columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS k FROM s),
f AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o
), g AS (SELECT *, min(k) FILTER (remains * weight / weights::DOUBLE <= 3 * source_size) OVER () AS open_from FROM f),
h AS (SELECT * FROM g WHERE k = open_from),
t AS (
  SELECT g.source, g.source_size, CASE WHEN g.k < g.open_from THEN 3 * g.source_size ELSE h.remains * g.weight / h.weights::DOUBLE END::DOUBLE AS target FROM g, h
), u AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS take FROM t),
p AS (
  SELECT d.*, source_size, target, take,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
  (greatest(least(take - pos, size), 0) + greatest(least(take - pos - source_size, size), 0) + greatest(least(take - pos - 2 * source_size, size), 0))::BIGINT AS taken
FROM p
"""
