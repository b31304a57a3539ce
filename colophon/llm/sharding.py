"""Sharding [native]: minimax contiguous partition of ordered atomic groups.

Documents with equal texts form an atomic group (null counts as the empty text). Groups are ordered by
the MD5 of their text. The smallest feasible shard capacity is found by binary search, each capacity
checked greedily (fill a shard as long as the next group fits), and the order is cut there.

The order is far too long for the driver, so the search sees it through blocks: ranges of the MD5, with
their total sizes. Greedy cuts at block borders bound every true cut from both sides, and only blocks
between the bounds are split further (PREFIX_STEP hex digits a pass) until they hold single groups. What
reaches the driver is the sums of 16 ** FIRST_PREFIX blocks (65,536) at most, then those of 16 ** PREFIX_STEP parts of each
of the few blocks around the cuts. A document's shard follows from comparing its MD5 with the cuts: an expression, no join
and no shuffle of texts. Slots follow the MD5 of the doc_id, then the MD5 of the text; rows are dealt by ranges of that order, so
a doc_id that many rows have, or lack, is dealt over many tasks.

Defined results: a null text has size 1 and CRC 0; repeated rows share a shard and get slots of their
own; an empty table gives an empty table; a group larger than an even share gets a shard of its own and
sets the capacity.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import numbered, written

FIRST_PREFIX, PREFIX_STEP, DIGITS = 4, 2, 32


def greedy_cuts(ends: list[int], shards: int, capacity: int) -> list[int] | None:
    """Indexes of the first item of shards 1.. when each is filled up to capacity; None if shards don't do.

    ends: running totals of the item sizes.
    """
    cuts, at, done = [], 0, 0
    for _ in range(shards):
        nxt = bisect.bisect_right(ends, done + capacity, at)
        if nxt == len(ends):
            return cuts
        if nxt == at:
            return None
        cuts.append(nxt)
        at, done = nxt, ends[nxt - 1]
    return None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity with which greedy filling needs no more than `shards` shards."""
    ends = list(accumulate(sizes))
    low, high = max([0, *sizes, -(-(ends[-1] if ends else 0) // shards)]), ends[-1] if ends else 0
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(ends, shards, mid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _bounds(blocks: list[tuple[str, int, int, int]], shards: int) -> tuple[set[str], int]:
    """Prefixes of blocks in which some greedy cut may fall, and the capacity if it is already exact.

    blocks: (prefix, size, groups, largest group) in order. An upper capacity is feasible with whole
    blocks; a lower one is what sizes alone demand. The k-th true cut lies between the greedy walk with
    the lower capacity that always stops early and the walk with the upper that never does.
    """
    sizes = [b[1] for b in blocks]
    ends = list(accumulate(sizes))
    total = ends[-1]
    upper = smallest_capacity(sizes, shards)
    lower = max(-(-total // shards), max(b[3] for b in blocks))
    lower = min(lower, upper)
    wanted: set[str] = set()
    early = late = 0
    for _ in range(shards - 1):
        late = min(total, late + upper)
        i = bisect.bisect_right(ends, early + lower)
        # the border below is reached for certain; the block at i may be cut inside
        early = ends[i - 1] if i else early
        first, last = bisect.bisect_right(ends, early), bisect.bisect_left(ends, late)
        wanted.update(b[0] for b in blocks[first : last + 1] if b[2] > 1)
        if early >= total:
            break
    return wanted, upper


def partition_cuts(groups: DataFrame, shards: int) -> list[str]:
    """First keys of shards 1.. for groups(key hex of 32 digits, size), by the smallest feasible capacity."""

    def sums(width: int, within: set[str] | None, parent: int) -> list[tuple[str, int, int, int]]:
        rows = groups if within is None else groups.filter(F.substring("key", 1, parent).isin(sorted(within)))
        got = rows.groupBy(F.substring("key", 1, width).alias("p")).agg(F.sum("size"), F.count("*"), F.max("size"))
        return sorted(tuple(r) for r in got.collect())

    width = FIRST_PREFIX
    blocks = sums(width, None, 0)
    if not blocks:
        return []
    while True:
        wanted, capacity = _bounds(blocks, shards)
        if not wanted:
            break
        # every block that may be cut has the same width: only the newest are ever split again
        width_of = {}
        for p in wanted:
            width_of.setdefault(len(p), set()).add(p)
        finer = []
        for parent, prefixes in sorted(width_of.items()):
            finer += sums(min(DIGITS, parent + PREFIX_STEP), prefixes, parent)
        blocks = sorted([b for b in blocks if b[0] not in wanted] + finer)
    cuts = greedy_cuts(list(accumulate(b[1] for b in blocks)), shards, capacity) or []
    return [blocks[i][0] for i in cuts]


def assign_shards(documents: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) of every document.

    Slots count from 0 without gaps in each shard, by the MD5 of the doc_id's text (null as empty), doc_id and text.
    """
    text = F.coalesce("text", F.lit(""))
    digests = written(
        documents.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("key"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-digests",
    )
    groups = written(digests.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    cuts = partition_cuts(groups, shards)
    shard = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    dealt = digests.withColumn("shard", shard.cast("int"))
    # the row number parts equal rows, which may have each other's slots
    placed = numbered(dealt, [F.col(c) for c in ("shard", "place", "doc_id", "key", "row")], "at", "shard-slots")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


# DuckDB has no CRC-32: its table is made by the rule of the polynomial, and a text's bytes are read from its hexadecimal form.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i AS b, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
x AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, md5(coalesce(text, '')) AS key, md5(coalesce(doc_id::VARCHAR, '')) AS place, hex(encode(coalesce(text, ''))) AS h FROM documents
), d AS (
  SELECT doc_id, size, key, place, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda p: ('0x' || p)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32 FROM x, crc
), g AS (SELECT key, sum(sum(size)) OVER (ORDER BY key)::BIGINT AS e FROM d GROUP BY key),
n AS (SELECT max(e) AS total, greatest((max(e) + 15) // 16, (SELECT max(s) FROM (SELECT sum(size)::BIGINT AS s FROM d GROUP BY key))) AS least FROM g),
-- binary search of the capacity: each step fills one more shard with the middle one, and a walk that ends halves the range
w AS (
  SELECT least AS lo, total AS hi, 0::BIGINT AS pos, 0 AS used, total FROM n
  UNION ALL
  SELECT CASE WHEN step < total AND used = 15 THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN step = total THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN step = total OR used = 15 THEN 0 ELSE step END, CASE WHEN step = total OR used = 15 THEN 0 ELSE used + 1 END, total
  FROM (SELECT w.*, (SELECT max(e) FROM g WHERE e <= w.pos + (w.lo + w.hi) // 2) AS step FROM w WHERE lo < hi)
), c AS (SELECT max(lo) AS capacity FROM w WHERE lo = hi),
cuts AS (
  SELECT 0::BIGINT AS pos, 0 AS shard FROM n
  UNION ALL SELECT (SELECT max(e) FROM g WHERE e <= cuts.pos + (SELECT capacity FROM c)), shard + 1 FROM cuts WHERE shard < 15 AND pos < (SELECT total FROM n)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, d.key) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM d JOIN (SELECT key, (SELECT max(shard) FROM cuts WHERE pos < e) AS shard FROM g) s ON s.key = d.key
"""
