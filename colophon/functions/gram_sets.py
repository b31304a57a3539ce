"""Multisets of a text's character n-grams as numbers, made in tasks: what the pairing of titles is found by and confirmed with.

A gram is its code points packed into 64 bits, so equal numbers are equal grams. A token is a hash of a gram and of its place among
its repeats, so that multisets become sets; tokens find pairs, packed grams confirm them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Counters of how frequent tokens are, whatever the input: tokens that share one count as equally frequent.
COUNTERS = 1 << 17
#: Tokens that are held before they are counted.
PENDING = 1 << 20
#: 64-bit words of the parity sketch of a part of PART to 2 * PART tokens, and of the second one that whole sets of MANY tokens or more have.
WORDS, PART, WIDE_WORDS, MANY = 8, 256, 64, 256
#: A set is dealt into 2 ** MOST_LEVEL parts at most.
MOST_LEVEL = 12


def packed_grams(text: str, n: int) -> np.ndarray:
    """All n-grams (n of 3 at most) in order of their numbers; a shorter text is its own only gram; '' has none."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)  # none is 0, so shorter grams differ
    n = min(n, len(points))
    if not n:
        return points
    out = points[: len(points) - n + 1].copy()
    for i in range(1, n):
        out = (out << np.uint64(21)) | points[i : len(points) - n + 1 + i]
    out.sort()
    return out


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)


def tokens(text: str, n: int) -> np.ndarray:
    """A 64-bit hash of each gram and its place among its repeats."""
    grams = packed_grams(text, n)
    starts = _starts(grams)
    place = np.arange(len(grams)) - np.repeat(starts, np.diff(np.append(starts, len(grams))))
    x = grams * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _counter(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(COUNTERS - 1)).astype(np.int64)


def parity(x: np.ndarray, words: int) -> np.ndarray:
    """A bit for the parity of the tokens of each hash value: differing bits of two sets are at most differing tokens."""
    bits = np.bincount((x & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def _levels(m: int, least: int) -> set[int]:
    """How often a set of m tokens is halved, and one of `least`: until a part has fewer than 2 * PART."""
    return {min(MOST_LEVEL, max(0, (k // PART).bit_length() - 1)) for k in (m, least)}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, held, n_held = np.zeros(COUNTERS, np.int64), [], 0
    for batch in batches:
        for text, n in zip(batch.column("text"), batch.column("n").to_pylist(), strict=True):
            held.append(_counter(tokens(text.as_py(), n)))
            n_held += len(held[-1])
            if n_held >= PENDING:
                total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                held, n_held = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=COUNTERS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["counter", "n"])


def commonness(texts: DataFrame) -> np.ndarray:
    """How common the tokens of each counter are, on a logarithmic scale. Any order of tokens finds all pairs, this one with the fewest trials.

    The driver gets a row for each counter, COUNTERS at most.
    """
    sums = texts.select("text", "n").mapInArrow(_counted, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.uint16)
    out[sums["counter"].to_numpy()] = (1000 * np.log2(1 + sums["n"].to_numpy().astype(np.float64))).astype(np.uint16)
    return out


def _lists(values: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in values)]).astype(np.int32)
    offsets = pa.array(ends, mask=np.array([*(v is None for v in values), False]))
    there = [v for v in values if v is not None]
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(there) if there else np.empty(0, np.int64), kind))


def _made(common: np.ndarray, least: Callable[[int], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    hashed = np.uint64((1 << 47) - 1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, sizes, whole, first, narrow, wide = [], [], [], [], [], [], []
            for row, (text, n) in enumerate(zip(batch.column("text"), batch.column("n").to_pylist(), strict=True)):
                x = tokens(text.as_py(), n)
                # the order of tokens: rare ones first, then by hash. Tokens of one place in it are one token to the join
                place = np.sort((common[_counter(x)].astype(np.uint64) << np.uint64(47)) | (x >> np.uint64(17)))
                held = parity((place & hashed) >> np.uint64(17), WIDE_WORDS) if len(x) >= MANY else None
                for level in sorted(_levels(len(x), least(len(x)))):
                    of = (place & hashed) >> np.uint64(47 - level)
                    for k in range(1 << level):
                        part = place[of == k] if level else place
                        if not len(part):
                            continue
                        rows.append(row)
                        parts.append((1 << level) + k)
                        sizes.append(len(part))
                        whole.append(len(x))
                        first.append(part[: len(part) - least(len(part)) + 1].astype(np.uint32).view(np.int32))
                        narrow.append(parity((part & hashed) >> np.uint64(23), WORDS))
                        wide.append(held)
                        held = None
            sketches = np.array(narrow, np.int64).reshape(-1, WORDS).T
            given = [batch.column(c).take(pa.array(rows, pa.int32())) for c in ("tid", "block", "n")]
            arrays = [*given, *(pa.array(c, pa.int32()) for c in (parts, sizes, whole)), _lists(first, pa.int32()), *(pa.array(np.ascontiguousarray(w)) for w in sketches), _lists(wide, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["tid", "block", "n", "part", "size", "m", "first", *(f"w{i}" for i in range(WORDS)), "wide"])

    return make


def gram_sets(texts: DataFrame, least: Callable[[int], int]) -> DataFrame:
    """The parts of the sets of texts(tid, block, n, text), a row each: tid, block, n, part, size, m (of the whole set), first, w0.. and wide.

    least: the smallest set that one of so many tokens can be similar to, and so many they share. A large set is halved by its tokens'
    hashes until a small sketch can tell its parts from others'. If two sets differ in a share of their tokens at most, so
    do their parts of some number, as not all parts can be above the average. A set is halved as often as its own size asks for, and
    as the smallest partner's does, so that both of a pair have the smaller one's parts. first: the rarest tokens of the part, as 32 bits,
    one of which any similar part has; w0..: its parity sketch; wide: the whole set's, of many tokens, in one of its rows.
    """
    dealt = texts.select("tid", "block", "n", "text").repartition("tid")
    words = ", ".join(f"w{i} bigint" for i in range(WORDS))
    return dealt.mapInArrow(_made(commonness(dealt), least), f"tid bigint, block string, n int, part int, size int, m int, first array<int>, {words}, wide array<bigint>")


@lru_cache(256)
def _distinct(text: str, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    grams = packed_grams(text, n)
    starts = _starts(grams)
    return grams[starts], np.diff(np.append(starts, len(grams))), len(grams)


def _dice(a: str, b: str, n: int) -> float:
    (x, nx, mx), (y, ny, my) = _distinct(a, n), _distinct(b, n)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(nx[i], ny[j]).sum()) * 2.0 / (mx + my) if mx and my else 0.0


@F.pandas_udf(DoubleType())
def dice(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    """The exact Dice coefficient of two texts' n-gram multisets."""
    return pd.Series([_dice(*row) for row in zip(a, b, n, strict=True)], dtype="float64")
