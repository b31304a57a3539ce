"""Packing: cutting-stock column generation.

A document's tokens are cut into whole sequences of LENGTH tokens, a main part of whole units (UNIT
tokens) and a crumb of less than a unit. The histogram of main parts over their 31 lengths is the demand
of a cutting-stock problem: a linear program over patterns (how many parts of each length fill one
sequence), whose columns are generated by a knapsack dynamic program on the dual prices. Patterns are
rounded down and assigned to the documents of each length by rank, which follows the order in which tasks read the table's
files and rows, so that documents that come mixed are packed mixed. Crumbs, and after them main parts that no whole
pattern takes, are laid end to end and cut every LENGTH tokens; the last of these sequences is cut into
powers of two. So no sequence needs padding, whatever the lengths are.

The driver sees the histogram (at most LENGTH / UNIT rows) only. The task that encodes a document notes what its part of the table
holds before it; what the parts before hold are sums over a few rows for each part. With both a document's place is a
closed form, and token ids are written once, read once and never shuffled, but where a table has more than BROADCAST_PARTS parts.

Defined results: a null text is empty and has the closing id alone; equal rows (equal doc_id, too) are
packed each; very long texts give many whole sequences; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import slices, written
from colophon.llm.word_cache import WordCache, worker_cache

LENGTH, UNIT, CLOSING_ID = 4096, 64, 2
UNITS = LENGTH // UNIT
#: Starts of up to so many parts (a task's rows; some 1.2 kB each, counted before: 60 MB at most) are broadcast; more are joined by a shuffle.
BROADCAST_PARTS = 50_000
BEFORE = ["rank_before", "full_before", "crumbs_before"]
#: Words whose ids a worker keeps, in each of two generations.
CACHED_WORDS = 400_000
#: What a unit costs outside of patterns, against 1 / UNITS inside a full one.
LOOSE_COST = 1.02
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part string"


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: counts a with sum(a[i] * (i + 1)) <= capacity. Prices are of parts of 1, 2, ... units."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        sizes = min(c, len(prices))
        worth = prices[:sizes] + best[c - 1 - np.arange(sizes)]
        i = int(np.argmax(worth))
        if worth[i] > best[c] + 1e-12:
            best[c], pick[c] = worth[i], i
    pattern, c = np.zeros(len(prices)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= pick[c] + 1
    return float(best[capacity]), pattern


def cutting_patterns(demand: list[int], units: int = UNITS) -> list[tuple[list[int], int]]:
    """(pattern, times): full patterns, rounded down, from the linear program solved by column generation.

    demand[i] parts of i + 1 units. Parts may also stay loose at a cost a little above their share, so
    that patterns with waste are not used and every basis is feasible from the start.
    """
    m = len(demand)
    d = np.array(demand, float)
    loose = LOOSE_COST * (np.arange(m) + 1) / units
    basis, cost, columns = np.eye(m), loose.copy(), [None] * m
    for _ in range(5000):
        inverse = np.linalg.inv(basis)
        x, prices = inverse @ d, cost @ inverse
        value, pattern = knapsack(np.maximum(prices, 0), units)
        if value > 1 + 1e-9:
            column, price, kind = pattern, 1.0, pattern
        else:
            i = int(np.argmax(prices - loose))
            if prices[i] - loose[i] <= 1e-9:
                break
            column, price, kind = np.eye(m)[i], loose[i], None
        step = inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out], cost[out], columns[out] = column, price, kind
    x = np.linalg.solve(basis, d)
    sizes = np.arange(m) + 1
    left, found = np.array(demand), []
    for kind, amount in zip(columns, x, strict=True):
        if kind is None or int(kind @ sizes) != units:
            continue
        a = kind.astype(int)
        times = min([int(np.floor(amount + 1e-6)), *(int(left[i]) // int(a[i]) for i in np.flatnonzero(a))])
        if times > 0:
            left -= a * times
            found.append(([int(v) for v in a], times))
    return found


def token_table(documents: DataFrame, vocabulary: str) -> DataFrame:
    """row_id, doc_id, n and ids (16 or 32-bit little-endian) of every document, written to shared storage, with what its
    part (the rows that a task read, whose number is row_id's upper bits) has before it: rank_before (tails of as many units),
    full_before (whole sequences) and crumbs_before (tokens)."""
    wide = _wide(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, wide)
        ranks, full, crumbs = [0] * UNITS, 0, 0
        for batch in slices(batches):
            ids = [encoder(t or b"") for t in batch.column(1).to_pylist()]
            counts = [len(x) // (4 if wide else 2) for x in ids]
            before = []
            for n in counts:
                whole, tail = divmod(n, LENGTH)
                q, crumb = divmod(tail, UNIT)
                before.append((ranks[q], full, crumbs))
                ranks[q] += 1
                full += whole
                crumbs += crumb
            sums = [pa.array([x[i] for x in before], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), *sums], ["doc_id", "n", "ids", *BEFORE])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    encoded = rows.mapInArrow(encode, f"doc_id {kind}, n long, ids binary, {', '.join(f'{c} long' for c in BEFORE)}")
    return written(encoded.withColumn("row_id", F.monotonically_increasing_id()), "pack-tokens")


def _description(vocabulary: str) -> dict:
    with open(vocabulary, encoding="utf-8") as f:
        return json.load(f)


def _wide(vocabulary: str) -> bool:
    d = _description(vocabulary)
    return max([*d["model"]["vocab"].values(), *(t["id"] for t in d.get("added_tokens", []))], default=0) >= 65536


#: How the vocabulary treats text, as its file states it: fixed values, by which `_bare` knows it.
DROPS_SPACE = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def _bare(d: dict) -> bool:
    """True if the vocabulary composes, joins spaces and lower-cases, keeps runs of letters, single digits and runs of other marks, and
    works on their UTF-8 bytes written as letters: then words can be encoded one by one, as `_encoder` does."""
    steps = (d.get("normalizer") or {}).get("normalizers") or []
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    parts = (d.get("pre_tokenizer") or {}).get("pretokenizers") or []
    normal = [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1] == spaces
    split = len(parts) == 2 and parts[0] == DROPS_SPACE and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex", True)
    plain = all(t["content"].startswith("<|") and t["content"].endswith("|>") and t["special"] for t in d.get("added_tokens", []))
    return normal and split and plain and d["model"].get("type") == "BPE" and not d["model"].get("ignore_merges")


def _encoder(vocabulary: str, wide: bool) -> Callable[[bytes], bytes]:
    """Encodes a text, the closing id included.

    Of a vocabulary as `_bare` describes it, words are encoded one by one and kept. A word of Latin-1 letters goes to the
    merges in lower case, one of letters and a last mark is the two together, one of digits is its digits, and any other
    goes through the whole tokenizer. Texts are lower-cased (ASCII) before, unless they hold what may be a special token or
    a combining mark, with which the order of the steps could matter. Of another vocabulary whole texts are encoded.
    """
    def make() -> Callable[[bytes], bytes]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer, kind = Tokenizer.from_file(vocabulary), "<u4" if wide else "<u2"
        merges, size, letters = tokenizer.model, 4 if wide else 2, re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
        end = CLOSING_ID.to_bytes(size, "little")

        def whole(text: bytes) -> bytes:
            return np.array(tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, kind).tobytes()

        if not _bare(_description(vocabulary)):
            return lambda text: whole(text) + end
        # byte-level vocabularies write the bytes of non-ASCII letters as the characters of the same number, or from 256 on
        shown = {b: 256 + b - 127 + 33 for b in range(127, 161)} | {173: 256 + 67}
        shape = [i.to_bytes(size, "little") for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]

        def encode(word: bytes) -> bytes:
            if word.isalpha() and word.islower():
                return b"".join([shape[t.id] for t in merges.tokenize(word.decode())])
            if word.isdigit():
                return b"".join([cache[word[i : i + 1]] for i in range(len(word))]) if len(word) > 1 else whole(word)
            w = word.decode("utf-8", "replace")
            if letters.fullmatch(w):
                return b"".join([shape[t.id] for t in merges.tokenize(w.lower().encode().decode("latin-1").translate(shown))])
            if w[-1] in ".,;:!?" and letters.fullmatch(w, 0, len(w) - 1):
                return cache[word[:-1]] + cache[word[-1:]]
            return whole(word)

        cache = WordCache(encode, limit=CACHED_WORDS)
        known = cache.__getitem__

        def by_words(text: bytes) -> bytes:
            plain = b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text
            ids = b"".join(map(known, (text.lower() if plain else text).split())) + end
            cache.turn()
            return ids

        return by_words

    return worker_cache(vocabulary, make)


def _part(row_id: str = "row_id") -> Column:
    return F.shiftright(row_id, 33)


def part_starts(tokens: DataFrame) -> tuple[DataFrame, list[int], int, int]:
    """What all parts before a part hold: part, ranks (a map: tails of each number of units), full_start and crumbs_start. And over all
    parts: the tails of each number of units, whole sequences and tokens in crumbs."""
    tail = F.col("n") % LENGTH
    of = tokens.select(_part().alias("part"), F.floor(tail / UNIT).cast("int").alias("q"), F.floor(F.col("n") / LENGTH).alias("full"), (tail % UNIT).alias("crumb"))
    # UNITS rows a part at most
    sums = written(of.groupBy("part", "q").agg(F.count("*").alias("rows"), F.sum("full").alias("full"), F.sum("crumb").alias("crumbs")), "pack-sums")
    hist = {r["q"]: r for r in sums.groupBy("q").agg(F.sum("rows").alias("rows"), F.sum("full").alias("full"), F.sum("crumbs").alias("crumbs")).collect()}
    before = lambda w, c: F.coalesce(F.sum(c).over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = sums.select("part", F.struct("q", before(Window.partitionBy("q"), "rows").alias("rank")).alias("at"))
    ranks = ranks.groupBy("part").agg(F.map_from_entries(F.collect_list("at")).alias("ranks"))
    # a row for each part
    whole = sums.groupBy("part").agg(F.sum("full").alias("full"), F.sum("crumbs").alias("crumbs"))
    whole = whole.select("part", before(Window.partitionBy(), "full").alias("full_start"), before(Window.partitionBy(), "crumbs").alias("crumbs_start"))
    starts = written(ranks.join(whole, "part"), "pack-starts")
    total = lambda c: int(sum(r[c] for r in hist.values()))
    return starts, [int(hist[q]["rows"]) if q in hist else 0 for q in range(UNITS)], total("full"), total("crumbs")


class Places:
    """Where pieces go, in closed form: whole sequences first, then patterns, then the stream of crumbs and of main parts that no pattern takes."""

    def __init__(self, tails: list[int], full: int, crumbs: int):
        self.full, self.crumbs = full, crumbs
        #: For each number of units the stretches of ranks that a pattern takes: first rank, parts in a sequence, first sequence, first unit.
        self.plan: list[list[tuple[int, int, int, int]]] = [[] for _ in range(UNITS)]
        self.given, self.patterns = [0] * UNITS, 0
        for a, times in cutting_patterns(tails[1:]):
            unit = 0
            for q in range(UNITS - 1, 0, -1):
                if k := a[q - 1]:
                    self.plan[q].append((self.given[q], k, self.patterns, unit))
                    self.given[q] += k * times
                    unit += k * q
            self.patterns += times
        self.left_at, at = [0] * UNITS, crumbs
        for q in range(1, UNITS):
            self.left_at[q] = at
            at += (tails[q] - self.given[q]) * q * UNIT
        self.stream = at

    def main(self, q: int, rank: int) -> tuple[int, int] | None:
        """Sequence and offset of the rank-th main part of q units; None if no pattern takes it."""
        if rank >= self.given[q]:
            return None
        low, k, seq, unit = self.plan[q][bisect.bisect_right(self.plan[q], rank, key=lambda p: p[0]) - 1]
        nth = rank - low
        return self.full + seq + nth // k, (unit + nth % k * q) * UNIT

    def loose(self, at: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(tokens, sequence, offset) of the pieces of a stretch of the stream."""
        for n, seq, off in stream_cuts(at, length, self.stream):
            yield n, self.full + self.patterns + seq, off

    def pieces(self, n: int, rank: int, full_at: int, crumbs_at: int) -> Iterator[tuple[int, int, int, int, str]]:
        """(start, length, sequence, offset, part) of a document of n tokens."""
        whole, tail = divmod(n, LENGTH)
        for k in range(whole):
            yield k * LENGTH, LENGTH, full_at + k, 0, "whole"
        start, q = whole * LENGTH, tail // UNIT
        rest = [(crumbs_at, tail % UNIT)]
        if q:
            if at := self.main(q, rank):
                yield start, q * UNIT, *at, "main"
                start += q * UNIT
            else:
                rest.insert(0, (self.left_at[q] + (rank - self.given[q]) * q * UNIT, q * UNIT))
        for at, length in rest:
            for size, seq, off in self.loose(at, length):
                yield start, size, seq, off, "loose"
                start += size


def stream_cuts(at: int, length: int, total: int) -> Iterator[tuple[int, int, int]]:
    """(tokens, sequence, offset) of the pieces of [at, at + length) of a stream of `total` tokens.

    Whole sequences end every LENGTH tokens; the rest of the stream is cut into falling powers of two.
    """
    whole = total // LENGTH
    while length > 0:
        if at < whole * LENGTH:
            seq, off = divmod(at, LENGTH)
            room = LENGTH - off
        else:
            seq, off, power = whole, at - whole * LENGTH, LENGTH // 2
            rest = total - whole * LENGTH
            while True:
                if rest & power:
                    if off < power:
                        break
                    off -= power
                    seq += 1
                power //= 2
            room = power - off
        n = min(room, length)
        yield n, seq, off
        at, length = at + n, length - n


def pack_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, part and row_id.

    part: whole, main (in a pattern) or loose. The ids of a piece are ids[start : start + length] of its
    document, of which row_id tells repeated ones apart.
    """
    tokens = token_table(documents, vocabulary)
    wide = _wide(vocabulary)
    starts, *totals = part_starts(tokens)
    places = Places(*totals)
    kind, size = ("<u4", 4) if wide else ("<u2", 2)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "row_id"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for row_id, doc_id, n, ids, rank, full_at, crumbs_at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, length, s, off, part in places.pieces(n, rank, full_at, crumbs_at):
                    crc = zlib.crc32(np.frombuffer(ids, kind, length, a * size).astype("<u4").tobytes())
                    out.append((doc_id, a, length, crc, n, s, off, part, row_id))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field("doc_id").type if k == "doc_id" else pa.string() if k == "part" else pa.int64()) for k, c in zip(names, columns, strict=True)], names)

    doc_kind = documents.schema["doc_id"].dataType.simpleString()
    few = starts.count() <= BROADCAST_PARTS
    met = tokens.withColumn("part", _part()).join(F.broadcast(starts) if few else starts, "part")
    rank = F.col("rank_before") + F.col("ranks")[F.floor(F.col("n") % LENGTH / UNIT).cast("int")]
    placed = met.select("row_id", "doc_id", "n", "ids", rank, F.col("full_before") + F.col("full_start"), F.col("crumbs_before") + F.col("crumbs_start"))
    return placed.toDF("row_id", "doc_id", "n", "ids", "rank", "full_at", "crumbs_at").mapInArrow(emit, f"doc_id {doc_kind}, {PIECES}, row_id long")
