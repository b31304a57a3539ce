"""MinHash near-dedup: universal hash minima, banding, signature verification, alternating stars.

A document's set is its distinct shingles of SHINGLE words (64-bit hashes; ASCII lower case). Documents of
one set form a class, represented by the smallest doc_id; only classes go on, so copies are never paired.
HASHES minima of multiply-add hashes make a signature, BANDS bands of it the buckets; two sets of similarity
0.75 share no bucket with a probability of (1 - 0.75 ** 4) ** 32, five in a million.

No bucket is expanded into all pairs. First every member of a bucket is compared with the bucket's smallest;
signatures that agree in SIGNATURE_LEAST of HASHES (over five standard deviations below 0.75) make a sketch link.
In large buckets whose members are not all connected yet, some more pivots, of components of their own, meet all others,
for a few rounds. What is still apart is compared in blocks: a cell holds two blocks of bounded size, compares what
is not connected, and passes on only links that connect something, so its output is no larger than its input. Groups that
are large even then (families of texts a little less alike than asked for) are parted by their sets' rare shingles first, without
which no two of them can be similar. The
components of sketch links are families, outside of which no two texts can be similar. The sketch links are
confirmed on full sets; families that fall apart are compared once more in the same way, this time on full sets.
A group of thousands of near copies thus costs about its size, and so does one of texts that have no more than a template in common. Every candidate pair that could connect two components is checked.

Joins on a bucket, family or node may have skewed keys. Both sides are plain shuffles of written tables and nothing
above the join asks for the rows of a key together, so adaptive execution splits what is skewed.

Defined results: null or empty texts, and texts without words, have 0 shingles and link with nothing; fewer
than SHINGLE words are one shingle; rows with equal doc_id count as one document; rows without a doc_id
take the component of their copies, and keep themselves if they have none; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import slices, written
from colophon.llm.components import connected_components
from colophon.llm.word_cache import WordCache, worker_cache

SHINGLE, HASHES, BANDS, SEED = 5, 128, 32, 20240229
#: Percent of the union that the intersection must reach.
PERCENT = 75
SIGNATURE_LEAST = 70
#: Size of a block: so many signatures, or shingles of full sets.
BLOCK_NODES, BLOCK_SHINGLES = 512, 100_000
#: Groups of more blocks than this get PIVOTS pivots in each of up to PIVOT_ROUNDS rounds before blocks meet.
LARGE_BLOCKS, PIVOTS, PIVOT_ROUNDS = 2, 8, 3
#: Up to so many rows of id and key (about 100 bytes each, counted before: 20 MB at most) are broadcast to pick
#: texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Words whose hashes a worker keeps, in each of two generations.
CACHED_WORDS = 60_000
_MIX, _FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _cache() -> WordCache:
    def make() -> WordCache:
        import xxhash

        return WordCache(xxhash.xxh3_64_intdigest, limit=CACHED_WORDS)

    return worker_cache("shingles", make)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    cache = _cache()
    for text in texts:
        words = (text or b"").lower().split()
        n = len(words)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
        cache.turn()
        k = min(n, SHINGLE)
        if not n:
            yield h
            continue
        out = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            out = out * _MIX + h[j : n - k + 1 + j]
        out ^= out >> np.uint64(32)
        out *= _FINAL
        out ^= out >> np.uint64(29)
        yield np.unique(out)


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, np.uint64)


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[i : i + 1024, None] * a + b).min(0))
    return (least >> np.uint64(32)).astype("<u4")


def _sketched(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set) and sig of every document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        family = _family()
        for batch in slices(batches):
            counts, keys, sigs = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist()):
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s, family).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "sig"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """node, n and bucket: a row for each class and band."""
    rows = HASHES // BANDS

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            m = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(m, BANDS, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (m, BANDS)).copy()
            for j in range(rows):
                key = (key * _MIX + sig[:, :, j]) * _FINAL
                key ^= key >> np.uint64(31)
            repeat = pa.array(np.repeat(np.arange(m), BANDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(repeat), batch.column(1).take(repeat), pa.array(key.reshape(-1).view(np.int64))], ["node", "n", "bucket"]
            )

    return classes.select("node", "n", "sig").mapInArrow(band, "node long, n long, bucket long")


def _paired(pairs: DataFrame, payload: DataFrame, name: str) -> DataFrame:
    """pairs(a, b) with the payload of both; a may be frequent, so only b's payload travels with each pair."""
    one = payload.select(F.col("node").alias("b"), F.col(name).alias("of_b"))
    two = payload.select(F.col("node").alias("a"), F.col(name).alias("of_a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "of_a", "of_b")


def _enough(both, sizes_a, sizes_b):
    return 100 * both >= PERCENT * (sizes_a + sizes_b - both)


def _sketch_links(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs(a, b) whose signatures agree enough."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, HASHES) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(1) >= SIGNATURE_LEAST))

    return _paired(pairs, classes, "sig").mapInArrow(alike, "a long, b long")


def _set_links(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs(a, b) whose sets are similar enough."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(bool(_enough(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _paired(pairs, full, "shingles").mapInArrow(exact, "a long, b long")


def _full_sets(nodes: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """node, n and shingles (the whole set) of the nodes, made from the texts again and written."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            found = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist())]
            right = [xxhash.xxh3_128_digest(s) == k for s, k in zip(found, batch.column(2).to_pylist(), strict=True)]
            sizes = pa.array([len(s) // 8 for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(found, pa.binary())], ["node", "n", "shingles"]).filter(pa.array(right, pa.bool_()))

    keys = written(nodes.join(classes.select("node", "set_key"), "node"), "near-wanted")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text"))
    return written(texts.join(keys, "node").select("node", "text", "set_key").mapInArrow(sets, "node long, n long, shingles binary"), "near-sets")


def _similar_signatures(left: list[bytes], right: list[bytes]) -> np.ndarray:
    a, b = (np.frombuffer(b"".join(x), "<u4").reshape(-1, HASHES) for x in (left, right))
    out = np.empty((len(a), len(b)), bool)
    for i in range(0, len(a), 64):
        out[i : i + 64] = (a[i : i + 64, None, :] == b[None, :, :]).sum(2) >= SIGNATURE_LEAST
    return out


def _similar_sets(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Which pairs of sets are similar: intersections by products of membership matrices, a slice of shingles at a time."""
    sides = []
    for side in (left, right):
        sets = [np.frombuffer(x, np.uint64) for x in side]
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.array([len(x) for x in sets])))
    (va, ia, na), (vb, ib, nb) = sides
    common = np.intersect1d(va, vb)
    both = np.zeros((len(left), len(right)), np.float32)
    parts = []
    for v, i in ((va, ia), (vb, ib)):
        at = np.searchsorted(common, v)
        good = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == v) if len(common) else np.zeros(len(v), bool)
        order = np.argsort(at[good], kind="stable")
        parts.append((at[good][order], i[good][order]))
    for low in range(0, len(common), 2048):
        slices = []
        for (at, i), m in zip(parts, (len(left), len(right)), strict=True):
            x, y = np.searchsorted(at, [low, low + 2048])
            member = np.zeros((m, 2048), np.float32)
            member[i[x:y], at[x:y] - low] = 1
            slices.append(member)
        both += slices[0] @ slices[1].T
    return _enough(both.astype(np.int64), na[:, None], nb[None, :])


def _connecting(components_l: np.ndarray, components_r: np.ndarray, similar: np.ndarray) -> list[tuple[int, int]]:
    """Of the similar (row, column) pairs, those that connect components that nothing before has connected."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, seen = [], set()
    for i, j in np.argwhere(similar & (components_l[:, None] != components_r[None, :])):
        pair = (int(components_l[i]), int(components_r[j]))
        if pair in seen:
            continue
        seen.add(pair)
        x, y = root(pair[0]), root(pair[1])
        if x != y:
            parent[x] = y
            out.append((int(i), int(j)))
    return out


def _groups(rows: DataFrame) -> DataFrame:
    """of, main, all_w and rest_w of each group that isn't connected: its largest component, its size, and the others' size."""
    sizes = rows.groupBy("g", "component").agg(F.sum("w").alias("cw")).groupBy("g")
    groups = sizes.agg(F.sum("cw").alias("all_w"), F.max(F.struct("cw", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    return written(groups.select(F.col("g").alias("of"), F.col("top.component").alias("main"), "all_w", (F.col("all_w") - F.col("top.cw")).alias("rest_w")), "near-groups")


def _pivot_links(rows: DataFrame, found: DataFrame, links: DataFrame, per_block: int, confirmed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, links, rows) after rounds in which pivots of large groups meet all nodes of other components.

    found: the components of links. A round makes PIVOTS pairs a node at most. It ends when no group is large, or when a
    round connects nothing.
    """
    for turn in range(PIVOT_ROUNDS):
        large = _groups(rows).filter(F.col("rest_w") > LARGE_BLOCKS * per_block).select(F.col("of").alias("g"), "main")
        if large.isEmpty():
            break
        apart = rows.join(large, "g").filter("component <> main OR node = component").select("g", "node", "component")
        some = [F.min_by(F.struct("node", "component"), F.struct(F.xxhash64("component", F.lit(PIVOTS * turn + k)), F.col("node"))).alias(f"p{k}") for k in range(PIVOTS)]
        pivots = written(apart.groupBy("g").agg(*some).select("g", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("p")), "near-pivots")
        met = rows.select("g", "node", "component").join(pivots.select("g", F.col("p.node").alias("a"), F.col("p.component").alias("of")), "g")
        pairs = written(met.filter("component <> of").select("a", F.col("node").alias("b")).distinct(), "near-pairs")
        more = confirmed(pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        now, links = _joined(found, links, more, "near-pivot-links")
        if now is found:
            break
        found = now
        labels = found.toDF("node", "label")
        rows = written(rows.drop("component").join(labels, "node", "left").select("g", "node", F.coalesce("label", "node").alias("component"), "w"), "near-labels")
    return found, links, rows


def _postings(nodes: DataFrame, full: DataFrame) -> DataFrame:
    """g, node, component, w, left and right: groups in which two similar sets of the nodes must meet, by rare shingles.

    Shingles are ordered by how many of the sets hold them, rarest first. Of two similar sets the smaller has a shingle of the other's
    first ones among its own first `index` ones, the larger among its first `probe` ones (prefix filter). A group is a shingle; its
    index side meets its probe side, but members of its largest component don't meet each other. So what many texts share
    brings nobody together as long as they differ enough elsewhere.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 64):
            data = batch.column(1).to_pylist()
            at = pa.array(np.repeat(np.arange(len(data)), [len(x) // 8 for x in data]))
            sets = pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in data], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), sets.take(at), pa.array(np.frombuffer(b"".join(data), np.int64))], ["node", "of_set", "s"])

    held = full.join(nodes.select("node"), "node", "left_semi").select("node", "shingles").mapInArrow(each, "node long, of_set long, s long")
    held = written(held, "near-shingles")
    rare = held.join(held.groupBy("s").agg(F.count("*").alias("c")), "s").groupBy("node", "of_set").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("o"))
    ceil = lambda a, b: F.call_function("div", F.size("o") * a + (b - 1), F.lit(b)).cast("int")
    probe, index = F.size("o") - ceil(PERCENT, 100) + 1, F.size("o") - ceil(2 * PERCENT, 100 + PERCENT) + 1
    first = rare.select("node", index.alias("to"), F.posexplode(F.slice("o", F.lit(1), probe)).alias("at", "x")).filter("x.c > 1")
    rows = first.groupBy(F.col("x.s").alias("g"), "node").agg(F.max(F.col("at") < F.col("to")).alias("index"))
    rows = written(rows.join(nodes, "node").select("g", "node", "component", "w", "index"), "near-postings")
    met = rows.join(_groups(rows).select(F.col("of").alias("g"), "main"), "g")
    main = F.col("component") == F.col("main")
    sides = ((F.lit(True), F.col("index") & ~main), (F.col("index") & main, ~main))
    one, two = (met.select(F.xxhash64("g", F.lit(k)).alias("g"), "node", "component", "w", x.alias("left"), y.alias("right")) for k, (x, y) in enumerate(sides))
    return one.union(two).filter("left OR right")


def _apart_links(rows: DataFrame, payload: DataFrame, per_block: int, similar: Callable[[list[bytes], list[bytes]], np.ndarray], full: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links(a, b) that connect the components inside each group.

    rows: g, node, component, w (what a node adds to a block's size). payload: node, data. All nodes of a group but those of its
    largest component meet all others; in groups that are still large, those that share a rare shingle only. full: the sets of nodes.
    """
    met = rows.join(_groups(rows).select(F.col("of").alias("g"), "main", "rest_w"), "g")
    met = written(met.select("g", "node", "component", "w", F.lit(True).alias("left"), (F.col("component") != F.col("main")).alias("right"), (F.col("rest_w") > LARGE_BLOCKS * per_block).alias("large")), "near-apart")
    nodes = written(met.filter("large").select("node", "component", "w").distinct(), "near-apart-nodes")
    sided = met.filter("NOT large").drop("large")
    if not nodes.isEmpty():
        sided = written(sided.unionByName(_postings(nodes, full(nodes.select("node")))), "near-sided")
    return _block_links(sided, payload, per_block, similar)


def _block_links(rows: DataFrame, payload: DataFrame, per_block: int, similar: Callable[[list[bytes], list[bytes]], np.ndarray]) -> DataFrame:
    """Links(a, b) between components, by comparing blocks of each group's left and right nodes; a cell is one block of each side."""
    blocks = lambda side: F.ceil(F.sum(F.when(F.col(side), F.col("w"))) / per_block).cast("int")
    shaped = rows.groupBy(F.col("g").alias("of")).agg(blocks("left").alias("nb"), blocks("right").alias("mb")).filter("nb > 0 AND mb > 0")
    dealt = rows.join(written(shaped, "near-shapes"), F.col("g") == F.col("of"))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.filter("left").withColumns({"i": deal("nb"), "j": every("mb"), "side": F.lit(0)})
    right = dealt.filter("right").withColumns({"j": deal("mb"), "i": every("nb"), "side": F.lit(1)})
    columns = ["g", "i", "j", "side", "node", "component"]
    cells = left.select(*columns).unionByName(right.select(*columns)).join(payload, "node").select(*columns, "data")
    by = ["g", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found(cell: list[tuple]) -> list[tuple[int, int]]:
            ls, rs = [r for r in cell if r[3] == 0], [r for r in cell if r[3] == 1]
            if not ls or not rs:
                return []
            close = similar([r[6] for r in ls], [r[6] for r in rs])
            hits = _connecting(np.array([r[5] for r in ls]), np.array([r[5] for r in rs]), close)
            return [(min(ls[i][4], rs[j][4]), max(ls[i][4], rs[j][4])) for i, j in hits]

        def table(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in slices(batches):
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    out += found(held)
                    held = []
                held.append(row)
            yield table(out)
        yield table(found(held)) if held else table([])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, *by).sortWithinPartitions(*by, "side").mapInArrow(compare, "a long, b long").distinct()


def _components_of(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _joined(found: DataFrame, links: DataFrame, more: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(components, links) with some more links; found: the components of links. Only components that a new link meets are looked at."""
    more = written(more, name)
    if more.isEmpty():
        return found, links
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    merged = connected_components(ends.select(F.coalesce("of_a", "a").alias("u"), F.coalesce("of_b", "b").alias("v")))
    merged = written(merged.select(F.col("node").alias("component"), F.col("component").alias("whole")), "near-merged")
    moved = found.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    new = merged.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(found.select("node"), "node", "left_anti")
    return written(moved.union(new), "near-components"), links.union(more)


def linked_classes(classes: DataFrame, documents: DataFrame) -> DataFrame:
    """node and component of the classes that confirmed links connect to others."""
    rows = _bands(classes)
    least = rows.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("p"), F.max("node").alias("y")).filter("p.node < y")
    rows = written(rows.join(least.select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "bucket"), "near-rows")
    alike = (F.col("n") * 100 >= F.col("pivot_n") * PERCENT) & (F.col("pivot_n") * 100 >= F.col("n") * PERCENT)
    first = rows.filter(alike & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    sketch = written(_sketch_links(first, classes), "near-sketch-links")
    found = written(_components_of(sketch), "near-components")
    labelled = rows.join(found, "node", "left").select(F.col("bucket").alias("g"), "node", F.coalesce("component", "node").alias("component"), F.lit(1).cast("long").alias("w"))
    labelled = written(labelled, "near-buckets")
    found, sketch, labelled = _pivot_links(labelled, found, sketch, BLOCK_NODES, lambda pairs: _sketch_links(pairs, classes))
    sets = lambda nodes: _full_sets(nodes, classes, documents)
    more = _apart_links(labelled, classes.select("node", F.col("sig").alias("data")), BLOCK_NODES, _similar_signatures, sets)
    families, sketch = _joined(found, sketch, more, "near-sketch-links")
    families = families.toDF("node", "g")
    full = sets(families.select("node"))
    links = written(_set_links(sketch, full), "near-links")
    found = written(_components_of(links), "near-components")
    parts = full.join(families, "node").join(found, "node", "left")
    parts = written(parts.select("g", "node", F.coalesce("component", "node").alias("component"), F.col("n").alias("w")), "near-parts")
    found, links, parts = _pivot_links(parts, found, links, BLOCK_SHINGLES, lambda pairs: _set_links(pairs, full))
    rest = _apart_links(parts, full.select("node", F.col("shingles").alias("data")), BLOCK_SHINGLES, _similar_sets, lambda nodes: full)
    return _joined(found, links, rest, "near-links")[0]


def near_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = written(_sketched(documents), "near-sketches")
    least = F.min(F.struct("doc_id", "n_shingles", "sig")).alias("c")
    some = docs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(some.groupBy("set_key").agg(least).select("set_key", F.col("c.doc_id").alias("node"), F.col("c.n_shingles").alias("n"), "c.sig"), "near-classes")
    # rows with one doc_id and different texts are classes that share a representative: one document
    of = classes.join(linked_classes(classes, documents), "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    own = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    return (
        docs.select("doc_id", "n_shingles", "set_key")
        .join(of, "set_key", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns: the one with the smallest doc_id, one without a doc_id last.

    Rows are told apart by number, so missing and repeated ids hide neither copies nor different texts. Texts
    without words link with nothing; of such rows with one doc_id one stays.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    numbered = written(documents.select(whole.alias("row"), F.monotonically_increasing_id().alias("number")), "near-documents")
    near = near_components(numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")))
    groups = near.select(F.col("doc_id").alias("number"), "component_id", (F.col("n_shingles") == 0).alias("wordless"))
    ids = numbered.select("number", F.col("row.doc_id").alias("id"))
    own = F.when(F.col("wordless") & F.col("id").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("id").cast("long").alias("key")))
    group = F.coalesce(own, F.struct(F.lit(0).alias("kind"), F.col("component_id").alias("key")))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "number")).alias("first")
    kept = groups.join(ids, "number").groupBy(group.alias("group")).agg(first).select(F.col("first.number").alias("number"))
    return numbered.join(kept, "number", "left_semi").select(*[F.col("row")[c].alias(c) for c in documents.columns])


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT row, doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT row, count(*) AS n FROM g GROUP BY row),
-- rows of one set are linked to the least of them; pairs are counted between those only
k AS (SELECT g.row, any_value(doc_id) AS doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM g GROUP BY g.row),
c AS (SELECT k, min(doc_id) AS doc_id, min(row) AS row FROM k WHERE doc_id IS NOT NULL GROUP BY k),
h AS (SELECT c.row, c.doc_id, g.s, n.n FROM c JOIN g ON g.row = c.row JOIN n ON n.row = c.row),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM h x JOIN h y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.row, y.row, x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), r AS (SELECT doc_id AS a, doc_id AS z FROM c UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.z),
m AS (SELECT a, min(z) AS z FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.z, d.doc_id) AS component_id, coalesce(m.z, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM d LEFT JOIN n ON n.row = d.row LEFT JOIN k ON k.row = d.row LEFT JOIN c ON c.k = k.k LEFT JOIN m ON m.a = c.doc_id
"""
