"""Training-data operators against brute force, round trips and odd inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from colophon.llm import components, line_rules, mixing, near_dedup, packing, quality_mil, reply_trees, sharding, token_counts, top_k, warc_revisits
from colophon.llm import queries as Q
from colophon.llm.word_cache import WordCache

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None, "a", "clash"), (2, "", None, "clash"), (3, " \t\n ", "a", "clash"), (4, "one", "b", "clash"), (5, "one", "b", "clash"), (5, "one", "b", "clash"),
    (6, LONG, "b", "clash"), (None, "no id here", "c", None), (7, "ünï <|endoftext|> İ J̌ ▁x  y", "c", "z"), (8, "\x00\x1c\x85 a b", None, "z"),
]
NAMES = "doc_id long, text string, source string, n_words string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, NAMES).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def none(frame):
    return frame.filter("false")


# ---- packing


def check_packing(rows, ids_of):
    """ids_of: the multiset of whole id lists by doc_id. Pieces must rebuild them; sequences must be gapless and full."""
    by_doc, by_seq, padded = {}, {}, 0
    for r in rows:
        by_doc.setdefault(r["row_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    left = Counter((d, tuple(x)) for d, x in ids_of)
    for pieces in by_doc.values():
        pieces.sort(key=lambda r: r["start"])
        known = [(d, x) for d, x in left if d == pieces[0]["doc_id"] and left[(d, x)] > 0]
        hit = next((d, x) for d, x in known if len(x) == pieces[0]["doc_tokens"] and all(r["ids_crc32"] == zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in pieces))
        left[hit] -= 1
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:i]) for i in range(len(pieces))]
        assert sum(r["length"] for r in pieces) == len(hit[1])
    assert not +left
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH
        padded += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    assert padded == 0


def whole_ids(pairs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path("word_bpe_49k.json"))
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, packing.CLOSING_ID]) for d, x in pairs]


def test_packing_round_trip(spark, docs, texts):
    check_packing(packing.pack_documents(docs, Q.tokenizer_path("word_bpe_49k.json")).collect(), whole_ids(texts.items()))


def test_packing_odd_and_empty(spark, odd):
    path = Q.tokenizer_path("word_bpe_49k.json")
    check_packing(packing.pack_documents(odd, path).collect(), whole_ids((r[0], r[1]) for r in ODD))
    assert packing.pack_documents(none(odd), path).count() == 0


def test_packing_of_many_parts(spark, docs, texts, monkeypatch, tmp_path):
    """Many tasks' rows, empty parts and starts too many to broadcast give the same pieces; token ids meet no shuffle."""
    path, many = Q.tokenizer_path("word_bpe_49k.json"), docs.select("doc_id", "text").repartition(23, "doc_id")
    many.write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    packed = packing.pack_documents(many, path)
    assert "Exchange hash" not in packed._jdf.queryExecution().executedPlan().toString()
    rows = packed.collect()
    check_packing(rows, whole_ids(texts.items()))
    assert len({r["row_id"] >> 33 for r in rows}) > 1
    monkeypatch.setattr(packing, "BROADCAST_PARTS", 0)
    assert sorted(map(tuple, packing.pack_documents(many, path).collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("lengths", [[40], [63], [1, 5, 17, 40, 63], list(range(1, 64))])
def test_places_hold_every_part_once(lengths):
    """Lengths that fill no pattern go to the stream; sequences have no gaps whatever the lengths are."""
    rng = random.Random(len(lengths))
    sizes = [rng.choice(lengths) * packing.UNIT + rng.randrange(packing.UNIT) + rng.choice([0, 0, 1, 3]) * packing.LENGTH for _ in range(700)]
    tails = Counter(n % packing.LENGTH // packing.UNIT for n in sizes)
    places = packing.Places([tails[q] for q in range(packing.UNITS)], sum(n // packing.LENGTH for n in sizes), sum(n % packing.UNIT for n in sizes))
    ranks, full, crumbs, found = Counter(), 0, 0, []
    for n in sizes:
        q = n % packing.LENGTH // packing.UNIT
        pieces = list(places.pieces(n, ranks[q], full, crumbs))
        assert [p[0] for p in pieces] == [sum(x[1] for x in pieces[:i]) for i in range(len(pieces))] and sum(p[1] for p in pieces) == n
        found += [(seq, off, length) for _, length, seq, off, _ in pieces]
        ranks[q], full, crumbs = ranks[q] + 1, full + n // packing.LENGTH, crumbs + n % packing.UNIT
    at: dict[int, int] = {}
    for seq, off, length in sorted(found):
        assert at.get(seq, 0) == off
        at[seq] = off + length
    assert sorted(at) == list(range(len(at))) and sum(v != packing.LENGTH for v in at.values()) <= 12
    assert all(v & (v - 1) == 0 for v in at.values())


def test_word_by_word_ids_equal_whole_texts():
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("word_bpe_49k.json")
    assert packing._bare(packing._description(path))
    t, encoder, rng = Tokenizer.from_file(path), packing._encoder(path, False), random.Random(4)
    letters = "abcdefgxyzABCÉéßüñØøÿÀŒœİıſǅΣς.,,'’!?-_0123456789#$ \n\t ́̌̇あ中🙂½ﬁ"
    for n in range(6000):
        text = "".join(rng.choice(letters if n % 2 else "ABzéÉÀßÖØÞÿ×÷19.,;:!? ") for _ in range(rng.randrange(1, 24)))
        assert np.frombuffer(encoder(text.encode()), "<u2").tolist() == [*t.encode(text, add_special_tokens=False).ids, packing.CLOSING_ID], text


def test_another_vocabulary_is_encoded_whole(spark, tmp_path):
    """A vocabulary that keeps white space can't be encoded word by word: its file says so, and whole texts are encoded."""
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("byte_bpe_50k.json")
    assert not packing._bare(packing._description(path))
    t, encoder = Tokenizer.from_file(path), packing._encoder(path, False)
    text = "Two  words,\n and a\ttab."
    assert np.frombuffer(encoder(text.encode()), "<u2").tolist() == [*t.encode(text, add_special_tokens=False).ids, packing.CLOSING_ID]


@pytest.mark.parametrize("seed", range(5))
def test_patterns_fit_the_demand(seed):
    rng = random.Random(seed)
    half = [rng.randrange(0, 2000) for _ in range(packing.UNITS // 2 - 1)]
    demand = [*half, 1000, *reversed(half)]  # each length has its complement, so full patterns can hold all but what rounding leaves
    used = np.zeros(len(demand), int)
    for a, times in packing.cutting_patterns(demand):
        assert sum(k * (i + 1) for i, k in enumerate(a)) == packing.UNITS
        used += np.array(a) * times
    assert (used <= demand).all()
    units = np.arange(1, packing.UNITS)
    assert (used @ units) >= 0.97 * (np.array(demand) @ units)


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        prices = rng.random(6)
        best, pattern = packing.knapsack(prices, 9)
        table = [0.0]
        for c in range(1, 10):
            table.append(max([table[c - 1], *(prices[i] + table[c - 1 - i] for i in range(min(c, 6)))]))
        assert best == pytest.approx(table[9]) and best == pytest.approx(prices @ pattern)
        assert pattern @ np.arange(1, 7) <= 9


def test_stream_cuts():
    for total in (0, 1, 4095, 4096, 10_000, 4096 * 3 + 2048 + 7):
        at, seqs, rng = 0, {}, random.Random(total)
        while at < total:
            n = min(total - at, rng.randrange(1, 3000))
            for length, seq, off in packing.stream_cuts(at, n, total):
                assert seqs.get(seq, 0) == off
                seqs[seq] = off + length
            at += n
        assert all(v & (v - 1) == 0 for v in seqs.values()) and sum(seqs.values()) == total


# ---- revisits


def test_revisits(spark):
    rows = [
        (1, "http://www.A.com/x/?utm_source=f#t", 10, 200, {"ETag": '"a"', "Content-Type": "text/html", "X": "1"}),
        (2, "https://a.com/x", 10, 304, {"etag": 'W/"a"', "x": "2", "content-type": "no"}),
        (3, "https://a.com/x", 5, 304, {"etag": '"a"'}),
        (4, "https://a.com/x", 20, 304, {"etag": '"b"'}),
        (5, None, 20, 304, None),
        (6, "https://a.com/x", 20, 304, None),
        (7, "https://a.com/x?b=2&a=1", None, 304, {"last-modified": "d"}),
        (8, "https://a.com/x?a=1&b=2", None, 200, {"last-modified": "d"}),
        (9, "m.a.com/x?a=1&b=2", 30, 304, {"Last-Modified": "d"}),
    ]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>")
    got = {r["revisit_id"]: (r["response_id"], r["outcome"], r["headers"]) for r in warc_revisits.resolve_revisits(frame).collect()}
    assert got[2] == (1, "resolved", {"etag": 'W/"a"', "content-type": "text/html", "x": "2"})
    assert got[3] == (None, "no_response", None) and got[5][1] == "no_response" and got[7][1] == "no_response"
    assert got[4] == (1, "validator_mismatch", None) and got[6][1] == "validator_mismatch"
    assert got[9][:2] == (8, "resolved")
    assert warc_revisits.resolve_revisits(none(frame)).count() == 0


def test_revisits_with_wrong_times(spark):
    """A URL with all captures, and some with times far off: ranges follow the captures, each holds a small part of them."""
    far = {0: -(10**15), 1: 10**17, 2: None}
    rows = [(i, "http://a.org/x", far.get(i, 10**9 + i // 2), 200 if i % 5 == 0 else 304, {"ETag": '"1"'}) for i in range(4000)]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>").repartition(8)
    got = {r["revisit_id"]: r["response_id"] for r in warc_revisits.resolve_revisits(frame).collect()}
    low, last, want = -(2**63), None, {}
    for i, _, ts, status, _ in sorted(rows, key=lambda r: (low if r[2] is None else r[2], r[0])):
        if status == 200:
            last = i
        else:
            want[i] = last
    assert got == want


def test_revisits_as_of_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a.com", "b.com"]), rng.randrange(2000), rng.choice([200, 304]), {"etag": '"e"'}) for i in range(400)]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>")
    got = {r["revisit_id"]: r["response_id"] for r in warc_revisits.resolve_revisits(frame).collect()}
    for i, url, ts, status, _ in rows:
        if status == 304:
            before = [(t, j) for j, u, t, s, _ in rows if s == 200 and u == url and (t, j) < (ts, i)]
            assert got[i] == (max(before)[1] if before else None)


# ---- classifier


def test_classifier_on_held_out(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality_mil.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_classifier_odd_and_empty(spark, odd, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    model = quality_mil.fit(docs, labels)
    rows = quality_mil.score_documents(odd, none(labels)).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.5}
    assert quality_mil.score_documents(none(odd), labels).count() == 0
    assert quality_mil.good_documents(odd, none(labels)).columns == odd.columns
    twice = quality_mil.fit(docs.union(docs), labels)
    assert all(np.array_equal(twice[k], model[k]) for k in model)
    one = quality_mil.scores(model, list(quality_mil.passage_features([None, b"", b"a b", b"a b"])))
    assert one[0] == one[1] and one[2] == one[3] and all(0 <= s <= 1 for s in one)


def test_attention_gradient():
    """The hand-written backward pass lowers the loss on bags in which one passage decides."""
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(200):
        x = rng.normal(size=(rng.integers(1, 6), quality_mil.FEATURES)).astype(np.float32)
        x[0, 0] = 3 if i % 2 else -3
        bags.append(x)
        labels.append(i % 2)
    p = quality_mil.scores(quality_mil.train(bags, labels), bags)
    assert np.mean((p > 0.5) == np.array(labels)) > 0.98
    assert quality_mil.train([], [])["constant"] == 0.5


# ---- sharding


def check_shards(rows, texts, shards):
    sizes, groups = Counter(), {}
    for r in rows:
        text = texts(r["doc_id"])
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
        sizes[r["shard"]] += r["size"]
        groups.setdefault(hashlib.md5(text.encode()).hexdigest(), set()).add(r["shard"])
    assert all(len(x) == 1 for x in groups.values())
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    weights = Counter()
    for r in rows:
        weights[hashlib.md5(texts(r["doc_id"]).encode()).hexdigest()] += r["size"]
    assert max(sizes.values(), default=0) == sharding.smallest_capacity([weights[k] for k in sorted(weights)], shards)


def test_shards(spark, docs, texts):
    check_shards(sharding.assign_shards(docs, 16).collect(), texts.__getitem__, 16)


def test_shards_odd_and_empty(spark, odd):
    known = {r[0]: r[1] or "" for r in ODD}
    check_shards(sharding.assign_shards(odd, 3).collect(), known.__getitem__, 3)
    assert sharding.assign_shards(none(odd), 16).count() == 0


def test_slots_of_rows_without_an_id(spark):
    """No doc_id, or one, over many rows of few texts: slots without gaps, in the order of the texts' digests where ids are equal."""
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 5).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 40).alias("text"))
    got = sharding.assign_shards(rows, 3).collect()
    for shard in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    plan = sharding.assign_shards(rows, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(shard" not in plan  # no window holds the rows of a shard


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_minimax(spark, seed):
    rng = random.Random(seed)
    sizes = {hashlib.md5(f"{seed}-{i}".encode()).hexdigest(): rng.choice([1, 5, 900]) * rng.randrange(1, 9) for i in range(300)}
    cuts = sharding.partition_cuts(spark.createDataFrame(list(sizes.items()), "key string, size long"), 7)
    loads = Counter(sum(k >= c for c in cuts) for k in sizes for _ in range(sizes[k]))
    assert max(loads.values()) == sharding.smallest_capacity([sizes[k] for k in sorted(sizes)], 7)


def test_smallest_capacity_equals_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 12))]
        c = sharding.smallest_capacity(sizes, 3)
        best = min(max(sum(sizes[:i]), sum(sizes[i:j]), sum(sizes[j:])) for i in range(len(sizes) + 1) for j in range(i, len(sizes) + 1))
        assert c == best


# ---- line rules


def brute_repeats(words):
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_line_measures_odd(spark, odd):
    rows = sorted(line_rules.line_quality(odd).collect(), key=lambda r: (r["n_words"], r["word_chars"]))
    want = []
    for _, text, *_ in ODD:
        words = [w.decode() for w in (text or "").encode().split()]
        want.append((len(words), sum(map(len, words)), brute_repeats(words)))
    assert [(r["n_words"], r["word_chars"], r["n_repeat_words"]) for r in rows] == sorted(want, key=lambda x: x[:2])
    assert line_rules.line_quality(none(odd)).count() == 0
    assert line_rules.clean_documents(odd).columns == odd.columns


def test_lines_are_removed(spark):
    good = "This is a plain sentence of some words that say a thing.\n" * 1
    body = "".join(good.replace("thing", f"thing{i}").replace("plain", f"plain{i}").replace("words", f"words{i}").replace("some", f"some{i}") for i in range(12))
    text = body + "Home | About | Contact | Login\nAll rights reserved.\n\nLast line is fine."
    frame = spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long")
    clean = line_rules.clean_documents(frame).first()
    assert "Home |" not in clean["text"] and "rights" not in clean["text"] and clean["text"].endswith("Last line is fine.")
    assert clean["n_chars"] == len(clean["text"])


def test_lines_of_any_script(spark):
    """A listed word among words of another script is no navigation; bars and boilerplate still are."""
    body = "".join(f"Sentence {i} tells of plain{i} things and some{i} words that say more.\n" for i in range(12))
    stay = [
        "我们昨天去了 top 酒店，房间很干净，早餐也不错。", "Мы вчера нашли home и остались довольны.", "Πήγαμε home χθες.", "ذهبنا home أمس.", "Été menu été.",
        "Copyright law is a wide field of its own.", "(c) the third point of the list stands here.",
    ]
    go = ["Home | Menu — Search", "· accueil · retour ·", "Copyright 2020 A. Person.", "© A. Person.", "(c) 2019 A. Person.", "Copyright (c) somebody."]
    frame = spark.createDataFrame([(i, body + line) for i, line in enumerate(stay + go)], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in line_rules.clean_documents(frame).collect()}
    assert [line for i, line in enumerate(stay + go) if left[i].endswith("\n" + line)] == stay


# ---- token counts


def test_token_counts(spark, odd, docs, texts):
    import sentencepiece

    path = Q.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for frame, known in ((docs, texts), (odd, {r[0]: r[1] or "" for r in ODD})):
        for r in token_counts.count_tokens(frame, path).collect():
            text = known[r["doc_id"]]
            n = len(model.encode(text))
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 4096)
    assert token_counts.count_tokens(none(odd), path).count() == 0


def test_pre_tokens_add_up():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))
    assert token_counts.splits_exactly(model)
    length, rng = token_counts.length_of(model), random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("abcde ▁\n\t é中🙂 <s>.") for _ in range(rng.randrange(1, 30)))
        assert sum(map(length, token_counts.pre_tokens(text.encode()))) == len(model.encode(text)), repr(text)


def test_word_cache_is_bounded():
    cache = WordCache(lambda w: len(w), {b"x": -1}, limit=10)
    for i in range(500):
        assert cache[f"{i}".encode()] == len(f"{i}")
        cache.turn()
        assert len(cache) <= 12 and len(cache.old) <= 12
    assert cache[b"x"] == -1 and cache[b"y" * 100] == 100 and b"y" * 100 not in cache


# ---- near duplicates


def brute_components(pairs):
    sets, parent = {}, {}
    for d, text in pairs:
        words = (text or "").encode().lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    counts, where = Counter(), {}
    for d in sorted(sets):
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    for ds in where.values():
        counts.update((ds[i], ds[j]) for j in range(len(ds)) for i in range(j))
    for (a, b), n in counts.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates(spark, docs, texts):
    want = brute_components(texts.items())
    for r in near_dedup.near_components(docs).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("large", [2, 0])
def test_families_near_the_threshold(spark, monkeypatch, large):
    """Blocks of few members; without large groups, and with pivots for every group."""
    monkeypatch.setattr(near_dedup, "LARGE_BLOCKS", large)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    rng, rows = random.Random(5), []
    for _ in range(4):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(words)))
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def template_family(seed, texts=90):
    """Texts of one template with about a fifth of their own, some of them near copies of others."""
    rng = random.Random(seed)
    base, rows = [f"t{i}" for i in range(80)], []
    for i in range(texts):
        if i % 6 == 5:
            words = rows[rng.randrange(len(rows))][1].split()
            words[rng.randrange(len(words))] = f"c{i}"
        else:
            words = [*base, *(f"o{i}_{k}" for k in range(rng.randrange(16, 30)))]
        rows.append((i, " ".join(words[rng.randrange(3) :])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_rare_shingles_part_a_template_family(spark, monkeypatch, seed):
    """Texts with a template in common, but below the threshold: near copies among them are found, and the template brings nobody together."""
    rows, seen, inner = template_family(seed), [], near_dedup._postings
    for name, value in (("BLOCK_NODES", 8), ("BLOCK_SHINGLES", 700), ("PIVOTS", 1), ("PIVOT_ROUNDS", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(near_dedup, "_postings", lambda *x: seen.append(inner(*x)) or seen[-1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert seen


@pytest.mark.parametrize("seed", range(3))
def test_similar_sets_meet_in_a_posting(spark, seed):
    rng, rows = random.Random(seed), template_family(seed, 60)
    sets = {i: x for (i, _), x in zip(rows, near_dedup.shingle_sets([t.encode() for _, t in rows]), strict=True)}
    component = {i: i if rng.random() < 0.7 else 0 for i in sets}
    nodes = spark.createDataFrame([(i, component[i], 1) for i in sets], "node long, component long, w long")
    full = spark.createDataFrame([(i, len(x), bytearray(x.tobytes())) for i, x in sets.items()], "node long, n long, shingles binary")
    sides = {}
    for r in near_dedup._postings(nodes, full).collect():
        for k in ("left", "right"):
            if r[k]:
                sides.setdefault(r["g"], {"left": [], "right": []})[k].append(r["node"])
    meet = {(min(a, b), max(a, b)) for g in sides.values() for a in g["left"] for b in g["right"] if a != b}
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    apart = [(a, b) for a in sets for b in sets if a < b and component[a] != component[b]]
    alike = {(a, b) for a, b in apart if near_dedup._enough(both(a, b), len(sets[a]), len(sets[b]))}
    assert alike and alike <= meet
    assert len(meet) < len(apart) / 4
    assert near_dedup._postings(nodes.filter("false"), full).count() == 0


def test_near_duplicates_odd_and_empty(spark, odd):
    rows = near_dedup.near_components(odd).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[None][2]
    assert near_dedup.near_components(none(odd)).count() == 0
    kept = near_dedup.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_rows_without_or_with_repeated_ids(spark):
    words = lambda start: [f"w{start + i}" for i in range(200)]
    a, b, c, d = (" ".join(words(1000 * i)) for i in range(4))
    near_a, near_b = " ".join([*words(0)[:-2], "x", "y"]), " ".join([*words(1000)[:-2], "x", "y"])
    rows = [(None, a), (None, a), (None, near_a), (7, c), (7, d), (5, near_b), (3, b), (9, b), (9, "something else"), (None, near_b), (8, ""), (8, ""), (4, None)]
    kept = near_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    unnamed = [r["text"] for r in kept if r["doc_id"] is None]
    assert len(unnamed) == 1 and unnamed[0] in (a, near_a)
    named = sorted((r["doc_id"], r["text"] or "") for r in kept if r["doc_id"] is not None)
    assert named == sorted([(3, b), (7, c), (7, d), (9, "something else"), (8, ""), (4, "")])


@pytest.mark.parametrize("seed", range(3))
def test_stars(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(50)] + [(999, 0)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in parent if x not in loops}


# ---- search


def test_top_k_odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [0.5, -0.25, 0.1 * (i % 3)]) for i in range(120)] + [(200, None), (250, [1.0, None, 0.0]), (300, [inf, 0.0, 0.0]), (350, [nan, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (400, [1.0])]
    rows += [(450, [1e6, 1e6, 1e6]), (451, [1e6, 1e6, 1e6])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {i: [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v] for i, v in rows if i is not None and v and i not in (250, 300, 350)}
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k.top_k(frame, 5, 50).collect())
    want = []
    for q in (x for x in whole if x % 50 == 0):
        score = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(score[:5], 1)]
    assert got == sorted(want)
    assert top_k.top_k(none(frame)).count() == 0


def test_products_that_do_not_fit_are_refused():
    big = np.array([[2**31, 2**31]])
    assert top_k.products(big, np.array([[2**31, -(2**31)]]))[0, 0] == 0
    with pytest.raises(OverflowError):
        top_k.products(big, big)


def test_top_k_over_many_cells(spark, monkeypatch):
    for name, value in (("TILE", 7), ("QUERIES_A_TASK", 3), ("ROWS_A_TASK", 9), ("MERGE", 2)):
        monkeypatch.setattr(top_k, name, value)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 3, 4)]) for i in rng.permutation(150)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 4, 10).collect()}
    known = {i: np.array(v) * 256 for i, v in rows}
    for q in range(0, 150, 10):
        best = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q)[:4]
        assert [got[(q, n + 1)] for n in range(4)] == [(i, -s) for s, i in best]


def test_cells_of_long_vectors(spark, monkeypatch):
    """Long vectors make cells of fewer rows; the result stays."""
    rows = spark.range(60).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: F.sin(x * F.col("id")).cast("float")).alias("embedding"))
    whole = sorted(top_k.top_k(rows, 4, 10).collect())
    monkeypatch.setattr(top_k, "VALUES_A_TASK", 640)
    assert top_k._cells(top_k.integer_vectors(rows), 1000) == 6
    assert sorted(top_k.top_k(rows, 4, 10).collect()) == whole


def test_top_k_with_repeated_ids(spark, monkeypatch):
    """Rows of one vec_id are all queries and candidates, as in the SQL; in one cell and in many."""
    rng = np.random.default_rng(5)
    rows = [(int(i % 40), [float(x) for x in rng.integers(-3, 3, 4)]) for i in range(120)]
    rows += [*rows[:3], (10, rows[10][1]), (11, rows[11][1])] + [(20, [3.0, -3.0, 3.0, -3.0])] * 12
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    known = [(i, np.array(v) * 256) for i, v in rows]
    want = []
    for q in range(0, 40, 10):
        best = sorted((-int(u @ v), c) for i, u in known if i == q for c, v in known if c != q)[:4]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    for tile in (4096, 7):
        if tile == 7:
            for name, value in (("TILE", 7), ("QUERIES_A_TASK", 3), ("ROWS_A_TASK", 9), ("MERGE", 2)):
                monkeypatch.setattr(top_k, name, value)
        assert sorted(tuple(r) for r in top_k.top_k(frame, 4, 10).select("query_id", "rank", "vec_id", "score").collect()) == want


# ---- mixing


def target_sizes(sizes, weights, most=3):
    """Targets that share sum(sizes) by weight; none is above `most` times its size, the excess is shared again by weight."""
    # a source is at its limit before any other whose size is larger for its weight
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    targets, left, weight = [0.0] * len(sizes), sum(sizes), sum(weights)
    for k, i in enumerate(order):
        if left * weights[i] / weight <= most * sizes[i]:
            for j in order[k:]:
                targets[j] = left * weights[j] / weight
            break
        targets[i] = float(most * sizes[i])
        left, weight = left - most * sizes[i], weight - weights[i]
    return targets


def test_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES_A_BUCKET", 2)
    for seed in range(6):
        rng = random.Random(seed)
        sizes = [rng.choice([0, 1, 10, 1000, 10**9]) * rng.randrange(1, 9) for _ in range(9)]
        t = target_sizes(sizes, [1 + i % 3 for i in range(9)])
        assert sum(t) == pytest.approx(sum(sizes)) and all(x <= 3 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
        names = sorted(rng.sample([chr(c) for c in range(0x21, 0x1F600, 997) if not 0xD800 <= c < 0xE000], 8)) + [None]
        frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
        rows = sorted(mixing._sources(frame)[0].collect(), key=lambda r: r["sid"])
        assert [r["source"] for r in rows] == names and [r["target"] for r in rows] == pytest.approx(t)
        edges = [0]
        for r in rows:
            assert r["take"] == min(int(r["target"] + 0.5), 3 * r["source_size"])
            edges.append(edges[-1] + r["take"])
        assert [(r["low"], r["high"]) for r in rows] == [((a << 46) // max(1, edges[-1]), (b << 46) // max(1, edges[-1])) for a, b in zip(edges, edges[1:], strict=False)]


def test_many_sources(spark, monkeypatch):
    """200,000 sources of few words: each has its own slot, and the mix takes what the targets say."""
    frame = spark.range(200_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.expr("repeat('a ', cast(id % 3 + 1 as int))").alias("text"))
    rows = mixing.mix_report(frame)
    totals = rows.agg(F.count("*"), F.sum("taken"), F.sum("target"), F.max(F.abs(F.col("taken") - F.col("target"))), F.max(F.col("taken") / F.col("size"))).first()
    assert totals[0] == 200_000 and totals[2] == pytest.approx(400_000, abs=3) and totals[3] <= 1 and totals[4] <= 3
    names = sorted(f"s{i}" for i in range(200_000))
    want = dict(zip(names, target_sizes([int(n[1:]) % 3 + 1 for n in names], [1 + i % 3 for i in range(200_000)]), strict=True))
    assert all(r["target"] == pytest.approx(want[f"s{r['doc_id']}"]) for r in rows.select("doc_id", "target").collect())


def test_points_are_counted_right():
    points = mixing.reversed_bits(np.arange(3000))
    for x in (0, 1, 1 << 40, 123_456_789_012_345 % (1 << 46), 1 << 46):
        below = np.concatenate([[0], np.cumsum(points < x)])
        assert (mixing.points_below(np.arange(3001), np.full(3001, x)) == below).all()


def test_mix(spark, docs, texts):
    rows = mixing.mix_report(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode().split()) and 0 <= r["taken"] <= 3 * r["size"]
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
    names = sorted(size)
    assert [target[s] for s in names] == pytest.approx(target_sizes([size[s] for s in names], [1 + i % 3 for i in range(len(names))]))
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    key = lambda x: (x["doc_id"], x["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix_report(docs.repartition(7)).collect()))


def test_mix_schedule_is_even(spark, docs):
    """Slots are a permutation of ranks, and any stretch of the schedule holds sources in proportion."""
    sized = docs.select("doc_id", "source", F.length("text").cast("long").alias("size"))
    known, slots = mixing._sources(sized)
    sources = known.collect()
    rows = mixing.schedule(known, slots).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    for s in sources:
        assert sorted(r["rank"] for r in rows if r["sid"] == s["sid"]) == list(range(s["slots"]))
    half = Counter(r["sid"] for r in rows[: len(rows) // 2])
    assert all(abs(half[s["sid"]] - s["slots"] / 2) <= 8 for s in sources)


def test_mixed_documents(spark, odd, docs, texts):
    taken = Counter()
    for r in mixing.mix_report(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += len(r["text"].encode().split())
    assert +got == +taken
    assert len(mixing.mix_report(odd).collect()) == len(ODD)
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix_report(none(odd)).count() == 0 and mixing.mixed_documents(none(odd)).count() == 0


# ---- reply trees


def test_trees_equal_brute_force(spark):
    rng, rows = random.Random(8), []
    for conv in (None, 1, 2):
        for i in range(40):
            parent = rng.choice([None, *range(i)]) if i else None
            rows.append((conv, i, 99 if i == 7 else parent, rng.choice(["user", "assistant", None]), rng.choice(["a", "<|im_end|>\n", "&lt;|", None, ""]), float(rng.randrange(5))))
    rows += [(3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0)]
    frame = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(r["conv_id"], r["branch"]): r for r in reply_trees.read_back(reply_trees.format_trees(frame, 3)).collect()}
    for conv in (None, 1, 2):
        node = {r[1]: r for r in rows if r[0] == conv}
        up = {i: r[2] if r[2] in node else None for i, r in node.items()}
        path = lambda i: [] if i is None else [*path(up[i]), i]
        leaves = [path(i) for i in node if i not in up.values()]
        leaves.sort(key=lambda p: (-sum(node[i][5] for i in p), -len(p), p[-1]))
        for k, p in enumerate(leaves[:3], 1):
            turns = [(node[i][3] or "", node[i][4] or "") for i in p]
            r = got[(conv, k)]
            assert [(t["role"], t["text"]) for t in r["turns"]] == turns
            assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
            for s, text in zip(r["loss_spans"], [t for role, t in turns if role == "assistant"], strict=True):
                inner = r["formatted"][s["start"] : s["start"] + s["length"]]
                assert inner.replace("&lt;|", "<|").replace("&amp;", "&") == text
    assert not any(c == 3 for c, _ in got)


def test_long_chain_and_odd_turns(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(300)] + [(2, None, None, None), (2, None, None, None), (2, 1, "a\nb&#10;", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in reply_trees.conversation_digests(spark, frame).collect()}
    assert got[1]["n_turns"] == 300 and got[2]["n_turns"] == 3 and got[-1]["n_turns"] == 2
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:300])
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256("\n\n\n\na\nb&#10;\nx\n".encode()).hexdigest()
    assert [r["conv_id"] for r in reply_trees.conversation_digests(spark, none(frame)).collect()] == [-1]


# ---- clashing names


def test_names_that_clash(spark, docs):
    """Columns named as the operators' own come through as they are."""
    names = ["__row_id", "__size", "__taken", "__left", "__text", "__row", "row", "number", "size", "left", "place", "cut", "epoch", "slot", "component_id", "file", "at"]
    frame = docs.withColumns({n: F.lit(n) for n in names})
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    for out in (mixing.mixed_documents(frame), near_dedup.keep_one_of_each(frame), line_rules.clean_documents(frame), quality_mil.good_documents(frame, labels)):
        assert out.columns == frame.columns
        row = out.first()
        assert all(row[n] == n for n in names)
    assert packing.pack_documents(frame, Q.tokenizer_path("word_bpe_49k.json")).agg(F.sum("length")).first() == packing.pack_documents(docs, Q.tokenizer_path("word_bpe_49k.json")).agg(F.sum("length")).first()


# ---- the order of the mix


def test_mix_order_reaches_the_sequences(spark, tmp_path):
    """Rows of a mix come in slot order, and every stretch of rows or packed sequences holds the sources in proportion."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(99)}" for _ in range(rng.randrange(100, 300))), "abc"[i % 3]) for i in range(900)]
    mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    source = {i: s for i, _, s in rows}
    ordered = mixed.select("doc_id", "text", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
    sequences = packing.pack_documents(mixed, Q.tokenizer_path("word_bpe_49k.json")).filter("part = 'main'").orderBy("sequence_id", "offset").collect()
    for listed, amount in ((ordered, lambda r: len(r["text"].split())), (sequences, lambda r: r["length"])):
        whole, parts = Counter(), [Counter() for _ in range(6)]
        for k, r in enumerate(listed):
            whole[source[r["doc_id"]]] += amount(r)
            parts[k * 6 // len(listed)][source[r["doc_id"]]] += amount(r)
        total = sum(whole.values())
        for part in parts:
            for s in "abc":
                assert abs(part[s] / sum(part.values()) - whole[s] / total) < 0.12


# ---- pipeline


def brute_clean(text):
    """The line rules, plainly: (kept, cleaned text)."""
    import re

    import regex

    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines, lost, left = text.split("\n"), 0, []
    for line in lines:
        solid = len(re.sub(r"[ \t\n\x0b\f\r]", "", line))
        count = lambda cs, line=line: sum(line.count(c) for c in cs)
        low = line.lower()
        bad = solid > 0 and (
            count("#*$%&<>") * 100 > solid * 15
            or count("!") * 100 > solid * 12
            or (solid >= 80 and not re.search(line_rules.SENTENCE_MARKS, line))
            or (count("|\u00bb>") >= 2 and count("|\u00bb>") * 100 >= solid * 5)
            or (solid <= 200 and regex.search(line_rules.NAVIGATION, low))
            or regex.search(line_rules.BOILERPLATE, low)
        )
        lost += solid if bad else 0
        left += [] if bad else [line]
    kept = len(words) >= 50 and brute_repeats(words) * 100 <= len(words) * 50 and lost * 100 <= sum(map(len, words)) * 40
    return kept, "\n".join(left)


def brute_scores(model, texts):
    """The forward pass, one passage after the other."""
    from math import exp, tanh

    out = []
    if "constant" in model:  # labels of one class only
        return [model["constant"]] * len(texts)
    for bag in quality_mil.passage_features([t.encode() for t in texts]):
        hidden, energy = [], []
        for x in bag:
            x = (x - model["mean"]) / model["scale"]
            h = [tanh(float(x @ model["w"][:, k] + model["b"][k])) for k in range(model["w"].shape[1])]
            v, u = np.array(h) @ model["v"], np.array(h) @ model["u"]
            hidden.append(h)
            energy.append(sum(float(a) * tanh(p) / (1 + exp(-q)) for a, p, q in zip(model["a"], v, u, strict=True)))
        weight = [exp(e - max(energy)) for e in energy]
        z = sum(w / sum(weight) * np.array(h) for w, h in zip(weight, hidden, strict=True))
        out.append(1 / (1 + exp(-float(z @ model["c"] + model["d"][0]))))
    return out


def test_scores_equal_a_plain_forward_pass(spark, docs, texts):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    model = quality_mil.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_mil.score_documents(docs, labels).collect()}
    ids = sorted(texts)
    assert [got[i] for i in ids] == pytest.approx(brute_scores(model, [texts[i] for i in ids]), abs=1e-6)


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on all that the stage before has kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "near_duplicates", "mixing_sources", "packing_sequences"]

    def after(name):
        nonlocal docs
        before = {r["doc_id"]: r for r in docs.collect()}
        stages[name](spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == names
        return before, docs.collect()

    before, rows = after("quality_rules")
    want = {i: brute_clean(r["text"]) for i, r in before.items()}
    assert {r["doc_id"]: r["text"] for r in rows} == {i: text for i, (kept, text) in want.items() if kept}
    model = quality_mil.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality"))
    before, rows = after("quality_classifier")
    ids = sorted(before)
    good = [i for i, p in zip(ids, brute_scores(model, [before[i]["text"] for i in ids]), strict=True) if p >= 0.3]
    assert sorted(r["doc_id"] for r in rows) == good and all(r["text"] == before[r["doc_id"]]["text"] for r in rows)
    before, rows = after("near_duplicates")
    groups = brute_components((i, r["text"]) for i, r in before.items())
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, (_, c) in groups.items() if i == c)
    before, rows = after("mixing_sources")
    taken = Counter({r["doc_id"]: r["taken"] for r in mixing.mix_report(spark.createDataFrame(list(before.values()))).collect()})
    got, times = Counter(), Counter()
    for r in rows:
        assert before[r["doc_id"]]["text"].startswith(r["text"])
        got[r["doc_id"]] += len(r["text"].encode().split())
        times[r["doc_id"]] += 1
    assert +got == +taken and max(times.values()) <= 3
    pieces = stages["packing_sequences"](spark, docs, DATA).collect()
    check_packing(pieces, whole_ids((r["doc_id"], r["text"]) for r in rows))
    assert corpus_pipeline.run(spark, DATA).count() == len(pieces)
