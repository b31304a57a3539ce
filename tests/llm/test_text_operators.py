"""Fill-in-middle, license scans and collocations against brute force and odd inputs."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from colophon.llm import collocations, fill_middle, license_scan

LONG = "Lorem é🙂 one-two. " * 9000
ODD = [
    (1, None, "en", "clash"), (2, "", None, "clash"), (3, " \t\n ", "en", "clash"), (4, "x", "fr", "clash"), (5, "same", "fr", "clash"), (5, "same", "fr", "clash"), (5, "another", "fr", "clash"),
    (6, LONG, "en", "clash"), (None, "no id 🙂 here", None, None), (7, "holds <S> itself", "und", "z"), (8, "\x00\x1c\x85 a b <P", None, "z"), (9, "a" * 256, "en", "z"), (10, "🙂é" * 300, "en", "z"),
]
NAMES = "doc_id long, text string, lang string, n string, file string, row string, pos string, start string, places string, phrase string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "", "", "", "", "", "") for r in ODD], NAMES).cache()


# ---- fill in the middle


def plain_cut(text, units, a, b):
    """Code points before the a-th and b-th unit of a text."""
    ends = [0]
    at = 0
    while at < len(text):
        m = units.match(text, at)
        at = m.end() if m else at + 1
        ends.append(at)
    return ends[a], ends[b], len(ends) - 1


@pytest.mark.parametrize(("units", "pattern"), [(fill_middle.CODE_POINTS, "(?s:.)"), (fill_middle.WORDS, r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+"), (fill_middle.LINES, r"[^\n]+\n?|\n")])
@pytest.mark.parametrize("run", [1, 3, 256])
def test_units_are_cut_right(spark, odd, monkeypatch, units, pattern, run):
    monkeypatch.setattr(fill_middle, "RUN", run)
    rows = odd.filter(F.length("text") < 2000) if run == 1 else odd
    half = lambda doc_id, n: [F.call_function("div", n, F.lit(3)), n - F.call_function("div", n, F.lit(7))]
    out = fill_middle.fill_in_middle(rows, units, half).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == rows.count()
    for r in out:
        assert r["back"] == r["text"]
        n = plain_cut(r["text"], re.compile(pattern), 0, 0)[2]
        assert r["n"] == n
        if r["form"] == "plain":
            assert r["output"] == r["text"] and r["prefix_chars"] is None and r["middle_chars"] is None
            continue
        a, b, _ = plain_cut(r["text"], re.compile(pattern), n // 3, n - n // 7)
        p, m, s = r["text"][:a], r["text"][a:b], r["text"][b:]
        assert (r["prefix_chars"], r["middle_chars"]) == (a, b - a)
        assert r["output"] == (f"<P>{p}<S>{s}<M>{m}" if r["form"] == "psm" else f"<S>{s}<P>{p}<M>{m}")


def test_forms(spark, odd):
    forms = {(r["doc_id"], r["text"]): r["form"] for r in fill_middle.fill_in_middle(odd).collect()}
    assert forms[(1, "")] == forms[(2, "")] == forms[(7, "holds <S> itself")] == "plain"
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    share = {r["form"]: r["count"] / 4000 for r in fill_middle.fill_in_middle(many).groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.1) < 0.02 and abs(share["spm"] - 0.18) < 0.03
    assert fill_middle.fim_digests(odd.filter("false")).count() == 0


def test_texts_are_shuffled_once(spark):
    """The join with the offsets hashes them and moves each text once; none is sorted."""
    plan = fill_middle.fim_digests(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(file") == 2


# ---- license scans


def test_markup():
    assert license_scan.parse('A <<beginOptional>>b <<var;name="x";original="y";match=".{0,3}">><<endOptional>> C-d <<var;name="z";original="";match="e f|g|">>') == [
        b"a", ("optional", [b"b", ("any", 0, 3)]), b"c", b"d", ("one of", [[b"e", b"f"], [b"g"], []]),
    ]
    for wrong in ("a <<endOptional>>", "a <<beginOptional>> b", "a <<unknown>>"):
        with pytest.raises(ValueError):
            license_scan.parse(wrong)
    for wrong in ('<<var;name="x";original="y";match=".+">> a', "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            license_scan.TokenAutomaton({"x": wrong})


@pytest.mark.parametrize("seed", range(8))
def test_automaton_equals_patterns(seed, monkeypatch):
    """Random templates over few words: every start, its longest end, in parts and with a small cache."""
    rng = random.Random(seed)
    monkeypatch.setattr(license_scan, "STEP", 17)
    monkeypatch.setattr(license_scan, "CACHED_STEPS", 5)

    def made(depth=0):
        out = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.random()
            if kind < 0.55 or depth > 1:
                out.append(rng.choice("abc"))
            elif kind < 0.75:
                out.append(f"<<beginOptional>>{made(depth + 1)}<<endOptional>>")
            elif kind < 0.9:
                least = rng.randrange(3)
                out.append(f'<<var;name="n";original="";match=".{{{least},{least + rng.randrange(3)}}}">>')
            else:
                out.append(f'<<var;name="n";original="";match="{"|".join(" ".join(rng.choice("abc") for _ in range(rng.randrange(3))) for _ in range(2))}">>')
        return " ".join(out)

    templates = {f"t{i}": f"{rng.choice('abc')} {made()}" for i in range(4)}
    automaton = license_scan.TokenAutomaton(templates)
    for _ in range(30):
        words = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        want = []
        for label, markup in templates.items():
            pattern = re.compile(license_scan.as_pattern(license_scan.parse(markup)))
            for i in range(len(words)):
                ends = [j for j in range(i, len(words)) if pattern.fullmatch("".join(w + " " for w in words[i : j + 1]))]
                want += [(label, i, max(ends))] if ends else []
        n, got = automaton.scan(" . ".join(words).encode())
        assert (n, sorted(got)) == (len(words), sorted(want))


def test_license_texts(spark):
    mit = re.sub("<<(?!var).*?>>", " ", license_scan.TEMPLATES["mit-text"]).replace(re.search("<<var.*?>>", license_scan.TEMPLATES["mit-text"])[0], "this program")
    texts = [mit, mit.replace("merge,", "sell,"), "Licensed under the Apache License, Version 2.0.", "the apache license", "GNU General Public License version 3, gnu general public license", None, "Cc BY-NC 4.0 " * 3]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_scan.license_labels(frame).collect()}
    assert [rows[i]["labels"] for i in range(7)] == ["mit-text", "", "apache,apache-2.0", "apache", "gpl,gpl-3.0", "", "cc-by,cc-by-nc-4.0"]
    assert [rows[i]["score"] for i in range(7)] == [1.0, 0.0, 1.0, 0.5, 1.0, 0.0, 1.0]
    assert (rows[6]["n_base"], rows[6]["first_word"], rows[6]["last_word"], rows[6]["base_labels"]) == (3, 0, 10, "cc-by")
    with pytest.raises(ValueError):
        license_scan.license_places(frame, {"mit": "some words"})


def test_license_scan_odd_and_empty(odd):
    rows = license_scan.license_labels(odd).collect()
    assert len(rows) == len(ODD) and all(r["labels"] == "" and r["first_word"] is None for r in rows)
    assert license_scan.license_labels(odd.filter("false")).count() == 0


# ---- collocations


def brute_collocations(rows, least, most_words, top, inside):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for k in range(1, most_words + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    rows = []
    for (lang, p), a in found.items():
        score, _, left, right = min((Fraction(10**6 * a * a, f[lang, p[:k]] * f[lang, p[k:]]).__floor__(), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        around = max((b for (la, q), b in found.items() if la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
        if not around or 100 * around < inside * a:
            rows.append((lang, -score, -a, " ".join(p).encode(), left, right, n[lang]))
    rows.sort()
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right, total in rows:
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -score))
    return out


@pytest.mark.parametrize(("seed", "most_words", "small"), [(0, 3, False), (1, 3, True), (2, 4, True), (3, 2, False)])
def test_collocations_equal_brute_force(spark, monkeypatch, seed, most_words, small):
    """Repeated words, shards of a few texts, classes of a few blocks and a filter that is nearly full don't change a count."""
    rng = random.Random(seed)
    if small:
        for name, value in (("SHARD_PLACES", 500), ("STEP", 40), ("CLASS_BLOCKS", 7), ("ROUNDS", (3, 2, 1))):
            monkeypatch.setattr(collocations, name, value)
    words = ["the", "of", "É", "x y", "\x00", "don't", *(f"w{i}" for i in range(25))]
    rows = [(rng.choice(["en", "fr", None, "und"]), rng.choice(["", ". "]).join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "; ", "\r"]) for _ in range(rng.randrange(120)))) for _ in range(300)]
    rows += [("en", "the the the the the. The of the of the of"), ("en", None), ("en", "")] * 7
    monkeypatch.setattr(collocations, "FILTER_BITS", 256)
    frame = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit(1), "words": F.lit(2), "a": F.lit(3)}).repartition(3)
    out = collocations.collocations(frame, 10, most_words, 40, 50)
    got = sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(brute_collocations(rows, 10, most_words, 40, 50))


def test_parts_keep_the_text():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("ab .\n;") for _ in range(rng.randrange(200))).encode()
        collected = list(collocations.parts(text))
        assert b"".join(collected) == text


def test_collocations_odd_and_empty(odd):
    assert collocations.collocations(odd).filter("lang = 'en'").count() > 0
    assert collocations.collocations(odd.filter("false")).count() == 0
    assert collocations.collocations(odd.withColumn("text", F.lit(None).cast("string"))).count() == 0
