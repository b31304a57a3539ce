"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from colophon.functions import isbn as I
from colophon.functions import metadata as M
from colophon.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "key"), [("《活着》", "活着"), ("三体·全集", "三体全集"), ("A—B", "ab"), ("ＴＨＥ ＨＯＢＢＩＴ", "thehobbit"), (None, ""), ("  ", ""), ("a؝b⹓", "ab")]
)
def test_title_key(spark, text, key):
    assert one(spark, T.title_key(F.lit(text).cast("string"))) == key


@pytest.mark.parametrize(("text", "core"), [("孙子兵法(全本)", "孙子兵法"), ("罪与罚（上）", "罪与罚"), ("A（B）C", "A(B)C"), ("x (a) [b]", "x")])
def test_title_core(spark, text, core):
    assert one(spark, T.title_core(F.lit(text))) == core


def test_author_keys(spark):
    assert one(spark, T.author_keys(F.array(F.lit("甲 & 乙"), F.lit("乙"), F.lit(None)))) == ["甲", "乙"]
    assert one(spark, T.author_keys(F.lit(None).cast("array<string>"))) == []


PAIRS = [
    ("德川家康（第一部）", "德川家康（第十二部）", "<"),
    ("苗疆蛊事", "苗疆蛊事1", "<"),
    ("苗疆蛊事（全集）", "苗疆蛊事1", "<"),
    ("鲁迅全集（全20卷）", "鲁迅全集", "<"),
    ("The Economist [Thu, 16 Jun]", "The Economist [Thu, 23 Jun]", "<"),
    ("孙子兵法", "孙子兵法(全本)", ">"),
    ("我是猫", "我是猫(果麦经典)", ">"),
    ("天龙八部（一）", "天龙八部（一）", ">"),
]


@pytest.mark.parametrize(("a", "b", "side"), PAIRS)
def test_variant_score(spark, a, b, side):
    key = lambda x: F.lit(one(spark, T.title_key(F.lit(x))))
    core = lambda x: F.lit(one(spark, T.title_key(F.lit(one(spark, T.title_core(F.lit(x)))))))
    ka, kb, ca, cb = key(a), key(b), core(a), core(b)
    score, back = one(spark, T.variant_score(ka, kb, ca, cb)), one(spark, T.variant_score(kb, ka, cb, ca))
    assert score == back
    assert (score >= 0.85) == (side == ">")


@pytest.mark.parametrize(("raw", "key"), [("0306406152", "9780306406157"), ("978-7-02-000220-7", "9787020002207"), ("0306406153", None), ("", None), (None, None), ("097522980X", "9780975229804")])
def test_isbn_key(spark, raw, key):
    assert one(spark, I.isbn_key(F.lit(raw).cast("string"))) == key
    assert one(spark, I.isbn_key(F.lit(""), F.lit(raw).cast("string"))) == key


@pytest.mark.parametrize(("value", "share"), [("85", 0.85), (0.3, 0.5), (1, 1.0), (1.5, 0.5), ("x", 0.85), (None, 0.85), (200, 1.0)])
def test_threshold(value, share):
    assert M.normalize_threshold(value) == share


@pytest.mark.parametrize(("rank", "similarity", "tier"), [(3, None, "strong"), (1, 1.0, "likely"), (1, 0.95, "likely"), (1, 0.9, "weak"), (0, 1.0, "weak"), (2, 0.1, "likely")])
def test_confidence(spark, rank, similarity, tier):
    assert one(spark, M.confidence(F.lit(rank), F.lit(similarity).cast("double"))) == tier


@pytest.mark.parametrize(("size", "text"), [(512, "512 B"), (1536, "1.5 KB"), (3 * 1024**2, "3.0 MB")])
def test_bytes_text(spark, size, text):
    assert one(spark, T.bytes_text(F.lit(size))) == text
