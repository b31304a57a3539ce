"""Format families, completeness scores and confidence tiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lists, weights and limits that decide results.
FAMILIES = {
    "audiobook": ("m4b", "mp3", "m4a", "opus", "ogg", "flac"),
    "comic": ("cbz", "cbr", "cb7", "cbx"),
    "ebook": ("epub", "pdf", "mobi", "azw", "azw3", "fb2", "kepub", "txt", "docx"),
}
WEIGHTS = {
    "title": 3.0,
    "authors": 3.0,
    "comments": 2.5,
    "has_cover": 2.0,
    "formats": 2.0,
    "isbn": 1.5,
    "publisher": 1.5,
    "pubdate": 1.5,
    "tags": 1.0,
    "series": 1.0,
    "languages": 1.0,
    "rating": 1.0,
}
UNKNOWN_AUTHORS = "未知作者|佚名|unknown|n/a"
CONFIDENCE_LABELS = {"strong": "确定", "likely": "很可能", "weak": "存疑", "certain": "完全相同"}
RANKS = {"file_hash": 4, "isbn": 3, "exact_metadata": 2, "fuzzy_metadata": 1, "weak_title_only": 0}
LIKELY_FROM = 0.95
DEFAULT_THRESHOLD, LEAST_THRESHOLD = 0.85, 0.5


def media_family(form: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(form)), r"^\.+", "")
    out = F.lit("unknown")
    for family, forms in FAMILIES.items():
        out = F.when(plain.isin(*forms), family).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def families_of(forms: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(forms, F.array().cast("array<string>")), media_family))


def has_text(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))


def has_items(value: Column) -> Column:
    return F.coalesce(F.size(value) > 0, F.lit(False))


def unknown_author(authors: Column) -> Column:
    """True if no name is given, or placeholders only."""
    named = F.exists(authors, lambda a: F.coalesce((F.trim(a) != "") & ~F.lower(a).rlike(UNKNOWN_AUTHORS), F.lit(False)))
    return ~F.coalesce(named, F.lit(False))


def presence(c) -> dict[str, Column]:
    """Which of the weighted fields are filled; c(name) gives a column. A rating of 0 means none."""
    return {
        "title": has_text(c("title")),
        "authors": ~unknown_author(c("authors")),
        "comments": F.coalesce(c("comments_present"), F.lit(False)),
        "has_cover": F.coalesce(c("has_cover"), F.lit(False)),
        "formats": has_items(c("formats")),
        "isbn": has_text(c("isbn")),
        "publisher": has_text(c("publisher")),
        "pubdate": has_text(c("pubdate")),
        "tags": has_items(c("tags")),
        "series": has_text(c("series")),
        "languages": has_items(c("languages")),
        "rating": F.coalesce(c("rating") > 0, F.lit(False)),
    }


def meta_score(c) -> Column:
    """Completeness from 0 to 100, cut to a whole number."""
    earned = sum((F.when(p, WEIGHTS[f]).otherwise(0.0) for f, p in presence(c).items()), F.lit(0.0))
    return (earned / sum(WEIGHTS.values()) * 100).cast("int")


def missing_fields(c) -> Column:
    names = F.array(*[F.when(~p, f) for f, p in presence(c).items()])
    return F.filter(names, lambda x: x.isNotNull())


def rounded4(x: Column) -> Column:
    """A share rounded to four decimals by its exact binary value, halves to even.

    x * 20000 as a double and what it lost (Dekker's product) tell exactly on which side of a half x lies.
    """
    top = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * 20000.0
    lost = (top * 20000.0 - product) + (x - top) * 20000.0
    halves = F.floor(product)
    at_half = (product == halves) & (halves % 2 == 1)
    low = F.floor(halves / 2)
    half = F.when(lost > 0, low + 1).when(lost < 0, low).otherwise(low + low % 2)
    return F.when(at_half, half).otherwise(F.floor((halves + 1) / 2)).cast("double") / 10000.0


def confidence(rank: Column, similarity: Column) -> Column:
    likely = rounded4(F.coalesce(similarity, F.lit(1.0))) >= LIKELY_FROM
    return F.when(rank >= 3, "strong").when(rank == 2, "likely").when((rank == 1) & likely, "likely").otherwise("weak")


def normalize_threshold(value: object) -> float:
    """A share or a percentage as a share within [0.5, 1]; what is no number is the default."""
    try:
        v = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return DEFAULT_THRESHOLD
    if v != v:
        return DEFAULT_THRESHOLD
    return min(1.0, max(LEAST_THRESHOLD, v / 100 if v > 1 else v))


def added_micros(added: Column) -> Column:
    """ISO time as a number; 0 (the oldest) where there is none."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(added)), F.lit(0)).cast("long")


def signature(title: Column, authors: Column, size: Column) -> Column:
    """What an ignored pair remembers of a record: title, first author, size in steps of 64 KiB."""
    return F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(F.get(authors, F.lit(0)), F.lit("")), F.floor(F.coalesce(size, F.lit(0)) / 65536).cast("string"))
