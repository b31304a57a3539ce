"""Title, author and serial-number functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters, words and marks below define which titles count as the same.
HAN_NUMERALS = "〇零一二三四五六七八九十百千两壹贰叁肆伍陆柒捌玖拾"
NUMERALS = f"0-9{HAN_NUMERALS}"
UNITS = "部卷册辑篇集回期章"
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
AUTHOR_SEPARATORS = "[&,;、，；/]| and "
SERIAL_LONGEST = 16

SERIAL = (
    f"^(?:第[{NUMERALS}]+[{UNITS}]|[{NUMERALS}]+[{UNITS}]?|[上下中][册卷部]?|全|共|套装|[a-z]{{0,4}}[0-9]{{1,4}}[a-z]{{0,4}})+$"
)
SERIAL_NOTE = f"[0-9]|^第[{NUMERALS}]+[{UNITS}]|^[{HAN_NUMERALS}上下中]{{1,3}}$|[上下中][册卷部]"
#: Punctuation, separators and white space; the last ranges are assigned later than Java 17's tables.
DROPPED = r"[\p{P}\p{Z}\s\x1c-\x1f\x85؝᭽᭾⹓-⹝]"
LAST_BRACKETS = r"(?:[（(\[][^）)\]]*[）)\]]\s*)+$"


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition. Spark has no built-in for it; ASCII texts need none and don't reach Python."""
    return F.coalesce(_compatible(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def key_of(normal: Column) -> Column:
    """Comparison key of a text that is composed already."""
    return F.lower(F.regexp_replace(normal, DROPPED, ""))


def title_key(text: Column) -> Column:
    """Composed, without punctuation and spaces, lower case; '' for null."""
    return key_of(nfkc(F.coalesce(text, F.lit(""))))


def core_of(normal: Column) -> Column:
    return F.regexp_replace(F.trim(normal), LAST_BRACKETS, "")


def title_core(text: Column) -> Column:
    """The title without its last bracketed notes (raw text, not a key)."""
    return F.trim(core_of(nfkc(F.coalesce(text, F.lit("")))))


def author_keys(authors: Column) -> Column:
    """Distinct keys of all names in the list, split at the usual separators."""
    parts = F.flatten(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.split(F.coalesce(a, F.lit("")), AUTHOR_SEPARATORS)))
    joined = nfkc(F.array_join(parts, "\x00"))
    keys = F.transform(F.split(joined, "\x00"), key_of)
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def is_serial(text: Column) -> Column:
    """True if the whole text is a volume or issue mark of at most 16 characters."""
    return (F.length(text) > 0) & (F.length(text) <= SERIAL_LONGEST) & text.rlike(SERIAL)


def is_serial_note(text: Column) -> Column:
    """True if a title's note counts volumes, issues or parts."""
    return (F.length(text) > 0) & text.rlike(SERIAL_NOTE)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of characters that two texts have in common at their starts."""
    short = F.least(F.length(a), F.length(b))
    first = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), F.lit(False))
    return F.when(short == 0, 0).when(first == 0, short).otherwise(first - 1).cast("int")


def differs_by_serial(a: Column, b: Column) -> Column:
    """True if two keys share two characters or more and differ in volume marks only.

    A mark is short, so all but the last characters are compared at once, and only those one by one.
    """
    start = F.greatest(F.length(a), F.length(b), F.lit(SERIAL_LONGEST)) - SERIAL_LONGEST
    last = lambda k: F.substring(k, start + 1, F.lit(2 * SERIAL_LONGEST))
    head = common_prefix(last(a), last(b))
    rest = lambda k: F.substring(last(k), head + 1, F.lit(2 * SERIAL_LONGEST))
    fits = lambda r: (r == "") | is_serial(r)
    near = (a != b) & (F.abs(F.length(a) - F.length(b)) <= SERIAL_LONGEST) & (F.length(a) >= 2) & (F.length(b) >= 2)
    return near & (F.left(a, start) == F.left(b, start)) & (start + head >= 2) & fits(rest(a)) & fits(rest(b))


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def cjk_ratio(text: Column) -> Column:
    """Share of CJK characters among those that aren't spaces; 0 without any."""
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(solid == 0, 0.0).otherwise(F.length(F.regexp_replace(text, f"[^{CJK}]", "")) / solid)


def gram_size(key: Column) -> Column:
    """2 for keys with a fair share of CJK characters, else 3."""
    cjk = F.length(F.regexp_replace(key, f"[^{CJK}]", ""))
    return F.when((cjk > 0) & (cjk >= F.lit(0.3) * F.length(F.regexp_replace(key, r"\s", ""))), 2).otherwise(3)


def grams(text: Column, n: int) -> Column:
    """All character n-grams, in one pass; a shorter text is its own only gram; '' has none."""
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) < n, F.array(text)).otherwise(every)


def dice(a: Column, b: Column, n: int) -> Column:
    """Dice coefficient of two texts' n-gram multisets."""
    ga, gb = grams(a, n), grams(b, n)
    count = lambda g, x: F.size(F.filter(g, lambda y: y == x))
    both = F.aggregate(F.array_distinct(ga), F.lit(0), lambda s, x: s + F.least(count(ga, x), count(gb, x)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(both * 2.0 / (F.size(ga) + F.size(gb)))


def squeezed(text: Column) -> Column:
    """The text with runs of one character reduced to one."""
    return F.regexp_replace(text, r"(?s)(.)\1+", "$1")


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set of squeezed bigrams that the other holds."""
    sa, sb = F.array_distinct(grams(squeezed(a), 2)), F.array_distinct(grams(squeezed(b), 2))
    short = F.least(F.size(sa), F.size(sb))
    return F.when(short == 0, 0.0).otherwise(F.size(F.array_intersect(sa, sb)) / short)


def key_similarity(a: Column, b: Column) -> Column:
    """Dice at the smaller gram size of the two; between CJK titles no more than their containment."""
    han = (gram_size(a) == 2) | (gram_size(b) == 2)
    return F.when(han, F.least(dice(a, b, 2), containment(a, b))).otherwise(dice(a, b, 3))


def note_of(key: Column, core: Column) -> Column:
    """What a title's note adds to its core."""
    return F.when((core != "") & F.startswith(key, core), F.substring(key, F.length(core) + 1, F.length(key))).otherwise("")


def variant_score(a: Column, b: Column, a_core: Column, b_core: Column) -> Column:
    """Similarity of two titles, by their keys or by their cores, whichever is larger.

    Titles that differ in volume only score 0; where a note counts volumes, cores don't speak for the titles.
    """
    full = key_similarity(a, b)
    cores = (a_core != "") & (b_core != "") & ((a_core != a) | (b_core != b))
    counted = is_serial_note(note_of(a, a_core)) | is_serial_note(note_of(b, b_core)) | differs_by_serial(a_core, b_core)
    by_core = F.when(a_core == b_core, 1.0).otherwise(key_similarity(a_core, b_core))
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(differs_by_serial(a, b), 0.0)
        .when(F.coalesce(cores, F.lit(False)) & ~F.coalesce(counted, F.lit(False)), F.greatest(full, by_core))
        .otherwise(full)
        .cast("double")
    )


def bytes_text(size: Column) -> Column:
    """1536 as '1.5 KB': powers of 1024, one decimal beyond bytes, halves up."""
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        tenths = F.floor(size / 1024**power * 10 + 0.5) / 10
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", tenths)).otherwise(out)
    return out
