"""Quality rules [native]: line-first cleaning.

Every line is judged by punctuation, navigation and boilerplate rules, failing lines are removed, and a
document is rejected when the removed lines held too much of its text. DataFrame functions only: one
pass over the documents, no shuffle, no Python on executors. Windows of three words are compared by
64-bit hashes first; a text in which none come twice has no repeats, and of others the windows themselves are compared.
Phrases of navigation and boilerplate are those of English, French, German and Spanish pages.

Defined results: a null or empty text has no words and fails the base rules; a line without a word is
neither judged nor removed; repeated documents get equal rows; an empty table gives an empty table; other
columns are kept as they are by clean_documents and never read by line_quality.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.common import SPACE_CHARS, words_of

SYMBOLS = "#*$%&|<>"
#: Percent of a line's non-space characters.
MAX_SYMBOLS, MAX_EXCLAIMS, MIN_BARS = 15, 12, 5
#: A line of so many non-space characters needs a mark that ends or parts a sentence.
UNPUNCTUATED = 80
#: Percent of a document's word characters that its removed lines may hold.
MAX_LOST = 40
SENTENCE_MARKS = "[.!?…:;。！？]"
#: What navigation bars and boilerplate lines say.
NAVIGATION_WORDS = (
    "home|menu|log ?in|sign ?(in|up)|search|next|previous|back|top|contact( us)?|about( us)?|sitemap|share|skip to content"
    "|accueil|connexion|rechercher|suivant|précédent|retour|plan du site|partager"
    "|startseite|anmelden|suche|weiter|zurück|impressum|kontakt|teilen"
    "|inicio|iniciar sesión|buscar|siguiente|anterior|volver|contacto|mapa del sitio|compartir"
)
#: What stands between words: no letter, digit or mark of any script.
BETWEEN = r"[^\p{L}\p{N}\p{M}_]"
NAVIGATION = rf"^{BETWEEN}*({NAVIGATION_WORDS})({BETWEEN}+({NAVIGATION_WORDS}))*{BETWEEN}*$"
BOILERPLATE = (
    r"all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|(uses?|accept) cookies"
    r"|enable javascript|click here|subscribe to our|lorem ipsum"
    rf"|^{BETWEEN}*copyright *(©|\(c\)|[0-9]{{4}})|^{BETWEEN}*©|^{BETWEEN}*\(c\) *[0-9]{{4}}|^{BETWEEN}*licensed under the "
    r"|tous droits réservés|politique de confidentialité|conditions d'utilisation|mentions légales|cliquez ici"
    r"|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|hier klicken"
    r"|todos los derechos reservados|política de privacidad|términos de uso|aviso legal|haga clic aquí"
)
#: A text without any of these has no line of boilerplate; looking for them is much cheaper than the pattern.
BOILERPLATE_HINTS = (
    "rights reserved", "terms of ", "privacy policy", "cookie", "javascript", "click here", "subscribe to our", "lorem ipsum", "copyright", "(c)", "©", "licensed under ",
    "tous droits r", "confidentialit", "conditions d'", "mentions l", "cliquez ici", "rechte vorbehalten", "datenschutz", "nutzungsbed", "hier klicken",
    "derechos reservados", "de privacidad", "rminos de uso", "aviso legal", "haga clic",
)
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_without(text, characters))


def line_fails(line: Column, solid: Column, signs: Column, hinted: Column) -> Column:
    """True if a line with a word breaks the punctuation, navigation or boilerplate rule.

    solid: its non-space characters. signs, hinted: whether its text has any symbol or '!', and hints of
    boilerplate; without them the costlier counts are left out.
    """
    punctuation = (
        (signs & (_count(line, SYMBOLS.replace("|", "")) * 100 > solid * MAX_SYMBOLS))
        | (signs & (_count(line, "!") * 100 > solid * MAX_EXCLAIMS))
        | ((solid >= UNPUNCTUATED) & ~line.rlike(SENTENCE_MARKS))
    )
    bars = _count(line, "|»>")
    navigation = (signs & (bars >= 2) & (bars * 100 >= solid * MIN_BARS)) | ((solid <= 200) & F.lower(line).rlike(NAVIGATION))
    return (solid > 0) & (punctuation | navigation | (hinted & F.lower(line).rlike(BOILERPLATE)))


def _measured(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with n_words, BASE, __judged (lines with l, solid and bad) and lost_chars.

    Each select below ends with what the next reads more than once, so that the optimiser keeps it as a
    column and does not compute it anew for each element of an array.
    """
    rest = rows.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    a = rows.select(
        *rest,
        words_of(text).alias("__words"),
        F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("l"), F.length(_without(x, SPACE_CHARS)).alias("solid"))).alias("__lines"),
        F.lower(text).alias("__low"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
    )
    n = F.size("__words")
    hinted = reduce(or_, [F.col("__low").contains(x) for x in BOILERPLATE_HINTS])
    window = lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))
    b = a.select(
        *rest,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "__words",
        "__lines",
        hinted.alias("__hinted"),
        ((F.col("n_symbols") > 0) | text.contains("!") | text.contains("»")).alias("__signs"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")).alias("__windows"),
        F.transform(F.filter("__lines", lambda x: x["solid"] > 0), lambda x: x["l"]).alias("__full"),
    )
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    words = lambda i: F.array_join(F.slice("__words", i + 1, F.lit(3)), " ")
    placed = F.sort_array(F.transform("__windows", lambda w, i: F.struct(words(i).alias("w"), i.alias("i"))))
    bad = lambda x: line_fails(x["l"], x["solid"], F.col("__signs"), F.col("__hinted"))
    c = b.select(
        *rest,
        "n_words",
        "word_chars",
        "n_symbols",
        F.transform("__lines", lambda x: F.struct(x["l"].alias("l"), x["solid"].alias("solid"), bad(x).alias("bad"))).alias("__judged"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, placed).otherwise(placed_none()).alias("__placed"),
    )
    same = lambda x, i: (x["w"] == F.get("__placed", i - 1)["w"]) | (x["w"] == F.get("__placed", i + 1)["w"])
    again = F.filter("__placed", lambda x, i: F.coalesce(same(x, i), F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    removed = F.filter("__judged", lambda x: x["bad"])
    return c.select(
        *rest,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.size(covered).cast("long").alias("n_repeat_words"),
        "__judged",
        F.aggregate(removed, F.lit(0).cast("long"), lambda s, x: s + x["solid"]).alias("lost_chars"),
        F.size(removed).cast("long").alias("n_lines_removed"),
    )


def placed_none() -> Column:
    return F.array().cast("array<struct<w:string,i:int>>")


def _judged(rows: DataFrame) -> DataFrame:
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return (
        _measured(rows)
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST))
    )


def line_quality(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, the four base measures, base_failed, kept, lost_chars and n_lines_removed of every document."""
    return _judged(documents.select("doc_id", "text")).select(
        "doc_id", "n_words", *BASE, "base_failed", "kept", "lost_chars", "n_lines_removed"
    )


def clean_documents(documents: DataFrame) -> DataFrame:
    """The kept documents with all their columns, less the lines that failed; n_chars follows the text."""
    columns = documents.columns
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col("text"))
    # Without a column that is not deterministic the optimiser would push the filter below the selects and
    # inline them, and count words anew for every element of an array.
    held = _judged(rows).withColumn("__row_number", F.monotonically_increasing_id())
    kept = held.filter(F.col("kept") & (F.col("__row_number") >= 0))
    clean = F.array_join(F.transform(F.filter("__judged", lambda x: ~x["bad"]), lambda x: x["l"]), "\n")
    new = {"text": F.col("__clean"), "n_chars": F.length("__clean").cast("long")}
    return kept.withColumn("__clean", clean).select(*[new.get(c, F.col("__row")[c]).alias(c) for c in columns])


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT row, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY row
), l AS (
  SELECT row, len(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS solid, l, lower(l) AS low,
         len(regexp_replace(l, '[^#*$%&<>]', '', 'g')) AS symbols,
         len(regexp_replace(l, '[^!]', '', 'g')) AS exclaims,
         len(regexp_replace(l, '[^|»>]', '', 'g')) AS bars
  FROM (SELECT row, unnest(ls) AS l FROM w)
), f AS (
  SELECT row, sum(solid) AS lost_chars, count(*) AS n_lines_removed FROM l
  WHERE symbols * 100 > solid * 15 OR exclaims * 100 > solid * 12
     OR (solid >= 80 AND NOT regexp_matches(l, '[.!?…:;。！？]'))
     OR (bars >= 2 AND bars * 100 >= solid * 5) OR (solid <= 200 AND regexp_matches(low, '@NAV@')) OR regexp_matches(low, '@BOIL@')
  GROUP BY row
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(lost_chars, 0)::BIGINT AS lost_chars, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed
  FROM w LEFT JOIN r ON w.row = r.row LEFT JOIN f ON w.row = f.row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_chars * 100 <= word_chars * 40 AS kept, lost_chars, n_lines_removed
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
""".replace("@NAV@", NAVIGATION.replace("'", "''")).replace("@BOIL@", BOILERPLATE.replace("'", "''"))
