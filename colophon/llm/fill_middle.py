"""Fill-in-middle transformation on relational units.

A text is cut between units: code points, words, lines or what a pattern matches, left to right. The matches are
posexploded, window running sums of their lengths give where each begins, cut requests are joined by unit ordinal, and the
offsets found are aggregated to one row for each document, which its text meets in one join; `substring` cuts there.

A row is a run of RUN units, not one (`(unit){1,RUN}` matches the same units one after the other, and whatever the pattern
doesn't match is a unit of one code point, so every run but the last has RUN units and a request finds its run by
division). The units before the cut inside that one run are measured by an expression. So a text gives n / RUN rows,
and texts themselves are shuffled once, by the last join; offsets are small.

Defined results: a null text is empty; empty texts and texts that hold a marker stay plain; a null doc_id draws its numbers
from no digits; repeated rows are cut alike (rows are told apart by their place in the table's files); an empty table
gives an empty table. Columns other than doc_id and text are not read. A pattern must not match the empty text nor look
outside its match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import is_scan, written

RUN = 256
MARKERS = ("<P>", "<S>", "<M>")
#: Percent of the documents that are cut, and percent of those with the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20


@dataclass(frozen=True)
class Units:
    """What a text is made of: a Java pattern, and the code points of every match where all have as many."""

    pattern: str
    length: int | None = None

    def runs(self) -> Column:
        """Pattern of up to RUN units one after the other."""
        return F.lit(f"{self._one()}{{1,{RUN}}}")

    def _one(self) -> str:
        return self.pattern if self.length == 1 else rf"(?:{self.pattern}|(?s:.))"

    def count(self, run: Column) -> Column:
        return F.length(run) if self.length == 1 else F.size(F.regexp_extract_all(run, F.lit(self._one()), F.lit(0)))

    def measure(self, run: Column, units: Column) -> Column:
        """Code points of a run's first units."""
        if self.length == 1:
            return units
        first = F.slice(F.regexp_extract_all(run, F.lit(self._one()), F.lit(0)), F.lit(1), units)
        return F.aggregate(first, F.lit(0), lambda s, x: s + F.length(x))


CODE_POINTS, WORDS, LINES = Units("(?s:.)", 1), Units(r"\s*\S+"), Units(r"[^\n]+\n?|\n")


def drawn(doc_id: Column, i: int) -> Column:
    """The i-th number, from 1, that a document draws: a group of eight digits of a digest of its id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def drawn_cuts(doc_id: Column, n: Column) -> list[Column]:
    """After how many of n units the prefix and the middle end."""
    cuts = [drawn(doc_id, i) % (n + 1) for i in (1, 2)]
    return [F.least(*cuts), F.greatest(*cuts)]


def unit_runs(rows: DataFrame, keys: list[str], units: Units) -> DataFrame:
    """keys, doc_id, pos, start and chars of every run of units, and n, the units of its text."""
    runs = rows.select(*keys, "doc_id", F.posexplode(F.regexp_extract_all("text", units.runs(), F.lit(0))).alias("pos", "run"))
    sized = runs.select(*keys, "doc_id", "pos", F.length("run").cast("long").alias("chars"), units.count(F.col("run")).cast("long").alias("units"))
    text = Window.partitionBy(*keys)
    before = text.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select(*keys, "doc_id", "pos", "chars", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("start"), F.sum("units").over(text).alias("n"))


def cut_places(runs: DataFrame, keys: list[str], cuts: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """keys, n and at0, at1 ...: for each cut the run (start, chars) that ends with it or holds it, and the units before the cut in there."""
    asked = cuts(F.col("doc_id"), F.col("n"))
    requests = runs.filter("pos = 0").select(*keys, "n", F.posexplode(F.array(*asked)).alias("cut", "ordinal"))
    requests = requests.withColumn("pos", F.call_function("div", F.greatest(F.col("ordinal") - 1, F.lit(0)), F.lit(RUN)).cast("int"))
    met = requests.join(runs.select(*keys, "pos", "start", "chars"), [*keys, "pos"])
    at = F.struct("start", "chars", (F.col("ordinal") - F.col("pos") * RUN).cast("int").alias("units"))
    return met.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("cut") == i, at)).alias(f"at{i}") for i in range(len(asked))])


def fill_in_middle(documents: DataFrame, units: Units = CODE_POINTS, cuts: Callable[[Column, Column], list[Column]] = drawn_cuts) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars and output of every document.

    form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle). `restored` turns an output back.
    """
    # no more of the rows is read or written than this
    rows = documents.select("doc_id", "text")
    rows = rows if is_scan(rows) else written(rows, "fim-documents")
    keys = ["file", "row"]
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    places = cut_places(written(unit_runs(rows, keys, units), "fim-runs"), keys, cuts)
    text = F.col("text")
    # the places are small and one for each text at most: hashed, so the texts need no sort
    met = rows.join(places.hint("shuffle_hash"), keys, "left")
    offset = lambda at: F.col(f"{at}.start") + units.measure(F.substring(text, (F.col(f"{at}.start") + 1).cast("int"), F.col(f"{at}.chars").cast("int")), F.col(f"{at}.units"))
    marked = F.contains(text, F.lit(MARKERS[0])) | F.contains(text, F.lit(MARKERS[1])) | F.contains(text, F.lit(MARKERS[2]))
    plain = (text == "") | marked | (drawn(F.col("doc_id"), 3) % 100 >= CUT_PERCENT)
    form = F.when(plain, "plain").when(drawn(F.col("doc_id"), 4) % 100 < SUFFIX_FIRST_PERCENT, "spm").otherwise("psm")
    cut = met.select("doc_id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"), form.alias("form"), offset("at0").cast("int").alias("first"), offset("at1").cast("int").alias("second"))
    prefix = F.substring(text, F.lit(1), F.col("first"))
    middle = F.substring(text, F.col("first") + 1, F.col("second") - F.col("first"))
    suffix = F.substring(text, F.col("second") + 1, F.length(text))
    p, s, m = (F.lit(x) for x in MARKERS)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    shown = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return cut.select("doc_id", "text", "n", "form", shown(F.col("first")).alias("prefix_chars"), shown(F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form were made of; no text that was cut holds a marker, so the first of each kind parts it."""

    def parts(a: str, b: str, c: str) -> tuple[Column, Column, Column]:
        """What follows a up to b, b up to c, and c; the output begins with a."""
        rest = F.substring(output, F.lit(len(a) + 1), F.length(output))
        first = F.substring_index(rest, b, 1)
        rest = F.substring(rest, F.length(first) + len(b) + 1, F.length(rest))
        second = F.substring_index(rest, c, 1)
        return first, second, F.substring(rest, F.length(second) + len(c) + 1, F.length(rest))

    prefix, suffix, middle = parts("<P>", "<S>", "<M>")
    late, early, inner = parts("<S>", "<P>", "<M>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(early, inner, late))


def fim_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of every document's output and of the text read back from it."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = fill_in_middle(documents)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM e
), x AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""
