"""Data sheets: parameters from text, tables of contents, makers, order codes, section quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import text_or_empty
from docweave.functions.values import name_quality, value_quality
from docweave.operators.ordered import first_per_key

_UNIT = r"\b(?:V|A|W|mA|mm|cm|m|km|g|kg|ms|s|Hz|kHz|bar|°[CF]|K|%|DC|AC|VA|bit|Ω|µm|MPa|psi)\b"
_NOISE = r"(?i)\A(?:Page\s+\d|https?://|www\.|©|All rights|\d{2}\.\d{2}\.\d{4})"
#: Line patterns, in the order they are tried: name and value by colon, by a wide gap, by a tab or bar.
LINES = (
    r"\A\s*([^:|\t]{3,70}?)\s*:\s*(\S.{0,149})\z",
    r"\A\s*([A-Z][A-Za-z0-9\s/\-.,()°±]{3,60}?)\s{4,}(\S.{1,80})\z",
    r"\A\s*([^:|\t]{3,70}?)\s*[\t|]\s*(\S.{0,149})\z",
)


def lines(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, line_no, line (as it is) of whole texts."""
    parts = F.posexplode(F.split(text_or_empty(column), r"\r\n|\r|\n"))
    return texts.select(key, parts.alias("line_no", "line")).where(F.trim("line") != "")


def parameters(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, name, value, line_no: parameters of whole texts; the first of a name counts, earlier patterns first.

    A name has 3 to 70 characters and is no number or capital heading; a value without number or unit has at most four
    words, and is no page, address or date line.
    """
    name, value, tier = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(LINES))):
        hit = F.col("line").rlike(p)
        name = F.when(hit, F.rtrim(F.trim(F.regexp_extract("line", p, 1)), F.lit(",:;"))).otherwise(name)
        value = F.when(hit, F.rtrim(F.trim(F.regexp_extract("line", p, 2)), F.lit(",;"))).otherwise(value)
        tier = F.when(hit, i).otherwise(tier)
    found = lines(texts, key, column).withColumns({"name": name, "value": value, "tier": tier}).where("tier is not null")
    heading = (F.col("name") == F.upper("name")) & F.col("name").rlike(r"\p{L}") & (F.length("name") > 8)
    words = F.size(F.filter(F.split("value", r"\s+"), lambda w: w != ""))
    plain = ~F.col("value").rlike(r"\d") & ~F.col("value").rlike(_UNIT) & (words > 4)
    kept = found.where(
        F.length("name").between(3, 70) & ~F.col("name").rlike(r"\A\d+\z") & ~heading & ~plain & ~F.col("value").rlike(_NOISE)
        & (F.length("value") <= 150) & ~F.lower("value").rlike(r"www\.|http")
    )
    keyed = kept.withColumn("k", F.lower(F.rtrim("name", F.lit(" :"))))
    return first_per_key(keyed.select(key, "k", "tier", "line_no", "name", "value"), [key, "k"], ["tier", "line_no"]).select(key, "name", "value", "line_no")


def contents(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, name of the entries of a table of contents: names followed by dots and a page."""
    pattern = r"\A(.{4,60}?)\s{2,}[.\s]{4,}\s*\d{1,3}\s*\z"
    name = F.rtrim(F.trim(F.regexp_extract("line", pattern, 1)), F.lit(". "))
    found = lines(texts, key, column).where(F.col("line").rlike(pattern)).select(key, name.alias("name"))
    return found.where((F.length("name") >= 5) & ~F.col("name").rlike(r"(?i)\A(table of|\d)")).distinct()


def value_of(text: Column | str, label: str) -> Column:
    """The value after a label: after a colon, after a gap, or on the next line; null without one.

    A value after a gap or a line has a number, a unit or at most three words.
    """
    import re

    source, name = text_or_empty(text), re.escape(label).replace(r"\ ", r"\s+")
    colon = F.regexp_extract(source, rf"(?i){name}\s*:\s*(\S[^\n]{{1,80}})", 1)
    gap = F.regexp_extract(source, rf"(?i){name}(?![ .]*\.[ .]{{3,}})[ \t]{{2,}}(\S[^\n]{{0,80}})", 1)
    line = F.regexp_extract(source, rf"(?i){name}[ \t]*\n\s*(\S[^\n]{{1,80}})", 1)
    real = lambda v: v.rlike(r"\d") | v.rlike(_UNIT)
    short = F.size(F.split(F.trim(gap), r"\s+")) <= 3
    return F.when(colon != "", F.trim(colon)).when((gap != "") & (real(gap) | short), F.trim(gap)).when((line != "") & real(line), F.trim(line))


def section_quality(parameters_: DataFrame, section: str) -> DataFrame:
    """section, quality: the mean score of its names and values, 4 places."""
    score = (name_quality("name") + value_quality("value")) / 2
    return parameters_.groupBy(section).agg(F.bround(F.round(F.avg(score), 9), 4).alias("quality"), F.count(F.lit(1)).alias("n"))


def maker(text: Column | str, makers: list[str]) -> Column:
    """The first maker of a list that a text names, by place, longer names first among equals; empty without one."""
    import re

    ordered = sorted(makers, key=lambda m: (-len(m), m))
    return F.regexp_extract(text_or_empty(text), r"(?i)(?<!\w)(" + "|".join(re.escape(m) for m in ordered) + r")(?!\w)", 1)


def order_code(text: Column | str) -> Column:
    """An order or article number: after such a label, else the first token of its shape; empty without one."""
    source = text_or_empty(text)
    labelled = F.regexp_extract(source, r"(?i)(?:order|article|bestell|artikel)[-\s]?(?:no|nr|nummer|code|number)?\.?\s*:?\s*([A-Z0-9][A-Z0-9\-./]{4,30}\d[A-Z0-9\-./]*)", 1)
    return F.when(labelled != "", labelled).otherwise(F.regexp_extract(source, r"\b([A-Z]{2,5}[- ]?\d[\dA-Z\-./]{5,30})\b", 1))
