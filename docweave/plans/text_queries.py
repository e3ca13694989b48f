"""Queries of the text and value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.functions import values as v
from docweave.plans.registry import Registry
from docweave.session import table

registry = Registry()

#: DuckDB: white space as Python and Java (Unicode) know it.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: DuckDB: the compatibility forms that removing accents leaves alone, as far as the tables hold them.
_LONGER = {"¼": "14", "½": "12", "¾": "34", "²": "2", "³": "3", "¹": "1", "ª": "a", "º": "o", "™": "TM", "…": "...", "№": "No", "ﬁ": "fi", "ﬂ": "fl", "´": " ", "¨": " ", "¸": " ", "¯": " ", "\xa0": " ", "℃": "C",
    "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ", "，": ",", "：": ":", "；": ";", "（": "(", "）": ")", "！": "!", "？": "?",
}


def sql_fold(column: str) -> str:
    for char, plain in _LONGER.items():
        column = f"replace({column}, '{char}', '{plain}')"
    return f"regexp_replace(strip_accents({column}), '[^\\x00-\\x7F]', '', 'g')"


def sql_identifier(column: str) -> str:
    return f"regexp_replace(lower({sql_fold(f'coalesce({column}, chr(32))')}), '[^a-z0-9]+', '', 'g')"


def sql_label(column: str) -> str:
    return f"trim(regexp_replace(lower({sql_fold(f'coalesce({column}, chr(32))')}), '[^a-z0-9]+', ' ', 'g'))"


def sql_clean(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{SPACE}', ' ', 'g'))"


@registry.add(
    "norm_identifier",
    f"SELECT record_key, {sql_identifier('display_name')} AS identifier, count(*) AS n FROM source_entity GROUP BY 1, 2",
)
def _norm_identifier(spark, d):
    rows = table(spark, d, "source_entity").select("record_key", t.normalize_identifier("display_name").alias("identifier"))
    return rows.groupBy("record_key", "identifier").agg(F.count(F.lit(1)).alias("n"))


@registry.add("norm_label", f"SELECT DISTINCT raw_value, {sql_label('raw_value')} AS label FROM document_data")
def _norm_label(spark, d):
    return table(spark, d, "document_data").select("raw_value", t.normalize_label("raw_value").alias("label")).distinct()


@registry.add(
    "slug",
    f"SELECT DISTINCT attribute_name, CASE WHEN {sql_label('attribute_name')} = '' THEN 'field' ELSE replace({sql_label('attribute_name')}, ' ', '_') END AS slug FROM document_data",
)
def _slug(spark, d):
    return table(spark, d, "document_data").select("attribute_name", t.slugify("attribute_name").alias("slug")).distinct()


@registry.add(
    "label_tokens",
    f"SELECT token, count(*) AS n FROM (SELECT unnest(string_split({sql_label('p_name')}, ' ')) AS token FROM part) WHERE token <> '' GROUP BY 1",
)
def _label_tokens(spark, d):
    return table(spark, d, "part").select(F.explode(t.tokenize("p_name")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@registry.add("clean_text", f"SELECT doc_id, md5({sql_clean('text')}) AS digest, length({sql_clean('text')}) AS n FROM documents")
def _clean_text(spark, d):
    cell = t.clean_cell("text")
    return table(spark, d, "documents").select("doc_id", F.md5(cell.cast("binary")).alias("digest"), F.length(cell).cast("bigint").alias("n"))


_HINTS = " ".join(f"WHEN contains(l, '{h}') THEN '{k}'" for h, k in t.TYPE_HINTS)


@registry.add(
    "value_types",
    f"SELECT attribute_name, CASE {_HINTS} ELSE 'string' END AS value_type FROM (SELECT DISTINCT attribute_name, {sql_label('attribute_name')} AS l FROM document_data)",
)
def _value_types(spark, d):
    return table(spark, d, "document_data").select("attribute_name").distinct().withColumn("value_type", t.guess_value_type("attribute_name"))


#: DuckDB: word characters beyond ASCII, which its word boundary does not know.
WORD = "|".join(f"[^\\x00-\\x7F\\P{{{c}}}]" for c in ("L", "M", "Nd", "Nl", "Pc")) + "|[\\x{200C}\\x{200D}]"


def component_sql(column: str, distinct: bool = True) -> str:
    """Designations of a text, in any order if distinct.  Where a pattern has only capitals, a small letter stands for word characters beyond ASCII."""
    text = f"coalesce({column}, '')"
    plain = f"regexp_replace({text}, '{WORD}', 'q', 'g')"
    parts = [
        f"regexp_extract_all({text if p.startswith('(?iU)') else plain}, '{p.replace('(?iU)', '(?i)').replace('(?U)', '')}')" for p in t.COMPONENTS
    ]
    every = "list_filter(list_transform(flatten([" + ", ".join(parts) + "]), lambda x: trim(x, '.,;:()[]{}')), lambda x: x <> '')"
    return f"list_distinct({every})" if distinct else every


@registry.add(
    "component_tokens",
    f"SELECT token, count(*) AS n FROM (SELECT unnest({component_sql('canonical_akz')}) AS token FROM uc1_report) GROUP BY 1",
)
def _component_tokens(spark, d):
    return table(spark, d, "uc1_report").select(F.explode(t.component_tokens("canonical_akz")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@registry.add("document_tokens", f"SELECT token, count(*) AS n FROM (SELECT doc_id, unnest({component_sql('text')}) AS token FROM documents) GROUP BY 1")
def _document_tokens(spark, d):
    """Designations of whole texts."""
    return table(spark, d, "documents").select(F.explode(t.component_tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "identifier_like",
    "SELECT canonical_tag, coalesce(regexp_full_match(trim(canonical_tag), '(?i)(?:HC|TU|X|PXC|IO|AI|AO|DI|DO)[A-Z0-9:_/\\-.]+'), false) AS is_identifier, count(*) AS n FROM source_entity GROUP BY 1, 2",
)
def _identifier_like(spark, d):
    rows = table(spark, d, "source_entity").select("canonical_tag", F.coalesce(t.looks_like_identifier("canonical_tag"), F.lit(False)).alias("is_identifier"))
    return rows.groupBy("canonical_tag", "is_identifier").agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "coordinates",
    """SELECT p_partkey, (CASE WHEN p_size > 26 THEN chr(CAST(65 + (((p_size - 27) // 26) % 26) AS INT)) ELSE '' END
       || chr(CAST(65 + ((p_size - 1) % 26) AS INT)) || CAST(p_partkey AS VARCHAR)) AS coord FROM part""",
)
def _coordinates(spark, d):
    return table(spark, d, "part").select("p_partkey", t.cell_coordinate("p_partkey", "p_size").alias("coord"))


#: Three and two letters before a designation, written out apart from the engine's own list.
_PREFIX3 = "[TPLAWDVQSJZ]I[CRAS]|FI[CQRA]"
_PREFIX2 = "[TPFLAWDVQSJZ]I|[PFLTHZAS]V"


def sql_akz(column: str) -> str:
    return f"trim(upper(regexp_replace(coalesce({column}, ''), '[=./\\-]|{SPACE[:-1]}', '', 'g')))"


def sql_stripped(column: str) -> str:
    return (
        f"CASE WHEN regexp_matches({column}, '^({_PREFIX3})\\p{{L}}') THEN substr({column}, 4) "
        f"WHEN regexp_matches({column}, '^({_PREFIX2})\\p{{L}}') THEN substr({column}, 3) ELSE {column} END"
    )


#: Tags that begin with a prefix, or with letters that look like one (FIS).
_PLANTED = ("FISTU10", "FIQTU10.T4", "TISXP26", "PVTU20Y30", "FITU1", "TIC12", "HVAC 10", "FIS", "VISA1", "=ZV.AB1")


@registry.add(
    "akz_forms",
    f"SELECT DISTINCT canonical_tag, {sql_akz('canonical_tag')} AS akz, {sql_stripped(sql_akz('canonical_tag'))} AS bare FROM "
    f"(SELECT canonical_tag FROM source_entity UNION ALL SELECT unnest({list(_PLANTED)}))",
)
def _akz_forms(spark, d):
    planted = spark.createDataFrame([(x,) for x in _PLANTED], "canonical_tag string")
    rows = table(spark, d, "source_entity").select("canonical_tag").unionByName(planted).select("canonical_tag", t.normalize_akz("canonical_tag").alias("akz"))
    return rows.withColumn("bare", t.strip_function_prefix("akz")).distinct()


_TRUE = "('1', 'true', 'yes', 'present', 'complete', 'matched')"


@registry.add(
    "truth_values",
    f"SELECT DISTINCT attribute_value, lower({sql_clean('attribute_value')}) IN {_TRUE} OR (lower({sql_clean('attribute_value')}) NOT IN {_TRUE} AND regexp_full_match({sql_clean('attribute_value')}, "
    f"'[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?') AND coalesce(try_cast({sql_clean('attribute_value')} AS DOUBLE) > 0, false)) AS is_true FROM document_data",
)
def _truth_values(spark, d):
    return table(spark, d, "document_data").select("attribute_value", t.boolish("attribute_value").alias("is_true")).distinct()


def _sql_quantity(pattern: str) -> str:
    """Word boundaries are Unicode ones; per cent keeps its own, which wants a word after it."""
    return pattern if "%" in pattern else pattern.replace("(?!²|2|\\^)", "").replace("\\b", "(?:[^\\p{L}\\p{N}_]|$)")


_QUANTITY = " ".join(
    f"WHEN regexp_matches(x, '{_sql_quantity(p)}') THEN {i}" for i, (p, _) in enumerate(v.QUANTITIES)
)


@registry.add(
    "quantities",
    f"""WITH texts AS (SELECT DISTINCT attribute_value, trim(coalesce(attribute_value, '')) AS x FROM document_data),
    kind AS (SELECT *, CASE {_QUANTITY} END AS i FROM texts),
    found AS (SELECT *, """
    + "CASE i "
    + " ".join(f"WHEN {i} THEN regexp_extract(x, '{_sql_quantity(p)}', 1)" for i, (p, _) in enumerate(v.QUANTITIES))
    + " ELSE '' END AS num, CASE i "
    + " ".join(
        f"WHEN {i} THEN {repr(u) if u else 'regexp_extract(x, ' + repr(_sql_quantity(p)).replace(chr(92) * 2, chr(92)) + ', 2)'}" for i, (p, u) in enumerate(v.QUANTITIES)
    )
    + " ELSE '' END AS raw_unit FROM kind) "
    "SELECT attribute_value, regexp_replace(regexp_replace(regexp_replace(replace(num, ',', '.'), '^0+([0-9])', '\\1'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS value, "
    "CASE lower(raw_unit) "
    + " ".join(f"WHEN '{w}' THEN '{u}'" for w, u in v.UNIT_WORDS.items())
    + " ELSE raw_unit END AS unit FROM found",
)
def _quantities(spark, d):
    rows = table(spark, d, "document_data").select("attribute_value").distinct()
    parsed = rows.withColumn("q", v.parse_quantity("attribute_value"))
    return parsed.select("attribute_value", "q.value", "q.unit")


@registry.add("units")
def _units(spark, d):
    """Value and unit of whole raw values; the rules are tested against a plain version."""
    rows = table(spark, d, "document_data").select("raw_value").distinct()
    return rows.withColumn("u", v.split_value_unit("raw_value")).select("raw_value", "u.value", "u.unit")


@registry.add(
    "iec_aspects",
    """WITH x AS (SELECT DISTINCT canonical_tag, trim(coalesce(canonical_tag, '')) AS c FROM source_entity)
    SELECT canonical_tag, 'Referenzkennzeichnung (' || CASE
      WHEN c[1] = '=' AND (contains(c, '+') OR contains(c, '-')) THEN 'Orts+Produktaspekt' WHEN c[1] = '=' THEN 'Funktionsaspekt'
      WHEN c[1] = '+' AND contains(c, '-') THEN 'Orts+Produktaspekt' WHEN c[1] = '+' THEN 'Ortsaspekt' WHEN c[1] = '-' THEN 'Produktaspekt'
      WHEN contains(c, '+') AND contains(c, '-') THEN 'Orts+Produktaspekt' WHEN contains(c, '+') THEN 'Ortsaspekt' ELSE 'Produktaspekt' END || ')' AS aspect FROM x""",
)
def _iec_aspects(spark, d):
    return table(spark, d, "source_entity").select("canonical_tag").distinct().withColumn("aspect", v.iec_aspect("canonical_tag"))


_PHRASES = "|".join(p.replace("/", "\\/") for p in v.PHRASES)


@registry.add(
    "sanitized",
    "WITH x AS (SELECT DISTINCT raw_value, regexp_replace(regexp_replace(coalesce(raw_value, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]|\\p{Co}', '', 'g'), "
    f"'^{SPACE}|{SPACE}$', '', 'g') AS s FROM document_data) "
    f"SELECT raw_value, CASE WHEN lower(s) IN {v.PLACEHOLDERS} OR regexp_matches(lower(s), '{_PHRASES}') THEN '' ELSE s END AS value FROM x",
)
def _sanitized(spark, d):
    return table(spark, d, "document_data").select("raw_value").distinct().withColumn("value", v.sanitize_text("raw_value"))


@registry.add(
    "repaired_dates",
    """WITH x AS (SELECT DISTINCT attribute_value AS raw, coalesce(attribute_value, '') AS t, regexp_replace(trim(coalesce(attribute_value, '')), '^[^0-9a-zA-Z]+', '') AS b FROM document_data),
    y AS (SELECT *, regexp_full_match(b, '\\s*[0-9]+\\s*/\\s*[0-9]+\\s*/\\s*[0-9]+\\s*') AS three, string_split(b, '/') AS p FROM x),
    z AS (SELECT raw, t, CASE WHEN NOT three THEN b WHEN CAST(trim(p[2]) AS BIGINT) > 12
      THEN lpad(CAST(CAST(trim(p[2]) AS BIGINT) AS VARCHAR), greatest(2, length(CAST(CAST(trim(p[2]) AS BIGINT) AS VARCHAR)))::INT, '0') || '.' || lpad(CAST(CAST(trim(p[1]) AS BIGINT) AS VARCHAR), greatest(2, length(CAST(CAST(trim(p[1]) AS BIGINT) AS VARCHAR)))::INT, '0') || '.' || trim(p[3])
      ELSE lpad(CAST(CAST(trim(p[1]) AS BIGINT) AS VARCHAR), greatest(2, length(CAST(CAST(trim(p[1]) AS BIGINT) AS VARCHAR)))::INT, '0') || '.' || lpad(CAST(CAST(trim(p[2]) AS BIGINT) AS VARCHAR), greatest(2, length(CAST(CAST(trim(p[2]) AS BIGINT) AS VARCHAR)))::INT, '0') || '.' || trim(p[3]) END AS s FROM y)
    SELECT raw AS attribute_value, CASE WHEN regexp_matches(t, '[0-9]') AND regexp_matches(t, '[./]') THEN trim(translate(s, 'gGlLoOsS', '99110055')) ELSE t END AS repaired FROM z""",
)
def _repaired_dates(spark, d):
    return table(spark, d, "document_data").select("attribute_value").distinct().withColumn("repaired", v.repair_date("attribute_value"))


@registry.add(
    "confidence_states",
    """SELECT report_id, rtrim(rtrim(format('{:.4f}', confidence), '0'), '.') AS score, CASE WHEN len(coalesce(present_in, [])) = 0 THEN 'Requires_Review'
    WHEN confidence IS NULL THEN 'Unreviewed' WHEN confidence >= 0.8 THEN 'Auto_Approved' ELSE 'Requires_Review' END AS state, count(*) AS n FROM uc1_report GROUP BY ALL""",
)
def _confidence_states(spark, d):
    has = F.size(F.coalesce("present_in", F.array().cast("array<string>"))) > 0
    rows = table(spark, d, "uc1_report").select(
        "report_id", F.when(F.col("confidence").isNotNull(), v.score_text("confidence")).alias("score"), v.review_status(F.col("confidence"), has).alias("state")
    )
    return rows.groupBy("report_id", "score", "state").agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "page_numbers",
    "SELECT DISTINCT source_locator, greatest(1, coalesce(try_cast(nullif(regexp_extract(coalesce(source_locator, ''), '([0-9]+)', 1), '') AS BIGINT), 1)) AS page FROM chunks",
)
def _page_numbers(spark, d):
    return table(spark, d, "chunks").select("source_locator").distinct().withColumn("page", v.page_number("source_locator"))


@registry.add("terminals")
def _terminals(spark, d):
    """Terminal designators of whole values; tested against a plain version."""
    rows = table(spark, d, "document_data").select("attribute_value").distinct().withColumn("t", v.terminal_designator("attribute_value"))
    return rows.select("attribute_value", "t.name", "t.attribute", F.col("t.value").alias("detail"))


@registry.add("value_scores")
def _value_scores(spark, d):
    """How much names and values look like parameters; tested against a plain version."""
    rows = table(spark, d, "document_data").select("attribute_name", "attribute_value").distinct()
    return rows.select("attribute_name", "attribute_value", F.round(v.name_quality("attribute_name"), 6).alias("name_score"), F.round(v.value_quality("attribute_value"), 6).alias("value_score"))


@registry.add("polarities")
def _polarities(spark, d):
    """The polarity whole texts name most often."""
    return table(spark, d, "documents").select("doc_id", v.polarity("text").alias("polarity"))
