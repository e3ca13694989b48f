"""Queries of matching, ordered winners, aggregates, audits, decisions, graphs, rules, store and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.text import component_tokens, tokenize
from docweave.operators import chunks as ch
from docweave.operators import decide, export, extract, graph, matching, ordered, quality, relational, retrieval, store
from docweave.plans import rules
from docweave.plans.registry import Registry
from docweave.plans.text_queries import component_sql, sql_akz, sql_clean, sql_identifier, sql_label, sql_stripped
from docweave.session import table
from docweave.sources import files, plant_xml, step

registry = Registry()

# ---------------------------------------------------------------- matching

_TAGS = f"""WITH src AS (SELECT DISTINCT {sql_akz('canonical_tag')} AS k FROM source_entity WHERE {sql_akz('canonical_tag')} <> ''),
dev AS (SELECT DISTINCT {sql_akz('canonical_tag')} AS k FROM target_entity WHERE {sql_akz('canonical_tag')} <> '')
"""


def _tags(spark, d, name):
    from docweave.functions.text import normalize_akz

    return table(spark, d, name).select(normalize_akz("canonical_tag").alias("key")).where("key <> ''").distinct()


@registry.add(
    "akz_exact_prefix",
    _TAGS + f"""SELECT s.k AS key, coalesce(e.k, b.k) AS matched, CASE WHEN e.k IS NOT NULL THEN 'exact' WHEN b.k IS NOT NULL THEN 'stripped' END AS method
    FROM src s LEFT JOIN dev e ON e.k = s.k LEFT JOIN dev b ON b.k = {sql_stripped('s.k')}""",
)
def _akz_exact_prefix(spark, d):
    return matching.exact_or_stripped(table(spark, d, "source_entity"), table(spark, d, "target_entity"), "canonical_tag", "canonical_tag")


@registry.add(
    "akz_levenshtein",
    _TAGS + """SELECT l AS left_key, r AS right_key, n AS distance FROM (SELECT s.k AS l, d.k AS r, levenshtein(s.k, d.k) AS n,
    row_number() OVER (PARTITION BY s.k ORDER BY levenshtein(s.k, d.k), d.k) AS rn FROM src s JOIN dev d ON levenshtein(s.k, d.k) <= 2) WHERE rn = 1""",
)
def _akz_levenshtein(spark, d):
    return matching.nearest_within(_tags(spark, d, "source_entity"), _tags(spark, d, "target_entity"), "key", 2).withColumn("distance", F.col("distance").cast("bigint"))


@registry.add("akz_ratcliff")
def _akz_ratcliff(spark, d):
    """Best partner by matching blocks; tested against a plain comparison of all pairs."""
    left, right = _tags(spark, d, "source_entity"), _tags(spark, d, "target_entity")
    return matching.best_by_ratio(left, right, "key")


@registry.add(
    "akz_canonical_map",
    f"""WITH occ AS (SELECT {sql_akz('canonical_tag')} AS k, canonical_tag AS original FROM source_entity WHERE {sql_akz('canonical_tag')} <> ''),
    n AS (SELECT k, count(*) AS n FROM occ GROUP BY k),
    near AS (SELECT a.k, min(b.k) AS into_k FROM n a JOIN n b ON a.n = 1 AND b.n > 1 AND levenshtein(a.k, b.k) <= 1 GROUP BY a.k)
    SELECT coalesce(into_k, o.k) AS canonical, original, CASE WHEN n > 1 OR into_k IS NOT NULL THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence,
    CASE WHEN n > 1 OR into_k IS NOT NULL THEN 'exact' ELSE 'singleton_unmatched' END AS method, count(*) AS n
    FROM occ o JOIN n USING (k) LEFT JOIN near ON near.k = o.k GROUP BY ALL""",
)
def _akz_canonical_map(spark, d):
    found = matching.canonical_map(table(spark, d, "source_entity").select(F.col("canonical_tag").alias("designation")))
    return found.groupBy("canonical", "original", "confidence", "method").agg(F.count(F.lit(1)).alias("n"))


#: Which record families count as which document type, and how often a device must occur there at least.
_RULES = [("klemmenplan_row", 1, "critical"), ("stellen_overview_record", 1, "critical"), ("cabinet_reference_row", 0, "warning")]


@registry.add(
    "cardinality_missing",
    f"""WITH keys AS (SELECT DISTINCT {sql_akz('canonical_tag')} AS k FROM target_entity WHERE {sql_akz('canonical_tag')} <> ''),
    has AS (SELECT DISTINCT family AS t, {sql_akz('canonical_tag')} AS k FROM source_entity WHERE {sql_akz('canonical_tag')} <> ''),
    rule(t, least, critical) AS (VALUES {', '.join(f"('{t}', {n}, {str(s == 'critical').lower()})" for t, n, s in _RULES)}),
    forms AS (SELECT k, k AS f FROM keys UNION SELECT k, {sql_stripped('k')} FROM keys),
    near AS (SELECT forms.k, has.t, min(CASE WHEN has.k = f THEN 0 ELSE levenshtein(has.k, f) END) AS n FROM forms JOIN has ON levenshtein(has.k, f) <= 2 GROUP BY ALL),
    state AS (SELECT keys.k, rule.*, n FROM keys CROSS JOIN rule LEFT JOIN near ON near.k = keys.k AND near.t = rule.t),
    marks AS (SELECT *, coalesce(n <= 1, false) AS present, NOT coalesce(n <= 1, false) AND least > 0 AS missing FROM state)
    SELECT k AS key, array_to_string(list_sort(list(t) FILTER (missing)), ',') AS missing_in, coalesce(array_to_string(list_sort(list(t) FILTER (present)), ','), '') AS present_in,
    CASE WHEN bool_or(missing AND critical) THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN bool_or(coalesce(n = 2, false)) THEN 0.75 ELSE 0.95 END::DOUBLE AS confidence,
    CASE WHEN bool_or(coalesce(n = 2, false)) THEN 'needs_review' ELSE 'auto' END AS review_status FROM marks GROUP BY k HAVING bool_or(missing)""",
)
def _cardinality_missing(spark, d):
    from docweave.functions.text import normalize_akz

    targets = table(spark, d, "source_entity").select(F.col("family").alias("doc_type"), normalize_akz("canonical_tag").alias("key"))
    wanted = spark.createDataFrame(_RULES, "target_doc string, min_count int, severity string")
    found = decide.cardinality(_tags(spark, d, "target_entity"), targets, wanted)
    return found.withColumns({c: F.array_join(c, ",") for c in ("missing_in", "present_in")})


def _entities(spark, d, name, key):
    rows = table(spark, d, name)
    return rows.select(
        F.col(key).alias("key"), "canonical_tag", F.col("normalized_tags").alias("tags"), tokenize("display_name").alias("label_tokens"), "context_tokens", F.lit("").alias("device")
    ).distinct()


def _sql_entities(name: str, key: str, p: str) -> str:
    return (
        f"{p} AS (SELECT DISTINCT {key} AS k, {sql_identifier('canonical_tag')} AS tag, "
        f"list_filter(list_distinct(list_transform(coalesce(normalized_tags, []), lambda x: {sql_identifier('x')})), lambda x: x <> '') AS tags, "
        f"list_filter(list_distinct(string_split({sql_label('display_name')}, ' ')), lambda x: x <> '') AS lab, list_distinct(coalesce(context_tokens, [])) AS ctx FROM {name})"
    )


@registry.add(
    "entity_resolution_scores",
    f"""WITH {_sql_entities('source_entity', 'record_key', 's')}, {_sql_entities('target_entity', 'device_id', 't')},
    raw AS (SELECT s.k AS source_key, t.k AS target_key, least(1.0,
      CASE WHEN s.tag = t.tag AND list_contains(list_intersect(s.tags, t.tags), s.tag) THEN 0.7 WHEN len(list_intersect(s.tags, t.tags)) > 0 THEN 0.55 ELSE 0 END
      + 0.15 * CASE WHEN len(s.lab) > 0 AND len(t.lab) > 0 THEN len(list_intersect(s.lab, t.lab)) / len(list_distinct(list_concat(s.lab, t.lab))) ELSE 0 END
      + 0.2 * CASE WHEN len(s.ctx) > 0 AND len(t.ctx) > 0 THEN len(list_intersect(s.ctx, t.ctx)) / len(list_distinct(list_concat(s.ctx, t.ctx))) ELSE 0 END) AS score FROM s CROSS JOIN t)
    SELECT DISTINCT source_key, target_key, round(score, 6) AS score FROM raw WHERE score >= 0.35""",
)
def _entity_resolution_scores(spark, d):
    pairs = matching.entity_pairs(_entities(spark, d, "source_entity", "record_key"), _entities(spark, d, "target_entity", "device_id"))
    return pairs.select("source_key", "target_key", F.round("score", 6).alias("score")).distinct()


@registry.add("entity_resolution_assignment")
def _entity_resolution_assignment(spark, d):
    """Each record and device at most once; tested against a plain assignment."""
    pairs = _entity_resolution_scores(spark, d).groupBy("source_key", "target_key").agg(F.max("score").alias("score"))
    ends = pairs.select(F.concat(F.lit("s|"), "source_key").alias("a"), F.concat(F.lit("t|"), "target_key").alias("b"))
    return matching.assign_one_to_one(pairs, graph.connected_components(ends, "a", "b"))


@registry.add(
    "field_header_match",
    f"""WITH f AS (SELECT DISTINCT attribute_name AS field, {sql_label('attribute_name')} AS fl FROM attribute_lookup),
    h AS (SELECT DISTINCT attribute_name AS header, {sql_label('attribute_name')} AS hl FROM document_data WHERE attribute_name IS NOT NULL)
    SELECT DISTINCT field, header FROM f JOIN h ON fl <> '' AND hl <> '' AND (contains(fl, hl) OR contains(hl, fl))""",
)
def _field_header_match(spark, d):
    fields = table(spark, d, "attribute_lookup").select(F.col("attribute_name").alias("field"))
    headers = table(spark, d, "document_data").where("attribute_name is not null").select(F.col("attribute_name").alias("header"))
    return matching.match_fields(fields, headers)


@registry.add(
    "field_tiers",
    f"""WITH f AS (SELECT DISTINCT attribute_name AS field, {sql_label('attribute_name')} AS fl, description FROM attribute_lookup),
    h AS (SELECT attribute_name AS header, min(row_index) AS ord, {sql_label('attribute_name')} AS hl FROM document_data WHERE attribute_name IS NOT NULL GROUP BY attribute_name),
    syn AS (SELECT field, {sql_label("unnest(string_split(replace(description, 'auch:', ''), ';'))")} AS sl FROM f),
    hits AS (SELECT field, header, ord, 0 AS t FROM f JOIN h ON fl = hl AND fl <> ''
      UNION ALL SELECT field, header, ord, 1 FROM syn JOIN h ON sl = hl AND sl <> ''
      UNION ALL SELECT field, header, ord, 2 FROM f JOIN h ON hl <> '' AND (contains(fl, hl) OR contains(hl, fl))),
    best AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY t, ord, header) AS rn FROM hits)
    SELECT field, header, [0.98, 0.95, 0.85][t + 1]::DOUBLE AS confidence, ['exact', 'synonym', 'partial'][t + 1] AS tier FROM best WHERE rn = 1""",
)
def _field_tiers(spark, d):
    lookup = table(spark, d, "attribute_lookup")
    fields = lookup.select(F.col("attribute_name").alias("field"))
    headers = table(spark, d, "document_data").where("attribute_name is not null").groupBy(F.col("attribute_name").alias("header")).agg(F.min("row_index").alias("ord"))
    names = F.split(F.replace("description", F.lit("auch:"), F.lit("")), ";")
    return matching.match_field_tiers(fields, headers, lookup.select(F.col("attribute_name").alias("field"), F.explode(names).alias("synonym")))


@registry.add(
    "blanks_filled",
    """WITH rows AS (SELECT row_index, document_id, document_type, schema_version FROM document_master),
    last AS (SELECT replace(lower(trim(document_id)), '_', '') AS k, arg_max(struct_pack(t := document_type, v := schema_version), row_index) AS s FROM document_master WHERE trim(document_id) <> '' GROUP BY 1)
    SELECT row_index, document_id, coalesce(nullif(trim(document_type), ''), s.t, document_type) AS document_type, coalesce(nullif(trim(schema_version), ''), s.v, schema_version) AS schema_version, count(*) AS n
    FROM rows LEFT JOIN last ON k = replace(lower(trim(document_id)), '_', '') GROUP BY ALL""",
)
def _blanks_filled(spark, d):
    rows = table(spark, d, "document_master").select("row_index", "document_id", "document_type", "schema_version")
    source = rows.withColumnRenamed("row_index", "ord")
    filled = matching.fill_blanks(rows, source, "document_id", ["document_type", "schema_version"])
    return filled.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "designations_resolved",
    """WITH el AS (SELECT device_id, min(canonical_tag) AS tag FROM target_entity WHERE trim(canonical_tag) <> '' GROUP BY 1),
    canon AS (SELECT device_id, CASE WHEN regexp_matches(u, '^[A-Z][0-9]') THEN '-' || u ELSE u END AS c FROM (SELECT device_id, upper(regexp_replace(tag, '[\\s\\x{A0}]+', '', 'g')) AS u FROM el)),
    spelled AS (SELECT device_id, lower(x) AS k FROM (SELECT device_id, unnest([c, replace(c, '.', ''), replace(c, '_', '')]) AS x FROM canon)
      UNION SELECT device_id, lower(substr(x, 2)) FROM (SELECT device_id, unnest([c, replace(c, '.', ''), replace(c, '_', '')]) AS x FROM canon) WHERE x LIKE '-%'),
    exact AS (SELECT k, min(device_id) AS e FROM spelled WHERE k <> '' GROUP BY k),
    base AS (SELECT b, min(device_id) AS e FROM (SELECT DISTINCT device_id, regexp_replace(regexp_replace(lower(c), '^-', ''), '[:/].*$', '') AS b FROM canon) WHERE b <> '' GROUP BY b HAVING count(*) = 1),
    cand AS (SELECT DISTINCT record_key, canonical_tag AS tag, CASE WHEN regexp_matches(u, '^[A-Z][0-9]') THEN '-' || u ELSE u END AS c
      FROM (SELECT record_key, canonical_tag, upper(regexp_replace(canonical_tag, '[\\s\\x{A0}]+', '', 'g')) AS u FROM source_entity WHERE trim(canonical_tag) <> '')),
    keys AS (SELECT record_key, tag, c, list_distinct(list_filter(list_transform([c, replace(c, '.', ''), replace(c, '_', ''), CASE WHEN c LIKE '-%' THEN substr(c, 2) ELSE '' END, CASE WHEN c LIKE '-%' THEN substr(replace(c, '.', ''), 2) ELSE '' END, CASE WHEN c LIKE '-%' THEN substr(replace(c, '_', ''), 2) ELSE '' END], lambda x: lower(trim(x))), lambda x: x <> '')) AS ks FROM cand),
    hits AS (SELECT record_key, 0 AS tier, min(exact.e) AS e FROM (SELECT record_key, unnest(ks) AS k FROM keys) q JOIN exact USING (k) GROUP BY 1
      UNION ALL SELECT record_key, 1, min(base.e) FROM (SELECT record_key, regexp_replace(regexp_replace(lower(c), '^-', ''), '[:/].*$', '') AS b FROM keys WHERE NOT contains(tag, ':')) q JOIN base USING (b) GROUP BY 1)
    SELECT record_key AS key, arg_min(e, tier) AS element_id FROM hits GROUP BY record_key""",
)
def _designations_resolved(spark, d):
    elements = table(spark, d, "target_entity").where("trim(canonical_tag) <> ''").groupBy(F.col("device_id").alias("element_id")).agg(F.min("canonical_tag").alias("designation"))
    cand = table(spark, d, "source_entity").select(F.col("record_key").alias("key"), F.lit(0).alias("ord"), F.col("canonical_tag").alias("designation")).distinct()
    return matching.resolve_designations(cand, elements.withColumn("ord", F.lit(0)))


def _boxes(spark, d):
    """Embedding dimensions as boxes on the page of their label."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double") * 40
    box = F.array(e(0), e(1), e(0) + 8 + F.abs(e(2)), e(1) + 8 + F.abs(e(3)))
    return table(spark, d, "embeddings").select(F.col("label").alias("page"), F.col("vec_id").alias("box_id"), box.alias("box"))


_BOX_SQL = """b AS (SELECT label AS page, vec_id AS id, x AS x0, y AS y0, x + 8 + abs(embedding[3]::DOUBLE * 40) AS x1, y + 8 + abs(embedding[4]::DOUBLE * 40) AS y1
  FROM (SELECT *, embedding[1]::DOUBLE * 40 AS x, embedding[2]::DOUBLE * 40 AS y FROM embeddings)),
pairs AS (SELECT page, a.id AS l, c.id AS r, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i,
  (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (c.x1 - c.x0) * (c.y1 - c.y0) AS sc FROM b a JOIN b c USING (page) WHERE a.id < c.id)"""


@registry.add(
    "overlap_clusters",
    f"""WITH RECURSIVE {_BOX_SQL}, e AS (SELECT l AS x, r AS y FROM pairs WHERE i / (sa + sc - i) >= 0.45 UNION SELECT r, l FROM pairs WHERE i / (sa + sc - i) >= 0.45),
    reach AS (SELECT id AS n, id AS k FROM b UNION SELECT e.y, reach.k FROM reach JOIN e ON e.x = reach.n WHERE reach.k < e.y)
    SELECT page, id AS box_id, min(k) AS cluster FROM b JOIN reach ON n = id GROUP BY ALL""",
)
def _overlap_clusters(spark, d):
    return graph.overlap_clusters(_boxes(spark, d), ["page"])


# ---------------------------------------------------------------- aggregates


@registry.add("count_by_source", "SELECT lower(trim(source)) AS source, count(*) AS n FROM documents GROUP BY 1")
def _count_by_source(spark, d):
    return table(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "joined_attributes",
    """SELECT document_id, array_to_string(list(attribute_name ORDER BY f, attribute_name), ' | ') AS attribute_name FROM
    (SELECT document_id, attribute_name, min(row_index) AS f FROM document_data WHERE attribute_name <> '' GROUP BY ALL) GROUP BY document_id""",
)
def _joined_attributes(spark, d):
    return ordered.distinct_joined(table(spark, d, "document_data"), ["document_id"], "attribute_name", "row_index")


@registry.add(
    "group_summary",
    """SELECT canonical_akz, count(*) AS n, min(confidence) AS least, round(avg(confidence), 3) AS mean, bool_or(coalesce(review_status = 'needs_review', false)) AS needs_review
    FROM uc1_report GROUP BY 1""",
)
def _group_summary(spark, d):
    return table(spark, d, "uc1_report").groupBy("canonical_akz").agg(
        F.count(F.lit(1)).alias("n"), F.min("confidence").alias("least"), F.round(F.avg("confidence"), 3).alias("mean"),
        F.max(F.coalesce(F.col("review_status") == "needs_review", F.lit(False))).alias("needs_review"),
    )


_DATA = "row_index document_data_id document_id attribute_name attribute_value raw_value normalized_value unit quantity_qualifier parsing_status semanticid extraction_timestamp loaded_at".split()


@registry.add(
    "fill_rates",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (trim(coalesce(CAST({c} AS VARCHAR), '')) <> '') AS filled, count(*) AS total, "
        f"round_even(count(*) FILTER (trim(coalesce(CAST({c} AS VARCHAR), '')) <> '') / count(*), 4) AS rate FROM document_data"
        for c in _DATA
    ),
)
def _fill_rates(spark, d):
    return quality.fill_rates(table(spark, d, "document_data"))


@registry.add(
    "noisy_or",
    "SELECT canonical_akz, round(1 - product(greatest(0, 1 - confidence)), 6) AS confidence FROM uc1_report WHERE confidence IS NOT NULL GROUP BY 1",
)
def _noisy_or(spark, d):
    rows = table(spark, d, "uc1_report").where("confidence is not null")
    return rows.groupBy("canonical_akz").agg(F.round(decide.noisy_or(F.col("confidence")), 6).alias("confidence"))


@registry.add(
    "majority_family",
    """SELECT document_path, family, n FROM (SELECT *, row_number() OVER (PARTITION BY document_path ORDER BY n DESC, f, family) AS rn
    FROM (SELECT document_path, family, count(*) AS n, min(id) AS f FROM chunks GROUP BY document_path, family)) WHERE rn = 1""",
)
def _majority_family(spark, d):
    return decide.majority(table(spark, d, "chunks"), ["document_path"], "family", "id")


@registry.add(
    "part_library",
    """SELECT 'PART_' || lpad(CAST(row_number() OVER (ORDER BY f, label, type) AS VARCHAR), greatest(4, length(CAST(row_number() OVER (ORDER BY f, label, type) AS VARCHAR)))::INT, '0') AS part_id, label, type, instances FROM
    (SELECT p_brand AS label, p_type AS type, count(*) AS instances, min(p_partkey) AS f FROM part GROUP BY ALL)""",
)
def _part_library(spark, d):
    return graph.part_library(table(spark, d, "part"), "p_brand", "p_type", "p_partkey")


@registry.add(
    "frequent_attributes",
    f"""SELECT family, name, count(*) AS n FROM (SELECT 'data' AS family, CASE WHEN {sql_label('attribute_name')} = '' THEN 'field' ELSE replace({sql_label('attribute_name')}, ' ', '_') END AS name FROM document_data)
    GROUP BY ALL HAVING count(*) >= 20""",
)
def _frequent_attributes(spark, d):
    rows = table(spark, d, "document_data").select(F.lit("data").alias("family"), F.col("attribute_name").alias("attribute"))
    return extract.mine_attributes(rows, 20)


@registry.add(
    "mined_schema",
    f"""WITH once AS (SELECT attribute_name AS header, min(row_index) AS o FROM document_data WHERE {sql_clean('attribute_name')} <> '' GROUP BY 1),
    named AS (SELECT *, CASE WHEN {sql_label('header')} = '' THEN 'field' ELSE replace({sql_label('header')}, ' ', '_') END AS name FROM once)
    SELECT 'data' AS family, name, array_to_string(list(header ORDER BY o, header), '|') AS aliases, min(o) AS ord FROM named GROUP BY name""",
)
def _mined_schema(spark, d):
    rows = table(spark, d, "document_data").select(F.lit("data").alias("family"), F.col("attribute_name").alias("header"), F.col("row_index").alias("ord"))
    return extract.mine_headers(rows).select("family", "name", F.array_join("aliases", "|").alias("aliases"), "ord")


_TRACKS = """WITH a AS (SELECT document_data_id AS key, max(attribute_value) AS value, 0.8 AS confidence FROM document_data WHERE attribute_value <> '' GROUP BY 1),
b AS (SELECT document_data_id AS key, max(raw_value) AS value, 0.6 AS confidence FROM document_data WHERE raw_value <> '' GROUP BY 1)
"""


@registry.add(
    "track_votes",
    _TRACKS + """SELECT key, coalesce(a.value, b.value) AS value, CASE WHEN a.value = b.value THEN 0.7 ELSE greatest(a.confidence, b.confidence) END::DOUBLE AS confidence,
    CASE WHEN a.value = b.value THEN 'agreed' WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN 'disagreed' WHEN a.value IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS status,
    NOT coalesce(a.value = b.value, false) AS needs_review FROM a FULL JOIN b USING (key)""",
)
def _track_votes(spark, d):
    rows = table(spark, d, "document_data")
    track = lambda c, s: rows.where(f"{c} <> ''").groupBy(F.col("document_data_id").alias("key")).agg(F.max(c).alias("value")).withColumn("confidence", F.lit(s))
    return decide.vote_tracks(track("attribute_value", 0.8), track("raw_value", 0.6))


@registry.add(
    "presence",
    """SELECT report_id, CASE WHEN verdict = 'consistent' AND confidence > 0.95 THEN 'present' WHEN s >= 0.7 OR (n >= 2 AND s >= 0.4) THEN 'present' WHEN s <= 0.2 AND n = 0 THEN 'missing' ELSE 'needs_review' END AS decision,
    CASE WHEN verdict = 'consistent' AND confidence > 0.95 THEN 1.0 WHEN s >= 0.7 OR (n >= 2 AND s >= 0.4) THEN least(0.95, greatest(0.65, s)) WHEN s <= 0.2 AND n = 0 THEN 0.9 ELSE least(0.75, greatest(0.35, s)) END AS confidence,
    count(*) AS n FROM (SELECT report_id, verdict, confidence, coalesce(confidence, 0) AS s, coalesce(len(present_in), 0) AS n FROM uc1_report) GROUP BY ALL""",
)
def _presence(spark, d):
    strict = (F.col("verdict") == "consistent") & (F.col("confidence") > 0.95)
    size = F.size(F.coalesce("present_in", F.array().cast("array<string>")))
    rows = table(spark, d, "uc1_report").select("report_id", decide.presence(strict, F.col("confidence"), size).alias("p"))
    return rows.groupBy("report_id", "p.decision", "p.confidence").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- order


@registry.add(
    "same_document_edges",
    """WITH c AS (SELECT DISTINCT id, document_path FROM chunks), e AS (SELECT document_path, id, lead(id) OVER (PARTITION BY document_path ORDER BY id) AS nx FROM c)
    SELECT CAST(id AS VARCHAR) || '::' || CAST(nx AS VARCHAR) || '::same_document' AS edge_id, id AS from_id, nx AS to_id, 'same_document' AS edge_type, 0.2::DOUBLE AS score, document_path AS reason FROM e WHERE nx IS NOT NULL""",
)
def _same_document_edges(spark, d):
    rows = table(spark, d, "chunks").select(F.col("id").alias("c_id"), F.col("document_path").alias("document"), F.col("id").alias("ord")).distinct()
    return retrieval.same_document_edges(rows)


#: Chunks with the designations in their latest text.
_CHUNK_TAGS = f"""t AS (SELECT DISTINCT id, {sql_identifier('unnest(' + component_sql('text') + ')')} AS tag FROM (SELECT id, max(text) AS text FROM chunks GROUP BY id))"""


@registry.add(
    "shared_identifier_edges",
    f"""WITH {_CHUNK_TAGS} SELECT CAST(a.id AS VARCHAR) || '::' || CAST(b.id AS VARCHAR) || '::shared_identifier::' || a.tag AS edge_id, a.id AS from_id, b.id AS to_id,
    'shared_identifier' AS edge_type, 1.0::DOUBLE AS score, a.tag AS reason FROM t a JOIN t b ON a.tag = b.tag AND a.id < b.id AND a.tag <> ''""",
)
def _shared_identifier_edges(spark, d):
    """Chunks that name the same designation, every pair."""
    rows = ch.latest_copies(table(spark, d, "chunks"), ["id"], ["text"]).select(F.col("id").alias("c_id"), F.col("id").alias("ord"), F.col("text").alias("c_text"))
    return retrieval.shared_identifier_edges(rows)


@registry.add(
    "filled_down",
    "SELECT event_id, last_value(CASE WHEN value > 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS event_type FROM events",
)
def _filled_down(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return ordered.forward_fill(rows, "event_type", F.col("value") > 0, ["user_id"], ["ts", "event_id"]).select("event_id", "event_type")


@registry.add(
    "looked_ahead",
    """SELECT event_id, first_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS next_value FROM events""",
)
def _looked_ahead(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return ordered.look_ahead(rows, F.col("value"), F.col("value") > 50, 3, ["user_id"], ["ts", "event_id"], "next_value").select("event_id", "next_value")


@registry.add(
    "neighbour_windows",
    "SELECT event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ',') AS around FROM events",
)
def _neighbour_windows(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("e"), "event_id", "user_id", "ts")
    return ordered.neighbours(rows, "e", 2, ["user_id"], ["ts", "event_id"], "around").select("event_id", F.array_join("around", ",").alias("around"))


@registry.add(
    "latest_versions",
    """SELECT document_id, row_index, document_type FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY row_index DESC, document_type DESC NULLS LAST) AS rn
    FROM (SELECT DISTINCT document_id, row_index, document_type FROM document_master)) WHERE rn = 1""",
)
def _latest_versions(spark, d):
    return store.latest_versions(table(spark, d, "document_master").select("document_id", "row_index", "document_type"), ["document_id"], "row_index")


@registry.add(
    "first_rows",
    """SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def _first_rows(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return ordered.first_per_key(rows, ["user_id", "event_type"], ["ts", "event_id"])


@registry.add(
    "richest_rows",
    """SELECT document_path, id FROM (SELECT document_path, id, row_number() OVER (PARTITION BY document_path ORDER BY tokens DESC NULLS LAST, id) AS rn FROM (SELECT DISTINCT document_path, id, coalesce(tokens, 0) AS tokens FROM chunks)) WHERE rn = 1""",
)
def _richest_rows(spark, d):
    rows = table(spark, d, "chunks").select("document_path", "id", F.coalesce("tokens", F.lit(0)).alias("tokens")).distinct()
    return ordered.richest_per_key(rows, ["document_path"], F.col("tokens"), ["id"]).select("document_path", "id")


@registry.add(
    "duplicate_rows",
    """SELECT document_data_id, row_index AS row, f AS first_row, count(*) AS n FROM (SELECT document_data_id, row_index, min(row_index) OVER (PARTITION BY document_data_id) AS f FROM document_data WHERE trim(document_data_id) <> '')
    WHERE row_index > f GROUP BY ALL""",
)
def _duplicate_rows(spark, d):
    found = ordered.duplicates(table(spark, d, "document_data").select("document_data_id", "row_index"), ["document_data_id"], "row_index")
    return found.groupBy("document_data_id", "row", "first_row").agg(F.count(F.lit(1)).alias("n"))


@registry.add("running_ids", "SELECT o_orderkey, 'R.' || CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS VARCHAR) AS id FROM orders")
def _running_ids(spark, d):
    return ordered.assign_ids(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "R", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")


@registry.add(
    "top_orders",
    """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) WHERE rank <= 3""",
)
def _top_orders(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordered.top_k(rows, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@registry.add("order_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _order_page(spark, d):
    return ordered.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50, 25)


@registry.add(
    "display_page",
    """SELECT attribute_value FROM (SELECT DISTINCT attribute_value, trim(coalesce(attribute_value, '')) AS t FROM document_data)
    ORDER BY CASE WHEN t = '' THEN 2 WHEN regexp_full_match(t, '[+-]?[0-9]+([.,][0-9]+)?') THEN 0 ELSE 1 END,
    CASE WHEN regexp_full_match(t, '[+-]?[0-9]+([.,][0-9]+)?') THEN CAST(replace(t, ',', '.') AS DOUBLE) END NULLS FIRST, lower(t), t, attribute_value NULLS FIRST LIMIT 40 OFFSET 100""",
)
def _display_page(spark, d):
    rows = table(spark, d, "document_data").select("attribute_value").distinct()
    return ordered.page(rows, [*ordered.display_order("attribute_value"), "attribute_value"], 100, 40)


@registry.add(
    "upserted",
    """WITH old AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), new AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)""",
)
def _upserted(spark, d):
    part = lambda c: table(spark, d, "orders").where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return ordered.upsert(part("o_orderstatus = 'F'"), part("o_orderstatus <> 'F'"), ["k"])


@registry.add(
    "positional_match",
    """WITH l AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS rank, s_suppkey FROM supplier), r AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS rank, n_nationkey FROM nation)
    SELECT rank, CAST(s_suppkey AS VARCHAR) AS left_id, CAST(n_nationkey AS VARCHAR) AS right_id, CASE WHEN s_suppkey IS NULL THEN 'Only_Right' WHEN n_nationkey IS NULL THEN 'Only_Left' ELSE 'Matched' END AS status FROM l FULL JOIN r USING (rank)""",
)
def _positional_match(spark, d):
    left = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("key"))
    right = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"))
    found = ordered.positional_match(left, right, ["key"], "key")
    return found.withColumns({"left_id": F.col("left_id").cast("string"), "right_id": F.col("right_id").cast("string")})


@registry.add(
    "undirected_pairs",
    """SELECT least(source_key, target_key) AS a, greatest(source_key, target_key) AS b, min(row_id) AS first_row FROM (SELECT source_key, target_key, coalesce(CAST(resolved_at AS VARCHAR), '') AS row_id FROM entity_resolution)
    WHERE source_key <> target_key GROUP BY ALL""",
)
def _undirected_pairs(spark, d):
    rows = table(spark, d, "entity_resolution").select("source_key", "target_key", F.coalesce(F.col("resolved_at").cast("string"), F.lit("")).alias("row_id"))
    kept = ordered.distinct_undirected(rows, "source_key", "target_key", "row_id")
    return kept.select(F.least("source_key", "target_key").alias("a"), F.greatest("source_key", "target_key").alias("b"), F.col("row_id").alias("first_row"))


# ---------------------------------------------------------------- audits


@registry.add(
    "fk_orders",
    "SELECT 'foreign_key' AS rule, 'lineitem' AS sheet, CAST(l_orderkey AS VARCHAR) AS key, 'l_orderkey has no target' AS message, 'error' AS severity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey",
)
def _fk_orders(spark, d):
    return quality.foreign_keys(table(spark, d, "lineitem"), "lineitem", "l_orderkey", table(spark, d, "orders"), "o_orderkey")


@registry.add(
    "fk_documents",
    """SELECT 'foreign_key' AS rule, 'document_data' AS sheet, v AS key, 'document_id has no target' AS message, 'error' AS severity FROM (SELECT DISTINCT trim(document_id) AS v FROM document_data WHERE trim(document_id) <> '')
    WHERE v NOT IN (SELECT trim(document_id) FROM document_master WHERE document_id IS NOT NULL)""",
)
def _fk_documents(spark, d):
    return quality.foreign_keys(table(spark, d, "document_data"), "document_data", "document_id", table(spark, d, "document_master"), "document_id")


_ENUM_SQL = """SELECT 'enumeration' AS rule, 'document_data' AS sheet, a || '=' || v AS key, 'value is outside its domain' AS message, 'warning' AS severity FROM
(SELECT DISTINCT d.attribute_name AS a, trim(attribute_value) AS v, enum_field FROM document_data d JOIN attribute_lookup l ON l.attribute_name = d.attribute_name WHERE enum_field IS NOT NULL AND trim(attribute_value) NOT IN ('', 'Unspecifiable')) x
WHERE NOT EXISTS (SELECT 1 FROM enum_lookup e WHERE e.field_name = x.enum_field AND e.allowed_value = x.v)"""


def _enum_violations(spark, d):
    return quality.enum_by_attribute(table(spark, d, "document_data"), "document_data", "attribute_name", "attribute_value", table(spark, d, "attribute_lookup"), table(spark, d, "enum_lookup"))


registry.add("enum_violations", _ENUM_SQL)(_enum_violations)

_NAMES_SQL = """SELECT 'attribute_name' AS rule, 'document_data' AS sheet, v AS key, 'unknown name' AS message, 'warning' AS severity FROM (SELECT DISTINCT trim(attribute_name) AS v FROM document_data WHERE trim(attribute_name) <> '')
WHERE v NOT IN (SELECT attribute_name FROM attribute_lookup)"""


def _unknown_names(spark, d):
    return quality.unknown_names(table(spark, d, "document_data"), "document_data", "attribute_name", table(spark, d, "attribute_lookup"), "attribute_name")


registry.add("unknown_names", _NAMES_SQL)(_unknown_names)

_PROVENANCE_SQL = """SELECT 'provenance' AS rule, 'document_master' AS sheet, document_id AS key, 'no source row' AS message, 'error' AS severity FROM (SELECT DISTINCT document_id FROM document_master WHERE document_id <> '')
WHERE document_id NOT IN (SELECT document_id FROM document_data WHERE document_id IS NOT NULL)"""


def _provenance(spark, d):
    return quality.without_provenance(table(spark, d, "document_master"), "document_master", "document_id", table(spark, d, "document_data"), "document_id")


registry.add("provenance_missing", _PROVENANCE_SQL)(_provenance)

_FORMAT_SQL = """SELECT 'id_format' AS rule, 'document_data' AS sheet, document_id AS key, 'unexpected form' AS message, 'error' AS severity FROM document_data
WHERE trim(document_id) <> '' AND NOT regexp_full_match(document_id, 'D[.][0-9]{9}') GROUP BY document_id"""


def _id_format(spark, d):
    return quality.id_format(table(spark, d, "document_data"), "document_data", "document_id", r"\AD[.][0-9]{9}\z")


registry.add("id_format", _FORMAT_SQL)(_id_format)
_KEYS_SQL = """SELECT 'primary_key' AS rule, 'document_master' AS sheet, document_id AS key, 'duplicate of row ' || CAST(f AS VARCHAR) AS message, 'error' AS severity FROM
(SELECT document_id, row_index, min(row_index) OVER (PARTITION BY document_id) AS f FROM document_master WHERE trim(document_id) <> '') WHERE row_index > f"""


def _primary_keys(spark, d):
    return quality.primary_keys(table(spark, d, "document_master"), "document_master", "document_id", "row_index")


registry.add("pk_violations", _KEYS_SQL)(_primary_keys)


@registry.add(
    "quality_report",
    "SELECT rule, sheet, severity, count(*) AS violations FROM (" + " UNION ALL ".join(f"({s})" for s in (_ENUM_SQL, _NAMES_SQL, _PROVENANCE_SQL, _FORMAT_SQL, _KEYS_SQL)) + ") GROUP BY ALL",
)
def _quality_report(spark, d):
    return quality.report([f(spark, d) for f in (_enum_violations, _unknown_names, _provenance, _id_format, _primary_keys)])


@registry.add(
    "required_attributes",
    """WITH need AS (SELECT attribute_name AS a FROM attribute_lookup WHERE required), docs AS (SELECT DISTINCT document_id FROM document_data)
    SELECT 'required_attribute' AS rule, 'document_data' AS sheet, document_id AS key, 'lacks ' || a AS message, 'error' AS severity FROM docs CROSS JOIN need
    WHERE NOT EXISTS (SELECT 1 FROM document_data x WHERE x.document_id IS NOT DISTINCT FROM docs.document_id AND x.attribute_name = a)""",
)
def _required_attributes(spark, d):
    need = [r.attribute_name for r in table(spark, d, "attribute_lookup").where("required").orderBy("attribute_name").collect()]
    return quality.required_attributes(table(spark, d, "document_data"), "document_data", "document_id", "attribute_name", need)


# ---------------------------------------------------------------- retrieval


@registry.add(
    "tfidf_top",
    """WITH c AS (SELECT doc_id AS id, text FROM documents),
    words AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}') AS w FROM c),
    terms AS (SELECT id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
    tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL),
    idf AS (SELECT term, ln((1 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
    w AS (SELECT id, term, tf * idf AS x FROM tf JOIN idf USING (term)),
    u AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM w),
    s AS (SELECT q.id AS q_id, u.id AS c_id, sum(q.x * u.x) AS tfidf FROM u q JOIN u USING (term) WHERE q.id % 100 = 0 GROUP BY ALL),
    r AS (SELECT q_id, c_id, round(tfidf, 6) AS tfidf, row_number() OVER (PARTITION BY q_id ORDER BY round(tfidf, 6) DESC, c_id) AS rank FROM s)
    SELECT q_id, c_id, tfidf, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""",
)
def _tfidf_top(spark, d):
    """Every document whose id is divisible by 100 as a query, against all documents."""
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("c_id"), F.col("text").alias("c_text"))
    queries = corpus.where("c_id % 100 = 0").select(F.col("c_id").alias("q_id"), F.col("c_text").alias("q_text"))
    return retrieval.tfidf_search(queries, corpus, 5)


def _hybrid(spark, d):
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("c_id"), F.col("text").alias("c_text"))
    queries = corpus.where("c_id % 100 = 0").select(F.col("c_id").alias("q_id"), F.col("c_text").alias("q_text"))
    return retrieval.hybrid_search(queries, corpus, 5)


#: Parts of the hybrid score of every document whose id is divisible by 100 against all.
_HYBRID_SQL = f"""WITH c AS (SELECT doc_id AS id, text FROM documents),
words AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM c),
terms AS (SELECT id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
u AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM (SELECT id, term, tf * idf AS x FROM tf JOIN idf USING (term))),
tfidf AS (SELECT q.id AS q, u.id AS c, sum(q.x * u.x) AS tfidf FROM u q JOIN u USING (term) WHERE q.id % 100 = 0 GROUP BY ALL),
plain AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(string_split({sql_label('text')}, ' ')) AS term FROM c) WHERE term <> '' GROUP BY ALL),
v AS (SELECT id, term, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM plain),
lexical AS (SELECT q.id AS q, v.id AS c, sum(q.x * v.x) AS lexical FROM v q JOIN v USING (term) WHERE q.id % 100 = 0 GROUP BY ALL),
found AS (SELECT id, {component_sql('text')} AS t, {sql_identifier('text')} AS whole FROM c),
tag AS (SELECT DISTINCT id, tag FROM (SELECT id, {sql_identifier('unnest(t)')} AS tag FROM found) WHERE tag <> ''),
sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM tag),
shared AS (SELECT q.id AS q, s.id AS c, count(*) / (any_value(q.n) + any_value(s.n) - count(*)) AS tags FROM sized q JOIN sized s USING (tag) WHERE q.id % 100 = 0 GROUP BY ALL),
q_ids AS (SELECT id, tag FROM tag WHERE id % 100 = 0 UNION SELECT id, whole FROM found WHERE id % 100 = 0 AND whole <> ''),
c_ids AS (SELECT id, tag FROM tag UNION SELECT id, whole FROM found WHERE whole <> '' AND length(whole) <= 40),
same AS (SELECT DISTINCT q.id AS q, s.id AS c FROM q_ids q JOIN c_ids s USING (tag)),
scored AS (SELECT a.id AS q_id, b.id AS c_id, CASE WHEN same.q IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS exact, coalesce(tags, 0)::DOUBLE AS tags, coalesce(tfidf, 0)::DOUBLE AS tfidf, coalesce(lexical, 0)::DOUBLE AS lexical
  FROM (SELECT * FROM c WHERE id % 100 = 0 AND trim(text) <> '') a CROSS JOIN c b LEFT JOIN same ON same.q = a.id AND same.c = b.id LEFT JOIN shared ON shared.q = a.id AND shared.c = b.id
  LEFT JOIN tfidf ON tfidf.q = a.id AND tfidf.c = b.id LEFT JOIN lexical ON lexical.q = a.id AND lexical.c = b.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) AS rank FROM (SELECT q_id, c_id, exact, round_even(tags, 4) AS tags, round_even(tfidf, 4) AS tfidf, round_even(lexical, 4) AS lexical, 0.0::DOUBLE AS prior,
  round(least(1.0, 0.35 * exact + 0.15 * tags + 0.25 * tfidf + 0.15 * lexical), 4) AS score FROM scored)),
hits AS (SELECT q_id, c_id, exact, tags, tfidf, lexical, prior, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5)
"""


@registry.add("hybrid_top", _HYBRID_SQL + "SELECT * FROM hits")
def _hybrid_top(spark, d):
    """Hybrid scores of every document whose id is divisible by 100 against all."""
    return _hybrid(spark, d)


@registry.add(
    "evidence_bundles",
    _HYBRID_SQL + """, b AS (SELECT q_id, string_agg(CAST(c_id AS VARCHAR), ',' ORDER BY rank) AS hit_ids, coalesce(string_agg(CAST(c_id AS VARCHAR), ',' ORDER BY rank) FILTER (score >= 0.45), '') AS support,
    coalesce(string_agg(CAST(c_id AS VARCHAR), ',' ORDER BY rank) FILTER (exact <= 0 AND score < 0.2), '') AS contradiction, max(score) AS top_score, count(*) FILTER (score >= 0.45) AS n FROM hits GROUP BY q_id)
    SELECT q_id, hit_ids, support, contradiction, top_score, CASE WHEN top_score >= 0.7 OR (n >= 2 AND top_score >= 0.4) THEN 'present' WHEN top_score <= 0.2 AND n = 0 THEN 'missing' ELSE 'needs_review' END AS decision,
    CASE WHEN top_score >= 0.7 OR (n >= 2 AND top_score >= 0.4) THEN top_score < 0.85 WHEN top_score <= 0.2 AND n = 0 THEN false ELSE true END AS needs_review FROM b""",
)
def _evidence_bundles(spark, d):
    """Bundles of the hybrid hits with the decision they lead to."""
    found = retrieval.bundles(_hybrid(spark, d))
    decided = found.withColumn("p", decide.presence(F.lit(False), F.col("top_score"), F.size("support")))
    names = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("hit_ids", "support", "contradiction")}
    return decided.select("q_id", *[e.alias(c) for c, e in names.items()], "top_score", "p.decision", "p.needs_review")


@registry.add(
    "cosine_top",
    """WITH s AS (SELECT q.vec_id AS q_id, v.vec_id AS v_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
    SELECT q_id, v_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, v_id) AS rn FROM s) WHERE rn <= 10""",
)
def _cosine_top(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("v_id"), F.col("embedding").alias("vector"))
    queries = vectors.where("v_id % 100 = 0").withColumnRenamed("v_id", "q_id")
    return retrieval.cosine_search(queries, vectors, 10).select("q_id", "v_id", F.round("similarity", 6).alias("similarity"))


@registry.add(
    "shared_payloads",
    """SELECT sha1(coalesce(document_path, '') || '::' || coalesce(source_kind, '') || '::' || coalesce(source_locator, '') || '::' || coalesce(text, '')) AS payload, min(id) AS first_chunk, count(*) AS chunks FROM chunks GROUP BY 1""",
)
def _shared_payloads(spark, d):
    rows = table(spark, d, "chunks").select(F.col("document_path").alias("document"), F.col("source_kind").alias("kind"), F.col("source_locator").alias("locator"), "text", "id")
    return ch.shared_payloads(rows, "id")


# ---------------------------------------------------------------- chunks and extraction


@registry.add(
    "line_chunks",
    f"""SELECT doc_id, line_no, text FROM (SELECT doc_id, CAST(i AS INT) AS line_no, {sql_clean('l[i]')} AS text FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM
    (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents))) WHERE text <> ''""",
)
def _line_chunks(spark, d):
    return ch.line_chunks(table(spark, d, "documents"), "doc_id", "text")




@registry.add("text_pairs")
def _text_pairs(spark, d):
    """Key-value pairs of whole texts, each text a page of lines; tested against a plain version."""
    lines = ch.line_chunks(table(spark, d, "documents"), "doc_id", "text").select(F.col("doc_id").cast("string").alias("document"), F.lit(1).alias("page"), F.col("line_no").alias("idx"), "text")
    return extract.block_pairs(lines)


#: Lines of whole texts, cleaned and numbered.
_LINES_SQL = f"""lines AS (SELECT * FROM (SELECT doc_id, i AS idx, {sql_clean('l[i]')} AS text FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM
(SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents))) WHERE text <> '')"""


@registry.add(
    "text_connections",
    f"""WITH {_LINES_SQL}, k AS (SELECT DISTINCT unnest({component_sql('canonical_tag')}) AS token FROM target_entity),
    r AS (SELECT doc_id, idx, {component_sql('text', False)} AS t FROM lines), t AS (SELECT doc_id, idx, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM r), p AS (SELECT DISTINCT doc_id, t[i] AS a, t[i + 1] AS b FROM (SELECT doc_id, t, unnest(generate_series(1, len(t) - 1)) AS i FROM t)),
    s AS (SELECT *, round_even(0.45 + CASE WHEN a IN (SELECT token FROM k) THEN 0.15 ELSE 0 END + CASE WHEN b IN (SELECT token FROM k) THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(a || b, '[/:]') THEN 0.1 ELSE 0 END, 2)::DOUBLE AS confidence FROM p)
    SELECT CAST(doc_id AS VARCHAR) AS document, 1 AS page, a AS from_token, b AS to_token, confidence, CASE WHEN confidence >= 0.6 THEN 'filled' ELSE 'needs_review' END AS status FROM s""",
)
def _text_connections(spark, d):
    """Neighbouring designations in lines of whole texts; tested against a plain version."""
    lines = ch.line_chunks(table(spark, d, "documents"), "doc_id", "text").select(F.col("doc_id").cast("string").alias("document"), F.lit(1).alias("page"), F.col("line_no").alias("idx"), "text")
    references = table(spark, d, "target_entity").select(F.explode(component_tokens("canonical_tag")).alias("token"))
    return extract.text_connections(lines, references)


@registry.add(
    "value_index",
    f"""SELECT DISTINCT key, record FROM (SELECT {sql_identifier('raw_value')} AS key, document_id AS record FROM document_data WHERE document_id IS NOT NULL
    UNION ALL SELECT {sql_identifier('attribute_name')}, document_id FROM document_data WHERE document_id IS NOT NULL UNION ALL SELECT {sql_identifier('document_id')}, document_id FROM document_data WHERE document_id IS NOT NULL) WHERE key <> ''""",
)
def _value_index(spark, d):
    rows = table(spark, d, "document_data").where("document_id is not null").select(F.lit("").alias("root"), F.col("raw_value").alias("value"), F.col("attribute_name").alias("display_name"), F.col("document_id").alias("record"))
    return extract.value_index(rows).select("key", "record")


# ---------------------------------------------------------------- graphs

_GROUP_SQL = """WITH RECURSIVE link AS (SELECT DISTINCT source_key AS a, target_key AS b FROM entity_resolution WHERE score >= 0.9 AND source_key IS NOT NULL AND target_key IS NOT NULL),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach AS (SELECT a AS n, a AS k FROM e UNION SELECT e.b, r.k FROM reach r JOIN e ON e.a = r.n WHERE r.k < e.b)
SELECT n AS node, min(k) AS component FROM reach GROUP BY n"""


@registry.add("spread_components", _GROUP_SQL)
def _spread_components(spark, d):
    links = table(spark, d, "entity_resolution").where("score >= 0.9 and source_key is not null and target_key is not null")
    return graph.connected_components(links, "source_key", "target_key")


@registry.add(
    "bounded_search",
    """WITH RECURSIVE l AS (SELECT DISTINCT trim(parent_label) AS p, trim(child_label) AS c FROM assembly_tree WHERE trim(parent_label) <> '' AND trim(child_label) <> '' AND trim(parent_label) <> trim(child_label)),
    e AS (SELECT p AS x, c AS y FROM l UNION SELECT c, p FROM l),
    walk AS (SELECT DISTINCT x AS s, x AS n, 0 AS depth FROM e WHERE x LIKE 'valve%' UNION SELECT w.s, e.y, w.depth + 1 FROM walk w JOIN e ON e.x = w.n WHERE w.depth < 4),
    hit AS (SELECT s, n, min(depth) AS depth FROM walk WHERE n LIKE 'tank%' GROUP BY ALL)
    SELECT s AS start, arg_min(n, (depth, n)) AS node, min(depth) AS depth FROM hit GROUP BY s""",
)
def _bounded_search(spark, d):
    rows = table(spark, d, "assembly_tree").select(F.trim("parent_label").alias("p"), F.trim("child_label").alias("c")).where("p <> '' and c <> ''")
    edges = graph.undirected(rows, "p", "c")
    labels = edges.select("x").distinct()
    return graph.nearest_target(labels.where("x like 'valve%'").select(F.col("x").alias("start")), edges, labels.where("x like 'tank%'").select(F.col("x").alias("node")), 4)


def _steps(spark, d):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, d, "embeddings").select(F.col("label").alias("assembly"), F.col("vec_id").alias("no"), F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


_LINKS = """WITH s AS (SELECT label AS assembly, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
l AS (SELECT assembly, id, lead(id) OVER w AS nx, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM s WINDOW w AS (PARTITION BY assembly ORDER BY id)),
k AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS distance FROM l WHERE nx IS NOT NULL)
"""


@registry.add("assembly_links", _LINKS + "SELECT assembly, id AS from_id, nx AS to_id, round(distance, 6) AS distance FROM k")
def _assembly_links(spark, d):
    return graph.assembly_links(_steps(spark, d)).select("assembly", "from_id", "to_id", F.round("distance", 6).alias("distance"))


@registry.add(
    "bend_angles",
    _LINKS + """, m AS (SELECT *, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey, lead(dz) OVER w AS ez, lead(distance) OVER w AS e FROM k WINDOW w AS (PARTITION BY assembly ORDER BY id))
    SELECT assembly, id AS no, round(degrees(acos(greatest(-1, least(1, (dx * ex + dy * ey + dz * ez) / (distance * e))))), 4) AS angle FROM m WHERE e IS NOT NULL""",
)
def _bend_angles(spark, d):
    return graph.bend_angles(graph.assembly_links(_steps(spark, d))).select("assembly", "no", F.round("angle", 4).alias("angle"))


@registry.add(
    "running_parents",
    """SELECT label AS assembly, vec_id AS id, last_value(CASE WHEN embedding[1] > 0 THEN vec_id END IGNORE NULLS) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_id FROM embeddings""",
)
def _running_parents(spark, d):
    return graph.running_parent(_steps(spark, d), F.col("x") > 0).select("assembly", "id", "parent_id")


# ---------------------------------------------------------------- rules

#: A rule set over the orders of a customer.
RULE_SET = {
    "source_type": "orders",
    "identity_fields": ["o_custkey"],
    "nodes": [
        {"id": "status", "node_type": "InputColumn", "config": {"field": "o_orderstatus", "mode": "join"}},
        {"id": "first", "node_type": "InputColumn", "config": {"field": "o_orderpriority", "mode": "first_non_empty"}},
        {"id": "count", "node_type": "InputColumn", "config": {"field": "o_orderkey", "mode": "count_present"}},
        {"id": "urgency", "node_type": "RegexExtract", "config": {"pattern": "^([0-9]+)", "default": "0"}},
        {"id": "named", "node_type": "MapEnum", "config": {"mapping": {"1": "urgent", "2": "high"}, "default": "other"}},
        {"id": "many", "node_type": "Condition", "config": {"operator": "regex", "compare_to": "^[0-9]{2,}$", "true_value": "many", "false_value": "few"}},
        {"id": "both", "node_type": "Concat", "config": {}},
        {"id": "gate", "node_type": "ConfidenceGate", "config": {"min_confidence": 5, "fallback": "too_few"}},
        {"id": "o1", "node_type": "OutputProperty", "config": {"property_name": "States"}},
        {"id": "o2", "node_type": "OutputProperty", "config": {"property_name": "Urgency"}},
        {"id": "o3", "node_type": "OutputProperty", "config": {"property_name": "Summary"}},
        {"id": "o4", "node_type": "OutputProperty", "config": {"property_name": "Gated"}},
        {"id": "model", "node_type": "OutputSubmodel", "config": {"id_short": "Orders"}},
    ],
    "edges": [
        {"id": f"e{i}", "from_node": a, "to_node": b, "order": o}
        for i, (a, b, o) in enumerate([
            ("status", "o1", 0), ("first", "urgency", 0), ("urgency", "named", 0), ("named", "o2", 0), ("count", "many", 0), ("many", "both", 0),
            ("named", "both", 1), ("both", "o3", 0), ("status", "gate", 0), ("count", "gate", 1), ("gate", "o4", 0), ("o1", "model", 0), ("o2", "model", 1),
            ("o3", "model", 2), ("o4", "model", 3),
        ])
    ],
}


def _order_rows(spark, d):
    rows = table(spark, d, "orders")
    return rows.select(*[F.col(c).cast("string").alias(c) for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")], F.col("o_orderkey").alias("ord"))


@registry.add(
    "rule_values",
    """WITH f AS (SELECT o_custkey, o_orderstatus AS s, min(o_orderkey) AS o FROM orders GROUP BY ALL), st AS (SELECT o_custkey, array_to_string(list(s ORDER BY o), '|') AS states FROM f GROUP BY 1),
    g AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p, count(*) AS n FROM orders GROUP BY 1),
    x AS (SELECT *, CASE regexp_extract(p, '^([0-9]+)', 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE 'other' END AS u, CASE WHEN n >= 10 THEN 'many' ELSE 'few' END AS m FROM g JOIN st USING (o_custkey))
    SELECT CAST(o_custkey AS VARCHAR) AS identity, states AS "Orders.States", u AS "Orders.Urgency", m || '|' || u AS "Orders.Summary", CASE WHEN n >= 5 THEN states ELSE 'too_few' END AS "Orders.Gated" FROM x""",
)
def _rule_values(spark, d):
    return rules.rule_values(_order_rows(spark, d), RULE_SET, "ord")


@registry.add("rule_documents")
def _rule_documents(spark, d):
    """The same rules as nested documents; tested against a plain evaluator."""
    return rules.run_rules(_order_rows(spark, d), RULE_SET, "ord").withColumn("gates", F.array_join("gates", ","))


#: A row profile over parts.
PROFILE = {
    "nodes": [
        {"id": "name", "node_type": "CellValue", "config": {"field": "p_name"}},
        {"id": "brand", "node_type": "CellValue", "config": {"field": "p_brand"}},
        {"id": "key", "node_type": "NormalizeIdentifier", "config": {}},
        {"id": "both", "node_type": "Concat", "config": {"separator": "/"}},
        {"id": "kind", "node_type": "Condition", "config": {"operator": "contains", "compare_to": "#1", "true_value": "first", "false_value": ""}},
        {"id": "row", "node_type": "BuildRow", "config": {"field_names": ["part_key", "title", "kind", "empty"]}},
        {"id": "out", "node_type": "OutputSheet", "config": {}},
    ],
    "edges": [
        {"id": "1", "from_node": "name", "to_node": "key"}, {"id": "2", "from_node": "brand", "to_node": "both", "order": 0},
        {"id": "3", "from_node": "name", "to_node": "both", "order": 1}, {"id": "4", "from_node": "brand", "to_node": "kind"},
        {"id": "5", "from_node": "key", "to_node": "row", "to_port": "part_key"}, {"id": "6", "from_node": "both", "to_node": "row", "to_port": "title"},
        {"id": "7", "from_node": "kind", "to_node": "row", "to_port": "kind"}, {"id": "8", "from_node": "row", "to_node": "out"},
    ],
}


@registry.add(
    "profile_rows",
    f"""SELECT {sql_identifier('p_name')} AS part_key, {sql_clean('p_brand')} || '/' || {sql_clean('p_name')} AS title, CASE WHEN contains(p_brand, '#1') THEN 'first' ELSE '' END AS kind, '' AS empty, count(*) AS n FROM part GROUP BY ALL""",
)
def _profile_rows(spark, d):
    return rules.run_profile(table(spark, d, "part"), PROFILE).groupBy("part_key", "title", "kind", "empty").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- store and exports


@registry.add(
    "keyword_page",
    """SELECT o_orderkey, o_orderstatus FROM orders o WHERE CAST(o_orderkey AS VARCHAR) ILIKE '%r%' OR o_orderpriority ILIKE '%r%' OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND (l_returnflag ILIKE '%r%' OR l_linestatus ILIKE '%r%'))
    ORDER BY o_orderkey LIMIT 50 OFFSET 10""",
)
def _keyword_page(spark, d):
    records = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    children = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus")
    found = store.record_page(records, children, "o_orderkey", "r", ["o_orderkey", "o_orderpriority"], ["l_returnflag", "l_linestatus"], ["o_orderkey"], 10, 50)
    return found.select("o_orderkey", "o_orderstatus")


@registry.add(
    "latest_feedback",
    "SELECT c_custkey, (SELECT arg_max(event_type, (event_id, event_type)) FROM events WHERE user_id = c_custkey) AS feedback_status FROM customer",
)
def _latest_feedback(spark, d):
    feedback = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("id"), F.col("event_type").alias("status"))
    return store.with_feedback(table(spark, d, "customer").select("c_custkey"), feedback, ["c_custkey"])


@registry.add("queue_state", "SELECT user_id AS item_id, arg_max(event_type, event_id) AS status, max(event_id) AS last_event FROM events GROUP BY 1")
def _queue_state(spark, d):
    return store.queue_state(table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("id"), F.col("event_type").alias("status")))


@registry.add(
    "cache_misses",
    """SELECT DISTINCT p_brand, p_type, sha256(p_brand || '::' || p_type) AS cache_key FROM part WHERE sha256(p_brand || '::' || p_type) NOT IN (SELECT sha256(p_brand || '::' || p_type) FROM part WHERE p_size > 40)""",
)
def _cache_misses(spark, d):
    part = table(spark, d, "part")
    held = part.where("p_size > 40").select(F.sha2(F.concat_ws("::", "p_brand", "p_type"), 256).alias("cache_key")).distinct()
    return store.cache_misses(part, held, ["p_brand", "p_type"])


_CUSTOMER = ("c_name", "c_nationkey", "c_mktsegment")


@registry.add(
    "unpivoted",
    " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS name, trim(CAST({c} AS VARCHAR)) AS value FROM customer WHERE {c} IS NOT NULL" for c in _CUSTOMER),
)
def _unpivoted(spark, d):
    return export.properties(table(spark, d, "customer"), "c_custkey", list(_CUSTOMER))


@registry.add("wide_again", "SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def _wide_again(spark, d):
    long = _unpivoted(spark, d).withColumnRenamed("name", "field").withColumn("ord", F.lit(0))
    return export.wide_records(long, "c_custkey", list(_CUSTOMER))


@registry.add(
    "template_rows",
    """SELECT record_key, CASE WHEN canonical_tag LIKE '=%' THEN '''' || canonical_tag ELSE coalesce(canonical_tag, '') END AS canonical_tag, '' AS remark, count(*) AS n FROM source_entity GROUP BY ALL""",
)
def _template_rows(spark, d):
    made = export.by_template(table(spark, d, "source_entity"), ["record_key", "canonical_tag", "remark"])
    return made.groupBy("record_key", "canonical_tag", "remark").agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "run_triples",
    """SELECT DISTINCT 'urn:docweave:' || CAST(r.id AS VARCHAR) AS subject, regexp_replace(regexp_replace(replace(j.fullkey, '"', ''), '\\[[0-9]+\\]', '', 'g'), '^\\$\\.?', '') AS predicate, j.atom->>'$' AS object,
    CASE WHEN j.type = 'BOOLEAN' THEN 'xs:boolean' WHEN j.type IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'xs:integer' WHEN j.type = 'DOUBLE' THEN 'xs:double' ELSE 'xs:string' END AS datatype
    FROM (SELECT DISTINCT id, summary_json FROM runs WHERE json_valid(summary_json)) r, json_tree(r.summary_json) j WHERE j.type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND j.atom->>'$' <> ''""",
)
def _run_triples(spark, d):
    return export.triples(table(spark, d, "runs"), "id", "summary_json")


@registry.add("supplier_documents")
def _supplier_documents(spark, d):
    """Nested documents of suppliers; tested for their content."""
    rows = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("identity"), F.lit("General").alias("submodel"), F.lit(0).alias("submodel_ord"), F.lit("Name").alias("name"), F.lit(0).alias("ord"), F.col("s_name").alias("value")
    )
    return export.nested_documents(rows, "supplier")


# ---------------------------------------------------------------- sources in the tables


@registry.add("file_kinds")
def _file_kinds(spark, d):
    """Kinds of files by their paths; tested case by case."""
    paths = table(spark, d, "documents").select(F.col("relative_path").alias("path")).where("path is not null").distinct()
    return files.classify(files.supported(paths)).select("path", "kind", F.array_join("families", ",").alias("families"))


@registry.add(
    "step_entities",
    """SELECT CAST(doc_id AS VARCHAR) AS path, CAST(regexp_extract(s, '(?s)^\\s*#([0-9]+)\\s*=\\s*(\\w+)\\s*\\((.*)\\)\\s*$', 1) AS BIGINT) AS number, upper(regexp_extract(s, '(?s)^\\s*#([0-9]+)\\s*=\\s*(\\w+)\\s*\\((.*)\\)\\s*$', 2)) AS class_name, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text, ';\\s*(?:\\r?\\n|\\z)')) AS s FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(s, '(?s)^\\s*#[0-9]+\\s*=\\s*\\w+\\s*\\(.*\\)\\s*$') GROUP BY ALL""",
)
def _step_entities(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("value"))
    return step.step_entities(rows).groupBy("path", "number", "class_name").agg(F.count(F.lit(1)).alias("n"))


@registry.add("plant_nodes")
def _plant_nodes(spark, d):
    """Nodes of the XML extracts among the texts, each text taken as the content of a model."""
    wrapped = F.concat(F.lit("<PlantModel>"), F.col("text"), F.lit("</PlantModel>"))
    rows = table(spark, d, "documents").where("text like '%<%'").select(F.col("doc_id").cast("string").alias("path"), wrapped.alias("content"))
    nodes = plant_xml.plant_nodes(rows)
    return nodes.select("path", "node_id", "tag", "category", "component_type", F.to_json("attributes").alias("attributes"))


@registry.add("artifacts")
def _artifacts(spark, d):
    """Source artifacts of the attribute rows of each document, each text once."""
    rows = table(spark, d, "document_data").where("document_id is not null")
    records = rows.select(F.col("document_id").alias("record"), F.col("document_id").alias("document")).distinct().withColumns({"tabular": F.lit(False), "display_name": F.col("record")})
    evidence = rows.select(
        F.col("document_id").alias("record"), F.col("row_index").alias("ord"), F.col("attribute_name").alias("field"), F.col("attribute_value").alias("value"), F.lit("").alias("source"), F.lit("").alias("page"),
        F.lit("").alias("locator"), F.col("raw_value").alias("snippet"), F.lit(0.0).alias("score"), F.lit(0.0).alias("decision_confidence"), F.lit(0.9).alias("confidence"), F.lit("native_text").alias("kind"), F.lit("").alias("engine"),
    )
    found, links = relational.objects(relational.artifacts(records, evidence))
    return links.join(found, "object_id").select("record", "text", "operation", "method", "confidence")


@registry.add("box_pairs", f"WITH {_BOX_SQL} SELECT page, l, r, round(i / (sa + sc - i), 6) AS iou FROM pairs WHERE i / (sa + sc - i) >= 0.45")
def _box_pairs(spark, d):
    found = graph.overlap_pairs(_boxes(spark, d), ["page"])
    return found.select("page", F.col("a").alias("l"), F.col("b").alias("r"), F.round("iou", 6).alias("iou"))
