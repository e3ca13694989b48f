"""Independent SQL of queries that are defined in other modules and need more of it than fits beside them."""

from __future__ import annotations

from docweave.functions import values as v
from docweave.plans.record_queries import _P4_BEST, NESTED, _json_tree
from docweave.plans.registry import Registry
from docweave.plans.relation_queries import _LINES_SQL
from docweave.plans.text_queries import WORD, _sql_quantity, sql_clean, sql_fold

registry = Registry()

# ---------------------------------------------------------------- p4, p7

#: The columns of the wide table and how their texts are read.
_WIDE = {
    "VARCHAR": "Description Document_Subtype Location Manufacturer Medium Normative_Reference Order_Number Origin Plant Project_Name Project_Number Replaces Software Version Wall_Material",
    "DOUBLE": "Cable_Length Design_Pressure Design_Temperature Flow_Rate Sheet_Number Signal_Count Supply_Voltage Terminal_Count Total_Sheets",
    "DATE": "Acceptance_Date Creation_Date Last_Update",
    "BOOLEAN": "As_Built Ex_Protected Released",
}
_READ = {
    "VARCHAR": "v",
    "DOUBLE": "CAST(replace(v, ',', '.') AS DOUBLE)",
    "DATE": "CASE WHEN contains(v, '-') THEN CAST(v AS DATE) ELSE CAST(v[7:10] || '-' || v[4:5] || '-' || v[1:2] AS DATE) END",
    "BOOLEAN": "lower(v) IN ('true', 'ja', 'yes', '1')",
}
registry.oracle["p4_wide"] = (
    _P4_BEST
    + "SELECT document_id, "
    + ", ".join(f"any_value(CASE WHEN attribute_name = '{n}' THEN {_READ[kind]} END) AS {n}" for kind, names in _WIDE.items() for n in names.split())
    + " FROM ranked WHERE rn = 1 GROUP BY document_id"
)

_PATH = "regexp_replace(regexp_replace(j.fullkey, '^\\$\\.?', ''), '\"', '', 'g')"
registry.oracle["p7_objects"] = (
    "SELECT source_table, record_id, path, CASE WHEN stem = '' THEN NULL WHEN contains(stem, '.') THEN regexp_replace(stem, '[.][^.]*$', '') ELSE '' END AS parent_path, "
    "CASE WHEN path = '' OR path LIKE '%]' THEN NULL ELSE regexp_extract(path, '([^.]*)$', 1) END AS member, CAST(nullif(regexp_extract(path, '\\[([0-9]+)\\]$', 1), '') AS BIGINT) AS position, "
    f"path LIKE '%]' AS in_array FROM (SELECT *, regexp_replace(path, '(\\[[0-9]+\\])+$', '') AS stem FROM ({_json_tree("j.type = 'OBJECT'", f'{_PATH} AS path')}))"
)

# ---------------------------------------------------------------- values

_U = v._UNIT.replace("'", "''")
_UNIT_RULES = (
    ("inner", f"\\A({_U})\\z", None, 1), ("inner", f"\\A({_U})[ /]", None, 1), ("inner", f"(?s)\\A(.*) ({_U})\\z", 1, 2),
    ("bare", f"(?s)\\A([^(]*?\\S) ({_U} {_U})\\.? ?\\(", 1, 2), ("bare", f"(?s)\\A([^(]*?\\S) ({_U})\\.? ?\\(", 1, 2), ("bare", f"(?s)\\A(.*\\S) +({_U})\\z", 1, 2),
    ("bare", f"(?s)\\A(.*\\S) *[(\\[]({_U})[)\\]]\\z", 1, 2), ("bare", f"(?s)\\A(.*?\\S) *\\((?:[^()]* )?({_U})\\)\\z", 1, 2),
)
registry.oracle["units"] = (
    "WITH x AS (SELECT DISTINCT raw_value, trim(coalesce(raw_value, '')) AS raw FROM document_data), "
    "y AS (SELECT raw_value, trim(regexp_extract(raw, '(?s)\\A\\[(.+)\\]\\z', 1)) AS \"inner\", trim(regexp_replace(raw, '[/,.;:–—\\s]+\\z', '')) AS bare FROM x), "
    "z AS (SELECT *, CASE "
    + " ".join(f"WHEN regexp_matches(\"{c}\", '{p}') THEN {i}" for i, (c, p, _, _) in enumerate(_UNIT_RULES))
    + " END AS k FROM y) SELECT raw_value, CASE k "
    + " ".join(f"WHEN {i} THEN " + (f"trim(regexp_extract(\"{c}\", '{p}', {a}))" if a else "''") for i, (c, p, a, _) in enumerate(_UNIT_RULES))
    + " ELSE bare END AS value, CASE k "
    + " ".join(f"WHEN {i} THEN regexp_extract(\"{c}\", '{p}', {b})" for i, (c, p, _, b) in enumerate(_UNIT_RULES))
    + " ELSE '' END AS unit FROM z"
)

registry.oracle["terminals"] = f"""WITH x AS (SELECT DISTINCT attribute_value, {sql_clean('attribute_value')} AS c FROM document_data),
y AS (SELECT *, CASE WHEN regexp_full_match(c, '[0-9]+') THEN 0 WHEN regexp_full_match(c, ':\\s*[0-9]+') THEN 1 WHEN regexp_full_match(c, '[0-9]+\\s*/\\s*[A-Z][A-Z0-9]*') THEN 2 WHEN regexp_full_match(c, '(?i)kanal\\s+[0-9]+') THEN 3
  WHEN regexp_full_match(c, '[A-Z][0-9]+[A-Za-z]?') THEN 4 WHEN c <> '' AND length(c) <= 12 AND NOT regexp_matches(lower(c), '^(verschaltung|klemm|plt)') THEN 5 END AS k FROM x)
SELECT attribute_value, CASE k WHEN 1 THEN regexp_extract(c, '([0-9]+)', 1) WHEN 2 THEN regexp_extract(c, '^([0-9]+)', 1) || '/' || regexp_extract(c, '([A-Z][A-Z0-9]*)$', 1) WHEN 3 THEN 'Kanal ' || regexp_extract(c, '([0-9]+)$', 1)
  WHEN 0 THEN c WHEN 4 THEN c WHEN 5 THEN c END AS name, CASE k WHEN 2 THEN 'Phase' WHEN 3 THEN 'Funktionsklasse' WHEN 4 THEN 'Klemmentyp' ELSE '' END AS attribute,
  CASE k WHEN 2 THEN regexp_extract(c, '([A-Z][A-Z0-9]*)$', 1) WHEN 3 THEN 'SPS-Kanal' WHEN 4 THEN 'Steuerklemme' ELSE '' END AS detail FROM y"""

_UNIT_WORD = "(?:V|A|W|mA|mm|g|kg|ms|m|Hz|bar|°[CF]|%|DC|AC|VA|bit|ZZO|ZZMs|ZZMm|MPa|kg/)"


def _ascii_words(x: str) -> str:
    """Word characters beyond ASCII as a small letter, the two of the units as capitals of their own."""
    return f"regexp_replace(replace(replace({x}, 'µ', 'ZZM'), 'Ω', 'ZZO'), '{WORD}', 'q', 'g')"


def _name_score(x: str) -> str:
    n = f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
    letters = f"regexp_matches({x}, '\\p{{L}}')"
    return f"""CASE WHEN {x} = '' THEN 0.0 ELSE greatest(0.0, least(1.0, 0.4 + CASE WHEN {n} <= 5 THEN 0.15 ELSE 0 END - CASE WHEN {n} > 12 THEN 0.4 ELSE 0 END
    + CASE WHEN regexp_matches({x}, '^\\p{{Lu}}') AND NOT ({letters} AND {x} = upper({x})) AND NOT ({letters} AND {x} = lower({x})) THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(trim({x}, ' '), '[.!?]$') THEN 0.3 ELSE 0 END
    - CASE WHEN regexp_matches(lower({x}), 'www\\.|http') THEN 0.5 ELSE 0 END - CASE WHEN {letters} AND {x} = upper({x}) AND length({x}) > 8 THEN 0.2 ELSE 0 END)) END"""


def _value_score(x: str) -> str:
    n = f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
    return f"""CASE WHEN {x} = '' THEN 0.0 ELSE greatest(0.0, least(1.0, CASE WHEN regexp_matches(lower({x}), 'www\\.|http:|\\\\|\\.pdf') THEN 0.0 ELSE
    CASE WHEN regexp_matches({_ascii_words(x)}, '\\b{_UNIT_WORD}\\b') THEN 0.5 WHEN regexp_full_match({x}, '[0-9.,\\s]+') AND length({x}) < 12 THEN 0.4 WHEN regexp_matches({x}, '[0-9]') AND {n} <= 3 THEN 0.25 ELSE 0.0 END
    + CASE WHEN {n} <= 2 THEN 0.15 WHEN {n} <= 4 THEN 0.05 ELSE 0.0 END - CASE WHEN {n} > 8 THEN 0.4 ELSE 0.0 END - CASE WHEN length({x}) > 120 THEN 0.3 ELSE 0.0 END
    - CASE WHEN regexp_matches({x}, '[.!?]$') AND {n} > 3 THEN 0.3 ELSE 0.0 END END - CASE WHEN regexp_full_match({x}, '[0-9]{{1,3}}') THEN 0.15 ELSE 0.0 END)) END"""


registry.oracle["value_scores"] = (
    f"SELECT attribute_name, attribute_value, round({_name_score('a')}::DOUBLE, 6) AS name_score, round({_value_score('b')}::DOUBLE, 6) AS value_score FROM "
    "(SELECT DISTINCT attribute_name, attribute_value, coalesce(attribute_name, '') AS a, trim(coalesce(attribute_value, ''), ' ') AS b FROM document_data)"
)

_POLES = "\\b(L1|L2|L3|L\\+|L-|N|PE|PEN|G\\+|G-|V\\+|V-|FE|AC|DC)\\b"
registry.oracle["polarities"] = f"""WITH x AS (SELECT doc_id, regexp_extract_all(regexp_replace(upper(coalesce(text, '')), '{WORD}', 'q', 'g'), '{_POLES}', 1) AS l FROM documents),
y AS (SELECT doc_id, unnest(l) AS code, generate_subscripts(l, 1) AS i FROM x), z AS (SELECT doc_id, code, count(*) AS n, min(i) AS f FROM y GROUP BY ALL), b AS (SELECT doc_id, arg_min(code, (-n, f)) AS code FROM z GROUP BY 1)
SELECT doc_id, coalesce(code, '') AS polarity FROM documents LEFT JOIN b USING (doc_id)"""

# ---------------------------------------------------------------- texts

_BLOCK = {
    "drawing_no": "(?i)zeichnungs?-?n(?:umme)?r\\.?\\s*:?\\s*([A-Z0-9][A-Z0-9._\\-/]*)",
    "project": "(?i)projekt(?:name)?\\s*:\\s*([^\\n|]+)",
    "date": "([0-9]{2}\\.[0-9]{2}\\.[0-9]{4})",
    "sheet": "(?i)bla(?:tt|tt-nr\\.?)\\s*:?\\s*([0-9]+(?:\\s*/\\s*[0-9]+)?)",
    "revision": "(?i)\\brev(?:ision)?\\.?\\s*:?\\s*([A-Z0-9][A-Z0-9.]*)",
}
registry.oracle["title_blocks"] = (
    f"SELECT doc_id, {', '.join(f'''trim(regexp_extract(c, '{p}', 1)) AS {n}''' for n, p in _BLOCK.items())} FROM (SELECT doc_id, {sql_clean('text')} AS c FROM documents)"
)

_RAW_LINES = """lines AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM
(SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents)) WHERE trim(l[i], ' ') <> '')"""
_LINE_RULES = (
    "\\A\\s*([^:|\\t]{3,70}?)\\s*:\\s*(\\S.{0,149})\\z",
    "\\A\\s*([A-Z][A-Za-z0-9\\s/\\-.,()°±]{3,60}?)\\s{4,}(\\S.{1,80})\\z",
    "\\A\\s*([^:|\\t]{3,70}?)\\s*[\\t|]\\s*(\\S.{0,149})\\z",
)
_PARAMETERS = (
    f"WITH {_RAW_LINES}, k AS (SELECT *, CASE "
    + " ".join(f"WHEN regexp_matches(line, '{p}') THEN {i}" for i, p in enumerate(_LINE_RULES))
    + " END AS tier FROM lines), p AS (SELECT doc_id, line_no, tier, rtrim(trim(CASE tier "
    + " ".join(f"WHEN {i} THEN regexp_extract(line, '{p}', 1)" for i, p in enumerate(_LINE_RULES))
    + " END, ' '), ',:;') AS name, rtrim(trim(CASE tier "
    + " ".join(f"WHEN {i} THEN regexp_extract(line, '{p}', 2)" for i, p in enumerate(_LINE_RULES))
    + f""" END, ' '), ',;') AS value FROM k WHERE tier IS NOT NULL),
f AS (SELECT * FROM p WHERE length(name) BETWEEN 3 AND 70 AND NOT regexp_full_match(name, '[0-9]+') AND NOT (name = upper(name) AND regexp_matches(name, '\\p{{L}}') AND length(name) > 8)
  AND NOT (NOT regexp_matches(value, '[0-9]') AND NOT regexp_matches({_ascii_words('value')}, '\\b(?:V|A|W|mA|mm|cm|m|km|g|kg|ms|s|Hz|kHz|bar|°[CF]|K|%|DC|AC|VA|bit|ZZO|ZZMm|MPa|psi)\\b') AND len(list_filter(regexp_split_to_array(value, '\\s+'), lambda w: w <> '')) > 4)
  AND NOT regexp_matches(value, '(?i)\\A(?:Page\\s+[0-9]|https?://|www\\.|©|All rights|[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}})') AND length(value) <= 150 AND NOT regexp_matches(lower(value), 'www\\.|http')),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, lower(rtrim(name, ' :')) ORDER BY tier, line_no, name, value) = 1)
"""
)
registry.oracle["datasheet_parameters"] = _PARAMETERS + "SELECT doc_id, name, value, CAST(line_no AS INT) AS line_no FROM b"
registry.oracle["datasheet_quality"] = (
    _PARAMETERS + f"SELECT doc_id, round_even(round(avg(({_name_score('name')})::DOUBLE / 2 + ({_value_score("trim(value, ' ')")})::DOUBLE / 2), 9), 4)::DOUBLE AS quality, count(*) AS n FROM b GROUP BY doc_id"
)

_ALONE = "\\A\\s*([A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß\\s./()-]{1,40})\\s*:\\s*\\z"
_INLINE = "(?s)\\A\\s*([^:]{2,80})\\s*:\\s*(.+?)\\s*\\z"
registry.oracle["text_pairs"] = f"""WITH {_LINES_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS rn, regexp_matches(text, '{_ALONE}') AS alone FROM lines),
a AS (SELECT x.doc_id, x.idx, regexp_replace(lower({sql_clean(f"regexp_extract(x.text, '{_ALONE}', 1)")}), '\\.+$', '') AS key, arg_min(y.text, y.rn) AS value FROM n x JOIN n y ON y.doc_id = x.doc_id AND y.rn BETWEEN x.rn + 1 AND x.rn + 3 AND NOT y.alone WHERE x.alone GROUP BY ALL),
l AS (SELECT doc_id, key, value, idx, 0 AS pass FROM a WHERE key IN ('projekt', 'projektnr', 'project number', 'projekt-nr', 'kunde', 'customer', 'auftrag', 'order', 'position', 'plant', 'anlage', 'facility', 'dokument', 'document', 'erstellt', 'created',
  'bearb', 'edited', 'gepr', 'geprüft', 'reviewed', 'norm', 'standard', 'software', 'datum', 'date', 'name', 'rev', 'revision')),
s AS (SELECT doc_id, {sql_clean(f"regexp_extract(text, '{_INLINE}', 1)")} AS key, {sql_clean(f"regexp_extract(text, '{_INLINE}', 2)")} AS value, idx, 1 AS pass FROM lines WHERE regexp_matches(text, '{_INLINE}')),
e AS (SELECT * FROM l UNION ALL SELECT * FROM s WHERE key <> '' AND value <> '')
SELECT CAST(doc_id AS VARCHAR) AS document, 1 AS page, key, value, pass, CAST(idx AS INT) AS idx FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, lower(key), lower(value) ORDER BY pass, idx, key, value) = 1"""

_ASPECT = """CASE WHEN s[1] = '=' AND (contains(s, '+') OR contains(s, '-')) THEN 'Orts+Produktaspekt' WHEN s[1] = '=' THEN 'Funktionsaspekt' WHEN s[1] = '+' AND contains(s, '-') THEN 'Orts+Produktaspekt' WHEN s[1] = '+' THEN 'Ortsaspekt' ELSE 'Produktaspekt' END"""
registry.oracle["cell_parts"] = f"""WITH {_RAW_LINES}, t AS (SELECT doc_id, trim(line, ' ') AS s FROM lines),
k AS (SELECT *, contains(s, ':') AND NOT regexp_matches(s, '^[=+\\-]') AS named, trim(regexp_extract(s, '(?s)\\A([^:]*):(.*)\\z', 1)) AS a, trim(regexp_extract(s, '(?s)\\A([^:]*):(.*)\\z', 2)) AS b FROM t),
norm AS (SELECT *, lower(a) IN ('messgröße', 'messgroesse', 'anschluss', 'anschlussbezeichnung', 'eingang', 'eingangskennzeichen', 'ausgang', 'ausgangskennzeichen', 'unterbrechung', 'unterbrechungsnummer') AS din FROM k),
p AS (SELECT doc_id, CASE WHEN NOT named AND regexp_full_match(s, '[0-9]{{1,3}}') THEN 'terminal' ELSE 'main' END AS part,
  CASE WHEN named THEN a WHEN regexp_full_match(s, '[0-9]{{1,3}}') THEN 'Anschlussbezeichnung' WHEN s[1] IN ('=', '+', '-') THEN 'Referenzkennzeichnung (' || {_ASPECT} || ')' WHEN regexp_full_match(s, '(?i)E[WX]?[0-9]+(\\.[0-9]+)?') THEN 'Eingangskennzeichen'
    WHEN regexp_full_match(s, '(?i)A[WX]?[0-9]+(\\.[0-9]+)?') THEN 'Ausgangskennzeichen' WHEN regexp_full_match(s, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}°]+/[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+[²³]?') THEN 'Messgröße' WHEN regexp_full_match(s, '[A-Z]{{2,3}}') THEN s ELSE 'Bemerkung' END AS name,
  CASE WHEN named THEN CASE WHEN din THEN 'DIN 19227-2' ELSE 'Herstellerspezifisch' END WHEN regexp_full_match(s, '[0-9]{{1,3}}') THEN 'DIN 19227-2' WHEN s[1] IN ('=', '+', '-') THEN 'IEC 81346-1' WHEN regexp_full_match(s, '(?i)[EA][WX]?[0-9]+(\\.[0-9]+)?') THEN 'DIN 19227-2'
    WHEN regexp_full_match(s, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}°]+/[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+[²³]?') THEN 'DIN 19227-2' WHEN regexp_full_match(s, '[A-Z]{{2,3}}') THEN 'CAE-systemspezifisch (COMOS)' ELSE 'Herstellerspezifisch' END AS class FROM norm WHERE NOT named OR b <> '')
SELECT doc_id, part, name, class, count(*) AS n FROM p GROUP BY ALL"""

# ---------------------------------------------------------------- documents

registry.oracle["supplier_documents"] = """SELECT CAST(s_suppkey AS VARCHAR) AS identity, '{"source_type":"supplier","id":"' || CAST(s_suppkey AS VARCHAR) || '","submodels":[{"idShort":"General","submodelElements":[{"modelType":"Property","idShort":"Name","valueType":"xs:string","value":"' || s_name || '"}]}]}' AS payload FROM supplier"""

_PROP = """'{{"modelType":"Property","idShort":"{0}","valueType":"xs:string","value":"' || {1} || '"}}'"""
registry.oracle["rule_documents"] = f"""WITH f AS (SELECT o_custkey, o_orderstatus AS s, min(o_orderkey) AS o FROM orders GROUP BY ALL), st AS (SELECT o_custkey, array_to_string(list(s ORDER BY o), '|') AS states FROM f GROUP BY 1),
g AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p, count(*) AS n FROM orders GROUP BY 1),
x AS (SELECT CAST(o_custkey AS VARCHAR) AS k, states, n, CASE regexp_extract(p, '^([0-9]+)', 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE 'other' END AS u, CASE WHEN n >= 10 THEN 'many' ELSE 'few' END AS m FROM g JOIN st USING (o_custkey))
SELECT k AS identity, '{{"source_type":"orders","assetAdministrationShells":[{{"modelType":"AssetAdministrationShell","id":"urn:docweave:aas:orders:' || k || '","idShort":"' || k || '","assetInformation":{{"assetKind":"Instance","globalAssetId":"urn:docweave:asset:orders:' || k || '"}},"submodels":[{{"type":"ModelReference","keys":[{{"type":"Submodel","value":"urn:docweave:aas:orders:' || k || ':orders"}}]}}]}}],"submodels":[{{"modelType":"Submodel","id":"urn:docweave:aas:orders:' || k || ':orders","idShort":"Orders","submodelElements":['
|| {_PROP.format('States', 'states')} || ',' || {_PROP.format('Gated', "CASE WHEN n >= 5 THEN states ELSE 'too_few' END")} || ',' || {_PROP.format('Urgency', 'u')} || ',' || {_PROP.format('Summary', "m || '|' || u")} || ']}}]}}' AS payload,
CASE WHEN n >= 5 THEN '' ELSE 'Orders.Gated' END AS gates FROM x"""

_FOLDED = "replace(lower(" + sql_fold("replace(replace(replace(replace(replace(replace({0}, 'ß', 'ss'), 'ẞ', 'SS'), 'æ', 'ae'), 'Æ', 'AE'), 'œ', 'oe'), 'Œ', 'OE')") + "), '\\', '/')"
_KIND = {
    "STELLEN_OVERVIEW": "STELLEN_OVERVIEW_RECORD", "DEVICE_DATASHEET": "STELLEN_TU_DATASHEET", "STELLEN_TU": "STELLEN_TU_DATASHEET",
    "RI": "RI_EQUIPMENT_ROW,RI_INSTRUMENT_FUNCTION_ROW,RI_PIPING_COMPONENT_ROW,RI_CONNECTION_ROW", "IFC": "IFC_PIPING_ITEM_ROW,IFC_CONNECTION_ROW",
    "CIRCUIT": "STROMLAUF_COMPONENT_GROUP,STROMLAUF_COMPONENT,STROMLAUF_CONNECTION", "TEMPLATE": "IFC_3D_ASSEMBLY_STEP,IFC_3D_ASSEMBLY_CONNECTION,IFC_3D_POSITION,IFC_3D_PART_LIBRARY",
}
_SHEETS = "geratedaten|geraetedaten|datenblatt|datasheet|spezifikation|specification|geratespezifikation|geraetespezifikation"
_TESTS = (
    ("place AND regexp_matches(name, 'stellenubersicht|stellenuebersicht')", "STELLEN_OVERVIEW", _KIND["STELLEN_OVERVIEW"]),
    ("place AND sheet", "DEVICE_DATASHEET", _KIND["DEVICE_DATASHEET"]), ("place", "STELLEN_TU", _KIND["STELLEN_TU"]), ("flow AND suffix = '.pdf'", "RI_FLOWSHEET", _KIND["RI"]),
    ("flow", "RI_FLOWSHEET", ""), ("suffix = '.ifc'", "IFC_MODEL", _KIND["IFC"]),
    ("listed AND suffix = '.pdf' AND (regexp_matches(name, 'stromlauf|sromlauf|stromkreis|iobaugruppe') OR contains(rel, 'stromlaufplane'))", "STROMLAUFPLAN", _KIND["CIRCUIT"]),
    ("listed AND regexp_matches(name, 'klemmenplan|klemmplan')", "KLEMMENPLAN", "KLEMMENPLAN_ROW"), ("listed AND contains(name, 'verschaltungsliste')", "VERSCHALTUNGSLISTE", "VERSCHALTUNGSLISTE_ROW"),
    ("listed", "CABINET_REFERENCE", "CABINET_REFERENCE_ROW"), ("sheet", "DEVICE_DATASHEET", _KIND["DEVICE_DATASHEET"]), ("suffix = '.pdf'", "STROMLAUFPLAN", _KIND["CIRCUIT"]),
    ("contains(name, 'assembly3dtemplate')", "IFC_MODEL", _KIND["TEMPLATE"]),
    ("suffix IN ('.xls', '.xlsx') AND contains(rel, 'piping') AND regexp_matches(name, 'mapping|assembly|filled')", "IFC_MODEL", ""), ("suffix IN ('.xls', '.xlsx')", "CABINET_REFERENCE", "CABINET_REFERENCE_ROW"),
)
registry.oracle["file_kinds"] = (
    f"""WITH p AS (SELECT DISTINCT relative_path AS path, regexp_extract(relative_path, '([^/]*)$', 1) AS f FROM documents WHERE relative_path IS NOT NULL),
x AS (SELECT path, regexp_replace({_FOLDED.format('path')}, '[^a-z0-9]+', '', 'g') AS rel, regexp_replace({_FOLDED.format('f')}, '[^a-z0-9]+', '', 'g') AS name, lower(regexp_extract(f, '([.][^.]+)$', 1)) AS suffix FROM p),
y AS (SELECT *, contains(rel, 'stellenplaene') AS place, contains(rel, 'verschaltungslisten') AS listed, regexp_matches(rel, 'rifliessbild|rifliesbild|riflieszbild') AS flow, regexp_matches(name || ' ' || rel, '{_SHEETS}') AS sheet FROM x),
z AS (SELECT *, CASE """
    + " ".join(f"WHEN {test} THEN {i}" for i, (test, _, _) in enumerate(_TESTS))
    + " END AS k FROM y WHERE suffix IN ('.pdf', '.xls', '.xlsx', '.ifc') OR (suffix IN ('.xml', '.xsd') AND flow)) SELECT path, CASE k "
    + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind, _) in enumerate(_TESTS))
    + " END AS kind, CASE k "
    + " ".join(f"WHEN {i} THEN '{families}'" for i, (_, _, families) in enumerate(_TESTS))
    + " END AS families FROM z WHERE k IS NOT NULL"
)

# ---------------------------------------------------------------- artifacts

_DERIVED_FIELD = "(?i)(^|_)(bbox|raw_context|trace_path|graph|geometry|object_type|component_(role|type)|confidence|decision_confidence|status|review|evidence|provenance|source|record|page_number|page|index|row|column|cluster|match|element_type)($|_)"
_BOX = "\\s*-?[0-9]+(?:[.][0-9]+)?(?:\\s*,\\s*-?[0-9]+(?:[.][0-9]+)?){3}\\s*"
registry.oracle["artifacts"] = f"""WITH r AS (SELECT DISTINCT document_id AS record FROM document_data WHERE document_id IS NOT NULL),
s AS (SELECT document_id AS record, {sql_clean('raw_value')} AS text FROM document_data WHERE document_id IS NOT NULL AND NOT regexp_matches(coalesce(attribute_name, ''), '{_DERIVED_FIELD}')),
f AS (SELECT DISTINCT record, text FROM s WHERE text <> '' AND NOT regexp_full_match(text, '{_BOX}'))
SELECT record, text, 'Tj' AS operation, 'Native_Text' AS method, 0.9::DOUBLE AS confidence FROM f UNION ALL
SELECT record, 'No source text for ' || record || '; requires review.', 'Manual_Entry', 'Manual_Review_Required', 0.0 FROM r WHERE record NOT IN (SELECT record FROM f)"""

# ---------------------------------------------------------------- the relational model

_TYPES = {
    "A": "Cabinet_Aggregate", "B": "Sensor", "C": "PLC_Module", "E": "Heater", "F": "Fuse", "G": "Power_Supply", "H": "Indicator_Lamp", "K": "Contactor", "M": "Motor",
    "P": "Indicator_Lamp", "Q": "Switch", "R": "Sensor", "S": "Switch", "T": "Power_Supply", "U": "PLC_Module", "V": "PLC_Module", "W": "Power_Supply", "X": "Terminal", "Y": "Valve_Actuator",
}
_MODEL = f"""WITH d0 AS (SELECT * FROM document_data WHERE document_id IS NOT NULL AND attribute_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_data_id ORDER BY row_index, document_id, attribute_name, attribute_value) = 1),
res AS (SELECT document_id || '#' || attribute_name AS record, attribute_name AS field, attribute_value AS value, {sql_clean('attribute_value')} AS c, row_index AS ord, document_id AS document FROM d0),
rec AS (SELECT record, document, min(ord) AS ord FROM res GROUP BY ALL),
agg AS (SELECT record, arg_max(c, (ord, c)) FILTER (field = 'Order_Number') AS known, arg_min(c, (ord, c)) FILTER (regexp_full_match(c, '[=+\\-][A-Za-z0-9.=+\\-:/_]+|[A-Z]{{1,3}}[0-9]+[A-Za-z0-9.:/_\\-]*')) AS shaped,
  bool_and(lower(c) = lower(replace(field, '_', ' '))) AS echo FROM res WHERE c <> '' GROUP BY record),
j AS (SELECT rec.*, known, shaped, coalesce(echo, false) AS echo FROM rec LEFT JOIN agg USING (record)),
kept AS (SELECT *, coalesce(known, shaped, nullif({sql_clean('record')}, ''), record) AS base FROM j WHERE NOT echo OR document IN (SELECT document FROM j GROUP BY document HAVING bool_and(echo))),
again AS (SELECT *, row_number() OVER (PARTITION BY document, base ORDER BY ord, record) AS n FROM kept),
top AS (SELECT document, record, base || CASE WHEN n = 1 THEN '' ELSE CASE WHEN contains(base, ':') THEN '-' ELSE ':' END || CAST(n AS VARCHAR) END AS designation FROM again),
m AS (SELECT rec.document, rec.record, rec.ord, coalesce(designation, '') AS designation, regexp_matches(coalesce(designation, ''), '[:/][0-9]+|[:/](L[123]|N|PE|U[0-9]+|V[0-9]+|W[0-9]+|p[0-9]+)') AS terminal FROM rec LEFT JOIN top USING (document, record)),
el AS (SELECT *, document || '/E.' || CAST(row_number() OVER (PARTITION BY document ORDER BY ord, record) AS VARCHAR) AS element_id FROM m)
"""
registry.oracle["sheet_elements"] = (
    _MODEL
    + "SELECT element_id, document AS document_id, record AS cluster_id, designation, CASE WHEN terminal THEN 'Terminal' ELSE CASE regexp_extract(trim(designation, ' '), '^-?([A-Z])', 1) "
    + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in _TYPES.items())
    + " ELSE 'Consumer' END END AS element_type FROM el"
)
_KINDS = " ".join(f"WHEN regexp_matches(x, '{_sql_quantity(p)}') THEN {i}" for i, (p, _) in enumerate(v.QUANTITIES))
_FOUND = " ".join(f"WHEN {i} THEN regexp_extract(x, '{_sql_quantity(p)}', 1)" for i, (p, _) in enumerate(v.QUANTITIES))
_STATED = " ".join(f"WHEN {i} THEN " + (f"'{u}'" if u else f"regexp_extract(x, '{_sql_quantity(p)}', 2)") for i, (p, u) in enumerate(v.QUANTITIES))
_VALUES = (
    _MODEL
    + f""", own AS (SELECT record, field, c, ord FROM res WHERE NOT regexp_matches(coalesce(field, ''), '{_DERIVED_FIELD}') AND c <> '' AND NOT regexp_full_match(c, '{_BOX}')
  AND NOT (length(c) > 400 AND length(c) - length(replace(c, ',', '')) > length(c) - length(replace(c, ' ', '')))),
one AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY record, field ORDER BY ord, c) = 1),
q AS (SELECT *, trim(c, ' ') AS x FROM one), k AS (SELECT *, CASE {_KINDS} END AS i FROM q), n AS (SELECT *, CASE i {_FOUND} ELSE '' END AS num, CASE i {_STATED} ELSE '' END AS raw_unit FROM k),
z AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(num, ',', '.'), '^0+([0-9])', '\\1'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS normal, CASE lower(raw_unit) """
    + " ".join(f"WHEN '{w}' THEN '{u}'" for w, u in v.UNIT_WORDS.items())
    + f""" ELSE raw_unit END AS unit, CASE WHEN regexp_matches(regexp_replace(x, '{WORD}', 'q', 'g'), '(?i)\\b(DC|AC|3~|3-phase|1~|1-phase)\\b') THEN regexp_extract(regexp_replace(x, '{WORD}', 'q', 'g'), '(?i)\\b(DC|AC|3~|3-phase|1~|1-phase)\\b') ELSE regexp_extract(regexp_replace(x, '{WORD}', 'q', 'g'), '(?i)\\b([0-9]+)\\s*Ph(?:ase)?\\b') END AS qualifier FROM n),
ed AS (SELECT document, record, element_id, designation, field AS attribute, c AS value, coalesce(nullif(normal, ''), c) AS normalized, unit, qualifier FROM z JOIN el USING (record))
"""
)


def _no(prefix: str, order: str, within: str = "document") -> str:
    return f"document || '/{prefix}.' || CAST(row_number() OVER (PARTITION BY {within} ORDER BY {order}) AS VARCHAR)"


registry.oracle["sheet_values"] = _VALUES + f"SELECT {_no('ED', 'element_id, attribute')} AS value_id, element_id, attribute, value, normalized, unit, qualifier FROM ed"
_ABOUT = {"document_data": ("DD", "'Project_Name', 'Plant', 'Manufacturer'"), "revision_data": ("R", "'Version', 'Last_Update'")}
for _sheet, (_prefix, _fields) in _ABOUT.items():
    registry.oracle[f"sheet_{_sheet}"] = _VALUES + f"SELECT {_no(_prefix, 'attribute')} AS data_id, document AS document_id, attribute, value, normalized, unit, qualifier FROM ed WHERE attribute IN ({_fields})"
registry.oracle["sheet_elements_topdown"] = (
    _MODEL
    + f"SELECT {_no('ETD', 'ord, record')} AS topdown_id, document AS document_id, designation, CASE WHEN regexp_matches(designation, '[:/][0-9]+|[:/](L[123]|N|PE|U[0-9]+|V[0-9]+|W[0-9]+|p[0-9]+)') THEN 'Terminal' ELSE 'Consumer' END AS element_type "
    "FROM (SELECT a.document, a.record, a.ord, t.designation FROM again a JOIN top t USING (document, record))"
)
registry.oracle["sheet_elements_from_cluster"] = _MODEL + f"SELECT {_no('EFC', 'ord, record')} AS from_cluster_id, document AS document_id, record AS cluster_id FROM rec"
registry.oracle["sheet_match_result"] = _MODEL + "SELECT rec.record AS cluster_id, CASE WHEN top.record IS NULL THEN 'Only_Cluster' ELSE 'Matched' END AS status FROM rec LEFT JOIN top USING (document, record)"
registry.oracle["sheet_layer_id"] = _MODEL + "SELECT DISTINCT document || '/LYR.1' AS layer_id, document AS document_id, 'Default' AS label FROM rec"
_CLASSES = "k AS (SELECT *, regexp_extract(trim(designation, ' '), '^-?([A-Z])', 1) AS letter FROM el), ec AS (SELECT * FROM k WHERE letter IN (" + ", ".join(f"'{x}'" for x in _TYPES) + "))"
registry.oracle["sheet_element_classification"] = (
    _MODEL
    + f", {_CLASSES} SELECT {_no('EC', 'element_id')} AS classification_id, element_id, 'IEC 81346-2' AS standard, letter AS class_code, CASE letter "
    + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in _TYPES.items())
    + " END AS element_type, CASE WHEN letter IN ('C', 'G', 'S', 'T', 'V', 'W') THEN 0.8 ELSE 0.55 END::DOUBLE AS confidence FROM ec"
)
_ITEMS = f""", it AS (SELECT *, regexp_replace(designation, '(?s)[:/].*', '') AS item FROM el), ri AS (SELECT *, {_no('RI', 'item')} AS item_id FROM (SELECT DISTINCT document, item FROM it WHERE item <> '')),
mp AS (SELECT it.document, it.element_id, ri.item_id FROM it JOIN ri ON ri.document = it.document AND ri.item = it.item)"""
registry.oracle["sheet_document_representeditem"] = _MODEL + _ITEMS + " SELECT item_id, document AS document_id, item FROM ri"
registry.oracle["sheet_element_representeditem_mapping"] = _MODEL + _ITEMS + f" SELECT {_no('MAP', 'element_id')} AS mapping_id, element_id, item_id FROM mp"
_FACTS = _VALUES + _ITEMS + ", rd AS (SELECT ed.*, item_id FROM ed JOIN mp USING (element_id) QUALIFY row_number() OVER (PARTITION BY item_id, attribute ORDER BY element_id) = 1)"
registry.oracle["sheet_representeditem_data"] = (
    _FACTS.replace("SELECT ed.*, item_id", "SELECT ed.document, ed.record, element_id, attribute, value, normalized, unit, qualifier, item_id")
    + f" SELECT {_no('RID', 'item_id, attribute')} AS data_id, item_id, attribute, value, normalized, unit, qualifier FROM rd"
)
registry.oracle["sheet_sources"] = (
    _FACTS.replace("SELECT ed.*, item_id", "SELECT ed.document, ed.record, element_id, attribute, item_id")
    + f""", {_CLASSES.replace("k AS (", "kk AS (").replace("FROM k ", "FROM kk ")}, src AS (SELECT record, count(DISTINCT c) AS n FROM res WHERE NOT regexp_matches(coalesce(field, ''), '{_DERIVED_FIELD}') AND c <> '' AND NOT regexp_full_match(c, '{_BOX}') GROUP BY record),
per AS (SELECT rec.record, coalesce(n, 1) AS n FROM rec LEFT JOIN src USING (record))
SELECT 'Element_Data_Source' AS sheet, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM ed JOIN per USING (record) UNION ALL SELECT 'Document_Data_Source', CAST(coalesce(sum(n), 0) AS BIGINT) FROM ed JOIN per USING (record) WHERE attribute IN ({_ABOUT['document_data'][1]})
UNION ALL SELECT 'Revision_Data_Source', CAST(coalesce(sum(n), 0) AS BIGINT) FROM ed JOIN per USING (record) WHERE attribute IN ({_ABOUT['revision_data'][1]}) UNION ALL SELECT 'RepresentedItem_Data_Source', CAST(coalesce(sum(n), 0) AS BIGINT) FROM rd JOIN per USING (record)
UNION ALL SELECT 'Element_Classification_Source', CAST(coalesce(sum(n), 0) AS BIGINT) FROM ec JOIN per USING (record)"""
)
