"""Rule graphs compiled to columns.

A rule set turns the rows of one identity into a nested document; a row profile turns each row into a new one.  A graph is
parsed and checked on the driver, ordered topologically, and compiled once: its input columns become one aggregation,
every other node a column expression over it.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import boolish, clean_cell, normalize_identifier, or_null, python_pattern

RULE_NODES = (
    "InputColumn", "Constant", "NormalizeIdentifier", "RegexExtract", "MapEnum", "BoolMap", "Concat",
    "PreferFirstNonEmpty", "Condition", "ConfidenceGate", "OutputProperty", "OutputSubmodel",
)
ROW_NODES = (
    "CellValue", "Constant", "NormalizeIdentifier", "RegexExtract", "Concat", "LookupMap", "Condition", "BuildRow",
    "OutputSheet",
)
#: Nodes that only mark a step of a profile and stand for their configured value.
MARKERS = (
    "BuiltinContext", "WorkbookSheet", "HeaderMatch", "RowIterator", "StrictMatch", "ResolverMatch", "MissingPlaceholder",
    "CompletionMerge", "RelationBuild",
)


def cleaned(value: object) -> str:
    """A configured value as a cell: white space collapsed."""
    return " ".join(str("" if value is None else value).split())


@dataclass(frozen=True)
class Node:
    id: str
    kind: str
    config: dict = field(default_factory=dict)
    label: str = ""


@dataclass(frozen=True)
class Edge:
    id: str
    source: str
    target: str
    order: int = 0
    port: str = ""


@dataclass(frozen=True)
class Graph:
    """Nodes and edges of a rule set or profile, with its remaining settings."""

    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]
    settings: dict

    @classmethod
    def parse(cls, payload: dict) -> Graph:
        nodes = tuple(
            Node(n["id"], n.get("node_type", n.get("type", "")), dict(n.get("config", {})), n.get("label", "")) for n in payload.get("nodes", [])
        )
        edges = tuple(
            Edge(e.get("id", f"e{i}"), e["from_node"], e["to_node"], int(e.get("order", 0)), e.get("to_port", e.get("target_port", "")))
            for i, e in enumerate(payload.get("edges", []))
        )
        return cls(nodes, edges, {k: v for k, v in payload.items() if k not in ("nodes", "edges")})

    def node(self, key: str) -> Node | None:
        return next((n for n in self.nodes if n.id == key), None)

    def parents(self, key: str) -> list[Edge]:
        return sorted((e for e in self.edges if e.target == key), key=lambda e: (e.order, e.id))

    def ordered(self) -> list[str]:
        """Node ids, parents first, ties by id; nodes of a cycle are left out."""
        known = {n.id for n in self.nodes}
        waiting, after = dict.fromkeys(known, 0), defaultdict(list)
        for e in self.edges:
            if e.source in known and e.target in known:
                after[e.source].append(e.target)
                waiting[e.target] += 1
        ready, done = deque(sorted(k for k, n in waiting.items() if not n)), []
        while ready:
            key = ready.popleft()
            done.append(key)
            for target in sorted(after[key]):
                waiting[target] -= 1
                if not waiting[target]:
                    ready.append(target)
        return done

    def ancestors(self, key: str) -> list[str]:
        """The node and everything it depends on, each once, nearest first along the first parent."""
        seen, todo = [], [key]
        while todo:
            here = todo.pop(0)
            if here not in seen and self.node(here):
                seen.append(here)
                todo = [e.source for e in self.parents(here)] + todo
        return seen


@dataclass(frozen=True)
class Issue:
    code: str
    where: str
    message: str


def validate(graph: Graph, kinds: tuple[str, ...] = RULE_NODES) -> list[Issue]:
    """What is wrong with a rule graph: ids, kinds, required settings, dangling edges, unbound outputs, cycles."""
    issues = []
    for what, ids in (("node", [n.id for n in graph.nodes]), ("edge", [e.id for e in graph.edges])):
        issues += [Issue(f"duplicate_{what}_id", i, f"{what} id {i} occurs more than once") for i in sorted({i for i in ids if ids.count(i) > 1})]
    required = {"InputColumn": "field", "OutputProperty": "property_name", "OutputSubmodel": "id_short", "CellValue": "field"}
    codes = {"InputColumn": "missing_input_field", "OutputProperty": "missing_property_name", "OutputSubmodel": "missing_submodel_id_short", "CellValue": "missing_input_field"}
    for n in graph.nodes:
        if n.kind not in kinds:
            issues.append(Issue("unsupported_node_type", n.id, f"{n.kind} is no known node type"))
        elif n.kind in required and not cleaned(n.config.get(required[n.kind])):
            issues.append(Issue(codes[n.kind], n.id, f"{n.kind} needs {required[n.kind]}"))
    for e in graph.edges:
        issues += [Issue(f"missing_{end}_node", e.id, f"{key} does not exist") for end, key in (("from", e.source), ("to", e.target)) if not graph.node(key)]
    if kinds is RULE_NODES:
        if not any(n.kind == "OutputSubmodel" for n in graph.nodes):
            issues.append(Issue("missing_output_submodel", "", "no OutputSubmodel"))
        for n in graph.nodes:
            if n.kind == "OutputProperty" and _submodel(graph, n.id) is None:
                issues.append(Issue("unbound_output_property", n.id, "leads to no OutputSubmodel"))
    if not issues and len(graph.ordered()) < len(graph.nodes):
        issues.append(Issue("cycle_detected", min(n.id for n in graph.nodes if n.id not in graph.ordered()), "the graph has a cycle"))
    return issues


def _submodel(graph: Graph, key: str) -> Node | None:
    for e in sorted((e for e in graph.edges if e.source == key), key=lambda e: (e.order, e.id)):
        found = graph.node(e.target)
        if found is not None and found.kind == "OutputSubmodel":
            return found
    return None


# ---------------------------------------------------------------- node columns


def _map(value: Column, config: dict) -> Column:
    mapping = config.get("mapping", {})
    if not isinstance(mapping, dict) or not mapping:
        return value if not isinstance(mapping, dict) else F.lit(cleaned(config["default"])) if "default" in config else value
    result = F.lit(cleaned(config["default"])) if "default" in config else value
    folded: dict[str, str] = {}
    for k, v in mapping.items():
        folded.setdefault(cleaned(k).lower(), cleaned(v))
    loose = F.create_map(*[F.lit(x) for kv in folded.items() for x in kv])
    exact = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (str(k), cleaned(v))])
    return F.coalesce(F.try_element_at(exact, value), F.try_element_at(loose, F.lower(value)), result)


def _regex(value: Column, config: dict) -> Column:
    pattern = cleaned(config.get("pattern"))
    if not pattern:
        return F.lit("")
    java = ("(?i)" if config.get("ignore_case", True) else "") + python_pattern(pattern)
    group = int(config.get("group", 1) or 1)
    return F.when(value.rlike(java), clean_cell(F.regexp_extract(value, java, group))).otherwise(F.lit(cleaned(config.get("default"))))


def _condition(inputs: list[Column], config: dict, row_profile: bool) -> Column:
    subject = clean_cell(inputs[0]) if inputs else F.lit("")
    other = clean_cell(inputs[1]) if len(inputs) > 1 else F.lit(cleaned(config.get("compare_to")))
    operator = cleaned(config.get("operator", "equals")) or "equals"
    tests = {
        "equals": lambda: subject == other,
        "not_equals": lambda: subject != other,
        "contains": lambda: (other != "") & F.contains(subject, other),
        "regex": lambda: (other != "") & (F.regexp_like(subject, other) if len(inputs) > 1 else subject.rlike(python_pattern(cleaned(config.get("compare_to"))) or "(?!)")),
    }
    if not row_profile:
        tests["is_truthy"] = lambda: boolish(subject)
    holds = tests[operator]() if operator in tests else F.lit(False)
    yes = cleaned(config.get("true_value"))
    return F.when(holds, F.lit(yes) if yes or row_profile else subject).otherwise(F.lit(cleaned(config.get("false_value"))))


def _separator(config: dict) -> str:
    """Separators are cells too, so their outer spaces are lost; a blank one is the default."""
    return cleaned(config.get("separator", " | ")) or " | "


def _concat(inputs: list[Column], config: dict) -> Column:
    return F.concat_ws(_separator(config), *[or_null(clean_cell(i)) for i in inputs])


#: Suffix of the column that says whether a node's gate was passed.
_GATE = "__gate"


def _node_columns(node: Node, inputs: list[Column], row_profile: bool) -> tuple[Column, Column]:
    """Value of a node, and whether its gate was passed."""
    config, passed = node.config, F.lit(True)
    first = inputs[0] if inputs else F.lit("")
    if node.kind == "Constant" or node.kind in MARKERS:
        return F.lit(cleaned(config.get("value"))), passed
    if node.kind == "NormalizeIdentifier":
        return normalize_identifier(first), passed
    if node.kind == "RegexExtract":
        return _regex(clean_cell(first), config), passed
    if node.kind in ("MapEnum", "LookupMap"):
        return _map(clean_cell(first), config), passed
    if node.kind == "BoolMap":
        return F.when(boolish(first), cleaned(config.get("true_value", "true"))).otherwise(cleaned(config.get("false_value", "false"))), passed
    if node.kind == "Concat":
        return _concat(inputs, config), passed
    if node.kind == "PreferFirstNonEmpty":
        return F.coalesce(*[or_null(clean_cell(i)) for i in inputs], F.lit(cleaned(config.get("fallback")))), passed
    if node.kind == "Condition":
        return _condition(inputs, config, row_profile), passed
    if node.kind == "ConfidenceGate":
        stated = clean_cell(inputs[1]) if len(inputs) > 1 else F.lit(cleaned(config.get("confidence")))
        enough = F.coalesce(stated.try_cast("double"), F.lit(0.0)) >= float(config.get("min_confidence", 0.0) or 0.0)
        return F.when(enough, clean_cell(first)).otherwise(F.lit(cleaned(config.get("fallback")))), enough
    return first, passed  # outputs


# ---------------------------------------------------------------- rule sets


def _inputs(graph: Graph) -> dict[str, tuple[str, str, str]]:
    """Node id to (field, mode, separator) of every input column."""
    return {
        n.id: (cleaned(n.config.get("field")), cleaned(n.config.get("mode", "join")) or "join", _separator(n.config))
        for n in graph.nodes
        if n.kind == "InputColumn"
    }


def aggregate_inputs(rows: DataFrame, graph: Graph, identity: str, order: str) -> DataFrame:
    """identity and one column per input node.

    The fields are unpivoted and their repeats reduced per (identity, field, value) before the values of an identity
    meet, so an identity with very many rows costs its distinct values.
    """
    wanted = _inputs(graph)
    fields = sorted({f for f, _, _ in wanted.values() if f in rows.columns})
    keyed = rows.select(F.col(identity).alias("identity"), F.col(order).alias("o"), *[clean_cell(f).alias(f) for f in fields])
    cells = keyed.select("identity", "o", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("c")) if fields else None
    base = keyed.select("identity").distinct()
    if cells is not None:
        reduced = cells.groupBy("identity", "c.field", "c.value").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n"))
        filled = F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("o", "value"))))
        per_field = reduced.groupBy("identity", "field").agg(
            F.transform(filled, lambda x: x["value"]).alias("values"),
            F.sum(F.when(F.col("value") != "", F.col("n")).otherwise(0)).alias("present"),
            F.max(boolish("value")).alias("any"),
            F.min_by("value", "o").alias("first"),
        )
        columns = {}
        for key, (name, mode, separator) in wanted.items():
            value = {
                "first": F.col("first"),
                "first_non_empty": F.coalesce(F.get("values", F.lit(0)), F.lit("")),
                "count_present": F.col("present").cast("string"),
                "bool_any": F.col("any").cast("string"),
            }.get(mode, F.array_join("values", separator))
            columns[key] = F.max(F.when(F.col("field") == name, value))
        base = per_field.groupBy("identity").agg(*[c.alias(k) for k, c in columns.items()]) if columns else base
    empty = {"count_present": "0", "bool_any": "false"}
    return base.select("identity", *[(F.coalesce(F.col(f"`{k}`"), F.lit(empty.get(m, "") if f else "")) if f in fields else F.lit(empty.get(m, "") if f else "")).alias(k) for k, (f, m, _) in wanted.items()])


def evaluate(values: DataFrame, graph: Graph, row_profile: bool = False) -> DataFrame:
    """The input columns and a column for each further node, with its gate as ``<node>__gate``."""
    have = set(values.columns)
    for key in graph.ordered():
        node = graph.node(key)
        if key in have:
            values = values.withColumn(key + _GATE, F.lit(True))
            continue
        if node.kind == "BuildRow":
            continue
        inputs = [F.col(f"`{e.source}`") for e in graph.parents(key) if graph.node(e.source) and graph.node(e.source).kind != "BuildRow"]
        value, gate = _node_columns(node, inputs, row_profile)
        values = values.withColumns({key: value, key + _GATE: gate})
    return values


def _outputs(graph: Graph) -> dict[str, list[Node]]:
    """Submodel to its properties, in the order they are evaluated."""
    found: dict[str, list[Node]] = defaultdict(list)
    for key in graph.ordered():
        node = graph.node(key)
        if node.kind == "OutputProperty" and (model := _submodel(graph, key)) is not None:
            found[cleaned(model.config.get("id_short"))].append(node)
    return found


def _name(node: Node) -> str:
    return cleaned(node.config.get("property_name")) or node.label or node.id


def property_struct(name: Column | str, value: Column) -> Column:
    """A property of a nested document; truth values are typed as such."""
    text = clean_cell(value)
    return F.struct(
        F.lit("Property").alias("modelType"),
        (F.lit(name) if isinstance(name, str) else name).alias("idShort"),
        F.when(F.lower(text).isin("true", "false"), "xs:boolean").otherwise("xs:string").alias("valueType"),
        text.alias("value"),
    )


def shell_payload(source_type: str, identity: Column, submodels: list[tuple[str, Column]]) -> Column:
    """JSON of a nested document: a shell, its submodels (name, array of properties) and the references between them."""
    key = F.coalesce(or_null(normalize_identifier(identity)), F.lit("entry"))
    shell, asset = (F.concat(F.lit(f"urn:docweave:{kind}:{source_type}:"), key) for kind in ("aas", "asset"))
    ids = [F.concat(shell, F.lit(":"), normalize_identifier(F.lit(name))) for name, _ in submodels]
    models = [
        F.struct(F.lit("Submodel").alias("modelType"), i.alias("id"), F.lit(name).alias("idShort"), elements.alias("submodelElements"))
        for i, (name, elements) in zip(ids, submodels, strict=True)
    ]
    references = [
        F.struct(F.lit("ModelReference").alias("type"), F.array(F.struct(F.lit("Submodel").alias("type"), i.alias("value"))).alias("keys")) for i in ids
    ]
    head = F.struct(
        F.lit("AssetAdministrationShell").alias("modelType"),
        shell.alias("id"),
        F.translate(identity, ".-", "__").alias("idShort"),
        F.struct(F.lit("Instance").alias("assetKind"), asset.alias("globalAssetId")).alias("assetInformation"),
        F.array(*references).alias("submodels"),
    )
    return F.to_json(F.struct(F.lit(source_type).alias("source_type"), F.array(head).alias("assetAdministrationShells"), F.array(*models).alias("submodels")))


def with_identity(rows: DataFrame, fields: list[str], fallback: str) -> DataFrame:
    """Rows with ``identity``: the first filled of the identity fields, else the fallback."""
    return rows.withColumn("identity", F.coalesce(*[or_null(clean_cell(f)) for f in fields if f in rows.columns], F.lit(fallback)))


def run_rules(rows: DataFrame, payload: dict, order: str) -> DataFrame:
    """identity, payload (JSON) and gates (properties whose gate failed) of every identity.

    A graph with errors gives each identity a document without submodels, and the error codes in ``gates``.
    """
    graph = Graph.parse(payload)
    source = cleaned(graph.settings.get("source_type")) or "entry"
    keyed = with_identity(rows, list(graph.settings.get("identity_fields", [])), source)
    issues = validate(graph)
    if issues:
        codes = F.array(*[F.lit(i.code) for i in issues])
        return keyed.select("identity").distinct().select("identity", shell_payload(source, F.col("identity"), []).alias("payload"), codes.alias("gates"))
    done = evaluate(aggregate_inputs(keyed, graph, "identity", order), graph)
    models, failed = [], []
    for name, properties in _outputs(graph).items():
        models.append((name, F.array(*[property_struct(_name(p), F.col(f"`{p.id}`")) for p in properties])))
        for p in properties:
            gates = [~F.col(f"`{k}{_GATE}`") for k in graph.ancestors(p.id) if graph.node(k).kind == "ConfidenceGate"]
            for g in gates:
                failed.append(F.when(g, F.lit(f"{name}.{_name(p)}")))
    gates = F.array_distinct(F.array_compact(F.array(*failed))) if failed else F.array().cast("array<string>")
    return done.select("identity", shell_payload(source, F.col("identity"), models).alias("payload"), gates.alias("gates"))


def rule_values(rows: DataFrame, payload: dict, order: str) -> DataFrame:
    """identity and a column per output property (``submodel.property``): the flat form of ``run_rules``."""
    graph = Graph.parse(payload)
    keyed = with_identity(rows, list(graph.settings.get("identity_fields", [])), cleaned(graph.settings.get("source_type")) or "entry")
    done = evaluate(aggregate_inputs(keyed, graph, "identity", order), graph)
    return done.select("identity", *[clean_cell(f"`{p.id}`").alias(f"{m}.{_name(p)}") for m, ps in _outputs(graph).items() for p in ps])


def trace(payload: dict, property_id: str) -> list[tuple[str, str]]:
    """The nodes a property depends on, with their kinds."""
    graph = Graph.parse(payload)
    return [(k, graph.node(k).kind) for k in graph.ancestors(property_id)]


# ---------------------------------------------------------------- row profiles


def run_profile(rows: DataFrame, payload: dict) -> DataFrame:
    """A new row for each row: the fields of the profile's row builder, from the nodes bound to its ports.

    Several builders are not united: the first, by id, is the profile's.  A field without a node is empty.
    """
    graph = Graph.parse(payload)
    issues = validate(graph, ROW_NODES + MARKERS)
    if issues:
        raise ValueError(f"invalid profile: {[i.code for i in issues]}")
    builders = sorted((n for n in graph.nodes if n.kind == "BuildRow"), key=lambda n: n.id)
    if not builders:
        raise ValueError("a profile needs a BuildRow node")
    cells = {n.id: cleaned(n.config.get("field")) for n in graph.nodes if n.kind == "CellValue"}
    values = rows.select("*", *[(clean_cell(f) if f in rows.columns else F.lit("")).alias(k) for k, f in cells.items()])
    done = evaluate(values, graph, row_profile=True)
    bound = {e.port: e.source for e in graph.parents(builders[0].id)}
    names = builders[0].config.get("field_names", list(bound))
    return done.select(*[(F.col(f"`{bound[n]}`") if n in bound else F.lit("")).alias(n) for n in names])


def match_profile(profile: dict, sheets: dict[str, list[str]]) -> float:
    """How well a profile's signature fits a workbook: sheet name, required and optional headers, fingerprint."""
    signature = profile.get("signature", {})
    fold = lambda x: "".join(ch for ch in cleaned(x).lower() if ch.isalnum())
    names = {fold(s) for s in sheets}
    have = {fold(h) for headers in sheets.values() for h in headers}
    score, wanted = 0.0, [fold(s) for s in signature.get("sheet_names", [])]
    if wanted:
        score += 0.5 if any(w in names for w in wanted) else -0.2
    share = lambda key: [fold(h) in have for h in signature.get(key, [])]
    needed, optional = share("required_headers"), share("optional_headers")
    score += 0.4 * sum(needed) / len(needed) if needed else 0.15
    score += 0.1 * sum(optional) / len(optional) if optional else 0.0
    if signature.get("fingerprint") and fold(signature["fingerprint"]) == fold("|".join(sorted(have))):
        score += 0.1
    return round(min(1.0, max(0.0, score)), 4)


def resolve_profile(profiles: list[dict], sheets: dict[str, list[str]], wanted: str = "") -> tuple[dict | None, float]:
    """The requested profile, else the one that fits best, the first among equals."""
    for p in profiles:
        if wanted and p.get("id") == wanted:
            return p, match_profile(p, sheets)
    best, score = None, 0.0
    for p in profiles:
        if (found := match_profile(p, sheets)) > score:
            best, score = p, found
    return best, score
