"""Building models as STEP text: entities by regular expression, relations by joins on entity numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import normalize_identifier

#: Entity classes that are components, and names of drawing helpers.
COMPONENTS = "IFC(PIPE|VALVE|ACTUATOR|PUMP|TANK|FLOWFITTING)[A-Z]*|IFC[A-Z]*(PIPE|VALVE|ACTUATOR|PUMP|TANK|FITTING)[A-Z]*|IFCBUILDINGELEMENTPROXY"
HELPERS = r"\A(Assembly|Joints?|Link|Fixed|GroundedJoint|LCS|(Origin|[XYZ]-axis|X[YZ]-plane|YZ-plane).*)\z"
RELATIONS = ("IFCRELCONNECTS", "IFCRELCONNECTSELEMENTS", "IFCRELCONNECTSPORTTOELEMENT", "IFCRELCONNECTSPORTS", "IFCRELFLOWCONTROLELEMENTS", "IFCRELASSIGNSTOPRODUCT")
_ENTITY = r"(?s)\A\s*#(\d+)\s*=\s*(\w+)\s*\((.*)\)\s*\z"


def step_entities(lines: DataFrame) -> DataFrame:
    """path, number, class_name, body of every ``#n= CLASS(...);`` in ``lines`` (path, value: whole or partial texts).

    A statement ends at a semicolon; statements that span lines need whole texts as ``value``.
    """
    statements = lines.select("path", F.explode(F.split("value", r";\s*(?:\r?\n|\z)")).alias("s")).where(F.col("s").rlike(_ENTITY))
    return statements.select(
        "path", F.regexp_extract("s", _ENTITY, 1).cast("bigint").alias("number"), F.upper(F.regexp_extract("s", _ENTITY, 2)).alias("class_name"),
        F.regexp_extract("s", _ENTITY, 3).alias("body"),
    )


def arguments(body: Column | str) -> Column:
    """Top-level arguments of an entity; commas in texts and brackets do not part them (three levels of brackets)."""
    inner = r"\((?:[^()']|'(?:[^']|'')*'|\((?:[^()']|'(?:[^']|'')*'|\([^()]*\))*\))*\)"
    return F.transform(F.regexp_extract_all(body, F.lit(rf"((?:'(?:[^']|'')*'|{inner}|[^,()'])+)(?:,|\z)"), F.lit(1)), lambda a: F.trim(a))


def text_argument(argument: Column) -> Column:
    """A quoted argument without quotes; empty for ``$`` and others."""
    return F.when(argument.rlike(r"(?s)\A'.*'\z"), F.replace(F.substring(argument, 2, F.length(argument) - 2), F.lit("''"), F.lit("'"))).otherwise("")


def step_nodes(entities: DataFrame) -> DataFrame:
    """path, node_id (GlobalId), number, class_name, name, tag, object_type, match_keys, flange_complete of components.

    The first entity of a GlobalId counts; drawing helpers are left out.
    """
    parts = entities.where(F.col("class_name").rlike(f"\\A({COMPONENTS})\\z")).withColumn("a", arguments("body"))
    get = lambda i: text_argument(F.coalesce(F.get("a", F.lit(i)), F.lit("")))
    named = parts.select("path", "number", "class_name", get(0).alias("node_id"), get(2).alias("name"), get(4).alias("object_type"), get(7).alias("tag"))
    kept = named.where((F.col("class_name") != "IFCBUILDINGELEMENTPROXY") | ~F.col("name").rlike(HELPERS))
    first = kept.where("node_id <> ''").groupBy("path", "node_id").agg(F.min(F.struct("number", "class_name", "name", "object_type", "tag")).alias("n"))
    keys = F.array_distinct(F.filter(F.transform(F.array("tag", "name", "object_type", "node_id"), normalize_identifier), lambda x: x != ""))
    flange = F.when(F.contains("class_name", F.lit("FLANGE")), True)
    return first.select("path", "node_id", "n.*").withColumns({"match_keys": keys, "flange_complete": flange})


def step_edges(entities: DataFrame) -> DataFrame:
    """path, from_id, to_id, relation of entities that a relation joins: its first two references, the first of a list."""
    ids = entities.select("path", "number", text_argument(F.coalesce(F.get(arguments("body"), F.lit(0)), F.lit(""))).alias("gid")).where("gid <> ''")
    relations = entities.where(F.col("class_name").isin(*RELATIONS)).withColumn("a", F.slice(arguments("body"), 5, 10))
    refs = F.filter(F.transform("a", lambda x: F.regexp_extract(x, r"\A\(?\s*#(\d+)", 1)), lambda x: x != "")
    ends = relations.select("path", F.col("number").alias("relation_no"), F.col("class_name").alias("relation"), refs.alias("r")).where("size(r) >= 2")
    pairs = ends.select("path", "relation_no", "relation", F.get("r", F.lit(0)).cast("bigint").alias("m"), F.get("r", F.lit(1)).cast("bigint").alias("n"))
    left = ids.select("path", F.col("number").alias("m"), F.col("gid").alias("from_id"))
    right = ids.select("path", F.col("number").alias("n"), F.col("gid").alias("to_id"))
    return pairs.join(left, ["path", "m"]).join(right, ["path", "n"]).select("path", "relation_no", "relation", "from_id", "to_id")


def global_ids(lines: DataFrame) -> DataFrame:
    """path, class_name, global_id, name of every entity that begins with a 22-character id."""
    pattern = r"=\s*(IFC\w+)\s*\(\s*'([0-9A-Za-z_$]{22})'\s*,[^,]*,\s*(?:'((?:[^']|'')*)'|\$)"
    found = lines.select("path", F.explode(F.split("value", r";\s*(?:\r?\n|\z)")).alias("s")).where(F.col("s").rlike(pattern))
    return found.select("path", F.regexp_extract("s", pattern, 1).alias("class_name"), F.regexp_extract("s", pattern, 2).alias("global_id"), F.regexp_extract("s", pattern, 3).alias("name"))


def read_step(spark: SparkSession, pattern: str) -> DataFrame:
    """path, value (whole text) of STEP files."""
    return spark.read.option("wholetext", "true").text(pattern).select(F.input_file_name().alias("path"), "value")
