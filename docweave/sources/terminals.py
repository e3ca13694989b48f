"""Terminal lists from sheet cells: layout, sections, repeated values, designators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import clean_cell
from docweave.functions.values import terminal_designator

#: Words of a header row, and what a column holds by its header.
HEADER_WORDS = "plt-stelle|funktion|beschreibung|klemmleiste|klemme|betriebsmittel"
ROLES = (
    ("terminal", r"(?i)klemm"), ("place", r"(?i)plt|tag|akz"), ("function", r"(?i)funktion"), ("description", r"(?i)beschreibung"),
    ("bridge", r"(?i)br(ü|ue)cke"), ("device", r"(?i)ger(ä|ae)t|betriebsmittel"), ("access", r"(?i)zugang|schrank|verschaltung|modul|sps"),
)
_DITTO = r"""\A(?:"{1,2}|'{1,2}|" "|" " "|" " " ")\z"""


def is_ditto(column: str):
    """Marks that repeat the value above."""
    return clean_cell(column).rlike(_DITTO)


def layer_label(text: str):
    """A heading without what precedes its first dash; ``Allgemein`` if blank."""
    label = clean_cell(text)
    return F.when(label == "", "Allgemein").when(label.rlike(r"\s-\s+\S"), F.regexp_replace(label, r"\A.*?\s+-\s+", "")).otherwise(label)


def object_type(reference: str, label: str):
    """What a strip is, by its designation and the header of its access column."""
    ref, text = F.upper(F.coalesce(F.col(reference), F.lit(""))), F.lower(F.coalesce(F.col(label), F.lit("")))
    return (
        F.when(text.rlike("sps|modul"), "SPS-Modul").when(ref.startswith("-K"), "Relais").when(ref.startswith("-F"), "Sicherung")
        .when(F.contains(text, F.lit("sicherung")), "Sicherung").when(F.contains(text, F.lit("relais")), "Relais").otherwise("Klemmenleiste")
    )


def terminal_rows(cells: DataFrame) -> DataFrame:
    """document, sheet, row, layer, object_ref, object_type, terminal, attribute, attribute_value and the column roles.

    ``cells``: document, sheet, row, col, value.  The header is the first of the first ten rows with a header word;
    sheets without a terminal column have no rows.  A row whose only cell is a longer text in the first column starts a
    section; repeat marks take the last value above within it.
    """
    filled = cells.select("document", "sheet", "row", "col", clean_cell("value").alias("value")).where("value <> ''")
    sheet = ["document", "sheet"]
    heads = filled.where((F.col("row") <= 10) & F.lower("value").rlike(HEADER_WORDS)).groupBy(*sheet).agg(F.min("row").alias("header_row"))
    named = filled.join(heads, sheet).where("row = header_row")
    role = F.lit(None).cast("string")
    for name, pattern in reversed(ROLES):
        role = F.when(F.col("value").rlike(pattern), name).otherwise(role)
    roles = named.withColumn("role", role).where("role is not null").groupBy(*sheet, "role").agg(F.min(F.struct("col", "value")).alias("h"))
    layout = roles.select(*sheet, "role", F.col("h.col").alias("col"), F.col("h.value").alias("header"))
    strip = layout.where("role = 'terminal'").select(
        *sheet, F.regexp_extract("header", r"(?i)klemmleiste\s*([A-Za-z][A-Za-z0-9._\-]*)", 1).alias("suffix")
    )
    ref = F.when(F.col("suffix") != "", F.concat(F.lit("-"), F.upper(F.substring("suffix", 1, 1)), F.substring("suffix", 2, 200))).otherwise("")
    strips = strip.select(*sheet, ref.alias("object_ref"))
    access = layout.where("role = 'access'").select(*sheet, F.col("header").alias("access_label"))
    body = filled.join(heads, sheet).where("row > header_row")
    # rows that only hold a heading
    shape = body.groupBy(*sheet, "row").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("col", "value")).alias("c"))
    section = (F.col("n") == 1) & (F.col("c.col") == 1) & F.length("c.value").between(8, 120) & ~F.substring(F.col("c.value"), 1, 3).rlike(r"\d")
    lines = shape.select(*sheet, "row", F.when(section, F.col("c.value")).alias("heading"))
    values = body.join(layout.select(*sheet, "role", "col"), [*sheet, "col"]).groupBy(*sheet, "row").agg(
        *[F.max(F.when(F.col("role") == name, F.col("value"))).alias(name) for name, _ in ROLES]
    )
    down = Window.partitionBy(*sheet).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.join(values, [*sheet, "row"], "left").withColumn("heading", F.last("heading", ignorenulls=True).over(down))
    within = Window.partitionBy(*sheet, "heading").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    carried = {
        name: F.when(is_ditto(name), F.last(F.when(~is_ditto(name), F.col(name)), ignorenulls=True).over(within)).otherwise(F.col(name))
        for name, _ in ROLES
        if name != "terminal"
    }
    full = placed.withColumns(carried).withColumn("t", terminal_designator("terminal")).where("terminal is not null and t.name is not null")
    joined = full.join(strips, sheet).join(access, sheet, "left")
    blank = {name: F.coalesce(F.col(name), F.lit("")) for name, _ in ROLES}
    return joined.withColumns(blank).select(
        *sheet, "row", layer_label("heading").alias("layer"), "object_ref", object_type("object_ref", "access_label").alias("object_type"),
        F.col("t.name").alias("terminal"), F.col("t.attribute").alias("attribute"), F.col("t.value").alias("attribute_value"),
        "place", "function", "description", "access", "bridge", "device",
    )
