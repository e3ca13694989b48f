"""Circuit drawings from text spans and lines: grid, objects, pins, wires; and poses of placed parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.designations import closest_wire
from docweave.functions.values import box_centre
from docweave.operators.ordered import first_per_key

PAGE = ["document", "page"]


def grid(spans: DataFrame) -> DataFrame:
    """document, page, axis, label, at: letters near the upper and lower edge, digits near the left and right one.

    ``spans``: document, page, span_id, text, box, size.
    """
    c = spans.withColumn("c", box_centre(F.col("box")))
    column = F.col("text").rlike(r"\A[A-F]\z") & ((F.col("c.y") < 60) | (F.col("c.y") > 520))
    row = F.col("text").rlike(r"\A\d\z") & ((F.col("c.x") < 90) | (F.col("c.x") > 810))
    axis = F.when(column, "column").when(row, "row")
    marked = c.withColumn("axis", axis).where("axis is not null")
    return marked.groupBy(*PAGE, "axis", F.col("text").alias("label")).agg(F.avg(F.when(F.col("axis") == "column", F.col("c.x")).otherwise(F.col("c.y"))).alias("at"))


def grid_positions(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """document, page, span_id, column, row: the nearest letter and digit of the grid, the smaller among equals; blank without."""
    c = spans.select(*PAGE, "span_id", box_centre(F.col("box")).alias("c"))
    found = c.select(*PAGE, "span_id")
    for axis, part in (("column", "x"), ("row", "y")):
        marks = lines.where(F.col("axis") == axis).select(*PAGE, "label", "at")
        near = c.join(marks, PAGE).withColumn("d", F.abs(F.col("at") - F.col(f"c.{part}")))
        best = first_per_key(near.select(*PAGE, "span_id", "d", "label"), [*PAGE, "span_id"], ["d", "label"]).select(*PAGE, "span_id", F.col("label").alias(axis))
        found = found.join(best, [*PAGE, "span_id"], "left")
    return found.na.fill({"column": "", "row": ""})


def pins(spans: DataFrame, objects: DataFrame) -> DataFrame:
    """document, page, object_id, y, pin, address, potential of small text rows below an object, within 100 of its centre.

    ``objects``: document, page, object_id, x, y.  In a row the first number is the pin, the first address-like text the
    address, the first short other text the potential; rows without a number are no pins.
    """
    small = spans.where((F.col("size") > 3) & (F.col("size") < 5)).select(*PAGE, "text", F.col("box")[0].alias("x0"), F.bround(F.col("box")[1]).cast("int").alias("y"), box_centre(F.col("box")).alias("c"))
    placed = small.join(objects.select(*PAGE, "object_id", F.col("x").alias("ox"), F.col("y").alias("oy")), PAGE)
    near = placed.where((F.abs(F.col("c.x") - F.col("ox")) < 100) & (F.col("c.y") > F.col("oy")))
    address = F.col("text").rlike(r"\A[A-Z]\d+\.\d+|\A%\w+|\A[A-Z]{2,}\d*\z") & (F.col("text") != "VW")
    number = F.col("text").rlike(r"\A\d+\z")
    first = lambda test: F.min(F.when(test, F.struct("x0", "text")))["text"]
    rows = near.groupBy(*PAGE, "object_id", "y").agg(
        first(number).alias("pin"), first(address).alias("address"), first(~number & ~address & (F.col("text") != "VW") & (F.col("text").rlike(r"\A[A-Z][+-]|\AL\d") | (F.length("text") <= 4))).alias("potential")
    )
    return rows.where("pin is not null").na.fill({"address": "", "potential": ""})


def wires(lines: DataFrame, objects: DataFrame, reach: float = 120.0) -> DataFrame:
    """document, page, from_object, to_object, colour: the objects at the lower and upper end of the lines of one colour.

    ``lines``: document, page, red, green, blue, x0, y0, x1, y1.  ``objects``: document, page, object_id, ord, box.  Black
    and unknown colours are no wires.  An end is a point that occurs once; without two of them the outermost points count.
    An object is met if its box, widened by 20, holds the point or is nearer than ``reach``; equal ends are left out.
    """
    colour = closest_wire(F.col("red"), F.col("green"), F.col("blue"))
    black = (F.col("red") < 0.01) & (F.col("green") < 0.01) & (F.col("blue") < 0.01)
    named = lines.where(~black).withColumn("colour", colour).where("colour is not null")
    keys = [*PAGE, "red", "green", "blue", "colour"]
    ends = named.select(*keys, F.explode(F.array(*[F.struct(F.bround(f"y{i}", 1).alias("y"), F.bround(f"x{i}", 1).alias("x")) for i in (0, 1)])).alias("p"))
    counted = ends.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"))
    single = F.when(F.col("n") == 1, F.col("p"))
    outer = counted.groupBy(*keys).agg(F.count(single).alias("free"), F.min(single).alias("s0"), F.max(single).alias("s1"), F.min("p").alias("a0"), F.max("p").alias("a1"))
    ends = outer.select(*keys, F.when(F.col("free") >= 2, F.col("s0")).otherwise(F.col("a0")).alias("top"), F.when(F.col("free") >= 2, F.col("s1")).otherwise(F.col("a1")).alias("bottom"))

    def met(end: str, name: str) -> DataFrame:
        b = [F.col("box")[0] - 20, F.col("box")[1] - 20, F.col("box")[2] + 20, F.col("box")[3] + 20]
        x, y = F.col(f"{end}.x"), F.col(f"{end}.y")
        gap = F.hypot(F.greatest(b[0] - x, F.lit(0.0), x - b[2]), F.greatest(b[1] - y, F.lit(0.0), y - b[3]))
        near = ends.join(objects, PAGE).withColumn("gap", gap).where(F.col("gap") < reach)
        return first_per_key(near.select(*keys, "gap", "ord", "object_id"), keys, ["gap", "ord"]).select(*keys, F.col("object_id").alias(name))

    both = met("bottom", "from_object").join(met("top", "to_object"), keys).where("from_object <> to_object")
    return both.select(*PAGE, "from_object", "to_object", "colour").distinct()


def is_diagram(documents: DataFrame, nodes: int = 3, tokens: int = 5) -> DataFrame:
    """Documents with ``is_diagram``: of a drawing kind, or with enough nodes or designations.

    ``documents``: document, kind, n_nodes, n_tokens.
    """
    drawing = F.col("kind").isin("STROMLAUFPLAN", "RI_FLOWSHEET")
    return documents.withColumn("is_diagram", drawing | (F.coalesce("n_nodes", F.lit(0)) >= nodes) | (F.coalesce("n_tokens", F.lit(0)) >= tokens))


# ---------------------------------------------------------------- placements



def joint(a: Column, b: Column) -> Column:
    """Kind of joint between two parts."""
    has = lambda t: (a == t) | (b == t)
    kind = F.when(has("tank"), "flange").when(has("elbow") & has("pipeline"), "weld_or_threaded").when(has("blackbox"), "flange_or_threaded")
    return kind.when((a == "elbow") & (b == "elbow"), "direct_fitting").when((a == "pipeline") & (b == "pipeline"), "weld_or_coupling").otherwise("unknown")


def rotate(w: Column, x: Column, y: Column, z: Column, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A vector turned by a quaternion."""
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return v[0] + w * tx + (y * tz - z * ty), v[1] + w * ty + (z * tx - x * tz), v[2] + w * tz + (x * ty - y * tx)


def quaternion(axis: tuple[Column, Column, Column], reference: tuple[Column, Column, Column]) -> Column:
    """struct(w, x, y, z) of a placement given by its axis and reference direction, made orthogonal; w is not negative.

    A placement without a direction gives no turn.
    """
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    unit = lambda v: tuple(F.when(norm(v) > 0, c / norm(v)) for c in v)
    z = unit(axis)
    dot = sum((a * b for a, b in zip(reference, z, strict=True)), F.lit(0.0))
    x = unit(tuple(a - dot * b for a, b in zip(reference, z, strict=True)))
    y = (z[1] * x[2] - z[2] * x[1], z[2] * x[0] - z[0] * x[2], z[0] * x[1] - z[1] * x[0])
    root = lambda *s: F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) + sum(s[1:], s[0]))) / 2
    w = root(x[0], y[1], z[2])
    signed = lambda value, by: F.when(by < 0, -value).otherwise(value)
    parts = (w, signed(root(x[0], -y[1], -z[2]), y[2] - z[1]), signed(root(-x[0], y[1], -z[2]), z[0] - x[2]), signed(root(-x[0], -y[1], z[2]), x[1] - y[0]))
    flat = (F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    known = x[0].isNotNull() & z[0].isNotNull()
    return F.struct(*[F.when(known, p).otherwise(f).alias(n) for n, p, f in zip("wxyz", parts, flat, strict=True)])


def torsion(links: DataFrame) -> DataFrame:
    """Links with ``torsion``: degrees between a part's forward direction (fx, fy, fz) and the way to the next (dx, dy, dz)."""
    length = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    dot = F.abs(F.col("fx") * F.col("dx") + F.col("fy") * F.col("dy") + F.col("fz") * F.col("dz")) / length
    return links.withColumn("torsion", F.when(length > 0, F.degrees(F.acos(F.least(F.lit(1.0), dot)))).otherwise(90.0))
