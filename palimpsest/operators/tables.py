"""Tables that rules draw on pages: which groups of rules are grids, what their cells span, and the words in each cell.

Rules of a group give the grid's coordinates; each stretch of a rule that covers a cell's edge is a separator, and where
one is missing a cell spans columns or rows. What decides whether a group is a grid at all is how much of an inner line
its rules cover together: islands of overlapping stretches, by a window over the rules on that line. Groups, lines, edges,
cells and words are relations joined by their page and group; only the spans of one table, of at most 40 by 400 cells, are
worked out in a loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import written
from .engine import once
from .geometry import THICK, _cell, _cells, _whole, clustered, grouped

#: Coordinates that merge; rules that count to a line of the grid in the cover test; and how short of an edge a rule may end.
MERGE, NEAR, SHORT = 3.0, 3.5, 2.0
#: Least width and height of a table; share of a page above which a group is a frame; most columns and rows.
LEAST_WIDTH, LEAST_HEIGHT, FRAME, MOST_COLUMNS, MOST_ROWS = 30.0, 12.0, 0.86, 40, 400
#: Share of a table's width and height that rules on some inner line must cover.
COVER_ROW, COVER_COLUMN = 0.5, 0.4
#: How far beside its last rule a table may go on, and how near its words stand to an edge to be aligned with it.
BESIDE, PAD = 60.0, 6.0
GROUP = ["id", "page", "root"]


def spans(columns: int, rows: int, upright: set[tuple[int, int]], level: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """``(row, column, rowspan, colspan)`` of a grid's cells in order: ``upright`` has (line, row) of the edges between columns
    that are drawn, ``level`` (line, column) of those between rows."""
    free = [[True] * columns for _ in range(rows)]
    out = []
    for r in range(rows):
        for c in range(columns):
            if not free[r][c]:
                continue
            wide = next((k for k in range(1, columns - c) if (c + k, r) in upright or not free[r][c + k]), columns - c)
            own = range(c, c + wide)
            high = next((k for k in range(1, rows - r) if any((r + k, x) in level or not free[r + k][x] for x in own)), rows - r)
            for y in range(r, r + high):
                free[y][c : c + wide] = [False] * wide
            out.append((r, c, high, wide))
    return out


def _spans(columns: pa.Array, rows: pa.Array, upright: pa.Array, level: pa.Array) -> pa.Array:
    def edges(found: pa.Array) -> Iterator[set[tuple[int, int]]]:
        ends, drawn = found.offsets.to_pylist(), list(zip(*[found.values.field(k).to_pylist() for k in ("line", "at")]))
        return (set(drawn[a:b]) if known else set() for a, b, known in zip(ends, ends[1:], found.is_valid().to_pylist()))

    made: list[tuple[int, int, int, int]] = []
    ends = [0]
    for n, m, v, h in zip(columns.to_pylist(), rows.to_pylist(), edges(upright), edges(level)):
        made += spans(n, m, v, h)
        ends.append(len(made))
    parts = [pa.array([cell[k] for cell in made], pa.int32()) for k in range(4)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["row", "col", "rowspan", "colspan"]))


def covered(lines: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """For each value of ``by`` the length that its intervals cover together, as ``cover``: each adds what goes beyond all before."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    more = F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start)))
    return lines.withColumn("more", F.greatest(F.lit(0.0), more)).groupBy(*by).agg(F.sum("more").alias("cover"))


def grids(rules: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of ``rules`` ``(id, page, rule, vertical, x, y, w, h, thickness)`` that are grids: ``(id, page, root, xs, ys, x0, x1,
    y0, y1)``; and their rules ``(id, page, root, vertical, pos, start, end)``.

    ``pages`` has ``(id, page, width, height)``; a group on a page that is not there is no grid.
    """
    thin = rules.filter((F.col("thickness") <= THICK) & _whole("x", "y", "w", "h")).repartition("id", "page").dropDuplicates(["id", "page", "rule"])
    upright = F.col("vertical")
    placed = written(
        grouped(thin).select(
            *GROUP, "vertical", F.when(upright, F.col("x") + F.col("w") / 2).otherwise(F.col("y") + F.col("h") / 2).alias("pos"),
            F.when(upright, F.col("y")).otherwise(F.col("x")).alias("start"), F.when(upright, F.col("y") + F.col("h")).otherwise(F.col("x") + F.col("w")).alias("end"),
            "x", "y", (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("bottom"),
        )
    )
    number = lambda up: F.count_if(upright == up)
    large = placed.groupBy(*GROUP).agg(number(True).alias("v"), number(False).alias("h"), F.min("x").alias("x0"), F.max("right").alias("x1"), F.min("y").alias("y0"), F.max("bottom").alias("y1"))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    large = large.join(pages.select("id", "page", "width", "height"), ["id", "page"]).filter(
        (F.col("v") >= 2) & (F.col("h") >= 2) & (wide >= LEAST_WIDTH) & (high >= LEAST_HEIGHT) & ~((wide > FRAME * F.col("width")) & (high > FRAME * F.col("height")))
    )
    own = placed.select(*GROUP, "vertical", "pos", "start", "end").join(large.select(*GROUP, "x0", "x1", "y0", "y1"), GROUP)
    at = lambda up: clustered(F.collect_list(F.when(upright == up, F.col("pos"))), MERGE)
    shape = own.groupBy(*GROUP).agg(at(True).alias("xs"), at(False).alias("ys"), *[F.first(c).alias(c) for c in ("x0", "x1", "y0", "y1")])
    shape = written(shape.filter((F.size("xs") >= 3) & (F.size("ys") >= 3)))
    lines = written(own.drop("x0", "x1", "y0", "y1").join(shape.select(*GROUP, "xs", "ys"), GROUP))
    inner = F.when(upright, F.col("xs")).otherwise(F.col("ys"))
    inner = F.slice(inner, 2, F.size(inner) - 2)
    near = lines.withColumn("line", F.explode(F.filter(inner, lambda p: F.abs(F.col("pos") - p) <= NEAR))).filter("end > start")
    extent = F.when(upright, F.element_at("ys", -1) - F.get("ys", F.lit(0))).otherwise(F.element_at("xs", -1) - F.get("xs", F.lit(0)))
    share = F.when(upright, COVER_COLUMN).otherwise(COVER_ROW)
    most = covered(near, [*GROUP, "vertical", "line"]).groupBy(*GROUP, "vertical").agg(F.max("cover").alias("cover"))
    enough = most.join(shape, GROUP).filter(F.col("cover") >= share * F.greatest(F.lit(1.0), extent)).groupBy(*GROUP).agg(F.count_distinct("vertical").alias("both")).filter("both = 2")
    return written(shape.join(enough.select(*GROUP), GROUP)), lines.select(*GROUP, "vertical", "pos", "start", "end")


def _near_boxes(words: DataFrame, shape: DataFrame, beside: float) -> DataFrame:
    """Words joined with the grids in whose bounds, ``beside`` points wider, their centre stands."""
    named = words.filter(_whole("x", "y", "w", "h")).withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    named = named.withColumns({"gx": _cell(F.col("cx")), "gy": _cell(F.col("cy"))})
    placed = shape.withColumn("gx", F.explode(_cells(F.col("x0") - beside, F.col("x1") + beside))).withColumn("gy", F.explode(_cells(F.col("y0"), F.col("y1"))))
    return named.join(placed, ["id", "page", "gx", "gy"]).filter(F.col("cx").between(F.col("x0") - beside, F.col("x1") + beside) & F.col("cy").between(F.col("y0"), F.col("y1"))).drop("gx", "gy")


def _edges(lines: DataFrame, shape: DataFrame, vertical: bool) -> DataFrame:
    """``(id, page, root, edges)``: (line, at) of each edge of the grid that one rule on its line covers."""
    along, across = ("ys", "xs") if vertical else ("xs", "ys")
    own = lines.filter(F.col("vertical") == vertical).join(shape.select(*GROUP, "xs", "ys"), GROUP)
    # What is drawn at all across the lines: cells beyond it are not held open by it.
    ruled = lines.filter(F.col("vertical") == vertical).groupBy(*GROUP).agg(F.min("start").alias("low"), F.max("end").alias("high"))
    own = own.join(ruled, GROUP)
    line = F.filter(F.sequence(F.lit(0), F.size(across) - 1), lambda k: F.abs(F.col("pos") - F.get(across, k)) <= MERGE)

    def covers(k: Column) -> Column:
        low = F.greatest(F.get(along, k), F.col("low"))
        return (F.col("start") <= low + SHORT) & (F.col("end") >= F.greatest(F.least(F.get(along, k + 1), F.col("high")), low) - SHORT)

    held = F.filter(F.sequence(F.lit(0), F.size(along) - 2), covers)
    drawn = own.withColumn("line", F.explode(line)).withColumn("at", F.explode(held)).select(*GROUP, "line", "at").distinct()
    return drawn.groupBy(*GROUP).agg(F.collect_list(F.struct("line", "at")).alias("edges"))


def cells(rules: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """``(id, page, root, row, col, rowspan, colspan, header, align, text)``: the cells of all tables that rules draw.

    ``words`` has ``(id, page, word, x, y, w, h, size, bold, text)``. A table open to the right goes on to its last word. A
    cell's text has its lines as lines; words within half their size of the one above share a line. A word whose centre
    lies on a rule counts to the cell right of or below it, at the table's end to the last one. The first row is a header
    if all its words are bold or there are three rows; empty rows at the end are left out, and so are tables without a word.
    """
    shape, lines = grids(rules, pages)
    end = F.element_at("xs", -1)
    beyond = _near_boxes(words, shape.select(*GROUP, "x0", "x1", "y0", "y1"), BESIDE).groupBy(*GROUP).agg(F.max(F.col("x") + F.col("w")).alias("text_end"))
    shape = shape.join(beyond, GROUP, "left").withColumn("xs", F.when(F.col("text_end") > end + SHORT, F.concat("xs", F.array(F.col("text_end") + SHORT))).otherwise(F.col("xs")))
    shape = shape.withColumns({"columns": F.size("xs") - 1, "rows": F.size("ys") - 1}).filter((F.col("columns") <= MOST_COLUMNS) & (F.col("rows") <= MOST_ROWS))
    shape = written(shape.withColumns({"x0": F.get("xs", F.lit(0)), "x1": F.element_at("xs", -1), "y0": F.get("ys", F.lit(0)), "y1": F.element_at("ys", -1)}))
    upright, level = (_edges(lines, shape, v).withColumnRenamed("edges", n) for v, n in ((True, "upright"), (False, "level")))
    solved = shape.join(upright, GROUP, "left").join(level, GROUP, "left").select(*GROUP, "xs", "ys", "rows", F.inline(once(F.arrow_udf(_spans, "array<struct<row:int,col:int,rowspan:int,colspan:int>>"))("columns", "rows", "upright", "level")))
    cell = written(solved.select(*GROUP, "row", "col", "rowspan", "colspan", "rows", F.get("xs", "col").alias("left"), F.get("xs", F.col("col") + F.col("colspan")).alias("right")))
    places = cell.withColumn("r", F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1))).withColumn("c", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)))
    index = lambda at, v, n: F.least(F.col(n) - 1, F.size(F.filter(at, lambda p: p <= F.col(v))) - 1)
    inside = _near_boxes(words, shape.select(*GROUP, "xs", "ys", "columns", "rows", "x0", "x1", "y0", "y1"), 0.0)
    inside = inside.withColumns({"c": index("xs", "cx", "columns"), "r": index("ys", "cy", "rows")}).select(*GROUP, "word", "x", "w", "cy", "size", "bold", "text", "r", "c")
    met = inside.join(places.select(*GROUP, "r", "c", "row", "col"), [*GROUP, "r", "c"])
    one = [*GROUP, "row", "col"]
    down = Window.partitionBy(*one).orderBy("cy", "x", "word")
    met = met.withColumn("line", F.sum(F.coalesce(F.col("cy") - F.lag("cy").over(down) > F.col("size") / 2, F.lit(True)).cast("int")).over(down))
    said = met.groupBy(*one, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word", "text"))), lambda w: w["text"]), " ").alias("text"), F.min("x").alias("low"), F.max(F.col("x") + F.col("w")).alias("high"), F.bool_and("bold").alias("bold")
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda w: w["text"]), "\n")
    said = said.groupBy(*one).agg(text.alias("text"), F.min_by("low", "line").alias("low"), F.min_by("high", "line").alias("high"), F.bool_and("bold").alias("bold"))
    whole = cell.join(said, one, "left")
    off_left, off_right = F.abs(F.col("low") - F.col("left")), F.abs(F.col("right") - F.col("high"))
    off_middle = F.abs((F.col("low") + F.col("high")) / 2 - (F.col("left") + F.col("right")) / 2)
    align = F.when((off_right <= PAD) & (off_left > PAD + off_middle), "right").when((off_middle <= PAD) & (off_left > PAD) & (off_right > PAD), "center").otherwise("left")
    table = Window.partitionBy(*GROUP)
    full = F.col("text").isNotNull()
    head = F.bool_and(F.col("bold")).over(Window.partitionBy(*GROUP, "row"))
    named = whole.withColumns({"align": align, "last": F.max(F.when(full, F.col("row"))).over(table), "header": (F.col("row") == 0) & ((F.col("rows") >= 3) | (full & F.coalesce(head, F.lit(False))))})
    return named.filter(F.col("row") <= F.col("last")).select(*one, "rowspan", "colspan", "header", "align", F.coalesce("text", F.lit("")).alias("text"))


def stitched(parts: DataFrame) -> DataFrame:
    """``cells`` with ``table`` ``(page, root)`` and ``line``: a table that opens a page like the one before it on the page before
    closes it (as many columns, the same header row) goes on with it, and its header counts once.

    Tables of a document are compared by their headers, a row a table; cells stay where they are until they are renumbered.
    """
    key = F.struct("page", "root")
    header = F.array_sort(F.collect_list(F.when((F.col("row") == 0) & F.col("header"), F.struct("col", F.lower(F.trim("text")).alias("text")))))
    tables = parts.groupBy(*GROUP).agg(F.max(F.col("col") + F.col("colspan")).alias("columns"), header.alias("head"), (F.max("row") + 1).alias("lines"))
    order = Window.partitionBy("id").orderBy("page", "root")
    before = lambda c: F.lag(c).over(order)
    goes_on = (F.size("head") > 0) & (before("page") == F.col("page") - 1) & (before("columns") == F.col("columns")) & before("head").eqNullSafe(F.col("head"))
    tables = tables.withColumn("new", ~F.coalesce(goes_on, F.lit(False))).withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    run = Window.partitionBy("id", "run").orderBy("page", "root")
    up = F.sum(F.col("lines") - F.when(F.col("new"), 0).otherwise(1)).over(run.rowsBetween(Window.unboundedPreceding, -1))
    tables = tables.withColumns({"table": F.first(key).over(run), "above": F.coalesce(up, F.lit(0)) - F.when(F.col("new"), 0).otherwise(1)})
    met = parts.join(tables.select(*GROUP, "new", "table", "above"), GROUP).filter(F.col("new") | ~((F.col("row") == 0) & F.col("header")))
    return met.withColumn("line", (F.col("row") + F.col("above")).cast("int")).drop("new", "above")
