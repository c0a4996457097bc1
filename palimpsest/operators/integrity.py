"""What a converted document must keep to, checked over relations: every violation is a row, a clean corpus has none.

Blocks have ``(id, ord, kind, chars, asset, page, x, y, w, h)``: reading order, characters of text, the picture of a figure and the
place they came from (page null: nowhere); pages ``(id, page, width, height)``; assets ``(id, asset, bytes)``; columns ``(id, ord,
column, width)`` and cells ``(id, ord, row, col, rowspan, colspan)`` of the blocks that are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks that may be without text; how far in points a place may leave its page.
TEXTLESS, SLACK = ("figure", "divider", "vector"), 1.0


def _rule(rows: DataFrame, rule: str, detail: str) -> DataFrame:
    return rows.select("id", F.col("ord").cast("long").alias("ord"), F.lit(rule).alias("rule"), F.col(detail).cast("string").alias("detail"))


def empty(blocks: DataFrame) -> DataFrame:
    """Blocks without text that should have some."""
    return blocks.filter((F.coalesce(F.col("chars"), F.lit(0)) <= 0) & ~F.coalesce(F.col("kind").isin(*TEXTLESS), F.lit(False)))


def orphans(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Figures whose picture is not there; a null picture is never there."""
    return blocks.filter("kind = 'figure'").join(assets.select("id", "asset").distinct(), ["id", "asset"], "left_anti").select(blocks.columns)


def normalized(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Blocks but for empty ones and figures without their picture, numbered anew from 0 in each document."""
    gone = empty(blocks).select("id", "ord").union(orphans(blocks, assets).select("id", "ord")).distinct()
    order = Window.partitionBy("id").orderBy("ord")
    return blocks.join(gone, ["id", "ord"], "left_anti").withColumn("ord", (F.row_number().over(order) - 1).cast("long")).select(blocks.columns)


def violations(blocks: DataFrame, pages: DataFrame, assets: DataFrame, columns: DataFrame, cells: DataFrame) -> DataFrame:
    """``(id, ord, rule, detail)``: each breach once for each block, column or cell that is in it.

    Rules: ``empty`` (detail: the kind), ``missing asset`` and ``empty asset`` (the asset; a block's number for the first only),
    ``unknown page`` (the page; documents without any page have none to be outside of), ``off page`` (the page), ``page order``
    (the page, which is less than one before it), ``zero width`` (the column), ``zero span`` (row and column).
    """
    placed = blocks.filter("page is not null")
    known = pages.select("id", "page", "width", "height").dropDuplicates(["id", "page"])
    recorded = known.select("id").distinct()
    unknown = placed.join(recorded, "id", "left_semi").join(known, ["id", "page"], "left_anti")
    out = (F.col("x") < -SLACK) | (F.col("y") < -SLACK) | (F.col("x") + F.col("w") > F.col("width") + SLACK) | (F.col("y") + F.col("h") > F.col("height") + SLACK)
    off = placed.join(known, ["id", "page"]).filter(out)
    # The greatest page so far: a running maximum, so a stray block far ahead puts all behind it out of order.
    so_far = F.max("page").over(Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    disorder = placed.withColumn("before", so_far).filter(F.col("page") < F.col("before"))
    tables = blocks.filter("kind = 'table'").select("id", "ord").distinct()
    narrow = columns.join(tables, ["id", "ord"], "left_semi").filter(F.col("width") <= 0)
    flat = cells.join(tables, ["id", "ord"], "left_semi").filter((F.col("rowspan") <= 0) | (F.col("colspan") <= 0)).withColumn("cell", F.concat_ws(",", "row", "col"))
    hollow = assets.filter(F.coalesce(F.col("bytes"), F.lit(0)) <= 0).withColumn("ord", F.lit(None).cast("long"))
    found = [
        _rule(empty(blocks), "empty", "kind"), _rule(orphans(blocks, assets), "missing asset", "asset"), _rule(unknown, "unknown page", "page"), _rule(off, "off page", "page"),
        _rule(disorder, "page order", "page"), _rule(narrow, "zero width", "column"), _rule(flat, "zero span", "cell"), _rule(hollow, "empty asset", "asset"),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def merged_lists(items: DataFrame) -> DataFrame:
    """Rows ``(id, ord, kind, ordered, list)`` with ``merged``: lists that follow one another with nothing between, of one kind
    (``ordered``), are one and have the number of the first of them; other blocks have none."""
    order = Window.partitionBy("id").orderBy("ord")
    before = lambda c: F.lag(c).over(order)
    goes_on = (F.col("kind") == "item") & (before("kind") == "item") & before("ordered").eqNullSafe(F.col("ordered"))
    run = F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(order)
    whole = Window.partitionBy("id", "run").orderBy("ord")
    return items.withColumn("run", run).withColumn("merged", F.when(F.col("kind") == "item", F.first("list").over(whole))).drop("run")
