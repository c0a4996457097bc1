"""Queries of page geometry, and their SQL counterparts, over pages laid out from line items.

Every line item stands for a rectangle whose place and size follow from its keys, on the page of its supplier and line
number; the SQL side lays the same pages out by the same arithmetic and compares all rows of a page.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, integrity, tables

_ITEMS = """
SELECT DISTINCT l_suppkey AS id, CAST(l_linenumber AS INT) AS page, l_orderkey AS o, l_partkey AS p,
  ((l_partkey * 1000000000 + l_orderkey) * 1000 + l_suppkey) * 10 + l_linenumber AS n
FROM lineitem
"""
#: The same items for Spark: of two items of a page, which is a supplier's, ``m`` tells the same as ``n``, equality and order, but
#: stays within 64 bits up to nine billion parts, ``n`` only up to 922,337. Items are dealt by page, which all that follows keeps.
_LAID_ITEMS = """
SELECT *, p * 1000000000 + o AS m FROM (
  SELECT DISTINCT * FROM (SELECT /*+ REPARTITION(id, page) */ * FROM (SELECT l_suppkey AS id, CAST(l_linenumber AS INT) AS page, l_orderkey AS o, l_partkey AS p FROM {lineitem}))
)
"""
_BLOCKS = """
SELECT id, page, n AS block, CASE WHEN p % 10 = 0 THEN 'table' ELSE 'paragraph' END AS kind, CAST(p * 7 % 560 AS DOUBLE) AS x,
  CAST(o * 11 % 740 AS DOUBLE) AS y, CAST(10 + o % 90 AS DOUBLE) AS w, CAST(8 + p % 23 AS DOUBLE) AS h FROM items
"""
_FILLS = """
SELECT id, page, n AS fill, CAST(o * 13 % 500 AS DOUBLE) AS x, CAST(p * 17 % 640 AS DOUBLE) AS y, CAST(40 + p % 200 AS DOUBLE) AS w,
  CAST(30 + o % 150 AS DOUBLE) AS h, CAST(o % 260 AS DOUBLE) AS luminance, p % 4 = 0 AS stroked FROM items
"""
_LINES = """
SELECT id, page, n AS line, CAST(o * 11 % 560 AS DOUBLE) AS x, CAST(p * 7 % 740 AS DOUBLE) AS y, CAST(20 + p % 150 AS DOUBLE) AS w, CAST(9 AS DOUBLE) AS h,
  concat(CASE o % 5 WHEN 0 THEN ' Figure ' WHEN 1 THEN 'TABLE ' WHEN 2 THEN 'source: ' WHEN 3 THEN 'figment ' ELSE 'see figure ' END, CAST(p AS STRING)) AS text FROM items
"""
_FIGURES = """
SELECT id, page, n AS figure, CAST(p * 3 % 400 AS DOUBLE) AS x, CAST(o * 5 % 600 AS DOUBLE) AS y, CAST(60 + o % 220 AS DOUBLE) AS w, CAST(30 + p % 90 AS DOUBLE) AS h FROM items
"""
_RULES = """
SELECT id, page, n AS rule, CAST(o * 11 % 600 AS DOUBLE) AS x, CAST(p * 7 % 780 AS DOUBLE) AS y, CAST(CASE WHEN p % 2 = 0 THEN 0.5 ELSE 5 + o % 55 END AS DOUBLE) AS w,
  CAST(CASE WHEN p % 2 = 0 THEN 5 + o % 55 ELSE 0.5 END AS DOUBLE) AS h, CAST(o % 8 AS DOUBLE) AS thickness FROM items
"""


def _laid_out(spark: SparkSession, sf_dir: str, *made: str) -> list[DataFrame]:
    """Relations over the pages of line items, numbered by ``m``; ``_named`` gives results the numbers of the SQL."""
    items = spark.sql(_LAID_ITEMS, lineitem=spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet"))
    by_m = lambda sql: re.sub(r"\bn\b", "m", sql.replace("ORDER BY n", "ORDER BY m, page").replace("FROM items", "FROM {items}"))
    return [spark.sql(by_m(sql), items=items) for sql in made]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with the number of their items, repeated ones included."""
    lineitem = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return lineitem.groupBy(F.col("l_suppkey").alias("id"), F.col("l_linenumber").cast("int").alias("page")).agg(F.count(F.lit(1)).alias("rows"))


def _named(number: str) -> Column:
    """``n`` for ``m``, the number of the item in SQL. One of more than 64 bits, at which the SQL ends with an error, keeps its
    low 64 bits, which still differ among the items of a page."""
    n = f"(CAST({number} AS DECIMAL(20, 0)) * 1000 + id) * 10 + page"
    return F.expr(f"CAST(pmod({n} + 9223372036854775808, 18446744073709551616) - 9223372036854775808 AS BIGINT)").alias(number)


def _sql(body: str, **made: str) -> str:
    """``body`` with the pages of line items laid out by DuckDB."""
    parts = {"items": _ITEMS, **made}
    return ("WITH RECURSIVE " if "RECURSIVE" in body else "WITH ") + ", ".join(f"{k} AS ({v})" for k, v in parts.items()).replace("AS STRING", "AS VARCHAR") + body.replace("RECURSIVE", "")


def _boxes(spark: SparkSession, sf_dir: str, smallest: bool) -> DataFrame:
    blocks, fills = _laid_out(spark, sf_dir, _BLOCKS, _FILLS)
    pages = _pages(spark, sf_dir).select("*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return geometry.callouts(blocks, fills, pages, smallest).select("id", "page", _named("block"), _named("box"))


def _boxes_sql(smallest: bool) -> str:
    rank = "f.w * f.h, f.fill" if smallest else "f.fill"
    return _sql(
        f"""
, held AS (
  SELECT b.block, f.fill, row_number() OVER (PARTITION BY b.block ORDER BY {rank}) AS nth
  FROM blocks b JOIN fills f ON b.id = f.id AND b.page = f.page
  WHERE b.kind <> 'table' AND f.w * f.h >= 1200 AND f.w * f.h < 0.85 * 612 * 792 AND (f.luminance <= 245 OR f.stroked)
    AND least(b.x + b.w, f.x + f.w) > greatest(b.x, f.x) AND least(b.y + b.h, f.y + f.h) > greatest(b.y, f.y)
    AND (least(b.x + b.w, f.x + f.w) - greatest(b.x, f.x)) * (least(b.y + b.h, f.y + f.h) - greatest(b.y, f.y)) >= 0.6 * b.w * b.h
)
SELECT b.id, b.page, b.block, h.fill AS box FROM blocks b LEFT JOIN held h ON h.block = b.block AND h.nth = 1
""",
        blocks=_BLOCKS,
        fills=_FILLS,
    )


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.captions(*_laid_out(spark, sf_dir, _LINES, _FIGURES), pages=_pages(spark, sf_dir)).select("id", "page", _named("figure"), _named("line"), "distance")


_PAIRS = """
, pairs AS (
  SELECT f.id, f.page, f.figure, l.line, l.y - (f.y + f.h) AS distance
  FROM figures f JOIN lines l ON l.id = f.id AND l.page = f.page
  WHERE regexp_matches(lower(l.text), '^\\s*(figure|fig\\.|table|chart|exhibit|source:)') AND l.y - (f.y + f.h) >= -2 AND l.y - (f.y + f.h) < 48
    AND greatest(0, least(l.x + l.w, f.x + f.w) - greatest(l.x, f.x)) >= 0.5 * l.w
)""".replace("\\\\", "\\")
#: Figures one after the other, page by page: each takes its nearest line that no figure before it has taken.
_CAPTIONS = (
    _PAIRS
    + """
, turns AS (
  SELECT id, page, figure, dense_rank() OVER (PARTITION BY id, page ORDER BY figure) AS turn, list({'d': distance, 'l': line} ORDER BY distance, line) AS choices FROM pairs GROUP BY id, page, figure
), RECURSIVE taken AS (
  SELECT id, page, 0::BIGINT AS turn, []::BIGINT[] AS used, NULL::BIGINT AS figure, NULL::BIGINT AS line, NULL::DOUBLE AS distance FROM turns GROUP BY id, page
  UNION ALL
  SELECT id, page, turn, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.l) END, figure, pick.l, pick.d
  FROM (SELECT t.id, t.page, s.turn, t.used, s.figure, list_filter(s.choices, lambda c: NOT list_contains(t.used, c.l))[1] AS pick FROM taken t JOIN turns s ON s.id = t.id AND s.page = t.page AND s.turn = t.turn + 1)
)
SELECT id, page, figure, line, distance FROM taken WHERE line IS NOT NULL
"""
)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.rule_groups(*_laid_out(spark, sf_dir, _RULES)).select("id", "page", _named("rule"), _named("root"))


_GROUPS = """
, links AS (
  SELECT a.id, a.page, a.rule AS a, b.rule AS b FROM rules a JOIN rules b ON a.id = b.id AND a.page = b.page AND a.rule <> b.rule
  WHERE a.thickness <= 6 AND b.thickness <= 6 AND a.x - 3 <= b.x + b.w + 3 AND b.x - 3 <= a.x + a.w + 3 AND a.y - 3 <= b.y + b.h + 3 AND b.y - 3 <= a.y + a.h + 3
), RECURSIVE reached AS (
  SELECT id, page, rule, rule AS root FROM rules WHERE thickness <= 6
  UNION
  SELECT r.id, r.page, l.b, r.root FROM reached r JOIN links l ON l.id = r.id AND l.page = r.page AND l.a = r.rule
)
SELECT id, page, rule, min(root) AS root FROM reached GROUP BY id, page, rule
"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    (blocks,) = _laid_out(spark, sf_dir, _BLOCKS)
    made = blocks.groupBy("id", "page").agg(geometry.clustered(F.collect_list("x"), 3.0).alias("xs"))
    return made.select("id", "page", F.posexplode("xs").alias("k", "x")).select("id", "page", F.col("k").cast("long").alias("k"), "x")


_CLUSTERS = """
, folded AS (
  SELECT id, page, list_reduce(list_transform(list(x ORDER BY x), lambda v: [v]),
    lambda a, v: CASE WHEN v[1] - a[len(a)] <= 3 THEN list_concat(a[1:len(a) - 1], [(a[len(a)] + v[1]) / 2]) ELSE list_concat(a, v) END) AS xs
  FROM blocks GROUP BY id, page
)
SELECT id, page, generate_subscripts(xs, 1) - 1 AS k, unnest(xs) AS x FROM folded
"""


def _covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    (blocks,) = _laid_out(spark, sf_dir, _BLOCKS)
    ends = blocks.select("id", "page", F.col("y").alias("start"), (F.col("y") + F.col("h")).alias("end"))
    return tables.covered(ends, ["id", "page"])


#: Every whole point of a page's height that some block covers, counted once.
_COVERS = """
SELECT id, page, count(DISTINCT point)::DOUBLE AS cover FROM (SELECT id, page, unnest(range(y::BIGINT, (y + h)::BIGINT)) AS point FROM blocks) GROUP BY id, page
"""

#: Orders as tables: a header, a row a line item by its number, four columns; a price below 20,000 and the flag behind it share
#: a cell. Line items of one number are one row, the least of them.
_ORDER_LINES = """
SELECT o, row_number() OVER (PARTITION BY o ORDER BY n) AS k, p, s, wide FROM (
  SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_partkey) % 3 = 0 AS wide FROM lineitem GROUP BY l_orderkey, l_linenumber
)
"""


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_ORDER_LINES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet"))
    lines = lines.select(F.col("o").alias("id"), F.lit(0).alias("page"), "k", "p", "s", "wide")
    head = lines.select("id", "page").distinct().select("id", "page", F.lit(0).alias("k"), F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("s"), F.lit(False).alias("wide"))
    rows = head.union(lines)
    top, foot = F.lit(100.0) + F.col("k") * 20, F.lit(120.0) + F.col("k") * 20
    upright = rows.withColumn("at", F.explode(F.when(F.col("wide"), F.array(*map(F.lit, (0, 1, 2, 4)))).otherwise(F.array(*map(F.lit, range(5))))))
    upright = upright.select("id", "page", (F.col("k") * 100 + F.col("at")).alias("rule"), F.lit(True).alias("vertical"), (50.0 + F.col("at") * 100 - 0.25).alias("x"), top.alias("y"), F.lit(0.5).alias("w"), F.lit(20.0).alias("h"))
    level = rows.select("id", "page", (F.col("k") * 100 + 50).alias("rule"), F.lit(False).alias("vertical"), F.lit(50.0).alias("x"), (foot - 0.25).alias("y"), F.lit(400.0).alias("w"), F.lit(0.5).alias("h"))
    first = head.select("id", "page", F.lit(60).cast("long").alias("rule"), F.lit(False), F.lit(50.0), F.lit(99.75), F.lit(400.0), F.lit(0.5))
    rules = upright.union(level).union(first).withColumn("thickness", F.lit(0.5))
    said = F.when(F.col("k") == 0, F.array(*map(F.lit, ("Part", "Supplier", "Sum", "Difference")))).otherwise(
        F.array(F.col("p").cast("string"), F.col("s").cast("string"), (F.col("p") + F.col("s")).cast("string"), F.when(~F.col("wide"), (F.col("p") - F.col("s")).cast("string")))
    )
    words = rows.select("id", "page", "k", F.posexplode(said).alias("at", "text")).filter("text is not null").select(
        "id", "page", (F.col("k") * 10 + F.col("at")).alias("word"), (60.0 + F.col("at") * 100).alias("x"), (106.0 + F.col("k") * 20).alias("y"), F.lit(40.0).alias("w"), F.lit(8.0).alias("h"), F.lit(8.0).alias("size"), (F.col("k") == 0).alias("bold"), "text"
    )
    pages = head.select("id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return tables.cells(rules, words, pages).select("id", "row", "col", "rowspan", "colspan", "header", "text")


_ORDER_TABLES = f"""
WITH lines AS ({_ORDER_LINES}), cells AS (
  SELECT DISTINCT o AS id, 0 AS row, unnest([0, 1, 2, 3]) AS col, 1 AS colspan, unnest(['Part', 'Supplier', 'Sum', 'Difference']) AS text FROM lines
  UNION ALL SELECT o, k, 0, 1, p::VARCHAR FROM lines
  UNION ALL SELECT o, k, 1, 1, s::VARCHAR FROM lines
  UNION ALL SELECT o, k, 2, CASE WHEN wide THEN 2 ELSE 1 END, (p + s)::VARCHAR FROM lines
  UNION ALL SELECT o, k, 3, 1, (p - s)::VARCHAR FROM lines WHERE NOT wide
)
SELECT id, row, col, 1 AS rowspan, colspan, row = 0 AS header, text FROM cells
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "page_boxes": lambda spark, sf_dir: _boxes(spark, sf_dir, False),
    "page_smallest_boxes": lambda spark, sf_dir: _boxes(spark, sf_dir, True),
    "page_captions": _captions,
    "rule_groups": _groups,
    "coordinate_clusters": _clusters,
    "interval_cover": _covers,
    "order_tables": _order_tables,
}

ORACLES: dict[str, str] = {
    "page_boxes": _boxes_sql(False),
    "page_smallest_boxes": _boxes_sql(True),
    "page_captions": _sql(_CAPTIONS, lines=_LINES, figures=_FIGURES),
    "rule_groups": _sql(_GROUPS, rules=_RULES),
    "coordinate_clusters": _sql(_CLUSTERS, blocks=_BLOCKS),
    "interval_cover": _sql(_COVERS, blocks=_BLOCKS),
    "order_tables": _ORDER_TABLES,
}

#: Line items of a supplier in order as the blocks of a document of eight pages, with what goes wrong in one place or another.
_DOCUMENT_BLOCKS = """
SELECT id, ord, kind, CAST(CASE WHEN o % 13 = 0 THEN 0 ELSE 1 + o % 50 END AS INT) AS chars, CASE WHEN kind = 'figure' THEN p * 3 % 60 END AS asset,
  CASE WHEN o % 97 = 0 THEN 0 WHEN o % 89 <> 0 THEN CAST(ord // 80 AS INT) END AS page, CAST(p * 7 % 600 - 5 AS DOUBLE) AS x, CAST(o * 11 % 780 AS DOUBLE) AS y, CAST(1 + o % 30 AS DOUBLE) AS w, CAST(1 + p % 20 AS DOUBLE) AS h, o, p
FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS ord, o, p, CASE p % 7 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'divider' ELSE 'paragraph' END AS kind FROM items)
"""
_ASSETS = "SELECT id, p % 41 AS asset, min(o % 9) AS bytes FROM items GROUP BY id, p % 41"


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, assets = _laid_out(spark, sf_dir, _DOCUMENT_BLOCKS.replace("ord // 80", "ord div 80"), _ASSETS)
    pages = blocks.select("id").distinct().select("id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    columns = blocks.select("id", "ord", F.lit(0).alias("column"), (F.col("p") % 12).cast("double").alias("width"))
    cells = blocks.select("id", "ord", F.lit(0).alias("row"), F.lit(0).alias("col"), (F.col("o") % 15).alias("rowspan"), (F.col("p") % 16).alias("colspan"))
    return integrity.violations(blocks.drop("o", "p"), pages, assets, columns, cells)


_VIOLATIONS = """
, so_far AS (
  SELECT *, max(page) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM blocks WHERE page IS NOT NULL
)
SELECT id, ord, 'empty' AS rule, kind AS detail FROM blocks WHERE chars = 0 AND kind NOT IN ('figure', 'divider', 'vector')
UNION ALL SELECT id, ord, 'missing asset', asset::VARCHAR FROM blocks b WHERE kind = 'figure' AND NOT EXISTS (SELECT 1 FROM assets a WHERE a.id = b.id AND a.asset = b.asset)
UNION ALL SELECT id, ord, 'unknown page', page::VARCHAR FROM blocks WHERE page > 5
UNION ALL SELECT id, ord, 'off page', page::VARCHAR FROM blocks WHERE page <= 5 AND (x < -1 OR y < -1 OR x + w > 613 OR y + h > 793)
UNION ALL SELECT id, ord, 'page order', page::VARCHAR FROM so_far WHERE page < before
UNION ALL SELECT id, ord, 'zero width', '0' FROM blocks WHERE kind = 'table' AND p % 12 = 0
UNION ALL SELECT id, ord, 'zero span', '0,0' FROM blocks WHERE kind = 'table' AND (o % 15 = 0 OR p % 16 = 0)
UNION ALL SELECT id, NULL, 'empty asset', asset::VARCHAR FROM assets WHERE bytes = 0
"""

QUERIES["document_violations"] = _violations
ORACLES["document_violations"] = _sql(_VIOLATIONS, blocks=_DOCUMENT_BLOCKS, assets=_ASSETS)
