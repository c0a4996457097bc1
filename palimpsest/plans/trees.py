"""The tree of nested blocks of documents as a query, with recursive SQL beside it.

Every sentence of a document becomes a line of Markdown; its number and the document's decide whether it is quoted, an item,
indented or preceded by nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree

_MARKDOWN = """
SELECT id, line, concat(
  CASE WHEN m % 29 < 7 THEN repeat('> ', CAST(1 + m % 3 AS INT)) ELSE '' END, repeat('  ', CAST(m % 4 AS INT)),
  CASE WHEN m % 5 < 3 THEN '- ' WHEN m % 5 = 3 THEN '2) ' ELSE '' END, CASE WHEN m % 11 = 0 THEN '' ELSE trim(piece) END) AS text
FROM (SELECT id, line, piece, id * 31 + line * 17 + line * line * 7 AS m FROM pieces)
"""


def _block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    pieces = docs.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", r"[.\n]", -1)).alias("line", "piece")).withColumn("line", F.col("line").cast("long"))
    return tree.subtrees(tree.nodes(spark.sql(_MARKDOWN.replace("FROM pieces", "FROM {pieces}"), pieces=pieces)))


_BLOCK_TREE = rf"""
WITH RECURSIVE pieces AS (
  SELECT doc_id AS id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS line FROM (SELECT doc_id, regexp_split_to_array(text, '[.\n]') AS p FROM documents WHERE text IS NOT NULL)
), lines AS ({_MARKDOWN}), quoted AS (
  SELECT id, line, regexp_extract(text, '{tree.QUOTE}') AS prefix, text FROM lines
), deep AS (
  SELECT id, line, length(prefix) - length(replace(prefix, '>', '')) AS quotes, CASE WHEN prefix LIKE '%>%' THEN substr(text, length(prefix) + 1) ELSE text END AS text FROM quoted
), cut AS (
  SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line) AS stretch
  FROM (SELECT *, coalesce(lag(quotes) OVER (PARTITION BY id ORDER BY line) <> quotes, true) AS new FROM deep)
), seen AS (
  SELECT *, trim(replace(text, chr(9), ' ')) = '' AS blank, regexp_matches(text, '{tree.ITEM}') AS item FROM cut
), begun AS (
  SELECT *, NOT blank AND (item OR coalesce(lag(blank) OVER (PARTITION BY id, stretch ORDER BY line), true)) AS starts FROM seen
), owned AS (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY id, stretch ORDER BY line) AS own FROM begun WHERE NOT blank
), texts AS (
  SELECT id, stretch, min(line) AS line, arg_min(item, line) AS item, least(8, length(regexp_extract(replace(arg_min(text, line), chr(9), '    '), '^ *')) // 2) AS indent, sum(length(trim(text))) AS chars, max(quotes) AS quotes
  FROM owned GROUP BY id, stretch, own
), holders AS (
  SELECT i.id, i.line, max(j.line) AS holder FROM texts i JOIN texts j ON i.id = j.id AND i.stretch = j.stretch AND j.item AND j.line < i.line AND j.indent < i.indent
  WHERE NOT EXISTS (SELECT 1 FROM texts m WHERE m.id = i.id AND m.stretch = i.stretch AND m.line > j.line AND m.line < i.line AND m.indent <= j.indent) GROUP BY i.id, i.line
), levels AS (
  SELECT id, line, d, line - row_number() OVER (PARTITION BY id, d ORDER BY line) AS run FROM deep, range(1, 9) AS s(d) WHERE d <= quotes
), islands AS (
  SELECT id, d, run, min(line) AS line, max(line) AS till FROM levels GROUP BY id, d, run
), filled AS (
  SELECT i.* FROM islands i WHERE EXISTS (SELECT 1 FROM texts t WHERE t.id = i.id AND t.line BETWEEN i.line AND i.till AND t.quotes >= i.d)
), nodes AS (
  SELECT id, line, 0 AS rank, d, 'quote' AS kind, 0 AS chars FROM filled UNION ALL SELECT id, line, 1, quotes + 1, CASE WHEN item THEN 'item' ELSE 'paragraph' END, chars FROM texts
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY line, rank, d) - 1 AS node FROM nodes
), parents AS (
  SELECT n.id, n.node, coalesce(i.node, q.node) AS parent FROM numbered n
  LEFT JOIN holders h ON n.rank = 1 AND h.id = n.id AND h.line = n.line LEFT JOIN numbered i ON i.id = h.id AND i.line = h.holder AND i.rank = 1
  LEFT JOIN islands s ON s.id = n.id AND s.d = n.d - 1 AND n.line BETWEEN s.line AND s.till LEFT JOIN numbered q ON q.id = s.id AND q.line = s.line AND q.d = s.d AND q.rank = 0
), above AS (
  SELECT id, node, parent AS up FROM parents WHERE parent IS NOT NULL
  UNION ALL SELECT a.id, a.node, p.parent FROM above a JOIN parents p ON p.id = a.id AND p.node = a.up WHERE p.parent IS NOT NULL
), depths AS (
  SELECT id, node, count(*) AS depth FROM above GROUP BY id, node
), below AS (
  SELECT a.id, a.up AS node, count(*) AS n, sum(x.chars) AS chars FROM above a JOIN numbered x ON x.id = a.id AND x.node = a.node GROUP BY a.id, a.up
)
SELECT n.id, n.node, n.kind, n.line, n.node + coalesce(b.n, 0) AS last, p.parent, coalesce(d.depth, 0) AS depth, n.chars::BIGINT AS chars, 1 + coalesce(b.n, 0) AS size, (n.chars + coalesce(b.chars, 0))::BIGINT AS total
FROM numbered n JOIN parents p ON p.id = n.id AND p.node = n.node LEFT JOIN depths d ON d.id = n.id AND d.node = n.node LEFT JOIN below b ON b.id = n.id AND b.node = n.node
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"block_tree": _block_tree}
ORACLES: dict[str, str] = {"block_tree": _BLOCK_TREE}
