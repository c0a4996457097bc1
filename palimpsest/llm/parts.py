"""Parts and laws of the operators' results that SQL can state, as queries beside the operators' own.

Places and spans of fixed patterns (licence phrases, base kinds of personal data) are compared row by row; of shards and
mixes, which SQL cannot choose, the laws that any right choice keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, pii, sharding
from .common import ALNUM_WORD, read_table

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def licence_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places and labels of the fixed phrases in every document."""
    return licenses.query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _places(phrase: str) -> str:
    words = phrase.split()
    same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(1, greatest(len(w) - {len(words) - 2}, 1)), lambda i: {same})"


_LABELS = sorted({label for _, label in licenses.PHRASES})
LICENCE_PHRASES = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{ALNUM_WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, {', '.join(f'{_places(text)} AS p{k}' for k, (text, _) in enumerate(licenses.PHRASES))} FROM d),
a AS (SELECT *, {' || '.join(f'p{k}' for k in range(len(licenses.PHRASES)))} AS every FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) - 1 AS BIGINT) AS first_word,
  CAST(list_max(every) - 1 AS BIGINT) AS last_word, concat_ws(',', {', '.join(
      f"CASE WHEN {' + '.join(f'len(p{k})' for k, (_, own) in enumerate(licenses.PHRASES) if own == label)} > 0 THEN '{label}' END" for label in _LABELS)}) AS base_labels FROM a"""


def private_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digest of the base spans of every document."""
    found = pii.based(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *pii.base_columns())


#: The contract's patterns and, of each match ``m``, the test that it must pass.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (
    f"length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN substr(reverse({_DIGITS}), k, 1)::INT "
    f"WHEN substr(reverse({_DIGITS}), k, 1)::INT > 4 THEN 2 * substr(reverse({_DIGITS}), k, 1)::INT - 9 ELSE 2 * substr(reverse({_DIGITS}), k, 1)::INT END)) % 10 = 0"
)
_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS INT), 256) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
}


def _spans_sql(kind: str, pattern: str, test: str) -> str:
    """Matches with their places: texts between matches and matches alternate."""
    return f"""m_{kind} AS (SELECT doc_id, i, hits[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d))),
k_{kind} AS (SELECT doc_id, count(*) AS n, string_agg('{kind}:' || s || ':' || (s + length(m)), ',' ORDER BY s) AS names FROM m_{kind} WHERE {test} GROUP BY doc_id)"""


PRIVATE_BASE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(_spans_sql(k, *x) for k, x in _SQL_KINDS.items())}
SELECT doc_id, {', '.join(f'CAST(coalesce(k_{k}.n, 0) AS BIGINT) AS n_{k}' for k in _SQL_KINDS)}, sha256(concat_ws(',', {', '.join(f'k_{k}.names' for k in _SQL_KINDS)})) AS base_sha256
FROM d {' '.join(f'LEFT JOIN k_{k} USING (doc_id)' for k in _SQL_KINDS)}"""


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the shards: rows and bytes in all, how many there are, whether slots have gaps, whether bytes are near equal."""
    per = sharding.query(spark, sf_dir).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.min("slot").alias("first"), F.max("slot").alias("last"),
        F.sum("slot").alias("slots"),
    )
    whole = per.agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("shards"),
        F.bool_and((F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n") * (F.col("n") - 1) / 2)).alias("gapless"),
        F.max("bytes").alias("most"), F.min("bytes").alias("least"), F.max("largest").alias("largest"),
    )
    share = F.col("bytes") / sharding.SHARDS
    slack = F.col("largest") + 2 * sharding.SLACK * share
    return whole.select("n", "bytes", "shards", "gapless", ((F.col("most") <= share + slack) & (F.col("least") >= share - slack)).alias("even"))


SHARD_LAWS = f"""SELECT count(*) AS n, CAST(sum(coalesce(strlen(text), 0) + 8) AS BIGINT) AS bytes, CAST({sharding.SHARDS} AS BIGINT) AS shards,
  true AS gapless, true AS even FROM documents"""


def mix_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mix by source: documents, words, target, whether no document is taken too often and the target is met to
    within the largest document."""
    docs = mixing.query(spark, sf_dir).join(_sources(spark, sf_dir), "doc_id")
    per = docs.groupBy("source", "source_size", "target").agg(
        F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.max("size").alias("largest"), F.bool_and(F.col("taken") <= 2 * F.col("size")).alias("within")
    )
    near = F.abs(F.col("taken") - F.col("target")) <= F.col("largest")
    return per.select("source", "n", "source_size", F.round("target", 3).alias("target"), "within", near.alias("near"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "source")


#: Resharing by rounds: in each, sources above twice their size get that and leave; what is left goes by weight to the rest.
MIX_LAWS = """WITH RECURSIVE s AS (SELECT source, count(*) AS n, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
r(source, size, weight, quota, remaining, k) AS (SELECT source, size, weight, CAST(NULL AS DOUBLE), 1.5 * (SELECT sum(size) FROM w), 0 FROM w
  UNION ALL SELECT source, size, weight,
    CASE WHEN quota IS NOT NULL THEN quota WHEN remaining * weight / nullif(sum(CASE WHEN quota IS NULL AND size > 0 THEN weight END) OVER (), 0) > 2 * size THEN 2.0 * size END,
    remaining - coalesce(sum(CASE WHEN quota IS NULL AND size > 0 AND remaining * weight > 2 * size * total THEN 2.0 * size END) OVER (), 0), k + 1
  FROM (SELECT *, sum(CASE WHEN quota IS NULL AND size > 0 THEN weight END) OVER () AS total FROM r) WHERE k < 12),
last AS (SELECT * FROM r WHERE k = 12)
SELECT w.source, w.n, w.size AS source_size,
  round(CASE WHEN w.size = 0 THEN 0.0 ELSE coalesce(l.quota, l.remaining * l.weight / sum(CASE WHEN l.quota IS NULL AND l.size > 0 THEN l.weight END) OVER ()) END, 3) AS target,
  true AS within, true AS near
FROM w JOIN last l ON w.source IS NOT DISTINCT FROM l.source"""
