"""Exact top-k inner products with a pivot-distance index.

Pivots are drawn by farthest-first choice from a bounded sample. Every vector is keyed by its nearest pivot and its
distance to it, and the table is laid out in that order, so that neighbouring rows form annuli around a pivot. A
query's distance to the pivot bounds, by the triangle inequality, its distance to any vector of an annulus, and with
the annulus' largest norm the inner product. The layout is cut into parts of bounded size, each described by its annuli
of one pivot. Queries are a table too. Each is first searched in the part of its highest bound; its tenth best score
there, or over the sample, is its bar. It then goes to every other part that holds an annulus whose bound reaches the
bar, and within a part to the annuli that do, the most promising first; a part returns only rows that reach the bar.
Rows meet by part number in a shuffle: a task holds one part's vectors and a batch of queries. The bounds never leave
out a row that belongs to the answer, so the result is exact.

Rows, not ids, ask and answer: rows of one id are candidates for each other. Vectors of any lengths are searched, those of
one length among themselves: lengths up to the same power of two share an index, filled up with zeros, in whose order and
annuli the length comes first, so there are some thirty indexes at most. Scores are exact while sums of absolute products
stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, read_table, written

PIVOTS = 64
#: Rows from which pivots are drawn and first bars taken.
SAMPLE = 2048
#: Bytes of that sample at most.
SAMPLE_BYTES = 64 << 20
ANNULUS = 256
#: Queries compared with a part at a time.
QUERY_BATCH = 1024
#: Bytes of the vectors of one part, more only where the index has over MOST_PARTS parts' worth of them: the driver and
#: each worker hold a description of all parts, some 40 bytes each.
PART_BYTES = 16 << 20
MOST_PARTS = 500_000
SCALE = 1024


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component; the empty vector is usable."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: F.coalesce(bad(x), F.lit(True))), F.lit(True))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each pivot is the sample row farthest from those before."""
    if not len(sample):
        return sample
    at, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(at) < min(count, len(sample)):
        k = int(far.argmax())
        if far[k] <= 0:
            break
        at.append(k)
        far = np.minimum(far, ((sample - sample[k]) ** 2).sum(1))
    return sample[at]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def index(vectors: DataFrame, pivots: np.ndarray, partitions: int, part_rows: int) -> DataFrame:
    """``(vec_id, v, dim, cell, r, row, part)`` of ``(vec_id, v, dim)`` in order of length, cell and distance, laid out once
    in the shared folder; ``row`` numbers the rows, a part is at most ``part_rows`` neighbouring ones."""
    width = pivots.shape[1]
    names = ["vec_id", "v", "dim", "cell", "r"]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column(1), width), pivots)
                cell = d.argmin(1)
                r = d[np.arange(len(d)), cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(r)], names=names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begin = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            row = at + np.arange(batch.num_rows, dtype=np.int64)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begin + row), pa.array(begin + row // part_rows)], names=[*names, "row", "part"])

    kind = "vec_id long, v array<double>, dim int, cell int, r double"
    keyed = vectors.select("vec_id", "v", "dim").mapInArrow(key, kind)
    laid = keyed.repartitionByRange(partitions, "dim", "cell", "r", "vec_id").sortWithinPartitions("dim", "cell", "r", "vec_id")
    return durable(laid.mapInArrow(number, f"{kind}, row long, part long"))


class _Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, count: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor
        self.score = np.full((count, k), -np.inf)
        self.id = np.full((count, k), np.iinfo(np.int64).max)

    def bar(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the queries ``rows``; ids ascending. Entries at -inf are no candidates."""
        some = (scores >= self.bar()[rows][:, None]).any(1)
        for q, s in zip(rows[some], scores[some]):
            take = np.flatnonzero(s >= max(self.floor[q], self.score[q, -1]))
            both, names = np.concatenate([self.score[q], s[take]]), np.concatenate([self.id[q], ids[take]])
            order = np.lexsort((names, -both))[: self.k]
            self.score[q], self.id[q] = both[order], names[order]


def search(
    vectors: DataFrame, queries: DataFrame | Column, k: int = 10, pivots: int = PIVOTS, sample: int = SAMPLE, part_rows: int | None = None
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its k best rows of ``vectors`` by inner product.

    ``vectors`` has ``vec_id`` (a long) and ``v`` (array of double, whole numbers). ``queries`` is a condition on ``vec_id``
    or a frame like ``vectors``. A condition makes each row that meets it ask, repeated ids too, all rows but itself, rows
    of its own id among them. Of a frame, rows of a query's own id are no candidates, and of the rows of one id and length
    the least vector asks. Ties go to the smaller id. Rows without an id or a vector take no part. Vectors, empty ones
    too, meet those of their own length only. Fewer rows than k: all.
    """
    named = _sized(vectors)
    kinds = named.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("dim").alias("least"), F.max("dim").alias("most")).collect()
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for r in sorted(kinds, key=lambda r: r["kind"]):
        width = max(1, r["most"])
        fill = F.array_repeat(F.lit(0.0), F.lit(width) - F.col("dim"))
        alike = lambda df: df.filter((F.col("kind") == r["kind"]) & (F.col("dim") <= r["most"])).select("vec_id", F.concat("v", fill).alias("v") if r["least"] < width else "v", "dim")  # noqa: E731, B023
        asked = queries
        if isinstance(queries, DataFrame):
            asked = alike(_sized(queries)).groupBy("vec_id", "dim").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("key"), "vec_id", "v", "dim")
        out = out.union(_search(alike(named), asked, width, r["n"], k, pivots, sample, part_rows))
    return out


def _sized(vectors: DataFrame) -> DataFrame:
    """Rows that take part, with their length and its kind: the power of two that it reaches up to."""
    some = vectors.filter("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim"))
    return some.withColumn("kind", F.length(F.bin(F.greatest(F.col("dim"), F.lit(1)) - 1)))


def _search(
    vectors: DataFrame, asked: DataFrame | Column, width: int, rows: int, k: int, pivots: int, sample: int, part_rows: int | None
) -> DataFrame:
    """``search`` among vectors that are filled up to one width."""
    spark = vectors.sparkSession
    sample = min(sample, max(pivots, SAMPLE_BYTES // (8 * width)))
    draw = vectors.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(sample).collect()
    known = np.array([r["v"] for r in draw])
    known_ids, known_dims = (np.array([r[c] for r in draw], np.int64) for c in ("vec_id", "dim"))
    centres = choose_pivots(known, pivots)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_rows = part_rows or max(ANNULUS, PART_BYTES // (8 * width), -(-rows // MOST_PARTS))
    laid = index(vectors, centres, max(shuffles, -(-rows // part_rows)), part_rows)
    own = "vec_id"
    if isinstance(asked, Column):
        own, asked = "row", laid.filter(asked).select(F.col("row").alias("key"), "vec_id", "v", "dim")
    # A row for each part, length and pivot: of MOST_PARTS parts, and of lengths up to one power of two, that is bounded.
    rings = spark.sparkContext.broadcast(described(laid))
    first = _asked(asked, centres, rings, k, (known, known_ids, known_dims))
    near = written(_meet(laid, own, first, centres, k))
    best = near.groupBy("key", "dim").agg(F.slice(F.sort_array(F.collect_list("score"), False), k, 1).alias("x"))
    bars = best.select("key", "dim", F.get("x", F.lit(0)).cast("double").alias("met"))
    bound = first.withColumnRenamed("part", "done").join(bars, ["key", "dim"], "left")
    met = F.greatest("bar", F.coalesce("met", F.lit(float("-inf"))))
    again = bound.select("key", "vec_id", "v", "dim", "done", met.alias("bar"))
    far = _meet(laid, own, _asked(again, centres, rings, k, None), centres, k)
    order = Window.partitionBy("key", "dim").orderBy(F.desc("score"), "vec_id")
    return near.union(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def described(laid: DataFrame) -> tuple[np.ndarray, ...]:
    """Part, length, pivot, least and greatest distance and greatest squared norm of the annuli of an index."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    each = laid.groupBy("part", "dim", "cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max(square).alias("square"))
    kept = each.toPandas().sort_values(["part", "dim", "cell"])
    return tuple(kept[c].to_numpy() for c in ("part", "dim", "cell", "lo", "hi", "square"))


def _bounds(near: np.ndarray, norm: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Highest inner product that each query (row) may have in each annulus (column)."""
    d = near[:, cell]
    gap = np.maximum(0, np.maximum(d - hi, lo - d))
    gap = np.maximum(0, gap * (1 - 1e-9) - 1e-6)  # rounding must not cut off an answer
    return (norm[:, None] + square - gap * gap) / 2 + 1e-3


def _asked(queries: DataFrame, centres: np.ndarray, rings, k: int, known: tuple[np.ndarray, ...] | None) -> DataFrame:
    """``(key, vec_id, v, dim, part, bar)``: queries with the parts that they go to.

    With the sample ``known`` (vectors, ids, lengths): each to its most promising part, the bar from the sample, in which
    rows of its own id do not count. Without: the queries bring the part already ``done`` and their bar, and go to all
    others whose bound reaches the bar.
    """
    width = centres.shape[1] if centres.ndim > 1 else 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, dims, cell, lo, hi, square = rings.value
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, int)
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_BATCH // 4):
                batch = whole.slice(at, QUERY_BATCH // 4)
                if not batch.num_rows or not len(part):
                    continue
                ids, dim = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 3))
                q = _matrix(batch.column(2), width)
                near, norm = _distances(q, centres), (q * q).sum(1)
                # The highest bound of each part, some thousand rings at a time.
                tops = np.concatenate([_tops(near, norm, dim, dims, cell, lo, hi, square, starts, a) for a in range(0, len(starts), 4096)], axis=1)
                if known is not None:
                    scores = q @ known[0].T
                    scores[(ids[:, None] == known[1][None, :]) | (dim[:, None] != known[2][None, :])] = -np.inf
                    bar = np.full(len(q), -np.inf)
                    if scores.shape[1] >= k:
                        bar = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                    i, j = np.arange(len(q)), tops.argmax(1)
                else:
                    done, bar = (batch.column(c).to_numpy(zero_copy_only=False) for c in (4, 5))
                    i, j = np.nonzero((tops >= bar[:, None]) & np.isfinite(tops) & (part[starts][None, :] != done[:, None]))
                for b in range(0, len(i), 10_000):
                    x, y = i[b : b + 10_000], j[b : b + 10_000]
                    at_x = pa.array(x)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(at_x) for c in range(4)], pa.array(part[starts][y]), pa.array(bar[x])], names=["key", "vec_id", "v", "dim", "part", "bar"]
                    )

    made = queries.mapInArrow(deal, "key long, vec_id long, v array<double>, dim int, part long, bar double")
    return written(made) if known is not None else made


def _tops(near, norm, dim, dims, cell, lo, hi, square, starts, a: int) -> np.ndarray:
    some = starts[a : a + 4096]
    end = starts[a + 4096] if a + 4096 < len(starts) else len(cell)
    at = slice(some[0], end)
    bounds = _bounds(near, norm, cell[at], lo[at], hi[at], square[at])
    bounds[dim[:, None] != dims[at][None, :]] = -np.inf
    return np.maximum.reduceat(bounds, some - some[0], axis=1)


def _meet(laid: DataFrame, own: str, asked: DataFrame, centres: np.ndarray, k: int) -> DataFrame:
    """``(key, dim, query_id, vec_id, score)``: the best rows of each part, k at most, for each query sent to it. A row whose
    column ``own`` is the query's key is no candidate."""
    none = F.lit(None)
    both = laid.select("part", F.lit(0).alias("kind"), F.col(own).alias("key"), "vec_id", "v", "dim", "cell", "r", none.cast("double").alias("bar")).union(
        asked.select("part", F.lit(1).alias("kind"), "key", "vec_id", "v", "dim", none.cast("int").alias("cell"), none.cast("double").alias("r"), "bar")
    )
    ready = both.repartition("part").sortWithinPartitions("part", "kind", "dim", "cell", "r", "vec_id")
    width = centres.shape[1] if centres.ndim > 1 else 1

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, made = None, None
        for batch in batches:
            part, kind = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if not len(part):
                continue
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                if part[lo] != now:
                    held, now, made = [], part[lo], None
                if not kind[lo]:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                made = made or _Part(held, width)
                held = []
                for at in range(lo, hi, QUERY_BATCH):
                    yield made.best(batch.slice(at, min(QUERY_BATCH, hi - at)), centres, k)

    return ready.mapInArrow(visit, "key long, dim int, query_id long, vec_id long, score long")


class _Part:
    """One part's vectors in order of length, pivot and distance, with its annuli."""

    def __init__(self, held: list[pa.RecordBatch], width: int) -> None:
        self.keys, self.ids, dims, cells, radii = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in (2, 3, 5, 6, 7))
        self.x, self.width = np.concatenate([_matrix(b.column(4), width) for b in held]), width
        size = (self.x * self.x).sum(1)
        cuts = (np.flatnonzero((cells[1:] != cells[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist()
        self.rings = [(a, min(a + ANNULUS, hi)) for lo, hi in zip([0, *cuts], [*cuts, len(self.ids)]) for a in range(lo, hi, ANNULUS)]
        first = np.array([a for a, _ in self.rings])
        self.cell, self.dim, self.lo = cells[first].astype(int), dims[first], radii[first]
        self.hi = np.array([radii[b - 1] for _, b in self.rings])
        self.square = np.array([size[a:b].max() for a, b in self.rings])

    def best(self, asked: pa.RecordBatch, centres: np.ndarray, k: int) -> pa.RecordBatch:
        keys, dim, bar = (asked.column(c).to_numpy(zero_copy_only=False) for c in (2, 5, 8))
        q = _matrix(asked.column(4), self.width)
        bounds = _bounds(_distances(q, centres), (q * q).sum(1), self.cell, self.lo, self.hi, self.square).T
        bounds[self.dim[:, None] != dim[None, :]] = -np.inf
        best = _Best(len(q), k, bar)
        for n in np.argsort(-bounds.max(1), kind="stable"):
            live = np.flatnonzero((bounds[n] >= best.bar()) & np.isfinite(bounds[n]))
            if not len(live):
                continue
            a, b = self.rings[n]
            order = np.argsort(self.ids[a:b], kind="stable")
            scores = q[live] @ self.x[a:b][order].T
            scores[keys[live][:, None] == self.keys[a:b][order][None, :]] = -np.inf
            best.add(live, scores, self.ids[a:b][order])
        at, place = np.nonzero(np.isfinite(best.score))
        rows = pa.array(at)
        return pa.RecordBatch.from_arrays(
            [*[asked.column(c).take(rows) for c in (2, 5, 3)], pa.array(best.id[at, place]), pa.array(best.score[at, place].astype(np.int64))],
            names=["key", "dim", "query_id", "vec_id", "score"],
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the ten best of every row whose id is divisible by 100, among all rows but itself; rows of one id each ask and
    answer."""
    table = read_table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")))
    vectors = table.select("vec_id", quantised(F.col("embedding")).alias("v"))
    return search(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n AS n, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id IS NOT NULL AND q.n <> c.n AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
