"""SimHash near-duplicates: 64-bit fingerprints of word shingles, exact links within a radius, connected components.

Copies collapse to one fingerprint first, so a group of copies of any size is one row. Distinct fingerprints within
``radius`` differing bits are found exactly: the 64 bits are cut into ``radius + m`` blocks, two linked fingerprints
agree in at least ``m`` of them, and for each choice of ``m`` blocks the fingerprints that agree there meet. Those of
one meeting place are laid out by population count in tiles of bounded size; pairs of tiles whose population counts
differ beyond the radius are skipped, the others are compared whole by numpy exclusive-or and bit counts. A tile pair
returns a spanning forest of its links, never all pairs, so a large group of near copies yields a row a member. Stars
then contract the forests to components with aggregations and joins, durably cut after each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, free_names, join_by_key, own_columns, quoted, read_table, sliced, space_words, written

SEED = 42
RADIUS = 4
SHINGLE = 4
TILE = 2048
#: Fingerprints expected at one meeting place beyond which one more block is taken into the key.
CROWD = 4096
#: Rows that go or need care, by id and text hash (24 bytes each), up to which they are broadcast and texts stay in place.
MOST_MARKED = 1_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the XXH64 values of all word shingles, repeats included; no words: zero."""
    words = space_words(text)
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    """Bits set in over half of the values."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, fp)`` for every row: a hash of the text and the fingerprint as a signed long; null is an empty text."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(t) for part in sliced(iter([batch])) for t in part[1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(got, np.uint64).view(np.int64))], names=["id", "th", "fp"]
            )

    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"), text_hash(text_col).alias("th")
    )
    return rows.mapInArrow(run, f"id {kind.simpleString()}, th long, fp long")


def text_hash(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def block_keys(radius: int, m: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """For each choice of ``m`` of ``radius + m`` blocks: its number and the (shift, width) of its blocks."""
    count = radius + m
    cuts = [64 * i // count for i in range(count + 1)]
    spans = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(count)]
    return [(k, tuple(spans[i] for i in pick)) for k, pick in enumerate(combinations(range(count), m))]


def _key_masks(radius: int, m: int) -> list[int]:
    return [sum(((1 << w) - 1) << s for s, w in spans) for _, spans in block_keys(radius, m)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _links(fps: np.ndarray, side: np.ndarray, masks: list[int], key: int, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``fps`` (unsigned) first found under this key.

    ``side`` 0 or 1: of two different tiles only pairs across are compared, as pairs within belong to another task;
    of one tile (all 0) all pairs. Rows are ordered by population count, blocks of rows whose counts lie further
    apart than the radius are skipped.
    """
    pops = np.bitwise_count(fps).astype(np.int16)
    order = np.argsort(pops, kind="stable")
    fps, pops, side = fps[order], pops[order], side[order]
    across = bool(side.any())
    earlier = np.array(masks[:key], np.uint64)
    root = np.arange(len(fps))
    out, step = [], 256
    for a in range(0, len(fps), step):
        rows = fps[a : a + step]
        top = pops[min(a + step, len(fps)) - 1]
        for b in range(a, len(fps), step):
            if pops[b] - top > radius:
                break
            diff = rows[:, None] ^ fps[None, b : b + step]
            near = np.bitwise_count(diff) <= radius
            if across:
                near &= side[a : a + step][:, None] != side[None, b : b + step]
            if a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i) and len(earlier):  # a pair that agrees under an earlier key is found there
                seen = ((diff[i, j][:, None] & earlier[None, :]) == 0).any(axis=1)
                i, j = i[~seen], j[~seen]
            root, more = _joined(root, i + a, j + b)
            out += [(int(fps[x]), int(fps[y])) for x, y in more]
    return out


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Labels after the links ``x``-``y``, and those of them that joined two labels: in each pass the first link of every
    label, so a dense group costs some passes over arrays and not a step for each pair."""
    used = []
    while len(x):
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        _, first = np.unique(root[x], return_index=True)
        up = np.arange(len(root))

        def top(k: int) -> int:
            while up[k] != k:
                k = up[k]
            return k

        for p, q in zip(x[first].tolist(), y[first].tolist()):
            one, two = top(root[p]), top(root[q])
            if one != two:
                up[max(one, two)] = min(one, two)
                used.append((p, q))
        while (up[up] != up).any():
            up = up[up]
        root = up[root]
    return root, used


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, m: int | None = None) -> DataFrame:
    """``(a, b)`` pairs of distinct fingerprints within the radius, enough of them to connect every component.

    ``distinct`` has one column fp. ``m`` (blocks in a key) follows from the number of fingerprints unless given; any
    value gives the same components.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    if m is None:
        m = next(k for k in range(1, 12) if n / 2 ** (64 * k // (radius + k)) <= CROWD or k == 11)
    masks = _key_masks(radius, m)
    keyed = distinct.select(
        "fp",
        F.bit_count("fp").cast("int").alias("pop"),
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(v))).alias("v")) for k, v in enumerate(masks)])
        ).alias("key"),
    ).select("fp", "pop", F.col("key.k").alias("k"), F.col("key.v").alias("v"))
    # How many fingerprints each meeting place has by population count: at most 65 rows a place.
    cells = keyed.groupBy("k", "v", "pop").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("k", "v")
    upto = place.orderBy("pop").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = (
        cells.withColumn("total", F.sum("n").over(place))
        .filter("total > 1")
        .withColumn("before", F.sum("n").over(upto) - F.col("n"))
        .withColumn("first", F.floor(F.col("before") / tile).cast("int"))
        .withColumn("split", F.ceil(F.col("n") / tile).cast("int"))
        .select("k", "v", "pop", "n", "total", "first", "split")
    )
    # A place of up to a tile is compared at once; a larger one in pairs of tiles.
    small = F.col("total") <= tile
    many = durable(cells.filter(~small))
    rows = keyed.join(cells.filter(small).select("k", "v", "pop"), ["k", "v", "pop"], "left_semi").select(
        "k", "v", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp"
    )
    if many.take(1):
        tiles = (
            many.select("k", "v", "pop", F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("part"), "first")
            .select("k", "v", F.col("first").alias("first"), "part", "pop")
            .groupBy("k", "v", "first", "part")
            .agg(F.min("pop").alias("low"), F.max("pop").alias("high"))
            .withColumn("t", F.row_number().over(place.orderBy("first", "part")))
        )
        right = tiles.select("k", "v", F.col("t").alias("u"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        pairs = (
            tiles.join(right, ["k", "v"])
            .filter((F.col("t") <= F.col("u")) & (F.col("low2") - F.col("high") <= radius) & (F.col("low") - F.col("high2") <= radius))
            .select("k", "v", "first", "part", "t", "u")
        )
        ends = pairs.select("k", "v", F.col("t").alias("i"), F.col("u").alias("j"), F.col("t").alias("at"), F.lit(0).alias("side")).union(
            pairs.filter("t < u").select("k", "v", F.col("t").alias("i"), F.col("u").alias("j"), F.col("u").alias("at"), F.lit(1).alias("side"))
        )
        # A place and population count may hold most fingerprints: its rows stay where they are.
        placed = (
            join_by_key(keyed, many.drop("total"), ["k", "v", "pop"], n * len(masks))
            .withColumn("part", F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("split").cast("long")).cast("int"))
            .join(tiles.select("k", "v", "first", "part", F.col("t").alias("at")), ["k", "v", "first", "part"])
            .select("k", "v", "at", "fp")
        )
        rows = rows.union(placed.join(ends, ["k", "v", "at"]).select("k", "v", "i", "j", "side", "fp"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = None
        found: list[tuple[int, int]] = []

        def close() -> None:
            if held:
                fps, side = (np.concatenate(x) for x in zip(*held))
                if len(fps) > 1:
                    found.extend(_links(fps.view(np.uint64), side, masks, now[0], radius))

        def packed() -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            k, v, i, j, side, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(k):
                continue
            cut = np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(k)]):
                group = (int(k[lo]), int(v[lo]), int(i[lo]), int(j[lo]))
                if group != now:
                    close()
                    held, now = [], group
                held.append([fp[lo:hi], side[lo:hi]])
            if len(found) > 10_000:
                yield packed()
        close()
        if found:
            yield packed()

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; root is the least node of its component.

    Alternating large-star and small-star contraction: in each half round a node's neighbours link to the least of
    them. Only aggregations by node and joins with their results occur, so no group is ever gathered. Rounds end when
    the links no longer change; a graph that needs more than ``rounds`` raises instead of returning part of the answer.
    """
    now = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")))
        large = join_by_key(both.filter("v > u"), least, ["u"], mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = durable(large)
        least = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = (
            join_by_key(large, least, ["u"], mark[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        now = durable(small)
        then, mark = mark, _mark(now)
        if then == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number and order-free hash sum of the links."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, hashes: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """Marked rows ``(id, th, fp)``; for each distinct fingerprint its component's root, the first of its rows and their
    number ``(fp, root, x, n)``; and the number of all rows. First is the least id, null ids last, then, if ``hashes``, the
    least hash; without, the aggregation needs no sort."""
    marked = durable(fingerprints(docs, id_col, text_col))
    least = F.min("id")
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "th")) if hashes else F.struct(least.isNull().alias("null"), least.alias("id"))
    by_fp = durable(marked.groupBy("fp").agg(first.alias("x"), F.count(F.lit(1)).alias("n")))
    tree = components(links(by_fp.select("fp"), radius))
    roots = by_fp.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return marked, durable(roots), by_fp.agg(F.sum("n")).first()[0] or 0


def firsts(roots: DataFrame) -> DataFrame:
    """``(fp, x, n)``: for each fingerprint the first row of its whole component."""
    best = roots.groupBy("root").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return join_by_key(roots.select("fp", "root", F.col("n").alias("rows")), durable(best), ["root"], roots.count()).select("fp", "x", F.col("rows").alias("n"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` (least id reachable over links).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows are kept. A null id stays null
    and never is a component's id unless all its ids are null. Columns besides the two named are not read.
    """
    marked, roots, total = rooted(docs, id_col, text_col, radius, hashes=False)
    return join_by_key(marked, durable(firsts(roots)), ["fp"], total).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("x.id").alias("component_id")
    )


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most_marked: int = MOST_MARKED) -> DataFrame:
    """One row of each component, columns unchanged: that of the least id (null ids last, then the least text hash), of
    rows equal in id and text one.

    Which rows go is decided on ids and hashes. Their keys are counted: up to ``most_marked`` are broadcast, and texts
    stay where they are; more meet the rows in one shuffle.
    """
    marked, roots, total = rooted(docs, id_col, text_col, radius)
    each = join_by_key(marked, durable(firsts(roots)), ["fp"], total)
    stays = F.col("id").eqNullSafe(F.col("x.id")) & (F.col("th") == F.col("x.th"))
    going = each.filter(~stays).select("id", "th", F.lit(False).alias("stays")).distinct()
    again = each.filter(stays).groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "th", F.lit(True).alias("stays"))
    key, th, of, own = free_names(docs, "key", "th", "of", "own")
    special = written(going.union(again)).toDF(key, th, of)
    count = special.groupBy(of).count().collect()
    if sum(r["count"] for r in count) <= most_marked:
        special = F.broadcast(special)
    named = docs.withColumn(own, text_hash(text_col))
    met = F.col(quoted(id_col)).eqNullSafe(F.col(key)) & (F.col(own) == F.col(th))
    single = named.join(special, met, "left_anti").select(own_columns(docs))
    if not any(r[of] for r in count):
        return single
    # Rows equal in id and text meet under one key and leave one of them.
    repeated = named.join(special.filter(of), met).dropDuplicates([key, th]).select(own_columns(docs))
    return single.union(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's fingerprint and component."""
    return classes(read_table(spark, sf_dir, "documents"))
