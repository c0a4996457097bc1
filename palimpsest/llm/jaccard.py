"""Similarity join of word-shingle sets by Jaccard similarity, exact, under several global orders of the shingles.

Two sets that are similar enough share a shingle among the first few of each, whatever total order the shingles are
given. All orders put shingles found in fewer documents first (so shared boilerplate comes last) and differ in how they
rank shingles of one frequency class; a pair is a candidate only if it passes the prefix filter of every order. Sets
whose prefix consists of shingles found nowhere else have no partner and leave at once: that is most of a corpus.

Frequencies come from one pass that sends each shingle's hash to the part of hash space it belongs to, packed in arrays,
and sends back what is shared. Groups of copies are one set. A group that meets at a shingle is joined to its first set
and contracted to components before the rest of it is compared, in tiles of bounded size and only across components, so
thousands of near copies cost a row a member and no pair is lost. Sets are compared by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, read_table, sliced, written
from .hashed import mixed, shingles
from .simhash import components

SHINGLE = 3
#: Least similarity in percent.
LEAST = 90
#: Orders besides the one that makes the meeting places.
MORE_ORDERS = 2
#: Sets in a tile of a meeting place; of those that meet a first set in one bin.
TILE, BIN = 512, 256
#: Shingles of a chunk of documents, and of a part of hash space that is counted at once.
CHUNK, PART = 1_000_000, 4_000_000
LEADERS = 2


def prefix_length(n: np.ndarray | int, least: int = LEAST) -> np.ndarray | int:
    """How many first shingles of a set of ``n`` hold one that any partner has among its own first ones."""
    return n + (-least * n) // 100 + 1


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), 7) - (1 << 63)


def marked(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, key, n)`` of every row: the key of its set (null: empty) and the set's size."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for part in sliced(iter([batch.select(["text"])])):
                for text in part[0]:
                    found = shingles(text, size)
                    keys.append(set_key(found) if len(found) else None)
                    sizes.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "key", "n"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, key long, n long")


def _steps(places: np.ndarray) -> bytes:
    """Ascending numbers below 65,536 as differences."""
    return np.diff(places, prepend=0).astype(np.uint16).tobytes()


def _places(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint16), dtype=np.int64)


_SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("own", pa.bool_()), ("doc", pa.binary()), ("token", pa.binary()), ("class", pa.binary())])
_SENT_SQL = "part int, chunk long, own boolean, doc binary, token binary, class binary"


def shared(docs: DataFrame, text_col: str, size: int, least: int, parts: int) -> DataFrame:
    """``(key, n, tokens, classes)`` of the sets that may have partners: their shingles found in other sets as well, with
    the logarithm of how many, and the size of the whole set."""
    spark = docs.sparkSession

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        sets: list[np.ndarray] = []
        task, count = TaskContext.get().partitionId(), 0

        def chunk() -> pa.RecordBatch:
            name = (task << 32) + count
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, tokens, owner = part[order], tokens[order], owner[order]
            cut = np.flatnonzero(np.diff(part)) + 1
            lows, highs = [0, *cut.tolist()], [*cut.tolist(), len(part)]
            rows = [(int(part[a]), name, False, _steps(owner[a:b]), tokens[a:b].tobytes(), None) for a, b in zip(lows, highs)]
            rows.append((name % parts, name, True, sizes.tobytes(), np.array(keys, np.int64).tobytes(), None))
            keys.clear(), sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)

        held, seen = 0, set()
        for part in sliced(batches):
            for text in part[0]:
                found = shingles(text, size)
                if not len(found) or (key := set_key(found)) in seen:
                    continue
                seen.add(key)
                keys.append(key)
                sets.append(found)
                held += len(found)
                if held >= CHUNK or len(keys) == 65_535:
                    yield chunk()
                    held, count = 0, count + 1
                    seen.clear()
        if keys:
            yield chunk()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def close() -> list[tuple]:
            rows = [r for r in held if not r[2]]
            out = [r for r in held if r[2]]
            held.clear()
            if rows:
                arrays = [np.frombuffer(r[4], np.uint64) for r in rows]
                _, at, times = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
                times = times[at]
                ends = np.cumsum([len(a) for a in arrays])
                for r, a, b, tokens in zip(rows, [0, *ends[:-1].tolist()], ends.tolist(), arrays):
                    more = times[a:b] > 1
                    if more.any():
                        classes = np.log2(times[a:b][more]).astype(np.uint8)
                        out.append((r[0], r[1], False, _steps(_places(r[3])[more]), tokens[more].tobytes(), classes.tobytes()))
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    if out := close():
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SENT)], schema=_SENT)
                    now = row[0]
                held.append(row)
        if out := close():
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SENT)], schema=_SENT)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            own = next((r for r in held if r[2]), None)
            rest = [r for r in held if not r[2]]
            held.clear()
            if not rest:
                return
            sizes, keys = np.frombuffer(own[3], np.int64), np.frombuffer(own[4], np.int64)
            doc = np.concatenate([_places(r[3]) for r in rest])
            tokens = np.concatenate([np.frombuffer(r[4], np.uint64) for r in rest])
            classes = np.concatenate([np.frombuffer(r[5], np.uint8) for r in rest])
            common = np.bincount(doc, minlength=len(keys))
            stays = sizes - common < prefix_length(sizes, least)
            mine = stays[doc]
            doc, tokens, classes = doc[mine], tokens[mine], classes[mine]
            order = np.lexsort((tokens, doc))
            tokens, classes = tokens[order], classes[order]
            docs_left = np.flatnonzero(stays & (common > 0))
            ends = np.cumsum(common[docs_left])
            for lo in range(0, len(docs_left), 256):
                some = slice(lo, lo + 256)
                spans = list(zip((ends - common[docs_left])[some].tolist(), ends[some].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[docs_left[some]]), pa.array(sizes[docs_left[some]]), pa.array([tokens[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([classes[a:b].tobytes() for a, b in spans], pa.binary())],
                    names=["key", "n", "tokens", "classes"],
                )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] != now:
                    yield from close()
                    now = row[1]
                held.append(row)
        yield from close()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(send, _SENT_SQL)
    weighed = sent.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(weigh, _SENT_SQL)
    back = weighed.repartition(tasks, "chunk").sortWithinPartitions("chunk")
    return written(back.mapInArrow(gather, "key long, n long, tokens binary, classes binary").dropDuplicates(["key"]))


def prefixes(sets: DataFrame, least: int, more: int = MORE_ORDERS) -> DataFrame:
    """``(key, n, first, others)``: the shared shingles of a set's prefix under the first order, and hashes of 32 bits of
    those under each other order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, tokens, classes in sliced(batches):
            firsts, others = [], []
            for n, t, c in zip(sizes, tokens, classes):
                t, c = np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint8)
                take = prefix_length(n, least) - (n - len(t))
                ranked = [t[np.lexsort((t if k == 0 else mixed(t + np.uint64(k)), c))[:take]] for k in range(more + 1)]
                firsts.append(ranked[0].view(np.int64))
                others.append(b"".join(r.astype(np.uint32).tobytes() for r in ranked[1:]))
            ends = np.cumsum([0, *map(len, firsts)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts))), pa.array(others, pa.binary())],
                names=["key", "n", "first", "others"],
            )

    return sets.mapInArrow(run, "key long, n long, first array<long>, others binary")


def verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """``(a, b)`` of those pairs ``(bin, a, b)`` whose sets are similar enough; of a bin enough to connect what it links.

    Each bin gets the sets it needs once. Shingles found in one set only are in no intersection, so the shared ones and the
    sizes give the exact similarity.
    """
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = pairs.select("bin", F.explode(F.array("a", "b")).alias("key")).distinct()
    brought = needed.join(sets, "key").select("bin", F.lit(0).alias("kind"), F.col("key").alias("a"), F.lit(0).cast("long").alias("b"), "n", "tokens")
    asked = pairs.select("bin", F.lit(1).alias("kind"), "a", "b", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        held: dict[int, tuple[int, np.ndarray]] = {}
        root: dict[int, int] = {}
        found: list[tuple[int, int]] = []

        def top(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for bins, kinds_, ones, others, sizes, tokens in sliced(batches):
            for bin_, kind, a, b, n, t in zip(bins, kinds_, ones, others, sizes, tokens):
                if bin_ != now:
                    now = bin_
                    held.clear(), root.clear()
                if kind == 0:
                    held[a] = (n, np.frombuffer(t, np.uint64))
                elif top(a) != top(b):
                    (n, x), (m, y) = held[a], held[b]
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    both = int((y[at] == x).sum()) if len(y) else 0
                    if 100 * both >= least * (n + m - both):
                        root[top(a)] = top(b)
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()

    return brought.union(asked).repartition(tasks, "bin").sortWithinPartitions("bin", "kind").mapInArrow(run, "a long, b long")


_PLACED = "t long, i int, j int, side int, key long, comp long, n long, first array<long>, others binary"


def _meeting(lists: list[np.ndarray]) -> np.ndarray:
    """Which of the lists have a value in common."""
    meet = np.zeros((len(lists), len(lists)), bool)
    values, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    cut = np.flatnonzero(np.diff(values)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(values)]):
        if hi - lo > 1:
            meet[np.ix_(owner[lo:hi], owner[lo:hi])] = True
    return meet


def _near(rows: list[tuple], least: int, more: int) -> np.ndarray:
    """Which sets of a tile pair are candidates: of different components and near sizes, sharing a prefix shingle under
    every order, and with this place as the least that they share under the first. ``rows`` ascend by size."""
    t, side, comp, n = rows[0][0], *(np.array([r[k] for r in rows]) for k in (3, 5, 6))
    near = np.triu((100 * n[:, None] >= least * n[None, :]) & (comp[:, None] != comp[None, :]), 1)
    if side.any():
        near &= side[:, None] != side[None, :]
    others = [np.frombuffer(r[8], np.uint32) for r in rows]
    for k in range(more):
        if not near.any():
            return near
        near &= _meeting([x[len(x) // more * k : len(x) // more * (k + 1)] for x in others])
    return near & ~_meeting([np.array([v for v in r[7] if v < t], np.int64) for r in rows]) if near.any() else near


def _overlaps(near: np.ndarray, tokens: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """For each candidate pair how many shingles it shares: pair by pair, or, of many pairs, by products of blocks of an
    indicator matrix over the shingles that several of the sets have."""
    i, j = np.nonzero(near)
    values, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    names, at, times = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    at, owner = column[at[keep]], owner[keep]
    width = int((times > 1).sum())
    if len(i) < 20 * len(tokens) * (1 + width // 4096):
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = sorted((tokens[a], tokens[b]), key=len)
            found = np.searchsorted(y, x)
            found[found == len(y)] = 0
            yield a, b, int((y[found] == x).sum())
        return
    both = np.zeros(near.shape, np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for lo in range(0, width, 4096):
        some = slice(*np.searchsorted(at, (lo, lo + 4096)).tolist())
        marks = np.zeros((len(tokens), min(4096, width - lo)), np.float32)
        marks[owner[some], at[some] - lo] = 1
        both += marks @ marks.T
    yield from zip(i.tolist(), j.tolist(), both[i, j].astype(np.int64).tolist())


def _by_tiles(placed: DataFrame, columns: str, out: str, work: Callable[[list[tuple]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``work`` on the rows of each tile pair, which ascend by size."""
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        held: list[tuple] = []
        for part in sliced(batches):
            for row in zip(*part):
                if row[:3] != now:
                    if len(held) > 1:
                        yield from work(sorted(held, key=lambda r: (r[6], r[4])))
                    now = row[:3]
                    held.clear()
                held.append(row)
        if len(held) > 1:
            yield from work(sorted(held, key=lambda r: (r[6], r[4])))

    return placed.select(names).repartition(tasks, "t", "i", "j").sortWithinPartitions("t", "i", "j").mapInArrow(run, out)


def compared(placed: DataFrame, sets: DataFrame, least: int, more: int) -> DataFrame:
    """``(a, b)``: links between components among the sets of tile pairs, of each tile pair enough to connect what it links.

    First the filters leave those sets that are in a candidate pair at all; these get their shingles and are compared where
    they meet, so pairs are never rows.
    """
    schema = pa.schema([("t", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("key", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("first", pa.list_(pa.int64())), ("others", pa.binary())])

    def narrow(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        near = _near(rows, least, more)
        some = [r for r, x in zip(rows, (near.any(axis=0) | near.any(axis=1)).tolist()) if x]
        for lo in range(0, len(some), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some[lo : lo + 256]), schema)], schema=schema)

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        near = _near(rows, least, more)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        found = []
        for i, j, both in _overlaps(near, [np.frombuffer(r[9], np.uint64) for r in rows]):
            if 100 * both >= least * (rows[i][6] + rows[j][6] - both) and (a := top(rows[i][5])) != (b := top(rows[j][5])):
                root[a] = b
                found.append((rows[i][4], rows[j][4]))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    left = written(_by_tiles(placed, _PLACED, _PLACED, narrow))
    return _by_tiles(left.join(sets.select("key", "tokens"), "key"), f"{_PLACED}, tokens binary", "a long, b long", compare)


def links(sets: DataFrame, least: int = LEAST, more: int = MORE_ORDERS, tile: int = TILE) -> DataFrame:
    """``(node, root)`` of all sets that have a partner, by components; ``sets`` as ``shared`` returns them."""
    spark = sets.sparkSession
    first = written(prefixes(sets, least, more))
    meets = first.select(F.explode("first").alias("t"), "key")
    counts = written(meets.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    meets = written(join_by_key(written(meets), counts, ["t"], total))
    edges, tree = (spark.range(0).select(F.col("id").alias(a), F.col("id").alias(b)) for a, b in (("a", "b"), ("node", "root")))
    if not total:
        return tree
    for turn in range(LEADERS):
        # Every set of a place against the place's first one; who is first changes with the turn.
        salt = F.lit(turn * 0x5DEECE66D1B54A35)
        lead = written(meets.groupBy("t").agg(F.min(F.col("key").bitwiseXOR(salt)).bitwiseXOR(salt).alias("a"), F.count(F.lit(1)).alias("n")))
        met = join_by_key(meets, lead, ["t"], total).filter("key <> a").select("a", F.col("key").alias("b")).distinct()
        if turn:
            comp = tree.select(F.col("node").alias("a"), F.col("root").alias("ra"))
            met = met.join(comp, "a", "left").join(comp.toDF("b", "rb"), "b", "left").filter("ra is null or rb is null or ra <> rb").select("a", "b")
        met = written(met)
        # A first set that meets many goes to a bin for each few hundred of them.
        many = written(met.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("bins", F.ceil(F.col("n") / BIN)))
        bins = join_by_key(met, many, ["a"], met.count()).select(F.xxhash64("a", F.pmod(F.xxhash64("b"), "bins")).alias("bin"), "a", "b")
        edges = written(edges.union(verified(written(bins), sets, least)))
        tree = written(components(edges))
    now = written(meets.join(tree.withColumnRenamed("node", "key"), "key", "left").select("t", "key", F.coalesce("root", "key").alias("comp")))
    open_places = now.groupBy("t").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    open_places = written(open_places.select("t", F.ceil(F.col("n") / tile).cast("int").alias("tiles"), "n"))
    here = join_by_key(now, open_places, ["t"], total)
    here = here.join(first, "key").withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles").cast("long")).cast("int"))
    ends = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") > k).cast("int").alias("side")))
    placed = here.withColumn("e", F.explode(ends)).select("t", "e.i", "e.j", "e.side", "key", "comp", "n", "first", "others")
    return written(components(written(edges.union(compared(placed, sets, least, more)))))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: int = LEAST, more: int = MORE_ORDERS, tile: int = TILE) -> DataFrame:
    """Per row: the id, ``n_shingles`` and ``component_id``, the least id reachable over links of at least ``least`` percent.

    Null and empty texts and texts without words have an empty set and link with nothing: their component is their own
    id. Repeated rows are kept and share a component. A null id stays null and is a component's id only if all its ids
    are null. Columns besides the two named are not read.
    """
    rows = written(marked(docs, id_col, text_col, size))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum("n")).first()[0] or 0) // PART))
    tree = links(shared(docs, text_col, size, least, parts), least, more, tile)
    full = rows.filter("key is not null")
    by_key = written(full.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    by_root = by_key.join(tree.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = written(by_root.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = written(join_by_key(written(by_root.select("key", "root", F.col("n").alias("rows"))), best, ["root"], by_key.count()).select("key", "component_id", F.col("rows").alias("n")))
    out = join_by_key(full.select("id", F.col("n").alias("size"), "key"), named, ["key"], rows.count()).select("id", "size", "component_id")
    alone = rows.filter("key is null").select("id", F.col("n").alias("size"), F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's number of shingles and component."""
    return classes(read_table(spark, sf_dir, "documents"))
