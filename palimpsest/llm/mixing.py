"""Mixing overlapping sources to target weights: min-cost flow over membership patterns, then seeded selection.

Documents are aggregated by membership pattern, the set of sources they belong to. Each pattern offers its words once
at no cost and again, copy by copy, at growing cost; each source asks for its quota. The flow of least cost says how
many words of a pattern go to which source; patterns are few, so it is solved on the driver. Within a pattern, every
document is taken the whole number of times that the flow affords, and one time more in the order of a seeded hash
until the rest is used up; a document too large for what is left is passed over, again and again until little is left,
and a last one is chosen among all that are left, those passed over too, whose size fits best. The cuts are found by
global prefix sums, so a source that holds a third of all rows needs no task of its own, and selection is a comparison of
a row's own hash and size with its pattern's cuts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, durable, free_names, own_columns, prefix_sums, quoted, read_table

SEED = 20
WEIGHTS = (3, 1, 2)
SHARE = 1.5
COPIES = 2
#: Share of a pattern's rest that may stay open when documents too large for what is left are no longer passed over, and
#: the passes over the keys after which it stops in any case.
GAP, MOST_FILLS = 1 / 1000, 24
#: Patterns beyond which the driver refuses to solve the flow.
MOST_PATTERNS = 50_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = COPIES) -> list[float]:
    """Quotas that add up to ``share`` of all sizes by weight, none above ``cap`` times its source; excess is reshared."""
    left, quota = share * sum(sizes), [0.0] * len(sizes)
    live = [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    while live:
        by_weight = sum(weights[i] for i in live)
        full = [i for i in live if left * weights[i] / by_weight > cap * sizes[i]]
        if not full:
            for i in live:
                quota[i] = left * weights[i] / by_weight
            break
        for i in full:
            quota[i] = float(cap * sizes[i])
        left -= sum(quota[i] for i in full)
        live = [i for i in live if i not in set(full)]
    return quota


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], copies: int = COPIES) -> list[dict[int, int]]:
    """Words of each pattern to each source: quotas met as far as possible at least repetition cost.

    The k-th copy of a word costs k - 1. Successive shortest paths: with a convex cost, a unit goes to the pattern
    whose next copy is cheapest among those that reach a hungry source, possibly by moving another source's words.
    """
    used, sent = [0] * len(supply), [dict.fromkeys(m, 0) for m in members]
    by_source: dict[int, list[int]] = {}
    for p, m in enumerate(members):
        for s in m:
            by_source.setdefault(s, []).append(p)
    need = list(quota)

    def path(start: int, level: int) -> list[tuple[int, int]] | None:
        """Steps (source, pattern) from a hungry source: it takes the pattern's words from the next step's source, and
        the last pattern still has words at this level."""
        back: dict[int, tuple[int, int] | None] = {start: None}
        queue = [start]
        for t in queue:
            for p in by_source.get(t, ()):
                if used[p] < (level + 1) * supply[p]:
                    steps, at = [(t, p)], back[t]
                    while at is not None:
                        steps.append(at)
                        at = back[at[0]]
                    return steps[::-1]
            for p in by_source.get(t, ()):
                for u in members[p]:
                    if u not in back and sent[p][u] > 0:
                        back[u] = (t, p)
                        queue.append(u)
        return None

    for level in range(copies):
        for s in sorted(by_source):
            while need[s] > 0 and (steps := path(s, level)):
                givers = [(steps[i + 1][0], p) for i, (_, p) in enumerate(steps[:-1])]
                last = steps[-1][1]
                push = min([need[s], (level + 1) * supply[last] - used[last], *(sent[p][u] for u, p in givers)])
                for t, p in steps:
                    sent[p][t] += push
                for u, p in givers:
                    sent[p][u] -= push
                used[last] += push
                need[s] -= push
    return sent


@dataclass(frozen=True)
class Cut:
    """A pattern's whole copies, the stretches of hashes (from, to but not including, largest size) that are taken once
    more, and the hash of the last row, which fits best."""

    copies: int
    stretches: tuple[tuple[int, int, int], ...] = ()
    extra: int | None = None


@dataclass(frozen=True)
class Plan:
    """``patterns``: for each list of sources its Cut; ``sizes`` and ``quota`` by source; ``flow`` by pattern and source."""

    patterns: list[tuple[list, Cut]]
    sizes: dict
    quota: dict
    flow: list[dict]


#: Working columns of the rows that are mixed.
MEMBERS, SIZE, RANK, COPIES_TAKEN = "__members", "__size", "__rank", "__copies"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` with ``__members`` (sorted distinct sources), ``__size`` (words) and ``__rank`` (seeded hash of id and text)."""
    text = F.col(quoted(text_col))
    return docs.select(
        *own_columns(docs),
        F.array_sort(F.array_distinct(members)).alias(MEMBERS),
        words_of(text).alias(SIZE),
        F.xxhash64(F.lit(seed), F.col(quoted(id_col)), F.coalesce(text, F.lit(""))).alias(RANK),
    )


def _order(name) -> tuple:
    return (name is None, name or "")


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> Plan:
    """The mix of ``keyed`` rows (``__members``, ``__size``, ``__rank``). A row without sources belongs to none and is not taken."""
    spark = rows.sparkSession
    found = rows.groupBy("__members").agg(F.sum("__size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} membership patterns")
    lists = sorted(([list(r["__members"] or []), r["n"]] for r in found), key=lambda x: [_order(s) for s in x[0]])
    names = sorted({s for m, _ in lists for s in m}, key=_order)
    number = {s: i for i, s in enumerate(names)}
    size = [0] * len(names)
    for m, n in lists:
        for s in m:
            size[number[s]] += n
    # A document of several sources counts in each of them, but its words exist once.
    total = sum(n for m, n in lists if m)
    scale = total / sum(size) if sum(size) else 0.0
    quota = targets(size, [weights[i % len(weights)] for i in range(len(names))], share * scale, copies)
    flow = min_cost_flow([n for _, n in lists], [[number[s] for s in m] for m, _ in lists], [round(q) for q in quota], copies)
    whole = [sum(f.values()) // n if n else 0 for f, (_, n) in zip(flow, lists)]
    rest = [sum(f.values()) - w * n for f, w, (_, n) in zip(flow, whole, lists)]
    cuts = [Cut(w) for w in whole]
    if lists:
        cuts = _cuts(spark, rows, lists, whole, rest)
    return Plan(
        [(m, c) for (m, _), c in zip(lists, cuts)], dict(zip(names, size)), dict(zip(names, quota)),
        [{names[s]: x for s, x in f.items()} for f in flow],
    )


def _table(spark: SparkSession, lists: list, columns: str, values: list[tuple]) -> DataFrame:
    """A row per pattern: few, checked against MOST_PATTERNS, and so fit for a broadcast."""
    return F.broadcast(spark.createDataFrame([(m, *v) for (m, *_), v in zip(lists, values)], f"__key array<string>, {columns}"))


def _cuts(spark: SparkSession, rows: DataFrame, lists: list, whole: list[int], rest: list[int]) -> list[Cut]:
    number = _table(spark, lists, "p int", [(i,) for i in range(len(lists))])
    lean = rows.select("__members", "__size", "__rank").join(number, F.col("__members").eqNullSafe(F.col("__key"))).select("p", "__rank", "__size")
    low, high = -(2**63), 2**63 - 1
    stretches: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    # Of each pattern: the hash after which rows are free, what is left to take, and the largest size that may be.
    state = {i: (low, r, high) for i, r in enumerate(rest) if r}
    # What is still to take when no more fills follow.
    short: dict[int, int] = {}
    for _ in range(MOST_FILLS):
        if not state:
            break
        info = F.broadcast(spark.createDataFrame([(i, *v) for i, v in state.items()], "p int, after long, left long, most long"))
        fit = lean.join(info, "p").filter((F.col("__rank") > F.col("after")) & (F.col("__size") <= F.col("most")) | (F.col("after") == low))
        laid, _ = prefix_sums(fit, ["p", "__rank", "__size"], ["__size"])
        start = F.broadcast(laid.groupBy("p").agg(F.min("before___size").alias("start")))
        inside = F.col("before___size") - F.col("start")
        past = F.when(inside + F.col("__size") > F.col("left"), F.struct(F.col("__rank").alias("r"), (F.col("left") - inside).alias("left")))
        found = laid.join(start, "p").groupBy("p").agg(F.min(past).alias("x"), F.sum("__size").alias("fits")).collect()
        ends = {r["p"]: (r["x"]["r"], r["x"]["left"]) for r in found if r["x"]}
        fits = {r["p"]: r["fits"] for r in found}
        then = {}
        for i, (after, left, most) in state.items():
            if i not in ends:  # all that is free fits
                stretches[i].append((after, high, most))
                if left > fits.get(i, 0):
                    short[i] = left - fits.get(i, 0)
                continue
            upto, left = ends[i]
            stretches[i].append((after, upto, most))
            if left > GAP * rest[i]:
                then[i] = (upto, left, left)
            elif left:
                short[i] = left
        state = then
    extra: dict[int, int] = {}
    short |= {i: left for i, (_, left, _) in state.items()}
    if short:
        kind = "p int, left long, taken array<struct<a:long,b:long,most:long>>"
        info = F.broadcast(spark.createDataFrame([(i, left, stretches[i]) for i, left in short.items()], kind))
        rank, size = F.col("__rank"), F.col("__size")
        free = ~F.exists("taken", lambda s: (rank >= s["a"]) & (rank < s["b"]) & (size <= s["most"]))
        gap = F.abs(size - F.col("left"))
        best = (
            lean.join(info, "p").filter(free & (gap < F.col("left")))
            .groupBy("p").agg(F.min(F.struct(gap.alias("g"), rank.alias("e"))).alias("x")).collect()
        )
        extra = {r["p"]: r["x"]["e"] for r in best}
    return [Cut(w, tuple(stretches[i]), extra.get(i)) for i, w in enumerate(whole)]


def copies_column(rows: DataFrame, made: Plan) -> DataFrame:
    """``keyed`` rows with ``__copies``, how many times the mix takes the row: a narrow pass."""
    lists = [[m] for m, _ in made.patterns]
    if not lists:
        return rows.withColumn("__copies", F.lit(0))
    kind = "__times int, __taken array<struct<a:long,b:long,most:long>>, __extra long"
    table = _table(rows.sparkSession, lists, kind, [(c.copies, list(c.stretches), c.extra) for _, c in made.patterns])
    rank, size = F.col("__rank"), F.col("__size")
    inside = F.exists("__taken", lambda s: (rank >= s["a"]) & (rank < s["b"]) & ((size <= s["most"])))
    once = F.coalesce(inside, F.lit(False)) | F.coalesce(rank == F.col("__extra"), F.lit(False))
    joined = rows.join(table, F.col("__members").eqNullSafe(F.col("__key")), "left")
    return joined.withColumn("__copies", F.coalesce("__times", F.lit(0)) + once.cast("int")).drop("__key", "__times", "__taken", "__extra")


def mixed(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, as often as they are taken. Rows without words are kept once: they have no weight."""
    # Columns of the caller that are called like working columns stand aside meanwhile.
    aside = free_names(docs, *(f"__own{k}" for k in range(len(docs.columns))))
    own = docs.select([F.col(quoted(c)).alias(n) for c, n in zip(docs.columns, aside)])
    at = {c: n for c, n in zip(docs.columns, aside)}
    rows = keyed(own, F.array(F.col(at[source_col]).cast("string")), at[id_col], at[text_col], seed)
    made = plan(durable(rows.select(MEMBERS, SIZE, RANK)))
    taken = copies_column(rows, made)
    times = F.when(F.col(SIZE) == 0, F.lit(1)).otherwise(F.col(COPIES_TAKEN))
    nth = taken.filter(times > 0).withColumn("__nth", F.explode(F.sequence(F.lit(1), times)))
    return nth.select([F.col(n).alias(c) for c, n in at.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: words taken of every document by the mix of all sources."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # Texts are read once; the rounds below go over keys and sizes.
    rows = durable(keyed(docs, F.array("source")).select("doc_id", "__members", "__size", "__rank"))
    made = plan(rows)
    per = F.broadcast(
        spark.createDataFrame([([s], n, float(made.quota[s])) for s, n in made.sizes.items()], "__source array<string>, source_size long, target double")
    )
    return copies_column(rows, made).join(per, F.col("__members").eqNullSafe(F.col("__source"))).select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).cast("long").alias("taken")
    )
