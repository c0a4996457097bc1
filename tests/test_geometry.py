"""Joins of rectangles against plain loops over all pairs of a page."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.durable import written
from palimpsest.operators import geometry as g
from palimpsest.operators import graph

RECT = "x double, y double, w double, h double"


def rect(r, wide=200, high=120):
    return (r.uniform(-20, 620), r.uniform(-20, 800), r.uniform(0, wide), r.uniform(0, high))


def overlap(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else None


def plain_plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("smallest", [False, True])
def test_blocks_are_held_by_the_boxes_that_a_plain_loop_finds(spark, smallest):
    r = random.Random(5)
    pages = [(d, p, 612.0, 792.0) for d in range(4) for p in range(3)]
    fills, blocks = [], []
    for d, p, w, h in pages:
        for k in range(30):
            x = rect(r, 400, 400) if k % 3 else (100.0, 100.0, 200.0, 90.0)
            fills.append((d, p, k, *x, r.choice([None, 10.0, 250.0]), r.random() < 0.3))
        fills.append((d, p, 30, 0.0, 0.0, w, h, 100.0, False))
        for k in range(60):
            x = rect(r, 150, 40) if k % 4 else (100.0 + k % 3, 110.0, 190.0, 0.0 if k % 8 else 20.0)
            blocks.append((d, p, k, r.choice(["paragraph", "paragraph", "heading", "table", None]), *x))
    blocks += [blocks[0], (9, 9, 1, "paragraph", None, 1.0, 1.0, 1.0), (0, 0, 99, "paragraph", 110.0, 110.0, 5.0, float("nan"))]
    tables = (
        spark.createDataFrame(blocks, f"id long, page int, block int, kind string, {RECT}").withColumn("a.b", F.lit(1)).drop("a.b"),
        spark.createDataFrame(fills, f"id long, page int, fill int, {RECT}, luminance double, stroked boolean"),
        spark.createDataFrame(pages, "id long, page int, width double, height double"),
    )
    made = g.callouts(*tables, smallest=smallest)
    assert "Cartesian" not in plain_plan(made) and "NestedLoop" not in plain_plan(made)
    got = sorted((r.id, r.page, r.block, r.box if r.box is not None else -1) for r in made.collect())
    want = []
    for d, p, k, kind, *x in blocks:
        held = []
        if kind not in g.FRAMED and None not in x and x[3] == x[3]:
            for e, q, n, *rest in fills:
                y, luminance, stroked = rest[:4], rest[4], rest[5]
                area = y[2] * y[3]
                if (e, q) == (d, p) and 1200 <= area < 0.85 * 612 * 792 and ((luminance or 0) <= 245 or stroked):
                    both = overlap(x, y)
                    if both is not None and both >= 0.6 * x[2] * x[3]:
                        held.append((area if smallest else 0, n))
        want.append((d, p, k, min(held)[1] if held else -1))
    assert got == sorted(want) and sum(w[3] >= 0 for w in want) > 100
    assert g.callouts(*(t.limit(0) for t in tables)).collect() == []


@pytest.mark.parametrize("smallest", [False, True])
def test_large_pages_are_laid_out_as_small_ones_are(spark, monkeypatch, smallest):
    r = random.Random(8)
    make = lambda n: [(d, p, k, *rect(r)) for d, m in ((0, n), (1, 8)) for p in range(2) for k in range(m)]
    blocks = spark.createDataFrame(make(60), f"id long, page int, block int, {RECT}").withColumn("kind", F.lit("paragraph"))
    fills = spark.createDataFrame(make(40), f"id long, page int, fill int, {RECT}").withColumns({"luminance": F.lit(1.0), "stroked": F.lit(False)})
    lines = spark.createDataFrame(make(60), f"id long, page int, line int, {RECT}").withColumn("text", F.lit("Figure"))
    pages = blocks.select("id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).distinct()
    told = pages.withColumn("rows", F.when(F.col("id") == 0, 40).otherwise(8))
    got = []
    # All pages compared in place; one document's found by cells, as its rows are counted; the same, as they are told.
    for dense, of in ((2000, pages), (20, pages), (20, told)):
        monkeypatch.setattr(g, "DENSE", dense)
        boxes = g.callouts(blocks.union(blocks.limit(5)), fills, of, smallest).collect()
        found = g.caption_pairs(lines, fills.withColumnRenamed("fill", "figure"), of if of is told else None).collect()
        got.append((sorted((x.id, x.page, x.block, -1 if x.box is None else x.box) for x in boxes), sorted(map(tuple, found))))
    assert got[0] == got[1] == got[2] and len(got[0][1]) > 20 and sum(x[3] >= 0 for x in got[0][0]) > 20


def test_cells_of_boxes_are_not_shuffled(spark):
    # Rows of a page of usual size are sent once, each as one row: the two exchanges by page.
    schema = f"id long, page int, fill int, {RECT}, luminance double, stroked boolean"
    fills = spark.createDataFrame([(0, 0, k, 0.0, 0.0, 500.0, 500.0, 1.0, True) for k in range(9)], schema).repartition(3)
    blocks = fills.select("id", "page", F.col("fill").alias("block"), F.lit("paragraph").alias("kind"), F.lit(9.0).alias("x"), F.lit(9.0).alias("y"), F.lit(9.0).alias("w"), F.lit(9.0).alias("h"))
    pages = fills.select("id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(9).alias("rows")).distinct()
    made = g.callouts(blocks, fills, pages)
    first = lambda df: df.agg(F.count("box"), F.min("box"), F.max("box")).first()
    assert tuple(first(made)) == (9, 0, 0)
    # The plan's first branch is that of such pages.
    branch = plain_plan(made).split(":- ", 1)[1].split("\n+- ")[0]
    assert "Generate" not in branch and "gx" not in branch


def test_rounds_of_bids_are_not_written_one_by_one(spark, monkeypatch):
    # Figure k bids for line 0 first, and only then for its own: two rounds and more.
    lines = [(0, 0, k, 0.0, 100.0 + k, 50.0, 9.0, "Figure") for k in range(3)]
    figures = [(0, 0, k, 0.0, 50.0, 100.0, 50.0) for k in range(3)]
    kept, tables = g.written, []
    monkeypatch.setattr(g, "written", lambda df: tables.append(1) or kept(df))
    got = g.captions(spark.createDataFrame(lines, f"id long, page int, line int, {RECT}, text string"), spark.createDataFrame(figures, f"id long, page int, figure int, {RECT}")).collect()
    assert sorted((x.figure, x.line) for x in got) == [(0, 0), (1, 1), (2, 2)] and len(tables) == 1


def test_rules_are_grouped_in_one_pass_over_pages(spark, monkeypatch):
    # Pages of several batches, stretches of pairs cut short, repeated and unnamed rules, rules without a page: as by links.
    r = random.Random(11)
    thin = lambda: r.choice([(0.5, r.uniform(5, 60)), (r.uniform(5, 60), 0.5), (-2.0, 3.0)])
    rules = [(d, p, r.choice([None, *range(n)]) if k % 17 == 0 else k, r.uniform(0, 300), r.uniform(0, 300), *thin(), r.choice([1.0, 1.0, 7.0])) for d, p, n in [(0, 0, 400), (0, 1, 3), (1, 0, 90), (2, None, 30)] for k in range(n)]
    rules = spark.createDataFrame(rules, f"id long, page int, rule int, {RECT}, thickness double")
    tree = {tuple(x.node): x.root.rule for x in graph.components(g.touching(rules)).collect()}
    want = sorted((str(x.id), str(x.page), str(x.rule), str(tree.get((x.id, x.page, x.rule), x.rule))) for x in rules.filter("thickness < 6").collect())
    monkeypatch.setattr(g, "PAGE_ROWS", 50)
    monkeypatch.setattr(g, "LINKS", 100)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    began = spark.sparkContext.statusTracker().getJobIdsForGroup()
    try:
        made = g.rule_groups(rules)
        # Nothing has run yet: no rounds of tables.
        assert spark.sparkContext.statusTracker().getJobIdsForGroup() == began
        assert sorted(tuple(map(str, x)) for x in made.collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert 20 < len({x[:2] + x[3:] for x in want}) < len(want) - 20


def test_captions_equal_taking_figures_one_after_the_other(spark):
    r = random.Random(6)
    lines, figures = [], []
    for d in range(6):
        for k in range(40):
            lines.append((d, 0, k, r.uniform(0, 500), float(r.randrange(0, 700, 5)), r.uniform(10, 300), 10.0, r.choice(["Figure 1", " fig. 2: x", "Source: y", "TABLE", "chart", "prose", "Figment", None])))
            figures.append((d, 0, k, r.uniform(0, 400), float(r.randrange(0, 600, 5)), r.uniform(50, 300), float(r.randrange(0, 60, 5))))
    # One line under a row of figures, each of which has one more line that the next one also has.
    for k in range(12):
        figures.append((7, 0, k, 0.0, 0.0, 300.0, 10.0 + k % 2))
        lines.append((7, 0, k, 0.0, 12.0 + k, 200.0, 5.0, "Figure"))
    lines.append((8, 0, 1, None, 1.0, 1.0, 1.0, "Figure"))
    figures.append((8, 0, 1, 0.0, 0.0, float("nan"), 1.0))
    got = g.captions(spark.createDataFrame(lines, f"id long, page int, line int, {RECT}, text string"), spark.createDataFrame(figures, f"id long, page int, figure int, {RECT}"))
    want, used = [], set()
    for d, p, k, *x in sorted(figures, key=lambda f: (f[0], f[2])):
        best = None
        for e, _, n, lx, ly, lw, _, text in lines:
            if e != d or lx is None or x[2] != x[2] or (e, n) in used or not (text or "").strip().lower().startswith(("figure", "fig.", "table", "chart", "exhibit", "source:")):
                continue
            distance = ly - (x[1] + x[3])
            under = max(0.0, min(lx + lw, x[0] + x[2]) - max(lx, x[0]))
            if -2 <= distance < 48 and under >= 0.5 * lw and (best is None or (distance, n) < best):
                best = distance, n
        if best:
            used.add((d, best[1]))
            want.append((d, k, best[1]))
    assert sorted((r.id, r.figure, r.line) for r in got.collect()) == sorted(want) and len(want) > 30


def plain_groups(rules):
    up = {x[:3]: x[:3] for x in rules}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in rules:
        for b in rules:
            if a[:2] == b[:2] and a[7] <= 6 and b[7] <= 6:
                near = all(a[3 + s] - 3 <= b[3 + s] + b[5 + s] + 3 and b[3 + s] - 3 <= a[3 + s] + a[5 + s] + 3 for s in (0, 1))
                if near and top(a[:3]) != top(b[:3]):
                    x, y = sorted((top(a[:3]), top(b[:3])))
                    up[y] = x
    return sorted((*x[:3], top(x[:3])[2]) for x in rules if x[7] <= 6)


def test_rule_groups_equal_union_find_and_long_chains_settle(spark):
    r = random.Random(7)
    rules = []
    for d in range(3):
        for k in range(120):
            long, at = r.uniform(5, 120), (r.uniform(0, 600), r.uniform(0, 700))
            rules.append((d, 0, k, *at, *((long, 0.5) if k % 2 else (0.5, long)), r.choice([0.5, 1.0, 7.0])))
    names = list(range(400))
    r.shuffle(names)
    rules += [(5, 1, n, 10.0 * (k % 60), 100.0 * (k // 60), 9.0, 0.5, 1.0) for k, n in enumerate(names)]  # rows of pieces that touch
    rules += [(5, 2, n, 0.0, 8.0 * k, 300.0, 0.5, 1.0) for k, n in enumerate(names[:90])]
    got = g.rule_groups(spark.createDataFrame(rules, f"id long, page int, rule int, {RECT}, thickness double"))
    assert sorted((r.id, r.page, r.rule, r.root) for r in got.collect()) == plain_groups(rules)


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(k, k + 1) for k in range(0, 500)]
    star = [(10_000 - k, 9_000) for k in range(1, 300)] + [(9_000, 10_001)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain + star + [(7, 7), (None, 3)], "a long, b long")).collect()}
    assert {got[k] for k in range(501)} == {0} and {got[k] for k in range(9_701, 10_000)} == {9_000} == {got[10_001], got[9_000]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_coordinates_cluster_like_a_plain_loop(spark):
    r = random.Random(9)
    rows = [[round(r.uniform(0, 60), 1) for _ in range(r.randrange(40))] for _ in range(80)] + [[], [5.0], [1.0, None, 4.0, 4.0, 8.5]]
    got = spark.createDataFrame([(v,) for v in rows], "v array<double>").select(g.clustered(F.col("v"), 3.0).alias("c")).collect()

    def plain(values):
        out = []
        for v in sorted(x for x in values if x is not None):
            if out and v - out[-1] <= 3.0:
                out[-1] = (out[-1] + v) / 2
            else:
                out.append(v)
        return out

    assert sorted(r.c for r in got) == sorted(plain(v) for v in rows)


def test_written_tables_are_shuffled_by_joins_not_sent(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 7).alias("root"))
    made = written(rows)
    for right in (made, made.filter("root > 0").select("id"), made.groupBy("id").agg(F.max("root").alias("most"))):
        plan = plain_plan(rows.join(right, "id"))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
