"""Rectangles on pages: what lies in which box, which line captions which figure, which rules make up a grid.

Every relation has ``id`` (the document), ``page`` and rectangles ``x``, ``y``, ``w``, ``h`` in points, y downwards. Rows are dealt
by page once, and those of a page are compared where they are. A page of more rows than DENSE is no key: pairs on it are found by
equality of the page and a cell of a grid laid over it, so its rows spread over as many keys as it has cells, and only rows that
share a cell are tested. Rows whose rectangle has a null side meet nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import written

#: Side of a grid cell in points; cells a rectangle is entered in along one axis at most (what lies beyond counts as the last).
CELL, MOST_CELLS = 48.0, 64
#: A box: its least area, its greatest share of the page, share of a block that it holds.
BOX_AREA, BOX_SHARE, HELD = 1200.0, 0.85, 0.6
#: Blocks that are no prose and stay as they are.
FRAMED = ("callout", "code", "table", "vector", "divider")
#: How far below a figure its caption begins, and the share of the caption's width that stands under it.
ABOVE, BELOW, UNDER = -2.0, 48.0, 0.5
CAPTION = r"^\s*(?:figure|fig\.|table|chart|exhibit|source:)"
#: Rules no thicker than this may touch; the gap over which they still do.
THICK, TOUCH = 6.0, 6.0
#: What rows are dealt by; rows of one kind above which a page's are found by cells; rounds of bids that are one pass.
PAGE, DENSE, PASS_ROUNDS = ["id", "page"], 2000, 3
#: Rules that a task gathers before it groups those of whole pages; pairs of them that it tests at a time.
PAGE_ROWS, LINKS = 200_000, 4_000_000


def _cell(at: Column) -> Column:
    """Number of the grid cell in which a coordinate lies; what lies off the grid counts as its first or last cell."""
    return F.greatest(F.lit(0), F.least(F.lit(MOST_CELLS - 1), F.floor(at / CELL))).cast("int")


def _cells(low: Column, high: Column) -> Column:
    """Numbers of the cells from one coordinate to another."""
    return F.sequence(_cell(low), _cell(high))


def _overlap(low: Column, high: Column, low2: Column, high2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(high, high2) - F.greatest(low, low2))


def _whole(*names: str) -> Column:
    """None of the columns is null or not a number."""
    return ~F.array_contains(F.array(*[F.col(n).isNull() | F.isnan(F.col(n).cast("double")) for n in names]), True)


def _crowded(rows: DataFrame, pages: DataFrame | None) -> DataFrame:
    """``(id, page)`` of large pages, by the column ``rows`` of ``pages`` or, without one, by counting. A number that is too large
    only changes the way in which pairs are found."""
    if pages is None or "rows" not in pages.columns:
        pages = rows.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("rows"))
    return pages.filter(F.col("rows") > DENSE).select(*PAGE).distinct()


def boxes(fills: DataFrame, pages: DataFrame) -> DataFrame:
    """Those of ``fills`` ``(id, page, fill, x, y, w, h, luminance, stroked)`` that may hold text: large, not of the page's
    size, not white unless they have an outline. ``pages`` has ``(id, page, width, height)``."""
    area = F.col("w") * F.col("h")
    seen = (F.coalesce(F.col("luminance"), F.lit(0.0)) <= 245) | F.col("stroked")
    large = fills.filter((area >= BOX_AREA) & seen)
    return large.join(pages.select("id", "page", "width", "height"), ["id", "page"]).filter(area < BOX_SHARE * F.col("width") * F.col("height")).drop("width", "height")


def callouts(blocks: DataFrame, fills: DataFrame, pages: DataFrame, smallest: bool = False) -> DataFrame:
    """``blocks`` ``(id, page, block, kind, x, y, w, h)`` with ``box``: the first drawn of the boxes that hold six tenths of it, or
    the smallest of them (ties: the first drawn); null for none and for blocks that are no prose.

    A block without area has no box. Repeated rows each get theirs. ``pages`` may tell the ``rows`` of each page.
    """
    blocks, able = blocks.repartition(*PAGE), boxes(fills.repartition(*PAGE), pages).filter(_whole("x", "y", "w", "h"))
    crowded = _crowded(fills, pages)
    able = able.select(*PAGE, "fill", *[F.col(c).alias(f"box_{c}") for c in "xywh"])
    near = _held_on_page(blocks.join(crowded, PAGE, "left_anti"), able.join(crowded, PAGE, "left_anti"), smallest)
    return near.union(_held_by_cell(blocks.join(crowded, PAGE, "left_semi"), able.join(crowded, PAGE, "left_semi"), smallest))


def _prose() -> Column:
    return ~F.coalesce(F.col("kind").isin(*FRAMED), F.lit(False)) & _whole("x", "y", "w", "h")


def _holds() -> Column:
    """Whether a box holds enough of a block."""
    wide = _overlap(F.col("x"), F.col("x") + F.col("w"), F.col("box_x"), F.col("box_x") + F.col("box_w"))
    high = _overlap(F.col("y"), F.col("y") + F.col("h"), F.col("box_y"), F.col("box_y") + F.col("box_h"))
    return (wide > 0) & (high > 0) & (wide * high >= HELD * F.col("w") * F.col("h"))


def _first_box(smallest: bool) -> Column:
    return F.min(F.when(F.col("box_x").isNotNull(), F.struct((F.col("box_w") * F.col("box_h")).alias("area"), "fill") if smallest else F.struct("fill")))["fill"]


def _held_on_page(blocks: DataFrame, able: DataFrame, smallest: bool) -> DataFrame:
    """``callouts`` of blocks and boxes that are dealt by page: all of a page are compared."""
    own = blocks.select(F.struct(*blocks.columns).alias("__own"), *PAGE, *"xywh", _prose().alias("__prose"), F.monotonically_increasing_id().alias("__row"))
    able = able.withColumnsRenamed({c: f"box_{c}" for c in PAGE})
    same = (F.col("id") == F.col("box_id")) & (F.col("page") == F.col("box_page"))
    met = own.hint("shuffle_hash").join(able, same & F.col("__prose") & _holds(), "left")
    held = met.groupBy(*PAGE, "__row").agg(F.first("__own").alias("__own"), _first_box(smallest).alias("__box"))
    return held.select("__own.*", F.col("__box").alias("box"))


def _held_by_cell(blocks: DataFrame, able: DataFrame, smallest: bool) -> DataFrame:
    """``callouts`` of blocks and boxes of large pages. What holds over half of a block's width and height holds its centre, so a
    block looks for boxes in one cell, and boxes are entered in all cells that they touch."""
    key = [*PAGE, "block", *"xywh"]
    prose = blocks.filter(_prose()).select(*key).distinct()
    prose = prose.withColumns({"gx": _cell(F.col("x") + F.col("w") / 2), "gy": _cell(F.col("y") + F.col("h") / 2)})
    able = able.withColumn("gx", F.explode(_cells(F.col("box_x"), F.col("box_x") + F.col("box_w")))).withColumn("gy", F.explode(_cells(F.col("box_y"), F.col("box_y") + F.col("box_h"))))
    held = prose.join(able, [*PAGE, "gx", "gy"]).filter(_holds()).groupBy(*key).agg(_first_box(smallest).alias("box"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    framed = F.coalesce(F.col("a.kind").isin(*FRAMED), F.lit(False))
    return blocks.alias("a").join(held.alias("b"), same, "left").select("a.*", F.when(~framed, F.col("b.box")).alias("box"))


def caption_pairs(lines: DataFrame, figures: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``(id, page, figure, line, distance)`` of all lines ``(id, page, line, x, y, w, h, text)`` that may caption a figure
    ``(id, page, figure, x, y, w, h)``: begun like a caption, just below it, for half their width under it.

    On large pages a line is entered in one band of the page's height, a figure in the bands that its captions may begin in: two.
    Pairs are dealt by page. ``pages``, if given, tells the ``rows`` of each page ``(id, page, rows)``.
    """
    said = lines.repartition(*PAGE).filter(F.rlike(F.lower("text"), F.lit(CAPTION)) & _whole("x", "y", "w")).select(
        *PAGE, "line", F.col("x").alias("line_x"), F.col("y").alias("line_y"), F.col("w").alias("line_w")
    )
    below = figures.repartition(*PAGE).filter(_whole("x", "y", "w", "h")).select(*PAGE, "figure", "x", "w", (F.col("y") + F.col("h")).alias("foot"))
    crowded = _crowded(figures, pages)
    distance = F.col("line_y") - F.col("foot")
    under = _overlap(F.col("line_x"), F.col("line_x") + F.col("line_w"), F.col("x"), F.col("x") + F.col("w"))
    fits = (distance >= ABOVE) & (distance < BELOW) & (under >= UNDER * F.col("line_w"))
    near = below.join(crowded, PAGE, "left_anti").hint("shuffle_hash").join(said, PAGE).filter(fits)
    band = BELOW - ABOVE
    bands = below.join(crowded, PAGE, "left_semi").withColumn("band", F.explode(F.sequence(F.floor((F.col("foot") + ABOVE) / band), F.floor((F.col("foot") + BELOW) / band))))
    far = bands.join(said.withColumn("band", F.floor(F.col("line_y") / band)), [*PAGE, "band"]).filter(fits)
    pairs = [met.select(*PAGE, "figure", "line", distance.alias("distance")) for met in (near, far)]
    return pairs[0].union(pairs[1].repartition(*PAGE)).repartition(*PAGE).distinct()


def _bid(pairs: DataFrame) -> DataFrame:
    """A round of bids over ``pairs``, dealt by page: those that may still come to be, with ``sure`` for those that do.

    A figure bids for its nearest line left; a line goes for good to the first figure of all that it might still come to.
    Such a pair is then alone with its figure and its line, and stays sure in any later round.
    """
    of_figure, of_line = Window.partitionBy(*PAGE, "figure"), Window.partitionBy(*PAGE, "line")
    first = pairs.withColumn("first", F.min("figure").over(of_line)).withColumn("nth", F.row_number().over(of_figure.orderBy("distance", "line")))
    sure = first.withColumn("sure", (F.col("nth") == 1) & (F.col("figure") == F.col("first"))).withColumn("gone", F.max("sure").over(of_figure))
    return sure.withColumn("gone", F.col("gone") | F.max("sure").over(of_line)).filter("sure or not gone").select("id", "page", "figure", "line", "distance", "sure")


def captions(lines: DataFrame, figures: DataFrame, rounds: int = 100, pages: DataFrame | None = None) -> DataFrame:
    """``(id, page, figure, line, distance)``: each figure's nearest caption (ties: the first line) that no earlier figure has.

    Figures bid for their nearest line left and lines go to the first figure that bids; who is turned away bids again
    in the next round. As every line ranks figures by their order, this ends with what taking figures one after the other
    gives. Rounds are few, as only figures that share lines are in a second one; more than ``rounds`` raise. Three rounds are
    one pass over a page's pairs, and only what they leave unsettled is dealt and written again.
    """
    left, taken = caption_pairs(lines, figures, pages), None
    for done in range(0, rounds, PASS_ROUNDS):
        for _ in range(min(PASS_ROUNDS, rounds - done)):
            left = _bid(left)
        table = written(left)
        sure = table.filter("sure").drop("sure")
        taken = sure if taken is None else taken.union(sure)
        left = table.filter("not sure").drop("sure").repartition(*PAGE)
        if not left.take(1):
            return taken
    raise RuntimeError(f"captions did not settle in {rounds} rounds")


def touching(rules: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of rules ``(id, page, rule, x, y, w, h, thickness)`` of a page that lie within TOUCH points of one
    another, each once; ends are structs ``(id, page, rule)``.

    Rules, grown by half that gap, meet in the cells that they touch; a pair counts in the first cell that both touch.
    """
    grown = rules.filter((F.col("thickness") <= THICK) & _whole("x", "y", "w", "h")).select(
        "id", "page", "rule", (F.col("x") - TOUCH / 2).alias("x0"), (F.col("x") + F.col("w") + TOUCH / 2).alias("x1"), (F.col("y") - TOUCH / 2).alias("y0"), (F.col("y") + F.col("h") + TOUCH / 2).alias("y1")
    )
    placed = grown.withColumn("gx", F.explode(_cells(F.col("x0"), F.col("x1")))).withColumn("gy", F.explode(_cells(F.col("y0"), F.col("y1"))))
    other = placed.select("id", "page", "gx", "gy", *[F.col(c).alias(f"{c}_") for c in ("rule", "x0", "x1", "y0", "y1")])
    meets = (F.col("x0") <= F.col("x1_")) & (F.col("x0_") <= F.col("x1")) & (F.col("y0") <= F.col("y1_")) & (F.col("y0_") <= F.col("y1"))
    here = (F.col("gx") == _cell(F.greatest("x0", "x0_"))) & (F.col("gy") == _cell(F.greatest("y0", "y0_")))
    pairs = placed.join(other, ["id", "page", "gx", "gy"]).filter((F.col("rule") < F.col("rule_")) & meets & here)
    return pairs.select(F.struct("id", "page", "rule").alias("a"), F.struct("id", "page", F.col("rule_").alias("rule")).alias("b"))


def _least_linked(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """``root``, a least row known for each of ``n`` rows, with the components that the links ``(a, b)`` join made one."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while (root != (up := root[root])).any():
            root = up


def _roots(start: np.ndarray, known: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """For each rule of whole pages the first one that touching rules lead to. ``start``: whether a row begins a page; ``known``:
    whether it is the same rule as the one before.

    A rule meets those of its page that begin, from left to right, before it ends: a stretch of the rows sorted by page and left
    edge. Stretches are tested LINKS pairs at a time.
    """
    n, page = len(start), np.cumsum(start)
    by = np.lexsort((x0, page))
    root = np.arange(n)
    same = np.flatnonzero(known)
    root = _least_linked(n, same - 1, same, root)
    # Left edges of all pages on one line: a page's stand beyond those of the page before.
    left, right = (np.unique(np.concatenate([x0, x1]), return_inverse=True)[1].reshape(2, n))
    at = page[by] * (2 * n + 1) + left[by]
    last = np.searchsorted(at, page[by] * (2 * n + 1) + right[by], "right")
    many = np.maximum(last - np.arange(n) - 1, 0)
    done, total = 0, np.concatenate([[0], np.cumsum(many)])
    while done < n:
        # At least one row at a time.
        to = max(done + 1, int(np.searchsorted(total, total[done] + LINKS, "right")) - 1)
        size = many[done:to]
        a = np.repeat(np.arange(done, to), size)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[done:to] - total[done], size)
        a, b = by[a], by[b]
        met = (x0[a] <= x1[b]) & (x0[b] <= x1[a]) & (y0[a] <= y1[b]) & (y0[b] <= y1[a])
        root = _least_linked(n, a[met], b[met], root)
        done = to
    return root


def grouped(rules: DataFrame) -> DataFrame:
    """``rules`` that are thin enough with ``root``, as ``rule_groups`` names it. Rules are dealt by page and sorted; a task
    holds some whole pages at a time."""
    whole = rules.filter((F.col("thickness") <= THICK) & _whole("x", "y", "w", "h"))
    sides = [F.col("x") - TOUCH / 2, F.col("x") + F.col("w") + TOUCH / 2, F.col("y") - TOUCH / 2, F.col("y") + F.col("h") + TOUCH / 2]
    sides = [c.cast("double").alias(f"__{k}") for k, c in enumerate(sides)]
    dealt = whole.select("*", F.col("rule").alias("root"), *sides).repartition(*PAGE).sortWithinPartitions(*PAGE, "rule")

    def differs(table: pa.Table, name: str) -> np.ndarray:
        col = table[name].combine_chunks()
        return np.concatenate([[True], pc.fill_null(pc.not_equal(col[1:], col[:-1]), True).to_numpy(zero_copy_only=False)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
            start = differs(table, "id") | differs(table, "page")
            # A rule without a number is a page of its own: it touches nothing.
            rule = table["rule"].combine_chunks()
            unnamed = pc.is_null(rule).to_numpy(zero_copy_only=False)
            start |= unnamed | np.concatenate([[False], unnamed[:-1]])
            roots = _roots(start, ~(start | differs(table, "rule")), *[table[f"__{k}"].to_numpy() for k in range(4)])
            yield from table.set_column(table.schema.get_field_index("root"), "root", rule.take(pa.array(roots))).drop_columns([f"__{k}" for k in range(4)]).to_batches()

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PAGE_ROWS:
                table = pa.Table.from_batches(held)
                first = np.flatnonzero(differs(table, "id") | differs(table, "page"))[-1]
                # The last page may go on.
                if first:
                    yield from solved(table.slice(0, first))
                held, rows = table.slice(first).to_batches(), 0
        if held:
            yield from solved(pa.Table.from_batches(held))

    return dealt.mapInArrow(find, dealt.drop(*[f"__{k}" for k in range(4)]).schema)


def rule_groups(rules: DataFrame) -> DataFrame:
    """``(id, page, rule, root)`` of all rules thin enough: ``root`` is the least rule that touching rules lead to."""
    return grouped(rules.select(*PAGE, "rule", *"xywh", "thickness")).select(*PAGE, "rule", "root")


def clustered(values: Column, tolerance: float) -> Column:
    """An array of coordinates, ascending, with those merged that lie within ``tolerance`` of the one before: a merged one
    moves half way to each that joins it, so the order of the values decides. Nulls are left out."""
    step = lambda out, v: F.when(
        F.size(out) == 0, F.array(v)
    ).when(v - F.element_at(out, -1) <= tolerance, F.concat(F.slice(out, 1, F.size(out) - 1), F.array((F.element_at(out, -1) + v) / 2))).otherwise(F.concat(out, F.array(v)))
    known = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(known) > 0, F.aggregate(F.slice(known, 2, F.greatest(F.size(known) - 1, F.lit(1))), F.slice(known, 1, 1), step)).otherwise(known)
