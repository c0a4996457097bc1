"""Tables drawn with rules come back cell by cell, with their spans."""

import random

import pytest

from palimpsest.operators import tables

RULES = "id long, page int, rule int, vertical boolean, x double, y double, w double, h double, thickness double"
WORDS = "id long, page int, word int, x double, y double, w double, h double, size double, bold boolean, text string"
PAGES = "id long, page int, width double, height double"


def drawn(cells, columns, rows, at=(50.0, 60.0), size=(60.0, 20.0), pieces=False, id_=1, page=0, first=0):
    """Rules and words of a table whose cells are (row, col, rowspan, colspan, text): each cell's border, or rules of full
    length cut only where a cell spans them."""
    edges = set()
    for r, c, high, wide, _ in cells:
        edges |= {(True, x, y) for x in (c, c + wide) for y in range(r, r + high)} | {(False, y, x) for y in (r, r + high) for x in range(c, c + wide)}
    rules = []
    for vertical in (True, False):
        for line in range((columns if vertical else rows) + 1):
            run = None
            for k in range((rows if vertical else columns) + 1):
                here = (vertical, line, k) in edges
                if here and run is None:
                    run = k
                if run is not None and (not here or pieces):
                    rules.append((vertical, line, run, k if not here else k + 1))
                    run = None if not here else (None if pieces else run)
    out = []
    for n, (vertical, line, lo, hi) in enumerate(sorted(set(rules))):
        x = at[0] + (line if vertical else lo) * size[0]
        y = at[1] + (lo if vertical else line) * size[1]
        long = (hi - lo) * (size[1] if vertical else size[0])
        out.append((id_, page, first + n, vertical, x - 0.25 * vertical, y - 0.25 * (not vertical), 0.5 if vertical else long, long if vertical else 0.5, 0.5))
    words = []
    for r, c, high, wide, text in cells:
        for n, line in enumerate(text.split("\n")):
            for k, word in enumerate(line.split()):
                words.append((id_, page, first + len(words), at[0] + c * size[0] + 4 + 14 * k, at[1] + r * size[1] + 3 + 9 * n, 12.0, 6.0, 8.0, r == 0, word))
    return out, words


def back(spark, rules, words, pages=((1, 0, 612.0, 792.0),), stitch=False):
    made = tables.cells(spark.createDataFrame(rules, RULES), spark.createDataFrame(words, WORDS), spark.createDataFrame(list(pages), PAGES))
    return tables.stitched(made).collect() if stitch else made.collect()


def some_cells(r, columns, rows):
    """A random partition of a grid into cells, some of which span."""
    free, out = {(y, x) for y in range(rows) for x in range(columns)}, []
    for y in range(rows):
        for x in range(columns):
            if (y, x) not in free:
                continue
            wide = 2 if r.random() < 0.2 and (y, x + 1) in free and y else 1
            # The last column keeps every line between rows: one that no cell ends at would not be drawn at all.
            high = 2 if r.random() < 0.2 and x + wide < columns and y + 1 < rows and all((y + 1, x + k) in free for k in range(wide)) and y else 1
            free -= {(y + a, x + b) for a in range(high) for b in range(wide)}
            out.append((y, x, high, wide, f"c{y}.{x} t" + ("\nmore" if high == 2 else "")))
    return out


@pytest.mark.parametrize("pieces", [False, True])
def test_drawn_tables_come_back_cell_by_cell(spark, pieces):
    r = random.Random(3)
    rules, words, pages, want = [], [], [], []
    for d in range(12):
        columns, rows = r.randrange(2, 7), r.randrange(3, 12)
        cells = some_cells(r, columns, rows)
        a, b = drawn(cells, columns, rows, pieces=pieces, id_=d)
        rules += a
        words += b
        pages.append((d, 0, 612.0, 792.0))
        want += [(d, y, x, h, w, y == 0, t) for y, x, h, w, t in cells]
    assert any(w[3] > 1 for w in want) and any(w[4] > 1 for w in want)
    got = back(spark, rules, words, pages)
    assert sorted((c.id, c.row, c.col, c.rowspan, c.colspan, c.header, c.text) for c in got) == sorted(want)


def test_frames_cards_and_lone_rules_are_no_tables(spark):
    def frame(k, x, y, w, h):
        return [(1, 0, k, False, x, y, w, 0.5, 1.0), (1, 0, k + 1, False, x, y + h, w, 0.5, 1.0), (1, 0, k + 2, True, x, y, 0.5, h, 1.0), (1, 0, k + 3, True, x + w, y, 0.5, h, 1.0)]

    short = drawn([(y, x, 1, 1, "t") for y in range(3) for x in range(3)], 3, 3, at=(300.0, 500.0))[0]
    stubs = [(*x[:7], x[7] if not x[3] or k % 4 in (0, 3) else 3.0, x[8]) for k, x in enumerate(short)]  # inner columns hardly begun
    rules = frame(100, 5.0, 5.0, 600.0, 780.0) + frame(200, 50.0, 50.0, 200.0, 90.0) + [(1, 0, 300, False, 50.0, 300.0, 200.0, 0.5, 1.0), (1, 0, 301, True, None, 1.0, 1.0, 1.0, 1.0)]
    rules += [(*x[:2], 400 + x[2], *x[3:]) for x in stubs]
    words = [(1, 0, k, 60.0 + 30 * k, 60.0, 20.0, 8.0, 8.0, False, "w") for k in range(5)]
    assert back(spark, rules, words) == [] == back(spark, [], words) == back(spark, rules, [])


def test_a_table_open_to_the_right_goes_on_to_its_words_and_alignment_is_seen(spark):
    rules, _ = drawn([(y, x, 1, 1, "") for y in range(3) for x in range(2)], 2, 3)
    at = lambda k, x, y, w, t: (1, 0, k, x, y, w, 6.0, 8.0, False, t)
    words = [at(0, 52.0, 65.0, 20.0, "left"), at(1, 88.0, 85.0, 20.0, "right"), at(2, 127.0, 105.0, 26.0, "mid"), at(3, 180.0, 65.0, 30.0, "open")]
    got = {(c.row, c.col): (c.text, c.align) for c in back(spark, rules, words)}
    assert got[0, 0] == ("left", "left") and got[1, 0] == ("right", "right") and got[2, 1] == ("mid", "center") and got[0, 2][0] == "open"


def test_sixty_one_rows_over_three_pages_are_one_table(spark):
    """A table of 61 rows and 5 columns with a repeated header, and cells that span, over three pages."""
    rules, words, pages, want = [], [], [], []
    head = [(0, x, 1, 1, f"H{x}") for x in range(5)]
    for page, count in enumerate((25, 25, 10)):
        body = []
        for k in range(count):
            n = 25 * page + k + 1
            spans = [(0, 2), (2, 1), (3, 1), (4, 1)] if n % 7 == 0 else [(x, 1) for x in range(5)]
            body += [(k + 1, x, 1, wide, f"r{n} c{x}") for x, wide in spans]
            want += [(n, x, wide, f"r{n} c{x}") for x, wide in spans]
        a, b = drawn(head + body, 5, count + 1, page=page, first=1000 * page)
        rules += a
        words += b
        pages.append((1, page, 612.0, 792.0))
    got = back(spark, rules, words, pages, stitch=True)
    assert sorted((c.line, c.col, c.colspan, c.text) for c in got if not c.header) == sorted(want) and max(c.line for c in got) == 60
    assert len({c.table for c in got}) == 1 and sum(c.header for c in got) == 5


def test_cover_is_the_length_of_the_union(spark):
    r = random.Random(1)
    rows = [(k % 7, a := float(r.randrange(60)), a + r.randrange(0, 9)) for k in range(120)]
    got = {x.k: x.cover for x in tables.covered(spark.createDataFrame(rows, "k int, start double, end double"), ["k"]).collect()}
    assert got == {k: float(len({n for q, a, b in rows if q == k for n in range(int(a), int(b))})) for k in range(7)}
