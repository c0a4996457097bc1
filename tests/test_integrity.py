"""Every breach of the rules of a document, planted and found; a clean one has none."""

from palimpsest.operators import integrity as i

BLOCKS = "id long, ord int, kind string, chars int, asset int, page int, x double, y double, w double, h double"
PAGES, ASSETS = "id long, page int, width double, height double", "id long, asset int, bytes long"
COLUMNS, CELLS = "id long, ord int, column int, width double", "id long, ord int, row int, col int, rowspan int, colspan int"


def tables(spark, blocks, pages, assets, columns, cells):
    return [spark.createDataFrame(rows, kind) for rows, kind in ((blocks, BLOCKS), (pages, PAGES), (assets, ASSETS), (columns, COLUMNS), (cells, CELLS))]


def clean():
    at = (10.0, 10.0, 100.0, 20.0)
    blocks = [(1, 0, "heading", 5, None, 0, *at), (1, 1, "figure", 0, 7, 0, *at), (1, 2, "table", 9, None, 1, *at), (1, 3, "divider", 0, None, 1, *at), (1, 4, "paragraph", 3, None, None, None, None, None, None), (2, 0, "paragraph", 1, None, 5, *at)]
    return [blocks, [(1, 0, 612.0, 792.0), (1, 1, 612.0, 792.0)], [(1, 7, 100)], [(1, 2, 0, 50.0), (1, 2, 1, 50.0)], [(1, 2, 0, 0, 1, 2), (1, 2, 1, 0, 1, 1)]]


def found(spark, parts):
    return sorted((r.id, -1 if r.ord is None else r.ord, r.rule, r.detail) for r in i.violations(*tables(spark, *parts)).collect())


def test_a_clean_document_has_no_violation_and_each_planted_one_is_found(spark):
    assert found(spark, clean()) == []
    assert found(spark, [[], [], [], [], []]) == []
    parts = clean()
    parts[0] += [
        (3, 0, "paragraph", 0, None, None, None, None, None, None), (3, 1, "list", None, None, None, None, None, None, None), (3, 2, "figure", 0, 1, None, None, None, None, None), (3, 3, "figure", 0, None, None, None, None, None, None),
        (4, 0, "paragraph", 1, None, 3, 0.0, 0.0, 1.0, 1.0), (4, 1, "paragraph", 1, None, 0, -1.5, 0.0, 1.0, 1.0), (4, 2, "paragraph", 1, None, 2, 0.0, 0.0, 613.1, 1.0), (4, 3, "paragraph", 1, None, 9, 0.0, 0.0, 1.0, 1.0),
        (4, 4, "paragraph", 1, None, 3, 0.0, 792.5, 1.0, 0.5), (5, 0, "table", 4, None, None, None, None, None, None),
    ]
    parts[1] += [(4, p, 612.0, 792.0) for p in (0, 2, 3)]
    parts[2] += [(3, 2, 0), (3, 3, None), (9, 1, 5)]
    parts[3] += [(5, 0, 0, 0.0), (5, 0, 1, 1.0), (5, 1, 0, 0.0)]
    parts[4] += [(5, 0, 0, 0, 0, 1), (5, 0, 0, 1, 1, 0), (5, 0, 1, 0, 1, 1)]
    want = [
        (3, 0, "empty", "paragraph"), (3, 1, "empty", "list"), (3, 2, "missing asset", "1"), (3, 3, "missing asset", None), (3, -1, "empty asset", "2"), (3, -1, "empty asset", "3"),
        (4, 1, "page order", "0"), (4, 1, "off page", "0"), (4, 2, "page order", "2"), (4, 2, "off page", "2"), (4, 3, "unknown page", "9"), (4, 4, "page order", "3"),
        (5, 0, "zero width", "0"), (5, 0, "zero span", "0,0"), (5, 0, "zero span", "0,1"),
    ]
    assert found(spark, parts) == sorted(want)
    blocks, assets = tables(spark, *parts)[0], tables(spark, *parts)[2]
    left = i.normalized(blocks, assets).collect()
    assert sorted((r.id, r.ord, r.kind) for r in left if r.id in (1, 3)) == [(1, k, x) for k, x in enumerate(("heading", "figure", "table", "divider", "paragraph"))]
    again = i.violations(i.normalized(blocks, assets), *tables(spark, *parts)[1:]).collect()
    assert not {r.rule for r in again} & {"empty", "missing asset"}


def test_lists_that_follow_one_another_are_one(spark):
    rows = [(1, 0, "item", True, 0), (1, 1, "item", True, 0), (1, 2, "item", True, 1), (1, 3, "item", False, 2), (1, 4, "paragraph", None, None), (1, 5, "item", False, 3), (2, 0, "item", None, 0), (2, 1, "item", None, 1)]
    got = i.merged_lists(spark.createDataFrame(rows, "id long, ord int, kind string, ordered boolean, list int")).orderBy("id", "ord").collect()
    assert [r.merged for r in got] == [0, 0, 0, 2, None, 3, 0, 0]
