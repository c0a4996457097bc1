"""Nested blocks against a plain reader with a stack."""

import random
import re

from palimpsest.operators import tree


def plain(lines):
    """(kind, line, last, parent, depth, chars) of each node, by reading lines one after the other."""
    out = []

    def add(kind, line, parent, depth, chars=0):
        out.append([kind, line, None, parent, depth, chars])
        return len(out) - 1

    def quoted(lines, parent, level):  # lines: (number, rest)
        k = 0
        while k < len(lines):
            deep = lambda t: re.match(r"[ \t]*> ?", t)
            own = bool(deep(lines[k][1]))
            j = k
            while j < len(lines) and bool(deep(lines[j][1])) == own and (j == k or lines[j][0] == lines[j - 1][0] + 1):
                j += 1
            if own:
                if level < 8:
                    node = add("quote", lines[k][0], parent, level)
                    quoted([(n, t[deep(t).end() :]) for n, t in lines[k:j]], node, level + 1)
                    if len(out) == node + 1:
                        out.pop()
            else:
                chunk(lines[k:j], parent, level)
            k = j

    def chunk(lines, parent, level):
        stack, going, blank = [], None, True  # stack of (indent, node) of open items
        for n, t in lines:
            if not t.replace("\t", " ").strip(" "):
                blank = True
                continue
            item = bool(re.match(tree.ITEM, t))
            if item or blank:
                indent = min(8, len(re.match(r"[ \t]*", t)[0].replace("\t", "    ")) // 2)
                while stack and stack[-1][0] >= indent:
                    stack.pop()
                going = add("item" if item else "paragraph", n, stack[-1][1] if stack else parent, level + len(stack))
                if item:
                    stack.append((indent, going))
            out[going][5] += len(t.strip(" "))
            blank = False

    quoted(list(enumerate(lines)), None, 0)
    for k, x in enumerate(out):
        x[2] = k
        up = x[3]
        while up is not None:
            out[up][2] = k
            up = out[up][3]
    return [tuple(x) for x in out]


def text(r):
    out = []
    for _ in range(r.randrange(0, 40)):
        quotes = r.choice(["", "", "", "> ", ">", "> > ", ">  >> ", " > > > ", "> " * 8, "> " * 9])
        out.append(quotes + r.choice(["", "  ", "    ", "      ", "\t", " " * 20]) + r.choice(["- a", "* b c", "1. one", "12) two", "plain", "more words", "", "-", "+x"]))
    return out


def test_nodes_equal_a_reader_with_a_stack(spark):
    r = random.Random(11)
    docs = [text(r) for _ in range(250)] + [["> "], [], [">", "> >", "x"], ["- a", "  - b", "    c", "", "    d", "  e", "", "f"]]
    frame = spark.createDataFrame([(k, "\n".join(x)) for k, x in enumerate(docs) if x] + [(999, None)], "id long, text string")
    got = {}
    for x in tree.subtrees(tree.nodes(tree.lines_of(frame).repartition(3))).orderBy("id", "node").collect():
        got.setdefault(x.id, []).append(x)
    nested = 0
    for k, lines in enumerate(docs):
        want = plain(lines)
        found = got.get(k, [])
        assert [(x.kind, x.line, x.last, x.parent, x.depth, x.chars) for x in found] == want, (lines, want)
        assert all(x.size == x.last - x.node + 1 and x.total == sum(w[5] for w in want[x.node : x.last + 1]) for x in found)
        nested += sum(x.depth > 1 for x in found)
    assert nested > 300


def test_lines_are_dealt_once_and_no_frame_is_read_to_its_end(spark):
    frame = spark.createDataFrame([(1, "> - a\n> - b\n\nc"), (None, "- a")], "id long, text string")
    made = tree.subtrees(tree.nodes(tree.lines_of(frame)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and "unboundedfollowing" not in plan.split("Window")[1].lower()
    # One exchange in the plan, listed once more as the initial plan is not yet final.
    assert plan.count("Exchange hashpartitioning") == 1
    assert [(r.kind, r.parent, r.last) for r in made.orderBy("node").collect()] == [("quote", None, 2), ("item", 0, 1), ("item", 0, 2), ("paragraph", None, 3)]
