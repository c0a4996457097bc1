"""Nested blocks of Markdown as a relation: quotes in quotes, items under items, paragraphs under items.

Every node knows its parent, its depth and the bounds of its subtree, so that ancestors and subtrees are comparisons of
numbers. Nothing is parsed from left to right: quotes are islands of lines at least so deep, and what a line of a list
hangs on follows from the last lines of each smaller indent, by windows over the lines of one stretch of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Quotes nest so deep; deeper lines are left out. Steps of indent that are told apart (deeper ones count as the last), and
#: the columns of a step.
MOST_QUOTES, MOST_INDENT, STEP = 8, 8, 2
QUOTE, ITEM = r"^(?:[ \t]*> ?)*", r"^[ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]+\S"


def lines_of(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, line, text)``: the lines of texts, from 0; null texts have none."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(F.split(f"`{text_col}`", "\r\n|\n|\r", -1)).alias("line", "text"))


def _indent(text: Column) -> Column:
    """Steps of indent; a tab is worth four columns."""
    lead = F.replace(F.regexp_extract(text, r"^[ \t]*", 0), F.lit("\t"), F.lit("    "))
    return F.least(F.lit(MOST_INDENT), F.floor(F.length(lead) / STEP)).cast("int")


def nodes(lines: DataFrame) -> DataFrame:
    """``(id, node, kind, line, last, parent, depth, chars)`` of Markdown lines ``(id, line, text)``.

    ``node`` counts the nodes of a document in reading order from 0, a parent before what it holds; ``last`` is the number of
    the last node in its subtree, itself at least; ``chars`` counts the characters of its own lines, quote signs left out.
    Kinds are quote, item and paragraph. Lines without a sign that follow an item or a paragraph go on with it; a blank
    line ends a paragraph; a paragraph behind one hangs on the item whose indent it exceeds. A quote ends what stands
    before it. Numbers of lines are distinct in a document; rows with a null number or text are left out.
    """
    known = lines.filter("id is not null and line is not null and text is not null").select("id", "line", "text", F.regexp_extract("text", QUOTE, 0).alias("prefix"))
    quotes = F.length(F.regexp_replace("prefix", "[^>]", ""))
    bare = known.select("id", "line", "text", "prefix", quotes.alias("quotes"))
    rest = F.when(F.col("quotes") > 0, F.substring(F.col("text"), F.length("prefix") + 1, F.length("text"))).otherwise(F.col("text"))
    bare = bare.select("id", "line", "quotes", rest.alias("text"))
    # From here on lines are numbers, and all is dealt by document once: no branch of the plan is run again by a join or union.
    every = bare.select(
        "id", "line", "quotes", (F.trim(F.translate("text", "\t", " ")) == "").alias("blank"), F.rlike("text", F.lit(ITEM)).alias("item"), _indent(F.col("text")).alias("indent"),
        F.length(F.trim("text")).alias("chars"),
    ).repartition("id")
    whole = Window.partitionBy("id").orderBy("line")
    around = lambda c, f: F.coalesce(f(c).over(whole), F.lit(0))
    every = every.withColumns({"before": around("quotes", F.lag), "after": around("quotes", F.lead), "new": F.coalesce(F.lag("quotes").over(whole) != F.col("quotes"), F.lit(True))})
    every = every.withColumn("stretch", F.sum(F.col("new").cast("int")).over(whole))
    # A quote of level d: an island of neighbouring lines at least d deep, from the line that goes down to d to the next one
    # behind which the text comes up from it.
    levels = range(1, MOST_QUOTES + 1)
    onward = Window.partitionBy("id").orderBy(F.desc("line"))
    every = every.withColumns({f"end{d}": F.min(F.when((F.col("quotes") >= d) & (F.col("after") < d), F.col("line") + 1)).over(onward) for d in levels})
    begun = F.array(*[F.when((F.col("before") < d) & (F.col("quotes") >= d), F.struct(F.lit(d).alias("d"), F.col(f"end{d}").alias("end"))) for d in levels])
    every = every.withColumn("begun", F.array_compact(begun)).drop(*[f"end{d}" for d in levels])
    # Nodes made of lines: items, and paragraphs that do not go on with what stands before them. What a stretch begins with,
    # quotes and blank lines, is number 0 of it or goes with its first text.
    part = Window.partitionBy("id", "stretch").orderBy("line")
    starts = ~F.col("blank") & (F.col("item") | F.coalesce(F.lag("blank").over(part), F.lit(True)))
    shown = every.withColumn("starts", starts)
    shown = shown.withColumns({"own": F.sum(F.col("starts").cast("int")).over(part), "foot": F.max("line").over(Window.partitionBy("id", "stretch")) + 1})
    said = lambda c: F.when(~F.col("blank") & (F.col("quotes") <= MOST_QUOTES), F.col(c))
    text = shown.groupBy("id", "stretch", "own").agg(
        F.min("line").alias("top"), F.min(said("line")).alias("line"), F.min_by("item", said("line")).alias("item"), F.min_by("indent", said("line")).alias("indent"),
        F.sum(said("chars")).alias("chars"), F.max("quotes").alias("quotes"), F.max("foot").alias("foot"), F.max("begun").alias("begun"),
    )
    # The last line of each indent before: an item is still open if it is that line, and behind all lines of a smaller indent.
    above = Window.partitionBy("id", "stretch").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    # From the end on, as a frame up to the end would be read anew for every line.
    below = Window.partitionBy("id", "stretch").orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    steps = range(MOST_INDENT + 1)
    text = text.withColumns({f"last{k}": F.max(F.when(F.col("indent") == k, F.struct("line", "item"))).over(above) for k in steps})
    text = text.withColumns({f"next{k}": F.min(F.when(F.col("indent") == k, F.col("line"))).over(below) for k in steps})
    behind = [F.greatest(F.lit(-1).cast("long"), F.lit(-1).cast("long"), *[F.col(f"last{m}.line").cast("long") for m in range(k)]) for k in steps]
    open_ = [
        F.when((F.col("indent") > k) & F.col(f"last{k}.item") & (F.col(f"last{k}.line") > behind[k]), F.struct(F.col(f"last{k}.line").alias("line"), F.lit(k).alias("indent"))) for k in steps
    ]
    ends = F.array_min(F.filter(F.array(*[F.when(F.col("indent") >= k, F.col(f"next{k}")) for k in steps]), lambda x: x.isNotNull()))
    text = text.select("id", "line", "item", "indent", "chars", "quotes", "foot", "begun", "top", F.array_compact(F.array(*open_)).alias("holders"), ends.alias("next"))
    end = F.when(F.col("item"), F.coalesce("next", "foot")).otherwise(F.col("line") + 1)
    node = lambda kind, line, indent, holder, depth, quotes, chars, end: F.struct(
        F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), line.alias("line"), indent.cast("int").alias("indent"), holder.cast("int").alias("holder"),
        depth.cast("int").alias("depth"), quotes.cast("int").alias("quotes"), chars.cast("long").alias("chars"), end.alias("end"),
    )
    none = F.lit(None)
    quote = F.transform("begun", lambda x: node("quote", F.col("top"), none, none, x["d"] - 1, x["d"] - 1, F.lit(0), x["end"]))
    kind = F.when(F.col("item"), "item").otherwise("paragraph")
    own = node(kind, F.col("line"), F.col("indent"), F.array_max("holders")["indent"], F.col("quotes") + F.size("holders"), F.col("quotes"), F.col("chars"), end)
    every = text.select("id", F.inline(F.concat(quote, F.array_compact(F.array(F.when(F.col("line").isNotNull(), own))))))
    return _numbered(every.withColumn("rank", (F.col("kind") != "quote").cast("int")))


def _numbered(every: DataFrame) -> DataFrame:
    """Numbers, parents and subtrees of nodes with their first line, the line behind their subtree, and their holder's indent."""
    # Quotes without a text are left out: the next text begins behind them.
    back = Window.partitionBy("id").orderBy(F.desc("line"), F.desc("rank"), F.desc("depth"))
    kept = every.withColumn("text", F.min(F.when(F.col("rank") == 1, F.col("line"))).over(back)).filter("rank = 1 or text < end").drop("text")
    order = Window.partitionBy("id").orderBy("line", "rank", "depth")
    kept = kept.withColumn("node", (F.row_number().over(order) - 1).cast("long"))
    # The parent: the item that holds it, the last text of the holder's indent, else the quote one level up that is open: the
    # last begun of that level.
    before = Window.partitionBy("id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda when: F.max(F.when(when, F.col("node"))).over(before)
    kept = kept.withColumns({
        "items": F.array(*[last(F.col("indent") == k) for k in range(MOST_INDENT + 1)]),
        "open": F.array(*[last((F.col("kind") == "quote") & (F.col("quotes") == d)) for d in range(MOST_QUOTES)]),
    })
    parent = F.coalesce(F.get("items", F.col("holder")), F.when(F.col("quotes") > 0, F.get("open", F.col("quotes") - 1)))
    kept = kept.select("id", "node", "kind", "line", parent.alias("parent"), "depth", "chars", "end", "rank")
    # Events in the order of lines: a node's end comes before the nodes that begin there, so that as many have begun at its end
    # as stand before and in its subtree.
    at = lambda step, line: F.struct(F.lit(step).alias("step"), F.col(line).cast("long").alias("at"))
    events = kept.select("*", F.inline(F.array(at(1, "line"), at(0, "end"))))
    along = Window.partitionBy("id").orderBy("at", "step", "rank", "depth").rowsBetween(Window.unboundedPreceding, 0)
    closed = events.withColumn("count", F.sum("step").over(along)).filter("step = 0")
    return closed.select("id", "node", "kind", "line", (F.col("count") - 1).alias("last"), "parent", "depth", "chars")


def subtrees(tree: DataFrame) -> DataFrame:
    """``nodes`` with ``size`` and ``total``, the nodes and characters of each subtree, from running sums in reading order."""
    # Each node is met at its own place and at that of its subtree's last node, where the sum is its subtree's and what stands
    # before; so no sum is joined back.
    place = lambda name, chars: F.struct(F.col(name).alias("__at"), F.lit(name == "last").alias("__ends"), chars.alias("__chars"))
    met = tree.select("*", F.inline(F.array(place("node", F.col("chars")), place("last", F.lit(0).cast("long")))))
    along = Window.partitionBy("id").orderBy("__at", "__ends", "node").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("__sum", F.sum("__chars").over(along))
    own = Window.partitionBy("id", "node").orderBy("__ends")
    met = met.withColumn("__from", F.lag("__sum").over(own)).filter("__ends")
    return met.select(*tree.columns, (F.col("last") - F.col("node") + 1).alias("size"), (F.col("__sum") - F.col("__from") + F.col("chars")).alias("total"))
