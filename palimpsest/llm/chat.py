"""Tool-call linking for chat transcripts, in DataFrame functions only.

Calls and results meet in a hash join on conversation and call identifier. Calls are ordered topologically by the
calls that they depend on: a call's level is one more than the highest level below it. Conversations are cut into blocks
of bounded size, settled within rows by array functions; what blocks need of each other is a smaller graph, settled
likewise. Arguments are checked against the schema of the tool, and each call
with its result becomes one line of canonical JSON: keys sorted, no spaces.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, read_table, shared_folder, written

#: Calls of a block that one row settles, and needed calls of other blocks up to which a block is contracted.
BLOCK_CALLS = 2048
MOST_ANCHORS = 64

#: A tool's arguments: for each its type (string, integer, number, boolean, array or object), whether required, bounds
#: of the length in code points (string), of the number of items (array) or of the value (numbers), and under ``one_of``
#: the only texts allowed.
Schema = Mapping[str, Mapping[str, object]]

#: The forms of JSON's numbers.
NUMBER_FORM = {"integer": r"^-?(0|[1-9][0-9]*)$", "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"}

TOOLS: dict[str, Schema] = {
    "configure": {"prompt": {"type": "string", "required": True, "least": 1}, "turn": {"type": "integer", "required": True, "least": 0}},
    "respond": {"prompt": {"type": "string", "required": True, "least": 1, "most": 2000}, "turn": {"type": "integer", "required": True, "least": 0}},
}


def linked(calls: DataFrame, results: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Calls ``(conv, call, ...)`` and results ``(conv, call, content)`` by identifier, in a hash join; ``known``, a row for
    each identifier of a call, adds columns.

    ``status``: linked, unanswered (no result), orphan (a result of no call) or surplus. Null identifiers never match. An
    identifier's answer is its least content, which all calls of that identifier get; any other content is a surplus row,
    and equal results are one. So rows add up and never multiply; identifiers with many calls or contents stay where
    they are and meet a bounded broadcast.
    """
    named = F.col("conv").isNotNull() & F.col("call").isNotNull()
    said = written(results.groupBy("conv", "call", "content").agg(F.lit(1).alias("one")).drop("one"))
    least = said.filter(named).groupBy("conv", "call").agg(F.min("content").alias("answer"), F.count(F.lit(1)).alias("contents"))
    asked = calls.filter(named).groupBy("conv", "call").agg(F.count(F.lit(1)).alias("asks"))
    pair = written(asked.hint("shuffle_hash").join(least, ["conv", "call"], "full"))
    counts = pair.agg(F.sum("asks").alias("asks"), F.sum("contents").alias("contents"), F.max("contents").alias("most")).first()
    asks = pair.filter("asks is not null").select("conv", "call", F.col("asks").alias("n"), F.col("answer").alias("content"), F.col("contents").isNotNull().alias("_answered"))
    if known is not None:
        asks = written(asks.join(known, ["conv", "call"], "left"))
    each = join_by_key(calls, asks, ["conv", "call"], counts["asks"] or 0)
    out = each.withColumn("status", F.when(F.col("_answered"), "linked").otherwise("unanswered")).drop("_answered")
    lost = pair.filter("asks is null").select("conv", "call", F.col("answer").alias("content"), F.lit("orphan").alias("status"))
    out = out.unionByName(lost, allowMissingColumns=True)
    nameless = calls.filter(~named).withColumn("status", F.lit("unanswered"))
    out = out.unionByName(nameless, allowMissingColumns=True).unionByName(said.filter(~named).withColumn("status", F.lit("orphan")), allowMissingColumns=True)
    if (counts["most"] or 0) > 1:
        several = pair.filter("contents > 1").select("conv", "call", "answer", F.col("contents").alias("n"))
        more = join_by_key(said, several, ["conv", "call"], counts["contents"]).filter(~F.col("content").eqNullSafe(F.col("answer")))
        out = out.unionByName(more.drop("answer").withColumn("status", F.lit("surplus")), allowMissingColumns=True)
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is never put back as an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


_VEC = "array<bigint>"


def _longest(calls: Column, anchors: Column) -> Column:
    """For the calls of one block, in their order, the longest ways to no need at all (first) and to each anchor, -1 for
    none; an empty array for a call on or behind a cycle within the block.

    ``calls``: array of (at, call, floor, edges), edges an array of (needs, w). One pass in order settles calls that need
    only earlier ones; sweeps follow until nothing changes.
    """
    none = F.array().cast(_VEC)

    def prepared(names: Column) -> Column:
        def one(x: Column) -> Column:
            inside = F.filter(F.transform(x["edges"], lambda e: F.struct(F.array_position(names, e["needs"]).alias("j"), e["w"].alias("w"))), lambda e: e["j"] > 0)
            most = lambda a: F.array_max(F.transform(F.filter(x["edges"], lambda e: e["needs"] == a), lambda e: e["w"]))
            own = F.transform(anchors, lambda a: F.coalesce(most(a), F.lit(-1).cast("long")))
            return F.struct(inside.alias("inside"), F.concat(F.array(x["floor"]), own).alias("own"))

        return F.transform(calls, one)

    def step(p: Column, known: Column) -> Column:
        at = lambda e: F.coalesce(F.try_element_at(known, e["j"].cast("int")), none)
        reach = lambda e, k: F.when(F.get(at(e), k) >= 0, F.get(at(e), k) + e["w"])
        way = lambda own, k: F.greatest(own, F.coalesce(F.array_max(F.transform(p["inside"], lambda e: reach(e, k))), F.lit(-1).cast("long")))
        return F.when(F.exists(p["inside"], lambda e: F.size(at(e)) == 0), none).otherwise(F.transform(p["own"], way))

    def solved(nodes: Column) -> Column:
        first = F.aggregate(nodes, F.array().cast(f"array<{_VEC}>"), lambda acc, p: F.concat(acc, F.array(step(p, acc))))

        def sweep(acc: Column, _: Column) -> Column:
            after = _let(F.transform(nodes, lambda p: step(p, acc["vec"])), lambda v: F.struct(v.alias("vec"), (v != acc["vec"]).alias("moved")))
            return F.when(acc["moved"], after).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(1), F.size(nodes)), F.struct(first.alias("vec"), F.lit(True).alias("moved")), sweep, lambda acc: acc["vec"])

    return _let(F.transform(calls, lambda x: x["call"]), lambda names: _let(prepared(names), solved))


def levels(edges: DataFrame, width: int = BLOCK_CALLS, rounds: int = 100_000) -> DataFrame:
    """``(conv, call, level)`` from ``(conv, call, needs)``, one row per dependency, ``needs`` null where there is none.

    A call that needs nothing known is at level 0, any other one above the highest that it needs; a needed call that
    does not exist binds nothing. Calls on or behind a cycle have no level: null. Rows without conversation or call take
    no part. A column ``at`` (a number, such as the turn) may place calls; any values give the same levels, and ones
    that put needed calls shortly before make long conversations fast.

    A conversation is cut by ``at`` into blocks of about ``width`` calls, and each block is settled within its row, so
    a conversation of any size is dealt over many tasks. Where a block needs calls of others, the longest ways from
    the calls that other blocks need to those outside make up a graph of its own, far smaller if needs are local,
    which is settled likewise. A graph that does not shrink is settled by rounds, one for each level of calls with
    several needs; if they do not end within ``rounds``, an error is raised.
    """
    known = edges.filter("conv is not null and call is not null")
    place = F.coalesce(F.col("at").cast("long"), F.lit(0)) if "at" in edges.columns else F.lit(0).cast("long")
    rows = known.select("conv", place.alias("at"), "call", "needs", F.col("needs").isNotNull().cast("long").alias("w"))
    return _levels(rows, width, rounds)


def _levels(rows: DataFrame, width: int, rounds: int) -> DataFrame:
    """``levels`` of weighted needs ``(conv, at, call, needs, w)``; a row without needs states the least level, ``w``."""
    edge = F.when(F.col("needs").isNotNull(), F.struct("needs", "w"))
    calls = rows.groupBy("conv", "call").agg(
        F.min("at").alias("at"), F.collect_set(edge).alias("edges"), F.coalesce(F.max(F.when(F.col("needs").isNull(), F.col("w"))), F.lit(0)).cast("long").alias("floor")
    )
    calls = written(calls.withColumn("slot", F.floor(F.col("at") / width)))
    crowded = written(calls.groupBy("conv", "slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * width))
    if crowded.isEmpty():
        calls = calls.withColumn("part", F.lit(0).cast("long"))
    else:
        calls = calls.join(crowded, ["conv", "slot"], "left").withColumn(
            "part", F.pmod(F.xxhash64("call"), F.ceil(F.coalesce("n", F.lit(1)) / width).cast("long"))
        ).drop("n")
    block = ["conv", "slot", "part"]
    blocks = calls.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("at", "call", "floor", "edges"))).alias("calls"))
    needed = F.array_distinct(F.flatten(F.transform("calls", lambda c: F.transform(c["edges"], lambda e: e["needs"]))))
    blocks = written(blocks.withColumn("out", F.array_except(needed, F.transform("calls", lambda c: c["call"]))))
    exists = calls.select("conv", F.col("call").alias("need"))
    real = written(blocks.select(*block, F.explode("out").alias("need")).join(exists, ["conv", "need"], "left_semi"))
    if real.isEmpty():
        alone = blocks.select("conv", "calls", _longest(F.col("calls"), F.array().cast("array<string>")).alias("vec"))
        each = alone.select("conv", F.explode(F.arrays_zip(F.transform("calls", lambda c: c["call"]).alias("call"), "vec")).alias("x"))
        return each.select("conv", "x.call", F.get("x.vec", F.lit(0)).alias("level"))
    # Blocks that need too many calls of others stay as they are: their calls go on with their own needs.
    anchors = real.groupBy(*block).agg(F.array_sort(F.collect_list("need")).alias("anchors"))
    anchors = anchors.select(*block, F.when(F.size("anchors") <= MOST_ANCHORS, F.col("anchors")).alias("anchors"), F.lit(True).alias("bound"))
    met = blocks.join(anchors, block, "left").withColumn("wide", F.col("bound").isNotNull() & F.col("anchors").isNull())
    met = met.withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))
    vec = F.when(F.col("wide"), F.array().cast(f"array<{_VEC}>")).otherwise(_longest(F.col("calls"), F.col("anchors")))
    each = met.withColumn("vec", vec).select("conv", "slot", "anchors", "wide", F.explode(F.arrays_zip("calls", "vec")).alias("x"))
    each = written(each.select("conv", "slot", "anchors", "wide", "x.calls.call", "x.calls.edges", "x.calls.floor", "x.vec"))
    wanted = real.select("conv", F.col("need").alias("call")).distinct()
    ends = each.filter("wide").unionByName(each.filter("not wide").join(wanted, ["conv", "call"], "left_semi").select(each.columns))
    kind = "array<struct<needs:string,w:bigint>>"
    pairs = F.filter(F.arrays_zip(F.col("anchors").alias("needs"), F.slice("vec", 2, F.greatest(F.size("vec") - 1, F.lit(0))).alias("w")), lambda e: e["w"] >= 0).cast(kind)
    lowest = F.array(F.struct(F.lit(None).cast("string").alias("needs"), F.get("vec", F.lit(0)).alias("w"))).cast(kind)
    own = F.array(F.struct(F.lit(None).cast("string").alias("needs"), F.col("floor").alias("w"))).cast(kind)
    round_itself = F.array(F.struct(F.col("call").alias("needs"), F.lit(1).cast("long").alias("w"))).cast(kind)
    onward = F.when(F.col("wide"), F.concat(own, F.col("edges").cast(kind))).when(F.size("vec") == 0, round_itself).otherwise(F.concat(lowest, pairs))
    less = written(ends.select("conv", F.col("slot").alias("at"), "call", F.inline(onward)))
    before, after = calls.count(), less.select("conv", "call").distinct().count()
    known = _levels(less, width, rounds) if 2 * after <= before else _by_rounds(less, rounds)
    known = written(known)
    settled = each.filter("not wide").select("conv", "call", "anchors", "vec")
    free = settled.filter((F.size("anchors") == 0) | (F.size("vec") == 0)).select("conv", "call", F.get("vec", F.lit(0)).alias("level"))
    hung = settled.filter((F.size("anchors") > 0) & (F.size("vec") > 0))
    steps = hung.select("conv", "call", F.get("vec", F.lit(0)).alias("floor"), F.inline_outer(pairs))
    base = known.select("conv", F.col("call").alias("needs"), "level")
    reached = steps.join(base, ["conv", "needs"], "left").groupBy("conv", "call").agg(
        F.max(F.col("level") + F.col("w")).alias("most"), F.max("floor").alias("floor"), F.max(F.col("needs").isNotNull() & F.col("level").isNull()).alias("open")
    )
    tied = reached.select("conv", "call", F.when(~F.col("open"), F.greatest("most", "floor")).alias("level"))
    passed = each.filter("wide").select("conv", "call").join(known, ["conv", "call"])
    return free.unionByName(tied).unionByName(passed)


def _by_rounds(rows: DataFrame, rounds: int) -> DataFrame:
    """``(conv, call, level)`` of weighted needs ``(conv, at, call, needs, w)`` whose graph is not local.

    Calls with one need form chains, which pointer doubling follows to their anchors, calls with no need or several, in
    rounds that grow with the logarithm of the longest chain; a chain's ways add up as largest floors and sums of
    weights. Anchors are then settled round by round, each round's into one folder, so that plans do not grow.
    """
    spark = rows.sparkSession
    nodes = written(rows.groupBy("conv", "call").agg(F.coalesce(F.max(F.when(F.col("needs").isNull(), F.col("w"))), F.lit(0)).cast("long").alias("floor")))
    asked = rows.filter("needs is not null").groupBy("conv", "call", "needs").agg(F.max("w").alias("w"))
    asked = written(asked.join(nodes.select("conv", F.col("call").alias("needs")), ["conv", "needs"], "left_semi").select("conv", "call", "needs", "w"))
    degree = asked.groupBy("conv", "call").agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("to"), F.min("w").alias("steps"))
    chain = written(degree.filter("n = 1").join(nodes, ["conv", "call"]).select("conv", "call", "to", "steps", "floor"))
    ends = False
    for _ in range(chain.count().bit_length() + 1):
        on = chain.select("conv", F.col("call").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"), F.col("floor").alias("least"))
        if chain.join(on, ["conv", "to"], "left_semi").isEmpty():
            ends = True
            break
        both = chain.join(on, ["conv", "to"], "left")
        chain = written(
            both.select(
                "conv", "call", F.coalesce("further", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                F.greatest("floor", F.col("least") + F.col("steps")).alias("floor"),
            )
        )
    if not ends:  # what still points into a chain after that many doublings runs round a cycle
        chain = written(chain.join(chain.select("conv", F.col("call").alias("to")), ["conv", "to"], "left_anti"))
    several = degree.filter("n > 1").select("conv", "call")
    loose = nodes.join(degree.select("conv", "call"), ["conv", "call"], "left_anti").select("conv", "call", F.col("floor").alias("level"))
    # Of each anchor with several needs, the anchors behind them and how far; ``level`` is what is known of its own.
    jump = chain.select("conv", F.col("call").alias("needs"), F.col("to").alias("behind"), "steps", F.col("floor").alias("by_chain"))
    wait = asked.join(several, ["conv", "call"], "left_semi").join(jump, ["conv", "needs"], "left").join(nodes, ["conv", "call"])
    wait = written(
        wait.select(
            "conv", "call", F.coalesce("behind", "needs").alias("to"), (F.col("w") + F.coalesce("steps", F.lit(0))).alias("steps"),
            F.greatest("floor", F.col("by_chain") + F.col("w")).alias("least"), F.lit(None).cast("long").alias("at"),
        )
    )
    folder = f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}"
    kind = loose.schema
    ready = loose
    for k in range(rounds + 1):
        if k == rounds:
            raise RuntimeError(f"levels did not settle in {rounds} rounds")
        ready.write.parquet(f"{folder}/round={k}")
        ready = spark.read.schema(kind).parquet(f"{folder}/round={k}")
        if ready.isEmpty():
            break
        done = ready.select("conv", F.col("call").alias("to"), F.col("level").alias("below"))
        met = wait.join(done, ["conv", "to"], "left")
        filled = written(met.select("conv", "call", "to", "steps", "least", F.coalesce("at", F.col("below") + F.col("steps")).alias("at")))
        full = filled.groupBy("conv", "call").agg(F.greatest(F.max("at"), F.max("least")).alias("level"), F.max(F.col("at").isNull()).alias("open"))
        ready = full.filter("not open").select("conv", "call", "level")
        wait = filled.join(ready, ["conv", "call"], "left_anti")
    anchors = spark.read.schema(kind).parquet(folder).select("conv", "call", "level")
    below = anchors.select("conv", F.col("call").alias("to"), F.col("level").alias("base"))
    chained = chain.join(below, ["conv", "to"]).select("conv", "call", F.greatest("floor", F.col("base") + F.col("steps")).alias("level"))
    return nodes.select("conv", "call").join(anchors.union(chained), ["conv", "call"], "left").select("conv", "call", "level")


def arguments(text: Column) -> Column:
    """Argument map of a JSON object: strings by their value, anything else as JSON; null if it is no object or names a
    key twice."""
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.from_json(text, "map<string,string>"))


def _fits(kind: str, value: Column) -> Column:
    """Whether an argument's text has the form of its type; null if it is null."""
    if kind in NUMBER_FORM:
        # A number beyond the range of doubles has no canonical form.
        return F.rlike(value, F.lit(NUMBER_FORM[kind])) & (F.abs(value.try_cast("double")) < F.lit(float("inf")))
    if kind == "boolean":
        return value.isin("true", "false")
    if kind in ("array", "object"):
        return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith(kind.upper()), value.isNotNull() & F.lit(False))
    return value.isNotNull()


def _json_value(kind: str, value: Column) -> Column:
    """The canonical JSON of an argument that fits: equal numbers have equal texts, keys are sorted."""
    if kind == "integer":
        return F.when(value == "-0", "0").otherwise(value)
    if kind == "number":
        double = value.try_cast("double")
        whole = (double == F.floor(double)) & (F.abs(double) < 1e15)
        return F.when(whole, double.cast("decimal(20,0)").cast("string")).otherwise(double.cast("string"))
    if kind in ("array", "object"):
        return F.to_json(F.try_parse_json(value))
    return value


def _problem(name: str, spec: Mapping[str, object], args: Column) -> Column:
    """Null if the argument fits, else what is wrong with it."""
    value = F.element_at(args, F.lit(name))
    say = lambda what: F.lit(f"{name}: {what}")
    kind, out = str(spec["type"]), F.lit(None).cast("string")
    out = F.when(~_fits(kind, value), say(f"not a{'n' if kind[0] in 'aio' else ''} {kind}"))
    if kind == "string":
        measure = F.length(value)
    elif kind == "array":
        measure = F.json_array_length(value)
    else:
        measure = value.try_cast("double")
    if spec.get("one_of") is not None:
        out = F.when(out.isNull() & ~value.isin(*spec["one_of"]), say("not one of its values")).otherwise(out)
    low, high = spec.get("least"), spec.get("most")
    if high is not None:
        out = F.when(out.isNull() & (measure > high), say(f"above {high}")).otherwise(out)
    if low is not None:
        out = F.when(out.isNull() & (measure < low), say(f"below {low}")).otherwise(out)
    missing = say("missing") if spec.get("required") else F.lit(None).cast("string")
    return F.when(value.isNull(), missing).otherwise(out)


def problems(tool: Column, args: Column, tools: Mapping[str, Schema] = TOOLS) -> Column:
    """Sorted array of what is wrong with ``args`` (map of name to text) for ``tool``; empty if all is well."""
    none = F.array().cast("array<string>")
    out = F.when(tool.isNull() | args.isNull(), F.array(F.lit("no tool or arguments")))
    for name, schema in tools.items():
        own = F.array_compact(F.array(*[_problem(a, s, args) for a, s in sorted(schema.items())])) if schema else none
        extra = F.transform(F.filter(F.map_keys(args), lambda k: ~k.isin(*schema) if schema else F.lit(True)), lambda k: F.concat(k, F.lit(": unknown")))
        out = out.when(tool == name, F.array_sort(F.concat(own, extra)))
    return out.otherwise(F.array(F.lit("unknown tool")))


def json_text(text: Column) -> Column:
    """A JSON string literal: quotes, backslashes and control characters escaped, all else as it is."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def canonical(tool: Column, call: Column, args: Column, content: Column, bare: Column) -> Column:
    """``{"arguments":{...},"call":...,"result":...,"tool":...}`` with sorted keys; ``bare`` maps names to the JSON that
    stands for their values, any other value becomes a string."""
    pair = lambda k: F.concat(json_text(k), F.lit(":"), F.coalesce(F.element_at(bare, k), json_text(F.element_at(args, k))))
    inner = F.array_join(F.transform(F.array_sort(F.map_keys(args)), pair), ",")
    body = F.when(args.isNull(), F.lit("null")).otherwise(F.concat(F.lit("{"), inner, F.lit("}")))
    return F.concat(
        F.lit('{"arguments":'), body, F.lit(',"call":'), json_text(call), F.lit(',"result":'), json_text(content), F.lit(',"tool":'), json_text(tool), F.lit("}")
    )


def formatted(calls: DataFrame, results: DataFrame, edges: DataFrame, tools: Mapping[str, Schema] = TOOLS) -> DataFrame:
    """Per call, orphan or surplus result: level, status, problems and canonical JSON.

    ``calls``: (conv, call, tool, args map<string,string>); ``results``: (conv, call, content); ``edges``: as ``levels``.
    An argument that is no string and fits its type appears as canonical JSON, one that does not fit as a string.
    """
    rows = linked(calls, results, levels(edges))
    alone = F.col("status").isin("orphan", "surplus")
    wrong = F.when(alone, F.array().cast("array<string>")).otherwise(problems(F.col("tool"), F.col("args"), tools))
    none = F.create_map().cast("map<string,string>")
    bare = none
    for name, schema in tools.items():
        typed = sorted((a, str(s["type"])) for a, s in schema.items() if s["type"] != "string")
        if typed:
            value = lambda a: F.element_at(F.col("args"), a)
            pairs = [F.when(_fits(k, value(a)), F.struct(F.lit(a).alias("k"), _json_value(k, value(a)).alias("v"))) for a, k in typed]
            bare = F.when(F.col("tool") == name, F.map_from_entries(F.array_compact(F.array(*pairs)))).otherwise(bare)
    rows = rows.withColumn("problems", wrong)
    return rows.select(
        "conv", "call", "level", "status",
        F.when(alone, F.lit(None).cast("boolean")).otherwise(F.size("problems") == 0).alias("valid"),
        F.array_join("problems", ";").alias("problems"),
        canonical(F.col("tool"), F.col("call"), F.col("args"), F.col("content"), bare).alias("json"),
    )


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and dependencies that chat turns ``(conv_id, turn, role, text)`` stand for.

    A user turn calls ``respond`` and a system turn ``configure``, with identifier ``<conversation>:<turn>``; any other
    turn answers the turn before it. A call depends on the calls one and two turns before. Turns without a conversation
    or number have no identifier and take no part; a null text is an empty argument, a null role answers.
    """
    whole = turns.filter("conv_id is not null and turn is not null")
    ident = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("string"))
    asks = F.coalesce(F.col("role").isin("user", "system"), F.lit(False))
    text = F.coalesce(F.col("text"), F.lit(""))
    args = F.create_map(F.lit("prompt"), text, F.lit("turn"), F.col("turn").cast("string"))
    calls = whole.filter(asks).select(
        F.col("conv_id").alias("conv"), ident(F.col("turn")).alias("call"), F.when(F.col("role") == "user", "respond").otherwise("configure").alias("tool"), args.alias("args")
    )
    results = whole.filter(~asks).select(F.col("conv_id").alias("conv"), ident(F.col("turn") - 1).alias("call"), text.alias("content"))
    back = F.explode(F.array(F.lit(None).cast("long"), F.lit(1).cast("long"), F.lit(2).cast("long")))
    edges = whole.filter(asks).select("conv_id", "turn", back.alias("b")).select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("at"), ident(F.col("turn")).alias("call"), F.when(F.col("b").isNotNull(), ident(F.col("turn") - F.col("b"))).alias("needs")
    )
    return calls, results, edges


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every call and orphan result of the conversations."""
    made = formatted(*from_turns(read_table(spark, sf_dir, "conversations")))
    return made.select(F.col("conv").alias("conv_id"), F.col("call").alias("call_id"), F.col("level").cast("long").alias("level"), "status", "valid", "problems", "json")


ORACLE = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(role IN ('user', 'system'), false) AS asks
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'respond' ELSE 'configure' END AS tool, text FROM t WHERE asks),
a AS (SELECT conv_id, turn - 1 AS turn, text AS content FROM t WHERE NOT asks),
lv AS (SELECT conv_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn IN (c.turn - 1, c.turn - 2))
  UNION SELECT c.conv_id, c.turn, lv.level + 1 FROM lv JOIN c ON c.conv_id = lv.conv_id AND c.turn - lv.turn IN (1, 2)),
top AS (SELECT conv_id, turn, max(level) AS level FROM lv GROUP BY ALL)
SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.conv_id, a.conv_id) || ':' || coalesce(c.turn, a.turn) AS call_id,
  CAST(top.level AS BIGINT) AS level,
  CASE WHEN c.conv_id IS NULL THEN 'orphan' WHEN a.conv_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  CASE WHEN c.conv_id IS NULL THEN NULL ELSE length(c.text) >= 1 AND (c.tool = 'configure' OR length(c.text) <= 2000) AND c.turn >= 0 END AS valid,
  CASE WHEN c.conv_id IS NULL THEN '' ELSE concat_ws(';', CASE WHEN length(c.text) < 1 THEN 'prompt: below 1'
    WHEN c.tool = 'respond' AND length(c.text) > 2000 THEN 'prompt: above 2000' END, CASE WHEN c.turn < 0 THEN 'turn: below 0' END) END AS problems,
  '{"arguments":' || CASE WHEN c.conv_id IS NULL THEN 'null' ELSE '{"prompt":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '}' END
    || ',"call":"' || coalesce(c.conv_id, a.conv_id) || ':' || coalesce(c.turn, a.turn)
    || '","result":' || CASE WHEN a.conv_id IS NULL THEN 'null' ELSE CAST(to_json(a.content) AS VARCHAR) END
    || ',"tool":' || CASE WHEN c.conv_id IS NULL THEN 'null' ELSE '"' || c.tool || '"' END || '}' AS json
FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.turn = a.turn
LEFT JOIN top ON top.conv_id = c.conv_id AND top.turn = c.turn
"""
