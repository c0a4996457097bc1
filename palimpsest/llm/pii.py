"""Personal data and secrets by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what fixed formats find: e-mail and IP addresses, payment cards, phone numbers, and keys and digests of
known format. Lexical patterns come from two kinds of places. A cue is a name of any length, perhaps in quotes, then
``=``, ``:``, ``=>`` or ``->`` within any run of spaces, before a value. A context is the words and punctuation around
a value in prose: two words to the left, or one on either side. Each such place is an edge between a pattern and an
instance, the value itself, known by a 64-bit hash. Spark scores this graph in rounds until the confident patterns no
longer change: a pattern is as confident as the share of its trusted values against those that are plain words; an
instance is trusted if a seed, else as far as the most confident pattern that holds it; what is known of values of its
shape is its prior. Confident patterns then extract their values anywhere, seeds or not, but for plain words and short
numbers. A first pass over the texts finds seeds and cues. Where contexts hold enough different seeds, a second one takes
all their values but plain words, in all texts; these are few. Plain words, which are many, only count against a context: those
of the texts with seeds in prose tell which contexts cannot be confident whatever is trusted, and a third pass counts those
of all texts for the others. So the patterns that extract, and what they extract, are those of all words of all texts. What
is joined back is spans, never texts. The third pass cuts only texts that hold the two words of such a context in their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, free_names, join_by_key, quoted, read_table, written

KINDS = ("email", "ip", "card", "phone")
EXTRA = "secret"

#: Java forms of the contract's patterns that find the same matches without rescanning: an e-mail's local part starts
#: where a run of its characters does or where the last match ended, an address' first number where digits do, and a
#: card needs 16 digits. Possessive where the next character cannot belong to the run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Keys of a published fixed format.
KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
_NAME = r"[A-Za-z0-9_]++(?:-[A-Za-z0-9_]++)*+"
_BETWEEN = r"[\"'`]?\]?\h*+(?:[=:]{1,3}+>?|->)\h*+"
#: A cue, its separator, and the value after it, however long: up to the quote that closes it or without closing
#: punctuation. A name starts where a run of its characters does, so that long ones are not scanned again.
CUE = (
    r"(?<![A-Za-z0-9_])(?<![A-Za-z0-9_]-)(?=[A-Za-z0-9_-]{2})(?=[0-9_-]*+[A-Za-z])"
    + _NAME + _BETWEEN
    + r"(?:\"[^\s\"]{4,}+(?=\")|'[^\s']{4,}+(?=')|[\"']?[^\s\"',;]{3,}[^\s\"',;.!?)])"
)
CUE_PARTS = rf"(?s)^({_NAME})({_BETWEEN}[\"']?)(.+)$"
#: Digests of the usual lengths; a cue's end; parts of a text, whole words of some 256 characters and what follows them.
DIGEST = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9])"
SEPARATED = "(?:[=:]>?|->)[\"'`]?$"
PART = r"(?s).{1,256}\S*+\s*+"
#: A character that plain words lack; the punctuation around a word; the shortest value of a context.
SIGN = r"[0-9@#$%^&*+=~|]"
OPENING, CLOSING = "\"'`(<[{", "\"'`)>]}.,;:!?"
LEAST_CHARS = 4
#: Characters of the text around a value that are looked at for its context, and of each word that a context names.
AROUND, WORD_CHARS = 128, 30

#: Rounds after which scoring that has not settled raises an error; the greatest change of a trust that counts as none.
MOST_ROUNDS = 100
SETTLED = 1e-3
#: Contexts that are sent to all workers; more are joined by a shuffle.
MOST_SENT = 1_000_000
#: Contexts by whose words texts are told apart before they are cut; for more, all are cut.
MOST_LISTED = 1_000
#: A pattern extracts if its confidence is at least this and trusted values stand behind it this often.
CONFIDENCE = 0.8
SUPPORT = 3
#: Plain values that every pattern is taken to have besides those seen.
SMOOTHING = 0.5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is never put back as an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(sizes: Column) -> Column:
    """For each number of an array the sum of those before it. Blocks of 256 are summed first: no list grows with the
    array but that of the blocks."""

    def run(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def by_block(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / 256).cast("int")), lambda b: run(F.slice(xs, b * 256 + 1, F.lit(256))))
        starts = lambda bs: run(F.transform(bs, lambda b: b["at"]))["out"]
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), lambda b, s: F.transform(b["out"], lambda x: x + s))))

    return _let(sizes, lambda xs: F.when(F.size(xs) <= 256, run(xs)["out"]).otherwise(by_block(xs)))


def spans(text: Column, pattern: str, keep=None) -> Column:
    """``array<struct<s,e,m,before,after>>``: matches of ``pattern`` that ``keep`` from left to right in code points, end
    exclusive, with some text on either side, up to the match before the last and the next one.

    Text between matches and matches alternate, so positions are sums of lengths. The pattern must not match the empty
    string and must not contain groups that change what group 0 is.
    """

    def of(x: Column) -> Column:
        sizes = F.zip_with(x["gaps"], x["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))

        def one(at: Column):
            def made(m: Column, i: Column) -> Column:
                s = F.get(at, i) + F.length(F.get(x["gaps"], i))
                before = F.concat(F.coalesce(F.get(x["hits"], i - 1), F.lit("")), F.get(x["gaps"], i))
                return F.struct(
                    s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), F.right(before, F.lit(AROUND)).alias("before"),
                    F.left(F.get(x["gaps"], i + 1), F.lit(AROUND)).alias("after"),
                )

            return made

        return _let(sums_before(sizes), lambda at: F.transform(x["hits"], one(at)))

    found = _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")), of)
    return F.filter(found, lambda x: keep(x["m"])) if keep else found


_SPAN = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def _where(text: Column, sign: Column, pattern: str, keep=None) -> Column:
    """Spans where the cheap ``sign`` holds and the pattern occurs, else none."""
    return F.when(sign & F.rlike(text, F.lit(pattern)), spans(text, pattern, keep)).otherwise(F.array().cast(_SPAN))


def is_ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(256)) <= 255)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def is_card(match: Column) -> Column:
    """16 to 19 digits that pass Luhn's check."""
    digits = _digits(match)
    back = F.reverse(digits)
    places = F.sequence(F.lit(1), F.least(F.length(digits), F.lit(19)))

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x)
    return F.length(digits).between(16, 19) & (total % 10 == 0)


def is_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(8, 15)


def base_spans(text: Column) -> dict[str, Column]:
    """The contract's spans by kind; matches that fail a kind's test are dropped without another try."""
    return {
        "email": _where(text, F.contains(text, F.lit("@")), EMAIL),
        "ip": _where(text, F.contains(text, F.lit(".")), IP, is_ip),
        "card": _where(text, F.lit(True), CARD, is_card),
        "phone": _where(text, F.contains(text, F.lit("+")), PHONE, is_phone),
    }


def shape(value: Column) -> Column:
    """The class by which the graph knows a value."""
    full = lambda p: F.rlike(value, F.lit(f"^(?:{p})$"))
    return (
        F.when(full(EMAIL), "email")
        .when(full(IP), "ip")
        .when(full(CARD), "card")
        .when(full(PHONE), "phone")
        .when(full("[0-9a-f]{12,}") & F.rlike(value, F.lit("[a-f]")) & F.rlike(value, F.lit("[0-9]")), "hex")
        .when(full("[A-Z0-9]{12,}") & F.rlike(value, F.lit("[0-9]")), "upper")
        .when((F.length(value) >= 8) & F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & full(r"[A-Za-z0-9+/=_.-]+"), "mixed")
        .when(full("[0-9-]{6,}"), "digits")
        .when((F.length(value) >= 6) & F.rlike(value, F.lit("[A-Za-z]")) & F.rlike(value, F.lit(r"[0-9@#%^&*+=~|!?\\]")) & ~F.rlike(value, F.lit("^//|://")), "symbols")
        .otherwise("plain")
    )


def is_seed(value: Column, kind: Column) -> Column:
    """Values that a fixed format vouches for: base kinds, keys, and digests of the usual lengths."""
    digest = (kind == "hex") & F.length(value).isin(32, 40, 64)
    return kind.isin(*KINDS) | digest | F.rlike(value, F.lit(f"^(?:{KEY})$"))


def occurrences(text: Column) -> Column:
    """``array<struct<s,e,cue,value,shape,seed>>``: values after cues, with the span of the value; cue and value as hashes."""
    found = spans(text, CUE)

    def parse(m: Column) -> Column:
        value = F.regexp_extract(m["m"], CUE_PARTS, 3)
        cue = F.concat(F.lower(F.regexp_extract(m["m"], CUE_PARTS, 1)), F.regexp_replace(F.regexp_extract(m["m"], CUE_PARTS, 2), r"\h", ""))
        return F.struct((m["e"] - F.length(value)).alias("s"), m["e"].alias("e"), F.xxhash64(cue).alias("cue"), value.alias("value"))

    def grade(o: Column) -> Column:
        kind = shape(o["value"])
        return F.struct(
            o["s"].alias("s"), o["e"].alias("e"), o["cue"].alias("cue"), F.xxhash64(o["value"]).alias("value"), kind.alias("shape"), is_seed(o["value"], kind).alias("seed")
        )

    empty = F.array().cast("array<struct<s:int,e:int,cue:bigint,value:bigint,shape:string,seed:boolean>>")
    sign = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")) | F.contains(text, F.lit("->"))) & F.rlike(text, F.lit(CUE))
    return F.when(sign, F.transform(F.transform(found, parse), grade)).otherwise(empty)


def _last(word: Column) -> Column:
    return F.right(word, F.lit(WORD_CHARS))


def _contexts(far: Column, near: Column, opening: Column, closing: Column, after: Column) -> Column:
    """Hashes of the two contexts of a value: the two words before it, and one word on either side. Null without words."""
    first = lambda x: F.left(x, F.lit(WORD_CHARS))
    left = F.when(near != "", F.xxhash64(F.lit("<"), _last(far), _last(near), _last(opening)))
    both = F.when((near != "") & (after != ""), F.xxhash64(F.lit("<>"), _last(near), _last(opening), first(closing), first(after)))
    return F.array(left, both)


def _ends(far: Column, near: Column, after: Column) -> Column:
    """Hashes of the two words that each of ``_contexts`` names, without the punctuation around the value."""
    return F.array(F.xxhash64(F.lit("<"), far, near), F.xxhash64(F.lit("<>"), near, after))


def seeds_in_prose(found: Column, kind: Column) -> Column:
    """``array<struct<cues<cue,ends>,near,value,shape>>`` of spans: their contexts and the words of each, hashes of the word
    before and of the value; none after a separator."""

    def place(x: Column) -> Column:
        left, right = F.split(F.lower(x["before"]), r"\s+", -1), F.split(F.lower(x["after"]), r"\s+", -1)
        at = lambda parts, k: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))
        free = ~F.rlike(F.concat(at(left, -2), at(left, -1)), F.lit(SEPARATED))
        cues = _contexts(at(left, -3), at(left, -2), at(left, -1), at(right, 1), at(right, 2))
        ends = _ends(_last(at(left, -3)), _last(at(left, -2)), F.left(at(right, 2), F.lit(WORD_CHARS)))
        cues = F.filter(F.zip_with(cues, ends, lambda c, e: F.struct(c.alias("cue"), e.alias("ends"))), lambda c: c["cue"].isNotNull())
        near = F.xxhash64(_last(at(left, -2)))
        return F.struct(F.when(free, cues).alias("cues"), near.alias("near"), F.xxhash64(x["m"]).alias("value"), kind.alias("shape"))

    return F.filter(F.transform(found, place), lambda x: F.size(x["cues"]) > 0)


def able(text: Column, near: list[int], ends: list[int]) -> Column:
    """Whether ``text`` can hold a context of which the word before the value is one of ``near`` and the two words are
    one of ``ends``.

    Never false for a text with such a place: where words or white space are so long that what is looked at around a
    value may begin within the two words before it, no text is ruled out.
    """

    def holds(words: Column) -> Column:
        def at(i: Column) -> Column:
            word = F.get(words, i)
            named = F.exists(_ends(F.get(words, i - 1), word, F.get(words, i + 2)), lambda e: e.isin(ends))
            return (F.xxhash64(word).isin(near) & named) | (F.length(word) > WORD_CHARS)

        return F.exists(F.sequence(F.lit(1), F.size(words) - 1), at)

    # Before the first word stands an empty one.
    words = F.concat(F.array(F.lit("")), F.split(F.lower(text), r"\s+", -1))
    return F.rlike(text, F.lit(rf"\s{{{AROUND // 2 - WORD_CHARS + 1}}}")) | _let(words, holds)


def _words(texts: DataFrame, wanted: DataFrame, sent: bool, signed: bool) -> DataFrame:
    """The words of ``texts`` (id, th, t) in the contexts ``wanted`` (cue, near), each with its context.

    A text is cut into parts of whole words; words and their neighbours are then rows, most of which the word before
    rules out. Only of those left are contexts found. ``sent``: ``wanted`` is small enough for a broadcast. ``signed``: only
    words that hold a character of SIGN.
    """
    send = F.broadcast if sent else lambda df: df
    near = send(wanted.select(F.col("near").alias("near_hash")).distinct())
    cues = send(wanted.select("cue").distinct())

    def part(p: Column, i: Column) -> Column:
        before = F.right(F.coalesce(F.get("parts", i - 1), F.lit("")), F.lit(AROUND))
        after = F.left(F.coalesce(F.get("parts", i + 1), F.lit("")), F.lit(2 * WORD_CHARS))
        return F.struct(p.alias("part"), F.get("at", i).alias("at"), F.lower(before).alias("before"), F.lower(after).alias("after"))

    cut = texts.select("id", "th", F.regexp_extract_all("t", F.lit(PART), F.lit(0)).alias("parts"))
    cut = cut.select("id", "th", "parts", sums_before(F.transform("parts", F.length)).alias("at"))
    each = F.transform("parts", part)
    laid = cut.select("id", "th", F.inline(F.filter(each, lambda p: F.rlike(p["part"], F.lit(SIGN))) if signed else each))
    word = lambda c, k: F.coalesce(F.try_element_at(F.split(c, r"\s+", -1), F.lit(k)), F.lit(""))
    low = F.split(F.lower(F.rtrim("part")), r"\s+", -1)
    laid = laid.select("id", "th", "part", "at", low.alias("low"), word("before", -3).alias("b"), word("before", -2).alias("a"), word("after", 1).alias("z"))
    zipped = F.arrays_zip(
        "low", F.concat(F.array("b", "a"), "low").alias("far"), F.concat(F.array("a"), "low").alias("near"),
        F.concat(F.slice("low", 2, F.size("low")), F.array("z")).alias("after"),
    )
    numbered = F.transform(zipped, lambda w, k: F.struct(k.alias("k"), *[w[c].alias(c) for c in ("low", "far", "near", "after")]))
    # Lower case neither makes nor takes signs.
    numbered = F.filter(numbered, lambda w: F.rlike(w["low"], F.lit(SIGN))) if signed else numbered
    laid = laid.select("id", "th", "part", "at", F.inline(numbered))
    laid = laid.filter((F.col("low") != "") & (F.col("near") != "")).withColumn("near_hash", F.xxhash64(_last(F.col("near")))).join(near, "near_hash", "left_semi")
    # The word as it stands, without the punctuation around it.
    laid = laid.withColumn("x", F.element_at(F.split("part", r"\s+", -1), F.col("k") + 1))
    late = F.ltrim("x", F.lit(OPENING))
    core = F.rtrim(late, F.lit(CLOSING))
    opening = F.lower(F.substring("x", F.lit(1), F.length("x") - F.length(late)))
    closing = F.lower(F.substring(late, F.length(core) + 1, F.length(late)))
    both = F.explode(_contexts(F.col("far"), F.col("near"), opening, closing, F.coalesce("after", F.lit(""))))
    placed = laid.select(
        "id", "th", "part", "at", "k", "x", F.concat("near", opening).alias("lead"), late.alias("late"), core.alias("core"), both.alias("cue")
    )
    return placed.join(cues, "cue", "left_semi")


def _met(texts: DataFrame, wanted: DataFrame, sent: bool) -> DataFrame:
    return _words(texts, wanted, sent, False)


def in_contexts(texts: DataFrame, wanted: DataFrame, sent: bool = True) -> DataFrame:
    """``(cue, value, shape, seed, id, th, s, e)``: the different words of ``texts`` (id, th, t) in the contexts ``wanted``
    (cue, near, ends). Plain words only count: they have no place, and repeated ones are one row before any shuffle. A part's
    place is a sum of lengths."""
    listed = wanted.select("near", "ends").limit(MOST_LISTED + 1).collect()
    if len(listed) <= MOST_LISTED:
        texts = texts.filter(able(F.col("t"), list({r["near"] for r in listed}), list({r["ends"] for r in listed})))
    return _graded(_met(texts, wanted, sent), "shape is not null")


def values_in_contexts(texts: DataFrame, wanted: DataFrame, sent: bool = True) -> DataFrame:
    """``in_contexts`` without plain words: only words with a sign are looked at, the rest is never cut into rows."""
    return _graded(_words(texts, wanted, sent, True), "shape <> 'plain'")


def _graded(met: DataFrame, kept: str) -> DataFrame:
    """``in_contexts`` of words in contexts; of their shapes those ``kept``, null for words that are no values."""
    core, late = F.col("core"), F.col("late")
    signed = F.rlike("x", F.lit(SIGN)) & (F.length(core) >= LEAST_CHARS)
    kind = F.when(signed & ~F.rlike(core, F.lit("[=:]")), shape(core)).when(~signed, "plain")
    kind = F.when((core != "") & ~F.rlike("lead", F.lit(SEPARATED)), kind)
    # What stands behind k separators is the word and the rest of its part.
    rest = F.element_at(F.split(F.col("part"), r"\s+", F.col("k") + 1), F.col("k") + 1)
    s = F.col("at") + F.length("part") - F.length(rest) + F.length("x") - F.length(late)
    # Rows of a list: a filter on them cannot move down to where it would be tried on every word of the texts.
    rows = met.select("cue", "id", "th", F.inline(F.array(F.struct(core.alias("core"), kind.alias("shape"), s.alias("s")))))
    rows = rows.filter(kept)
    s = F.col("s")
    live = F.col("shape") != "plain"
    return rows.select(
        "cue", F.xxhash64("core").alias("value"), "shape", (live & is_seed(F.col("core"), F.col("shape"))).alias("seed"),
        *[F.when(live, F.col(c)).alias(c) for c in ("id", "th")], F.when(live, s).alias("s"), F.when(live, s + F.length("core")).alias("e"),
    ).distinct()


def fit(contexts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``contexts`` (cue) that can be confident. ``pairs`` (cue, value, shape, seed) has all their values but plain
    words, and some of their plain words: what is left out can only lower a confidence.

    The most that ``patterns`` can count for a context is a trust of 1 for all its values; a value that is known by several
    shapes counts there as often.
    """
    live = pairs.filter("shape <> 'plain'")
    known = live.groupBy("value").agg(F.count_distinct("shape", "seed").alias("shapes"))
    most = live.join(known, "value").groupBy("cue").agg(F.sum("shapes").alias("most"))
    plain = pairs.groupBy("cue").agg(F.count_if(F.col("shape") == "plain").alias("plain"))
    able_ = (F.col("most") / (F.col("most") + F.col("plain") + SMOOTHING) >= CONFIDENCE) & (F.col("most") >= SUPPORT)
    return contexts.join(most.join(plain, "cue").filter(able_), "cue", "left_semi")


def patterns(pairs: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``(cue, confidence, support)`` from different pairs ``(cue, value, shape, seed)``: mutual scoring of patterns and
    instances.

    A pattern's support is the trust of its values, its confidence the support over support and plain values, smoothed by
    half a plain value; values not trusted count for neither, but for those with symbols, which count as plain until
    trusted. An instance's trust is 1 for a seed, else the best confidence of an extracting pattern that holds it or, from
    a half on, its shape's prior: the share of seeds among its values or, if more, a pattern's confidence times the share
    of the shape among that pattern's values. Trust only grows; rounds end when none grows by more than SETTLED, and
    raise an error if that takes more than ``most_rounds``.
    """
    pairs = written(pairs)
    live = written(pairs.filter("shape <> 'plain'"))
    total = live.count()
    plain = pairs.groupBy("cue").agg(F.count_if(F.col("shape") == "plain").alias("plain"))
    mix = live.groupBy("cue", "shape").agg(F.count(F.lit(1)).alias("n"))
    mix = written(mix.join(live.groupBy("cue").agg(F.count(F.lit(1)).alias("all_n")), "cue").select("cue", "shape", (F.col("n") / F.col("all_n")).alias("share")))
    # Shapes are a fixed list of ten.
    prior = {r["shape"]: r["prior"] for r in live.groupBy("shape").agg(F.avg(F.col("seed").cast("double")).alias("prior")).collect()}

    def likely() -> Column:
        out = F.lit(0.0)
        for kind, value in prior.items():
            out = F.when(F.col("shape") == kind, F.lit(float(value) if value >= 0.5 else 0.0)).otherwise(out)
        return out

    known = live.groupBy("value", "shape", "seed").agg(F.count(F.lit(1)).alias("n"))
    trust = written(known.select("value", "shape", F.when(F.col("seed"), F.lit(1.0)).otherwise(likely()).alias("trust"), "n"))
    for _ in range(most_rounds):
        met = join_by_key(live.drop("shape"), trust, ["value"], total)
        doubt = (F.col("shape") == "symbols") & (F.col("trust") < 0.5)
        each = met.groupBy("cue").agg(F.sum("trust").alias("support"), F.count_if(doubt).alias("doubt"), F.count(F.lit(1)).alias("n")).join(plain, "cue")
        confidence = F.col("support") / (F.col("support") + F.col("plain") + F.col("doubt") + SMOOTHING)
        scored = written(each.select("cue", "support", confidence.alias("confidence"), "n"))
        good = scored.filter(extracts())
        best = join_by_key(live.filter("not seed"), good.select("cue", "confidence", "n"), ["cue"], total).groupBy("value").agg(F.max("confidence").alias("best"))
        for r in mix.join(good, "cue").groupBy("shape").agg(F.max(F.col("confidence") * F.col("share")).alias("typical")).collect():
            prior[r["shape"]] = max(prior[r["shape"]], r["typical"])
        new = F.greatest("trust", F.coalesce("best", F.lit(0.0)), likely())
        after = trust.join(best, "value", "left").select("value", "shape", new.alias("trust"), "n", (new - F.col("trust") > SETTLED).alias("grown"))
        after = written(after)
        if after.filter("grown").isEmpty():
            return scored.drop("n")
        trust = after.drop("grown")
    raise RuntimeError(f"patterns do not settle in {most_rounds} rounds")


def extracts() -> Column:
    """Whether a scored pattern extracts."""
    return (F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)


def disjoint(found: DataFrame, base: DataFrame) -> DataFrame:
    """``(id, th, more)``: the spans ``found`` (id, th, s, e) of each text that overlap none of ``base``, those that overlap
    one another as one span, in order.

    A span overlaps base spans if those that start before its end reach beyond its start; both questions are running
    maxima over sorted spans.
    """
    own = Window.partitionBy("id", "th")
    ends = found.select("id", "th", F.col("e").alias("at"), F.lit(0).alias("kind"), "s", "e", F.lit(None).cast("int").alias("reach"))
    starts = base.select("id", "th", F.col("s").alias("at"), F.lit(1).alias("kind"), "s", "e", F.col("e").alias("reach"))
    # At one place ends come first: a base span that starts where another ends does not meet it.
    reach = F.max("reach").over(own.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    free = ends.union(starts).withColumn("reach", reach).filter("kind = 0 and (reach is null or reach <= s)").select("id", "th", "s", "e")
    before = F.max("e").over(own.orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    begins = free.withColumn("new", F.coalesce(F.col("s") >= before, F.lit(True)).cast("int"))
    islands = begins.withColumn("island", F.sum("new").over(own.orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    one = islands.groupBy("id", "th", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return one.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("more"))


def lean(found: Column) -> Column:
    """Spans without the texts in and around them."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def based(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``extracted`` without the method's own values: the id and the base spans of each kind, in one pass over the texts."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    return docs.select(F.col(quoted(id_col)).alias(id_col), *[lean(c).alias(k) for k, c in base_spans(text).items()])


def extracted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, an array of spans ``(s, e)`` for each kind of KINDS, and one for values found by the method.

    Positions are code points, end exclusive. A null text is an empty one. Rows equal in id and text have equal results;
    null ids stay. Values that overlap a base span are not reported again, values that overlap one another are one span.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    known = {**base_spans(F.col("t")), "key": _where(F.col("t"), F.contains("t", F.lit("AKIA")), KEY), "hex": _where(F.col("t"), F.lit(True), DIGEST)}
    # Columns of their own: fields of one struct would be put back into the lambdas that read them, and run for every word.
    scan = texts.select("id", "th", "t", *[c.alias(f"found_{k}") for k, c in known.items()]).select(
        "id", "th", *[lean(F.col(f"found_{k}")).alias(k) for k in (*KINDS, "key")],
        F.concat(*[seeds_in_prose(F.col(f"found_{k}"), F.lit("upper" if k == "key" else k)) for k in known]).alias("prose"),
        occurrences(F.col("t")).alias("occ"), "t",
    )
    # The text is kept where there are seeds in prose. A table, as its columns are read one by one.
    rows = written(scan.withColumn("t", F.when(F.size("prose") > 0, F.col("t"))))
    # Rows equal in id and text are one document to the graph, and the graph counts different values: copies add nothing.
    occ = durable(rows.filter(F.size("occ") > 0).select("id", "th", "occ").dropDuplicates(["id", "th"]).select("id", "th", F.inline("occ")))
    seeds = rows.filter(F.size("prose") > 0).select(F.inline("prose")).select(F.inline("cues"), "near", "value", "shape", F.lit(True).alias("seed"))
    seeds = durable(seeds.distinct())
    wanted = written(seeds.groupBy("cue", "near", "ends").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT).drop("n"))
    pairs = occ.select("cue", "value", "shape", "seed")
    sent = lambda n: n <= MOST_SENT
    if n_wanted := wanted.count():
        held = seeds.drop("near", "ends").join(F.broadcast(wanted) if sent(n_wanted) else wanted, "cue", "left_semi")
        words = written(values_in_contexts(texts, wanted, sent(n_wanted)))
        near = in_contexts(rows.filter(F.size("prose") > 0).select("id", "th", "t"), wanted, sent(n_wanted))
        # Values of the texts with seeds are among those of all texts.
        near = near.filter("shape = 'plain'").select("cue", "value", "shape", "seed").distinct()
        occ = occ.union(words.select(occ.columns))
        pairs = written(pairs.union(held).union(words.select("cue", "value", "shape", "seed")).union(near).distinct())
        wanted = written(fit(wanted, pairs))
        if n_wanted := wanted.count():
            words = in_contexts(texts, wanted, sent(n_wanted))
            pairs = pairs.union(words.filter("shape = 'plain'").select("cue", "value", "shape", "seed"))
    good = patterns(pairs.distinct()).filter(extracts()).select("cue")
    places = written(occ.filter("shape <> 'plain'").select("id", "th", "s", "e", "cue"))
    counts = written(places.groupBy("cue").agg(F.count(F.lit(1)).alias("n")).join(good, "cue"))
    keys = rows.filter(F.size("key") > 0).select("id", "th", F.inline("key")).distinct()
    found = join_by_key(places, counts, ["cue"], places.count()).select("id", "th", "s", "e").union(keys)
    base = rows.select("id", "th", F.inline(F.concat(*[F.col(k) for k in KINDS])))
    more = disjoint(found, base).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "more")
    joined = rows.join(more, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    none = F.array().cast("array<struct<s:int,e:int>>")
    return joined.select(F.col("id").alias(id_col), *KINDS, F.coalesce("more", none).alias(EXTRA))


def named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; needs ids that are not null and unique."""
    key, spots_name = free_names(docs, "key", "spots")
    pair = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    found = extracted(pair, "id", "text")

    def mark(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind}]").alias("r")))

    every = F.concat(*[mark(k) for k in (*KINDS, EXTRA)])
    spots = found.select(F.col("id").alias(key), F.array_sort(every).alias(spots_name))
    t = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), x["r"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), gap.alias("out"))

    done = F.aggregate(spots_name, first, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    own = [done.alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns]
    return docs.join(spots, F.col(quoted(id_col)) == F.col(key)).select(own)


def base_columns() -> list[Column]:
    """Numbers and digest of the base spans."""
    base = F.concat(*[named(k) for k in KINDS])
    return [*[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: base and all spans of every document."""
    found = extracted(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *base_columns(), F.array_join(F.concat(*[named(k) for k in (*KINDS, EXTRA)]), ",").alias("spans"))
