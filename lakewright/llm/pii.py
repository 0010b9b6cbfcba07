"""Personal data: base patterns, and contexts learnt from what they find.

Base spans are the leftmost non-overlapping matches of fixed patterns, with
value checks.  They seed a bootstrap: the words around a seed induce lexical
patterns (one or two words to the left, or one on either side), a pattern
points at identifier-like tokens (with a digit or ``@``), and a bipartite graph
of patterns and instances is scored for a few rounds in Spark.  A pattern's
confidence in a kind is the occurrence-weighted mean of its instances' belief,
an instance's belief the confidence of its best pattern that is ``LEARN`` or
more for certain (1 for seeds, 0 for seeds of another kind): unseen identifiers
in a context of mostly seeds are missing evidence, seeds of another kind are
evidence against.  Patterns with enough distinct seeds and confidence add spans
at instances the base does not cover.

Only DataFrame functions are used.  Positions count code points.  Defined
results: null and empty texts have no spans (the digest is that of the empty
string); repeated rows are judged alike; an empty table gives no rows.  A very
long text is cut into pieces of words, and places are taken from running sums,
so that time and memory grow with its length and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import docs_of, stage

KINDS = ("email", "ip", "card", "phone")
# What a base match looks like.  Possessive where nothing can be
# given back; a match starts at a run's first character or where one ended, as
# a later start in the run would fail alike: no pattern rescans a run.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap conditions without which there can be no match that counts.
_WORTH = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9][\x20().0-9-]"),
}
ROUNDS = 3
MIN_SEEDS = 3
CONFIDENCE = 0.8
LEARN = 0.6                        # confidence from which a pattern's unseen instances are believed as much as it is,
SURE = 1.64                        # less so many standard errors: few occurrences prove little
SPACE = r"[\x20\x09-\x0D]"
PIECE = 128                        # words in a piece of a text, spans in a group
BLOCK = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Luhn's checksum of a digit string is a multiple of 10."""
    back = F.split(F.reverse(d), "")
    total = F.aggregate(F.transform(F.filter(back, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(values: Column, length: int) -> Column:
    """An array cut into arrays of ``length``; an empty one is one empty block."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / length).cast("int"))),
                       lambda j: F.slice(values, j * length + 1, F.lit(length)))


def running_starts(lengths: Column, levels: int = 2) -> Column:
    """For every element the sum of all before it.  Sums are taken in blocks and
    blocks of blocks, so the work is a constant number of steps an element."""
    def inside(block: Column, first: Column) -> Column:
        return F.transform(block, lambda _, i: first + F.aggregate(
            F.slice(block, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    if levels == 0:
        return _let(lengths, lambda ls: inside(ls, F.lit(0)))
    return _let(_blocks(lengths, BLOCK), lambda bs: _let(
        running_starts(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), levels - 1),
        lambda firsts: F.flatten(F.transform(bs, lambda b, j: inside(b, F.get(firsts, j))))))


def spans_of(kind: str, text: Column) -> Column:
    """Valid matches as structs (start, kind number, end).  The gaps that
    ``split`` leaves and the matches alternate, which gives their places."""
    pattern = PATTERNS[kind]
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("g"), matches.alias("m"))

    def placed(ps: Column) -> Column:
        lengths = F.transform(ps, lambda x: x["g"] + F.coalesce(F.length(x["m"]), F.lit(0)))
        return _let(running_starts(lengths), lambda at: F.filter(F.transform(ps, lambda x, i: F.when(
            x["m"].isNotNull() & _valid(kind, x["m"]), F.struct(
                (F.get(at, i) + x["g"]).alias("start"), F.lit(KINDS.index(kind)).alias("k"),
                (F.get(at, i) + x["g"] + F.length(x["m"])).alias("end")))), lambda s: s.isNotNull()))
    return F.when(_WORTH[kind](text), _let(parts, placed)).otherwise(F.array().cast("array<struct<start:int,k:int,end:int>>"))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    return F.array_sort(F.concat(*[spans_of(k, text) for k in KINDS]))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _pieces(text: Column, base: Column) -> Column:
    """The text's words in pieces of ``PIECE``: at (place of the first word), words,
    the words next to the piece (prev2, prev1, next1) and the base spans that touch it."""
    def touching(spans: Column, low: Column, high: Column) -> Column:
        return F.filter(spans, lambda s: (s["start"] < high) & (s["end"] > low))

    def cut(ws: Column, groups: Column, lengths: Column, starts: Column) -> Column:
        def piece(length: Column, j: Column) -> Column:
            low = F.get(starts, j)
            near = F.filter(groups, lambda g: (g["low"] < low + length) & (g["high"] > low))
            return F.struct(low.alias("at"), F.slice(ws, j * PIECE + 1, F.lit(PIECE)).alias("words"),
                            F.get(ws, j * PIECE - 2).alias("prev2"), F.get(ws, j * PIECE - 1).alias("prev1"),
                            F.get(ws, j * PIECE + PIECE).alias("next1"),
                            F.flatten(F.transform(near, lambda g: touching(g["spans"], low, low + length))).alias("base"))
        return F.transform(lengths, piece)
    # Base spans go by start, so blocks of them with their outer borders need not be searched one by one.
    groups = F.transform(F.filter(_blocks(base, PIECE), lambda b: F.size(b) > 0), lambda b: F.struct(
        F.get(b, F.lit(0))["start"].alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high"), b.alias("spans")))
    return _let(F.split(text, SPACE), lambda ws: _let(groups, lambda gs: _let(
        F.transform(_blocks(ws, PIECE), lambda b: F.aggregate(b, F.lit(0), lambda a, w: a + F.length(w) + 1)),
        lambda ls: _let(running_starts(ls), lambda at: cut(ws, gs, ls, at)))))


def _tokens(d: DataFrame) -> DataFrame:
    """Identifier-like tokens of texts that have any, with their places and the
    words around them: key, start, end, instance, k (of the base span that
    begins in the token, else null), covered, left1, left2, right1."""
    pieces = (d.where(F.col("text").rlike("[0-9@]")).select("key", F.explode(_pieces(F.col("text"), F.col("base"))).alias("p"))
              .select("key", "p.*"))
    hits = pieces.select("*", F.explode(F.filter(
        F.transform("words", lambda w, i: F.when(w.rlike("[0-9@]"), i)), lambda i: i.isNotNull())).alias("i"))
    clean = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^\W+|\W+$", "")
    i = F.col("i")
    word = F.get("words", i)
    lead = F.length(word) - F.length(F.regexp_replace(word, r"^[^\w@+]+", ""))
    core = F.regexp_replace(F.regexp_replace(word, r"^[^\w@+]+", ""), r"[^\w]+$", "")
    before = F.when(i > 0, F.length(F.array_join(F.slice("words", F.lit(1), i), " ")) + 1).otherwise(0)
    left1 = F.when(i > 0, F.get("words", i - 1)).otherwise(F.col("prev1"))
    left2 = F.when(i > 1, F.get("words", i - 2)).when(i == 1, F.col("prev1")).otherwise(F.col("prev2"))
    right1 = F.when(i + 1 < F.size("words"), F.get("words", i + 1)).otherwise(F.col("next1"))
    t = hits.select("key", "base", (F.col("at") + before + lead).alias("start"), core.alias("instance"),
                    clean(left1).alias("left1"), clean(left2).alias("left2"), clean(right1).alias("right1"))
    t = t.where("instance <> ''").withColumn("end", F.col("start") + F.length("instance"))
    mine = F.filter("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    return (t.withColumn("mine", mine).select(
        "key", "start", "end", "instance", "left1", "left2", "right1", (F.size("mine") > 0).alias("covered"),
        # Only the token a span begins in stands for the entity.
        F.when(F.get("mine", F.lit(0))["start"] >= F.col("start"), F.get("mine", F.lit(0))["k"]).alias("k")))


def _patterns() -> Column:
    l1, l2, r1 = F.col("left1"), F.col("left2"), F.col("right1")
    return F.filter(F.array(
        F.when(l1 != "", F.concat(l1, F.lit(" _"))),
        F.when((l1 != "") & (l2 != ""), F.concat(l2, F.lit(" "), l1, F.lit(" _"))),
        F.when((l1 != "") & (r1 != ""), F.concat(l1, F.lit(" _ "), r1))), lambda p: p.isNotNull())


def score_patterns(tokens: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
                   confidence: float = CONFIDENCE) -> DataFrame:
    """High-confidence (pattern, k).  The graph is pre-aggregated to one edge
    per pattern and instance before anything is scored."""
    # Continuation parts of an entity (covered, but not its first token) say nothing about its context.
    edges = stage(tokens.where(~F.col("covered") | F.col("k").isNotNull())
                  .select(F.explode(_patterns()).alias("pattern"), "instance", "k")
                  .groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("k").alias("k")), "graph")
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    seeds = edges.where("k is not null").select("pattern", "instance", "k", "n")
    support = seeds.groupBy("pattern", "k").agg(F.count("*").alias("seeds"))
    belief = seeds.select("instance", "k").distinct().withColumn("belief", F.lit(1.0))
    fixed = edges.where("k is not null").select("instance").distinct()
    scored = None
    for _ in range(rounds):
        scored = (edges.select("pattern", "instance", "n").join(belief, "instance")
                  .groupBy("pattern", "k").agg(F.sum(F.col("n") * F.col("belief")).alias("good"))
                  .join(total, "pattern").join(support, ["pattern", "k"])
                  .select("pattern", "k", "seeds", "total", (F.col("good") / (F.col("total") + 0.5)).alias("confidence")))
        scored = stage(scored, "patterns")
        c = F.least(F.col("confidence"), F.lit(1.0))
        likely = scored.where((F.col("seeds") >= min_seeds) & (c - SURE * F.sqrt(c * (1 - c) / F.col("total")) >= LEARN))
        learnt = (edges.select("pattern", "instance").join(likely, "pattern")
                  .groupBy("instance", "k").agg(F.max("confidence").alias("belief")).join(fixed, "instance", "left_anti"))
        belief = stage(seeds.select("instance", "k").distinct().withColumn("belief", F.lit(1.0)).unionByName(learnt), "belief")
    return scored.where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= confidence)).drop("total")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["k"] == kind)).cast("long")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, n_added."""
    d = docs_of(docs).select("doc_id", "text", F.concat_ws(
        ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"),
        F.length("text").cast("string")).alias("key"), base_spans(F.col("text")).alias("base"))
    tokens = stage(_tokens(d), "tokens")
    strong = score_patterns(tokens)
    added = (tokens.where("not covered").select("key", "start", "end", F.explode(_patterns()).alias("pattern"))
             .join(strong, "pattern")
             .groupBy("key", "start", "end").agg(F.max_by("k", F.struct(F.col("confidence"), -F.col("k"))).alias("k"))
             .groupBy("key").agg(F.collect_set(F.struct("start", "k", "end")).alias("added")))
    base = d.drop("text")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,k:int,end:int>>"))))
    return (base.join(added, "key", "left").select(
        "doc_id", *[_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(spans).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added")))
