"""License scan: phrases, and every text block that contains a template.

Words are runs of ASCII letters and digits and of all non-ASCII characters,
A-Z lower-cased.  ``BASE`` phrases are found wherever their words stand
consecutively.

The method is a set-similarity join of text blocks with license templates.
A template's blocks are all windows of twice its words, BLOCK_WORDS at least.
A block matches when it has at least ``threshold`` percent of a template's
distinct tokens.  Only windows that start at a template token are tried: any
other can be moved on to its first one and loses none.  Tokens are ordered by
their number of documents in the whole corpus, rare first; a document that
holds a matching block must have one of a template's first
``n - ceil(t * n) + 1`` tokens (prefix filter) and as many of its tokens as the
threshold asks for (length filter).  In a block, the rarest token's place bounds
the overlap by the tokens from there on in template and block (positional
filter) before distinct tokens are counted.  ``MARKS`` tell the licenses of a
family apart: a block with another one's distinguishing word does not match.

Defined results: null, empty and wordless texts have 0 words, no places, empty
labels and score 0; repeated rows are judged alike.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import docs_of, stage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Template -> label of the method.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-text",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}
# Label -> (words one of which a block must have, words it may not have), which tell
# the licenses of a family apart.
MARKS = {"cc-by-nc-notice": (["nc", "noncommercial"], ["sa", "sharealike", "nd", "noderivatives"]),
         "cc-by-sa-notice": (["sa", "sharealike"], ["nc", "noncommercial", "nd", "noderivatives"]),
         "cc-by-notice": ([], ["nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives"])}
THRESHOLD = 80
BLOCK_WORDS = 32


def words_of(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _joined(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _places(phrase: str) -> Column:
    """Starts of a phrase among ``words``; only texts that hold it pay for it."""
    parts = phrase.split()
    n = len(parts)
    at = F.filter(F.sequence(F.lit(0), F.size("words") - n),
                  lambda i: F.slice("words", i + 1, F.lit(n)) == F.array(*map(F.lit, parts)))
    return F.when(F.col("joined").contains(f" {phrase} "), at).otherwise(F.array().cast("array<int>"))


def token_order(words: DataFrame, tokens: list[str]) -> list[str]:
    """Template tokens, the ones in fewest documents first (all documents count)."""
    vocabulary = F.array(*map(F.lit, tokens))
    counts = (words.select(F.explode(F.array_intersect("words", vocabulary)).alias("token"))
              .groupBy("token").count().collect())                      # one row per template token
    seen = {r["token"]: r["count"] for r in counts}
    return sorted(tokens, key=lambda t: (seen.get(t, 0), t))


def template_matches(words: DataFrame, templates: dict[str, str], threshold: int,
                     marks: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """(key, label, containment) of every matching block, best per label.
    ``words``: key, words.  ``marks``: per label the words of which a block must
    have one, and those it may not have."""
    spark = words.sparkSession
    order = token_order(words, sorted({t for x in templates for t in x.split()}))
    rank = {t: i for i, t in enumerate(order)}
    rows = []
    for text, label in templates.items():
        tokens = sorted(set(text.split()), key=rank.get)
        need = ceil(threshold * len(tokens) / 100)
        width = max(BLOCK_WORDS, 2 * len(text.split()))
        for token in tokens[:len(tokens) - need + 1]:
            rows.append((token, label, tokens, need, width, *(marks or {}).get(label, ([], []))))
    index = spark.createDataFrame(rows, "token string, label string, tokens array<string>, need int, width int, "
                                  "must array<string>, may_not array<string>")
    first = F.array(*[F.lit(t) for t in sorted({r[0] for r in rows})])
    # The index has (templates x prefix) rows, a size fixed by the templates given.  A document meets
    # a template once: by the rarest of its tokens that it has.
    mine = F.array_intersect("tokens", "words")
    pairs = (words.where(F.arrays_overlap("words", first))
             .select("key", "words", F.explode(F.array_intersect("words", first)).alias("token"))
             .join(F.broadcast(index), "token").where((F.size(mine) >= F.col("need")) & (F.get(mine, F.lit(0)) == F.col("token"))))
    # Where a template's tokens and marks stand: twice a token's place in the order, and one more
    # for a word asked for; -1 for a word not allowed.
    hits = pairs.select("key", "label", "need", "width", F.size("tokens").alias("n"), F.size("must").alias("asks"), F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("at"), F.when(F.array_contains("may_not", w), -1).otherwise(
            2 * F.array_position("tokens", w).cast("int") + F.array_contains("must", w).cast("int")).alias("code"))),
        lambda h: h["code"] != 0).alias("hits"))
    # A row of a window holds the window only, so a text needs as much as its hits times the width.
    windows = F.transform("hits", lambda h, i: F.when(h["code"] > 1, F.transform(
        F.filter(F.slice("hits", i + 1, F.col("width")), lambda x: x["at"] < h["at"] + F.col("width")), lambda x: x["code"])))
    blocks = (hits.select("key", "label", "need", "n", "asks", F.explode(windows).alias("block")).where("block is not null")
              .where("(asks = 0 or exists(block, c -> c % 2 = 1)) and not array_contains(block, -1)")
              .select("key", "label", "need", "n", F.expr("filter(transform(block, c -> c div 2), p -> p > 0)").alias("places")))
    most = F.least(F.col("n") - F.array_min("places") + 1, F.size("places"))
    both = F.size(F.array_distinct("places"))
    return (blocks.where(most >= F.col("need")).where(both >= F.col("need"))
            .groupBy("key", "label").agg(F.max(both / F.col("n")).alias("containment")))


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None,
                 threshold: int = THRESHOLD, marks: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score (the best containment; 1 with a base
    phrase).  A text of any length is scanned whole, in memory that grows with
    it; labels are sorted, so ties leave nothing open."""
    base, templates, marks = base or BASE, templates or TEMPLATES, MARKS if marks is None else marks
    d = (docs_of(docs).withColumn("words", words_of(F.col("text")))
         .select("doc_id", F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).alias("key"), "words"))
    found = template_matches(d.select("key", "words"), templates, threshold, marks)
    method = stage(found.groupBy("key").agg(F.collect_set("label").alias("method"), F.max("containment").alias("best")), "licenses")
    phrases = list(base)
    per = (d.withColumn("joined", F.when(F.arrays_overlap("words", F.array(*[F.lit(p.split()[0]) for p in phrases])), _joined(F.col("words")))
                        .otherwise(F.lit("")))
           .select("doc_id", "key", F.size("words").cast("long").alias("n_words"),
                   *[_places(p).alias(f"p{i}") for i, p in enumerate(phrases)]))
    cols = [F.col(f"p{i}") for i in range(len(phrases))]
    every = F.concat(*cols)
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(base[p])) for c, p in zip(cols, phrases)]),
                                                    lambda x: x.isNotNull())))
    per = per.select("doc_id", "key", "n_words", F.size(every).cast("long").alias("n_base"),
                     F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
                     labels.alias("base"))
    # Repeated rows share a key and its matches; null ids compare equal inside the text of the key.
    name = F.to_json("key").alias("k")
    method = method.select(name, "method", "best")
    return (per.withColumn("k", name).join(method, "k", "left")
            .select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union("base", F.coalesce("method", F.array().cast("array<string>")))), ",")
                    .alias("labels"),
                    F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score")))
