"""License scan in DataFrame operations only.

Base labels are phrases whose words stand consecutively.  The method's labels
come from an exact set-similarity join of text blocks with license templates: a
block meets a template if it holds at least the threshold's share of its
distinct words.  Blocks are the lines and, for notices wrapped over lines, all
windows of as many consecutive words of the text as the template has.  Lines: words are ordered by how many documents hold them in
the whole table, rare ones first; a block that meets a template must hold one
of the template's first ``size - needed + 1`` words (prefix filter), have
``needed`` words (length filter) and have enough words of the templates left
from the first match on, on both sides (positional filter).  What passes is
verified on the whole sets, so no block is missed.  Windows: only texts that hold
a template's needed words anywhere are looked at, and only windows that start at
one of its words, so no window is missed either.

Templates are configuration: their index is a literal in the plan and is
bounded by ``MAX_TEMPLATE_WORDS``.  Only counts and the few candidate lines
are shuffled, never texts.

Defined cases: a null text is empty; a text without words has n_words 0, no
labels and score 0; rows repeated with one doc_id are scanned one by one;
extra columns are ignored; blank templates and phrases are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
MAX_TEMPLATE_WORDS = 20_000

#: (phrase, label)
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: (label, words of the notice): notices as the licenses' own texts recommend them.
TEMPLATES = (
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def normal(text: Column) -> Column:
    """Lower-case words, one blank between them."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, " "))


def _count(part: Column) -> Column:
    """Words of text whose words have a blank on either side each."""
    t = F.trim(part)
    return F.when(t == "", F.lit(0)).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit("  "), F.lit(" "))) + 1).cast("long")


def _least(cols: list[Column], pick) -> Column:
    return pick(*cols) if len(cols) > 1 else cols[0]


def base_columns(doc: DataFrame, phrases) -> DataFrame:
    """``doc`` (norm) with n_words, n_base, first_word, last_word and base (labels)."""
    doc = doc.withColumn("spaced", F.concat(F.lit(" "), F.replace("norm", F.lit(" "), F.lit("  ")), F.lit(" ")))
    doc = doc.withColumn("n_words", _count(F.col("spaced")))
    n, first, last, labels = [], [], [], []
    for phrase, label in phrases:
        words = phrase.split()
        sign = " " + "  ".join(words) + " "
        here = F.contains("spaced", F.lit(sign))
        n.append(F.when(here, F.regexp_count("spaced", F.lit(f"(?={sign})"))).otherwise(0))
        first.append(F.when(here, _count(F.substring_index("spaced", sign, 1))))
        last.append(F.when(here, F.col("n_words") - len(words) - _count(F.substring_index("spaced", sign, -1))))
        labels.append(F.when(here, F.lit(label)))
    total = n[0]
    for x in n[1:]:
        total = total + x
    return (
        doc.withColumn("n_base", total.cast("long"))
        .withColumn("first_word", _least(first, F.least))
        .withColumn("last_word", _least(last, F.greatest))
        .withColumn("base", F.array_compact(F.array(*labels)))
        .drop("spaced")
    )


def word_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many texts of the whole table each of ``words`` stands."""
    own = F.array(*map(F.lit, words))
    held = docs.select(F.explode(F.array_intersect(F.split(normal(F.coalesce(F.col("text").cast("string"), F.lit(""))), " "), own)).alias("w"))
    return {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


def _windows(own: DataFrame) -> DataFrame:
    """(row, label, share) of the templates that a window of words meets; the share is that of the best window."""
    each = own.select("row", "places", F.explode("wanted").alias("t")).select("row", "t", F.filter("places", lambda x: F.array_contains(F.col("t.members"), x["word"])).alias("places"))
    best = "array_max(transform(places, (x, i) -> size(array_distinct(transform(filter(slice(places, i + 1, t.length), y -> y.at < x.at + t.length), y -> y.word)))))"
    each = each.select("row", "t", F.expr(best).alias("best")).where("best >= t.needed")
    return each.select("row", F.col("t.label").alias("label"), (F.col("best") / F.size("t.members")).alias("share"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs`` (doc_id, text).

    The score is the largest share of a template that a block holds, 1 for a base phrase, 0 without labels.
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    lengths = [len(text.split()) for _, text in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    if not all(s for _, s in sets) or not all(p.split() for p, _ in phrases) or len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError("templates and phrases need words, and templates a bounded number of them")
    counts = word_counts(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, front, whole = [], set(), []
    for t, (label, words) in enumerate(sets):
        words = sorted(words, key=rank.__getitem__)
        needed = max(1, -int(-threshold * len(words) // 1))
        whole.append((label, lengths[t], needed, words))
        for pos, w in enumerate(words[: len(words) - needed + 1]):
            front.add(w)
            index.append((rank[w], t, label, pos, len(words), needed, [rank[x] for x in words]))
    ranks = F.create_map(*(x for w in order for x in (F.lit(w), F.lit(rank[w]))))
    first_words, all_words = F.array(*map(F.lit, sorted(front))), F.array(*map(F.lit, order))

    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    own = docs.select("doc_id", low.alias("low")).withColumn("norm", normal(F.col("low")))
    own = base_columns(own, phrases)
    lines = F.filter(F.split("low", "\n"), lambda x: F.arrays_overlap(F.split(F.regexp_replace(x, NOT_WORD, " "), " "), first_words))
    own = own.withColumn("held", F.array_intersect(F.split("norm", " "), all_words))
    own = own.withColumn("lines", F.when(F.arrays_overlap("held", first_words), lines))
    # templates that the whole text could meet, and where their words stand in it
    wanted = F.array(*(F.struct(F.lit(lab).alias("label"), F.lit(m).alias("length"), F.lit(c).alias("needed"), F.array(*map(F.lit, w)).alias("members")) for lab, m, c, w in whole))
    several = F.arrays_overlap("held", first_words) & F.contains("low", F.lit("\n"))
    own = own.withColumn("wanted", F.when(several, F.filter(wanted, lambda t: F.size(F.array_intersect(F.col("held"), t["members"])) >= t["needed"])))
    places = F.filter(F.transform(F.split("norm", " "), lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains(all_words, x["word"]))
    own = own.withColumn("places", F.when(F.size("wanted") > 0, places))
    own = staged(own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "lines", "wanted", "places"), "licenses")

    blocks = own.select("row", F.posexplode("lines").alias("line", "text"))
    blocks = blocks.select("row", "line", F.array_distinct(F.split(normal(F.col("text")), " ")).alias("words"))
    # words of the templates only, as ranks in the global order
    blocks = blocks.select("row", "line", F.size("words").alias("size"), F.array_sort(F.transform(F.array_intersect("words", all_words), lambda w: F.element_at(ranks, w))).alias("ranks"))
    probe = blocks.select("row", "line", "size", "ranks", F.posexplode("ranks").alias("at", "rank"))
    entries = F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(t).alias("template"), F.lit(lab).alias("label"), F.lit(p).alias("pos"), F.lit(s).alias("n"), F.lit(c).alias("needed"), F.array(*map(F.lit, m)).alias("members")) for r, t, lab, p, s, c, m in index))
    table_ = spark.range(1, numPartitions=1).select(F.inline(entries))
    near = probe.join(F.broadcast(table_), "rank").where("size >= needed and 1 + least(n - pos - 1, size(ranks) - at - 1) >= needed")
    share = F.size(F.array_intersect("ranks", "members"))
    met = near.where(share >= F.col("needed")).select("row", "label", (share / F.col("n")).alias("share"))
    met = met.unionByName(_windows(own))
    found = met.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))

    out = own.drop("lines", "wanted", "places").join(found, "row", "left")
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("base")).alias("base_labels"), join(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    phrases = ", ".join(f"('{p}', '{lab}', {len(p.split())})" for p, lab in PHRASES)
    templates = ", ".join(f"('{lab}', list_distinct(string_split('{text}', ' ')), {len(text.split())})" for lab, text in TEMPLATES)
    norm = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, list_filter(string_split({norm.format('text')}, ' '), lambda x: x <> '') AS words FROM d),
ph(phrase, label, m) AS (VALUES {phrases}),
occ AS (SELECT k, label, i FROM w, ph, LATERAL (SELECT unnest(range(0, len(words) - m + 1)) AS i) r
       WHERE array_to_string(words[i + 1 : i + m], ' ') = phrase),
b AS (SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM occ GROUP BY k),
tm(label, tw, size) AS (VALUES {templates}),
l AS (SELECT k, list_distinct(string_split({norm.format('line')}, ' ')) AS lw FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)),
lm AS (SELECT k, label, len(list_intersect(lw, tw)) AS inter, len(tw) AS n FROM l, tm WHERE len(list_intersect(lw, tw)) >= ceil({THRESHOLD} * len(tw))),
c AS (SELECT k, words, label, tw, size FROM w JOIN d USING (k, doc_id), tm WHERE contains(text, chr(10)) AND len(list_intersect(words, tw)) >= ceil({THRESHOLD} * len(tw))),
wm AS (SELECT k, label, len(list_intersect(words[i : i + size - 1], tw)) AS inter, len(tw) AS n
       FROM c, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i) r WHERE list_contains(tw, words[i])),
m AS (SELECT * FROM lm UNION ALL SELECT * FROM wm WHERE inter >= ceil({THRESHOLD} * n)),
s AS (SELECT k, max(inter / n) AS share FROM m GROUP BY k),
a AS (SELECT k, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT k, label FROM occ UNION ALL SELECT k, label FROM m) GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (k) LEFT JOIN s USING (k) LEFT JOIN a USING (k)
"""


OP7_SQL = _sql()
