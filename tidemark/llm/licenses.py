"""License scans by diagonal voting.

All rolling word pairs of the documents are joined with the places of the same pairs in the license templates (a
fixed list of phrases, so that side is broadcast). A match votes for the diagonal `place in document - place in
template`. Votes are counted per document, template and diagonal; diagonals at most `reach` apart are merged, whatever
other diagonals got votes in between, which bridges inserted or lost words. A span is verified in order: the longest
chain of votes that goes forward in document and template alike, from one vote to the next by at most `reach`
diagonals, must hold `least` of the template's pairs. Each vote compares both words themselves, so a hash collision
can't make one.

The base phrases must stand word for word: all their pairs on one diagonal. Longer templates need `least` of their
pairs, and add labels of their own (bsd, mpl, cc, and others, or the base labels).

Edge cases: null and empty texts, or texts without a word, have n_words 0, no labels and score 0; texts of any length
are scanned whole; rows that share a doc_id stay separate rows, equal ones too (they are scanned once and given out as
often as they came), as do rows with a null doc_id; an empty table gives no rows; other columns, of whatever name, are
not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but these.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Well-known sentences of public licenses and their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("the person who associated a work with this deed has dedicated the work to the public domain", "cc0"),
    ("boost software license version 1 0", "boost"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "zlib"),
    ("this font software is licensed under the sil open font license version 1 1", "ofl"),
]


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, GAPS), lambda w: w != "")


def template_pairs(spark: SparkSession) -> DataFrame:
    rows = []
    for t, (phrase, label) in enumerate(BASE + TEMPLATES):
        w = phrase.split()
        rows += [(t, label, t < len(BASE), len(w) - 1, p, w[p], w[p + 1]) for p in range(len(w) - 1)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, pairs int, place int, word string, next string")
    return table.withColumn("pair", F.xxhash64("word", "next"))


def longest_chain(votes: list[tuple[int, int]], reach: int) -> tuple[int, int, int]:
    """(votes, place in the document of the first and of the last one) of the longest chain among votes
    (diagonal, place in template): each next vote lies further on in both and at most `reach` diagonals away."""
    best: dict[tuple[int, int], tuple[int, int]] = {}  # vote -> votes of the best chain that ends there, less its first place
    top = (0, 0, 0)
    for d, p in sorted(votes, key=lambda v: (v[1], v[0])):
        found = (1, -(d + p))
        for e in range(d - reach, d + reach + 1):
            for q in range(p):
                if q + e < p + d and (e, q) in best:
                    n, first = best[e, q]
                    found = max(found, (n + 1, first))
        best[d, p] = found
        top = max(top, (found[0], found[1], -(d + p)))
    return top[0], -top[1], -top[2]


def verified_span(reach: int) -> Column:
    @F.pandas_udf("found int, first long, last long")
    def verify(votes: pd.Series) -> pd.DataFrame:
        rows = [longest_chain([(v["diagonal"], v["place"]) for v in group], reach) for group in votes]
        return pd.DataFrame(rows, columns=["found", "first", "last"])

    return verify


def scan_licenses(docs: DataFrame, least: float = 0.8, reach: int = 3) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row."""
    spark = docs.sparkSession
    # Rows are told apart by their values, which a recomputed task gives again; equal rows are counted.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit("two"), text, F.octet_length(text)).alias("two")).alias("row")
    # A last empty word stands for the row itself, so that rows without any match come through the same pass.
    rows = docs.select(row, F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
    # The array is made once below the generator; the words are told apart while it streams.
    each = rows.select("row", "w", F.posexplode("w").alias("at", "this"))
    each = each.select("row", F.col("at").cast("long").alias("at"), "this", F.get("w", F.col("at") + 1).alias("following"))
    each = each.withColumn("hash", F.xxhash64("this", "following"))
    pairs = F.broadcast(template_pairs(spark))
    same = (F.col("hash") == F.col("pair")) & (F.col("this") == F.col("word")) & (F.col("following") == F.col("next"))
    votes = each.join(pairs, same, "left").where(F.col("template").isNotNull() | (F.col("this") == ""))
    votes = votes.select("row", "at", "template", "label", "base", "pairs", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    diagonals = votes.groupBy("row", "template", "label", "base", "pairs", "diagonal").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.collect_set("place").alias("places"))
    # Diagonals within reach of each other form one span; a base phrase stands on one diagonal.
    beside = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(beside) > reach), F.lit(True))
    votes_of = F.transform("places", lambda p: F.struct("diagonal", p.alias("place")))
    numbered = diagonals.withColumn("span", F.sum(apart.cast("int")).over(beside)).withColumn("votes", votes_of)
    spans = numbered.groupBy("row", "template", "label", "base", "pairs", "span").agg(
        F.max("n").alias("n"), F.min("first").alias("first"), F.flatten(F.collect_list("votes")).alias("votes"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places")
    )
    enough = (F.col("places") / F.col("pairs")) >= least
    # Spans with too few places of the template can't hold a chain that is long enough.
    checked = F.when(~F.col("base") & enough, F.col("votes")).otherwise(F.array())
    spans = spans.withColumn("chain", verified_span(reach)(checked)).withColumn("whole", F.col("places") == F.col("pairs"))
    share = F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("chain.found") / F.col("pairs"))
    ok_base, itself = F.col("base") & F.col("whole"), F.col("template").isNull()
    good = ok_base | (~F.col("base") & (share >= least))
    start, end = F.when(F.col("base"), F.col("first")).otherwise(F.col("chain.first")), F.when(F.col("base"), F.col("first") + F.col("pairs") - 1).otherwise(F.col("chain.last"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("row").agg(
        F.max(F.when(itself, F.col("n"))).alias("copies"),
        F.max(F.when(itself, F.col("first"))).alias("n_words"),
        F.sum(F.when(ok_base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(ok_base, F.col("first"))).alias("first_word"),
        F.max(F.when(ok_base, F.col("first"))).alias("last_word"),
        joined(F.when(ok_base, F.col("label"))).alias("base_labels"),
        joined(F.when(good, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(good, share)), F.lit(0.0)).cast("double").alias("score"),
        F.array_sort(F.collect_list(F.when(good, F.struct(start.alias("first"), (end + 2).alias("end"), "label")))).alias("spans"),
    )
    return out.select("row.doc_id", *out.columns[2:], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
