"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram hash of a text is joined to the template positions
that have it. Hits of one template on one diagonal (position in the text less
position in the template) vote together; diagonals a few words apart, as a word
put in or left out makes them, are merged; and a merged span is verified word by
word: the words of each hit are compared with the template's, and what counts
is the share of the template's own positions that stand so, each counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases that must stand word by word, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Well-known license passages, found also when a few words differ.
PASSAGES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit-text"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this work is licensed under the gnu general public license", "gpl-notice"),
    ("this work is licensed under a creative commons attribution", "cc-by-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lower-cased, then maximal runs of letters, digits and anything beyond ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


def bigrams(w: Column) -> Column:
    """Hashes of words i and i+1, for each i (the last stands with null)."""
    return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def fourgrams(pairs: Column) -> Column:
    """Hashes of words i to i+3, rolled from the bigram hashes of i and i+2."""
    return F.zip_with(pairs, F.slice(pairs, 3, F.greatest(F.size(pairs) - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def said(w: Column, place: Column, k: int) -> Column:
    """The k words from a place on."""
    return F.array(*[F.get(w, place + n) for n in range(k)])


def templates(spark: SparkSession, phrases, passages) -> DataFrame:
    """The rolling hashes of all templates with their positions: bigrams of phrases, 4-grams of passages. Fixed texts: a few hundred rows."""
    rows = [(k, label, text, exact) for k, (text, label, exact) in enumerate([(t, n, True) for t, n in phrases] + [(t, n, False) for t, n in passages])]
    table = spark.createDataFrame(rows, "template int, label string, body string, exact boolean")
    table = table.withColumn("w", words(F.col("body")))
    two = bigrams(F.col("w"))
    grams = F.when(F.col("exact"), F.slice(two, 1, F.size("w") - 1)).otherwise(F.slice(fourgrams(two), 1, F.greatest(F.size("w") - 3, F.lit(0))))
    index = table.select("template", "label", "exact", F.size(grams).alias("n_grams"), "w", F.posexplode(grams).alias("at", "hash"))
    return index.withColumn("asked", F.when(F.col("exact"), said(F.col("w"), F.col("at"), 2)).otherwise(said(F.col("w"), F.col("at"), 4))).drop("w")


def license_spans(docs: DataFrame, phrases=PHRASES, passages=PASSAGES, coverage: float = 0.6, drift: int = 3) -> DataFrame:
    """Verified spans: doc_key, doc_id, n_words, template, label, exact, first_word, last_word (first places of the span's first and last n-gram), votes, covered.

    A row with template -1 stands for each input row, so that texts without
    a span appear too. Phrases must be met in full; passages by the given share
    of their 4-grams. Hits whose hash agrees and whose words differ count for nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).withColumn("doc_key", F.monotonically_increasing_id())
    rows = rows.select("doc_id", "doc_key", words(F.col("text")).alias("w"))
    # One entry for each word place, and one (place -1, hash of nothing) that stands for the row itself.
    mark = F.lit(0).cast("long")
    rows = rows.withColumn("two", bigrams(F.col("w")))

    def entries(hashes, k):
        return F.transform(hashes, lambda x, i: F.struct(i.alias("place"), F.when(x == 0, F.lit(1)).otherwise(x).alias("hash"), said(F.col("w"), i, k).alias("said")))

    own = F.array(F.struct(F.size("w").alias("place"), mark.alias("hash"), F.lit(None).cast("array<string>").alias("said")))
    places = rows.select("doc_id", "doc_key", F.explode(F.concat(own, entries(F.col("two"), 2), entries(fourgrams(F.col("two")), 4))).alias("p")).select("doc_id", "doc_key", "p.*")
    index = templates(spark, phrases, passages)
    lone = spark.createDataFrame([(-1, None, None, 0, 0, 0, None)], "template int, label string, exact boolean, n_grams int, at int, hash long, asked array<string>")
    hits = places.join(F.broadcast(index.unionByName(lone)), "hash")
    # Votes of each diagonal.
    votes = hits.withColumn("diagonal", F.when(F.col("template") >= 0, F.col("place") - F.col("at")))
    near = votes.groupBy("doc_key", "doc_id", "template", "label", "exact", "n_grams", "diagonal").agg(F.collect_set(F.struct("at", "place", F.col("said").eqNullSafe(F.col("asked")).alias("holds"))).alias("met"))
    # Merge diagonals of one template that drift by a few words: their texts are within a template's length of each other.
    order = Window.partitionBy("doc_key", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    fresh = F.when(F.col("exact") | step.isNull() | (step > drift), 1).otherwise(0)
    merged = near.withColumn("island", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("doc_key", "doc_id", "template", "label", "exact", "n_grams", "island").agg(F.filter(F.flatten(F.collect_list("met")), lambda m: m["holds"]).alias("met"))
    spans = spans.withColumn("votes", F.size(F.array_distinct("met.at"))).withColumn("first_word", F.array_min("met.place")).withColumn("last_word", F.array_max("met.place"))
    spans = spans.withColumn("n_words", F.col("last_word")).drop("met")
    share = F.col("votes") / F.greatest(F.col("n_grams"), F.lit(1))
    good = F.when(F.col("exact"), F.col("votes") == F.col("n_grams")).otherwise(share >= coverage)
    return spans.withColumn("covered", share).filter((F.col("template") < 0) | good)


def license_scan(docs: DataFrame, phrases=PHRASES, passages=PASSAGES, coverage: float = 0.6, drift: int = 3) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null or empty text has no words and no labels (empty strings, score 0).
    Repeated rows and null ids each get a row of their own; other columns are
    ignored. score is the largest share of a template that a span covers.
    """
    spans = license_spans(docs, phrases, passages, coverage, drift)
    base, own = F.col("template") >= 0, F.col("template") < 0
    exact = base & F.col("exact")
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    return spans.groupBy("doc_key", "doc_id").agg(
        F.max(F.when(own, F.col("n_words"))).cast("long").alias("n_words"),
        F.count(F.when(exact, 1)).cast("long").alias("n_base"),
        F.min(F.when(exact, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("first_word"))).cast("long").alias("last_word"),
        joined(F.when(exact, F.col("label"))).alias("base_labels"),
        joined(F.when(base, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(base, F.col("covered"))), F.lit(0.0)).alias("score"),
    ).drop("doc_key")
