"""License scans by diagonal voting, in DataFrame operations only.

Texts become words (runs of digits, letters and characters beyond ASCII, A-Z in lower case). The hashes of all rolling
runs of K words are joined to the template positions with the same hash; each match votes for the diagonal, its place
in the text less its place in the template. Neighbouring diagonals of one template (a few words more or less) merge,
and a merged diagonal is a span if the template words it holds, against the longer of template and span, reach LEAST.

The templates are a fixed, small table (checked against MAX_TEMPLATE_WORDS before it is broadcast); texts are exploded
to rows of a few words and shuffled only where they match.

Defined results: null text is empty; rows that repeat (same doc_id and text) count as one text and get equal answers;
texts of any length are whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals this far apart are one span.
GAP = 3
LEAST = 0.6
MAX_TEMPLATE_WORDS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# What licences say of themselves, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
               "without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
            "by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case for matching ASCII words: the Kelvin sign, whose lower case is a k, is kept apart."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def template_grams(spark, templates=TEMPLATES) -> DataFrame:
    """(hash, template, label, tpos, tlen) of each run of K words."""
    rows = [(n, label, text.split()) for n, (label, text) in enumerate(templates)]
    if sum(len(w) for *_, w in rows) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to broadcast")
    grams = [(n, label, k, len(w), *w[k : k + K]) for n, label, w in rows for k in range(len(w) - K + 1)]
    df = spark.createDataFrame(grams, "template int, label string, tpos int, tlen int, " + ", ".join(f"w{i} string" for i in range(K)))
    return df.select(F.xxhash64(*[f"w{i}" for i in range(K)]).alias("hash"), "template", "label", "tpos", "tlen")


def spans(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, text_hash, label, template, start, end, score): verified spans, in words."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(lowered(F.col("text"))).alias("w"))
    n = F.greatest(F.size("w") - (K - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice("w", i + 1, n).alias(f"w{i}") for i in range(K)])
    rolling = text.select("doc_id", "text_hash", F.posexplode(runs).alias("pos", "run")).select("doc_id", "text_hash", "pos", F.xxhash64(*[F.col("run").getItem(f"w{i}") for i in range(K)]).alias("hash"))
    hits = rolling.join(F.broadcast(template_grams(docs.sparkSession, templates)), "hash").drop("hash")
    hits = hits.withColumn("diag", F.col("pos") - F.col("tpos")).distinct()
    key = ["doc_id", "text_hash", "template"]
    votes = hits.groupBy(*key, "label", "tlen", "diag").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("tpos").alias("tpos"))
    order = Window.partitionBy(*key).orderBy("diag")
    apart = F.when(F.col("diag") - F.lag("diag").over(order) > GAP, 1).otherwise(0)
    merged = (votes.withColumn("apart", apart).withColumn("island", F.sum("apart").over(order))
              .groupBy(*key, "label", "tlen", "island")
              .agg(F.min("low").alias("start"), (F.max("high") + K).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("n")))
    score = F.least(F.lit(1.0), F.col("n") / (F.greatest("tlen", F.col("end") - F.col("start")) - (K - 1)))
    return merged.withColumn("score", score).where(F.col("score") >= LEAST).select("doc_id", "text_hash", "label", "template", "start", "end", "score")


def standing(parts: list[str]):
    """Whether these words stand at a place of the word array."""
    return lambda i: reduce(lambda a, b: a & b, [F.get("w", i + k) == word for k, word in enumerate(parts)])


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""
    low = lowered(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), low.contains("license").alias("maybe"), words(low).alias("w"))
    places = []
    for phrase, label in PHRASES:
        at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), standing(phrase.split()))
        places.append(F.when(F.col("maybe") & (F.size("w") > 0), at).otherwise(F.array().cast("array<int>")).alias(label))
    base = rows.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), *places)
    every = F.concat(*[F.col(label) for _, label in PHRASES])
    labels = F.array_compact(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for _, label in PHRASES]))
    base = base.select("doc_id", "text_hash", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
                       F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base_labels"))
    found = spans(docs, templates).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "more", "best")
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h")), "left")
    all_labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
                       F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"))
