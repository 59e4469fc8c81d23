"""License scans by diagonal voting, with DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words, the phrases with their labels, and notices that licenses ask to be put into files.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("epl-2", "under the terms of the eclipse public license 2 0"),
    ("boost-1", "distributed under the boost software license version 1 0"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-2", "spdx license identifier gpl 2 0"),
    ("gpl-3", "spdx license identifier gpl 3 0"),
    ("bsd-2", "spdx license identifier bsd 2 clause"),
    ("bsd-3", "spdx license identifier bsd 3 clause"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
)
#: Words of a gram; diagonals this near to each other are one occurrence with words put in or left out; least share of a notice's grams,
#: and the length in grams under which a notice must stand whole, since versions differ in one word.
GRAM, NEAR, LEAST, SHORT = 3, 3, 0.7, 10


def word_array(text: Column) -> Column:
    """Words of the whole text after lower-casing A to Z; none for null.

    lower() is put right first for the only two other characters that it turns into ASCII letters, U+0130 and U+212A; what it does to
    characters beyond ASCII changes no word's bounds and no phrase.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0130"), F.lit("\u0131")), F.lit("\u212a"), F.lit("\u03ba"))
    return F.array_remove(F.split(F.lower(plain), SEPARATORS, -1), "")


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """template, label, base, grams, at, t1, t2, t3: a row for each gram of each template; some hundred rows whatever the data."""
    rows = []
    for i, (base, (label, words)) in enumerate([(True, p) for p in phrases] + [(False, p) for p in notices]):
        w = re.split(" ", words)
        rows += [(i, label, base, len(w) - GRAM + 1, at, *w[at : at + GRAM]) for at in range(len(w) - GRAM + 1)]
    # the row that every document matches once, at its sentinel gram, and so carries its count of words through the join
    rows.append((-1, "", False, 0, 0, "", "", ""))
    return spark.createDataFrame(rows, "template int, label string, base boolean, grams int, at int, t1 string, t2 string, t3 string").withColumn("hash", F.xxhash64("t1", "t2", "t3"))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    All rolling grams of three words are joined by hash to their places in the templates and compared word for word. A match votes for the diagonal
    word place - template place. A phrase stands where one diagonal has all its votes. For notices, diagonals at most NEAR apart are merged,
    grams of the template are counted once, and a span is verified if it has the share LEAST of them (all, in a notice of under SHORT grams) within its own length.
    spans: array of label, first word, last word, share. score: the largest share of any template, 1 where a phrase stands.
    Null and empty texts have no words, no labels (empty strings) and score 0. Rows that repeat are each scanned; other columns are not read.
    """
    spark = docs.sparkSession
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), word_array(F.col("text")).alias("w"))
    n = F.size("w")
    tail = F.lit(2_000_000_000)
    zipped = F.arrays_zip(F.col("w").alias("c1"), F.slice("w", F.lit(2), tail).alias("c2"), F.slice("w", F.lit(3), tail).alias("c3"))
    sentinel = F.array(F.struct(F.lit("").alias("c1"), F.lit("").alias("c2"), F.lit("").alias("c3")))
    grams = words.select("doc_id", "row", n.cast("long").alias("n_words"), F.posexplode(F.concat(sentinel, zipped)).alias("place", "g"))
    grams = grams.select("doc_id", "row", "n_words", (F.col("place") - 1).alias("place"), "g.c1", "g.c2", "g.c3").filter("c3 IS NOT NULL")
    known = F.broadcast(templates(spark, phrases, notices))  # a fixed table
    hits = grams.withColumn("hash", F.xxhash64("c1", "c2", "c3")).join(known, "hash").filter("c1 = t1 AND c2 = t2 AND c3 = t3")
    key = ["row", "doc_id", "n_words"]
    votes = hits.groupBy(*key, "template", "label", "base", "grams", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"), F.collect_set("at").alias("ats"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    # what a chain of neighbouring diagonals has voted for is one occurrence only while its places stay near, too
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR) | F.col("base")
    chained = votes.withColumn("chain", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(along))
    spans = chained.groupBy(*key, "template", "label", "base", "grams", "chain").agg(F.min("low").alias("low"), (F.max("high") + GRAM - 1).alias("high"), F.sum("votes").alias("votes"), F.min("diagonal").alias("diagonal"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"))
    share = F.when(F.col("grams") > 0, F.col("covered") / F.col("grams")).otherwise(F.lit(0.0))
    fits = F.when(F.col("base"), F.col("covered") == F.col("grams")).otherwise(((share >= LEAST) & ((F.col("grams") >= SHORT) | (F.col("covered") == F.col("grams")))) & (F.col("high") - F.col("low") + 1 <= F.col("grams") + GRAM - 1 + 2 * NEAR))
    spans = spans.withColumn("share", share).withColumn("fits", fits & (F.col("template") >= 0))
    base = F.col("fits") & F.col("base")
    named = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    out = spans.groupBy(*key).agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("fits")).alias("labels"),
        F.greatest(F.max(F.when(base, 1.0).otherwise(0.0)), F.max(F.when(F.col("fits"), F.col("share")).otherwise(0.0))).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct(F.col("low").alias("first"), F.col("high").alias("last"), "label", "share")))).alias("spans"),
    )
    return out.drop("row")


def oracle_sql() -> str:
    """The query's rows in DuckDB's dialect, from the same fixed tables."""
    rows = ", ".join(f"({i}, '{label}', {str(base).lower()}, string_split('{words}', ' '))" for i, (base, (label, words)) in enumerate([(True, p) for p in PHRASES] + [(False, p) for p in NOTICES]))
    return rf"""
WITH t(template, label, base, w) AS (VALUES {rows}),
tg AS (SELECT template, label, base, len(w) - {GRAM - 1} AS grams, u.i - 1 AS tp, w[u.i] AS t1, w[u.i + 1] AS t2, w[u.i + 2] AS t3 FROM t, unnest(range(1, len(w) - {GRAM - 2})) AS u(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, u.i - 1 AS place, w[u.i] AS t1, w[u.i + 1] AS t2, w[u.i + 2] AS t3 FROM d, unnest(range(1, len(w) - {GRAM - 2})) AS u(i)),
h AS (SELECT r, template, label, base, grams, place - tp AS diagonal, place, tp FROM g JOIN tg USING (t1, t2, t3)),
v AS (SELECT r, template, label, base, grams, diagonal, min(place) AS low, max(place) AS high, list(DISTINCT tp) AS ats FROM h GROUP BY ALL),
x AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {NEAR}, true) OR base AS fresh FROM v),
y AS (SELECT *, sum(fresh::int) OVER (PARTITION BY r, template ORDER BY diagonal) AS chain FROM x),
z AS (SELECT r, template, label, base, grams, chain, min(low) AS low, max(high) + {GRAM - 1} AS high, min(diagonal) AS diagonal, len(list_distinct(flatten(list(ats)))) AS covered FROM y GROUP BY ALL),
f AS (SELECT *, covered::DOUBLE / grams AS share FROM z WHERE CASE WHEN base THEN covered = grams ELSE covered::DOUBLE / grams >= {LEAST} AND (grams >= {SHORT} OR covered = grams) AND high - low + 1 <= grams + {GRAM - 1 + 2 * NEAR} END),
a AS (SELECT r, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE WHEN base THEN 1.0::DOUBLE ELSE share END) AS score FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 9)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)"""
