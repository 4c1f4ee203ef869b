"""License scans by diagonal voting, in DataFrame operations alone.

All rolling word k-grams of all texts are hashed and joined to the template positions that have the same hash. A match at
text word i and template word j votes for the diagonal i - j of that template; votes are counted by diagonal, diagonals a
few words apart are merged (words put in or left out shift the rest), and the spans are verified against the words. Phrases
of two to four words are templates whose k is 2 and which must match as a whole. The templates are a fixed set that grows
with this file and not with the corpus, so their side of the join is broadcast.

Contract: words are runs of 0-9, a-z (A-Z lowered) and non-ASCII characters; a null text is empty; a row per row, null ids
included, and rows with the same id and text have the same result each; an empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from segmenta.llm.store import stored

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
K = 5
#: Diagonals so near are one placement; a placement counts if so much of its template is there.
NEAR, COVERED = 3, 0.75
#: Phrases and labels of the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Labels of the method's own and their notices.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-release": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def words(text: str = "text"):
    t = F.coalesce(F.col(text), F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    # Two characters outside ASCII have ASCII lower cases; for texts with them only A-Z are mapped.
    plain = F.when(t.contains("İ") | t.contains("K"), F.translate(t, upper, upper.lower())).otherwise(F.lower(t))
    return F.array_remove(F.split(plain, NOT_WORD), "")


def _grams(k: int) -> str:
    return f"if(size(_w) < {k}, cast(array() as array<bigint>), transform(sequence(0, size(_w) - {k}), i -> xxhash64({k}, " + ", ".join(f"_w[i + {j}]" for j in range(k)) + ")))"


def templates(spark) -> DataFrame:
    rows = [(x, label, True, x.split()) for x, label in PHRASES.items()] + [(x, label, False, x.split()) for label, x in NOTICES.items()]
    return spark.createDataFrame([(n, label, base, w) for n, (_, label, base, w) in enumerate(rows)], "template int, label string, base boolean, words array<string>")


def placements(docs: DataFrame) -> DataFrame:
    """A row per verified placement: doc_id, text_hash, template, label, base, first_word, end_word, covered."""
    known = F.broadcast(templates(docs.sparkSession).hint("broadcast"))
    spots = known.withColumn("_w", F.col("words")).select("template", F.posexplode(F.when(F.col("base"), F.expr(_grams(2))).otherwise(F.expr(_grams(K)))).alias("at", "gram"))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    # Places of 2-grams come first in the array, then those of K-grams.
    grams = keyed.withColumn("_w", words()).select("doc_id", "text_hash", F.size("_w").alias("n"), F.posexplode(F.concat(F.expr(_grams(2)), F.expr(_grams(K)))).alias("i", "gram"))
    votes = (
        grams.join(F.broadcast(spots), "gram")
        .withColumn("place", F.when(F.col("i") < F.col("n") - 1, F.col("i")).otherwise(F.col("i") - F.col("n") + 1))
        .groupBy("doc_id", "text_hash", "template", (F.col("place") - F.col("at")).alias("diagonal"))
        .agg(F.countDistinct("at").alias("votes"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    )
    votes = stored(votes, "license-votes").join(known.select("template", "label", "base", "words"), "template")
    by = W.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal", "lo")
    # A phrase's placements stand alone; a notice's join while each diagonal is near the last.
    new = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by) > NEAR), F.lit(True)).cast("int")
    merged = votes.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    spans = merged.groupBy("doc_id", "text_hash", "template", "run").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("words").alias("words"), F.sum("votes").alias("votes"), F.min("diagonal").alias("d0"), F.max("diagonal").alias("d1"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = spans.filter(~F.col("base") | (F.col("votes") >= F.size("words") - 1))
    # The words decide: along the merged diagonals, how many of the template's words stand where it has them.
    texts = keyed.join(spans.select("doc_id", "text_hash").distinct(), (keyed.doc_id.eqNullSafe(spans.doc_id)) & (keyed.text_hash == spans.text_hash), "left_semi").dropDuplicates(["doc_id", "text_hash"]).withColumn("_w", words()).drop("text")
    x = spans.join(texts.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))).drop("_d", "_t")
    there = "size(filter(sequence(0, size(words) - 1), j -> exists(sequence(d0, d1), d -> get(_w, d + j) = words[j])))"
    x = x.withColumn("covered", F.expr(f"{there} / cast(size(words) as double)"))
    x = x.filter(F.when(F.col("base"), F.col("covered") == 1.0).otherwise(F.col("covered") >= COVERED))
    return x.select("doc_id", "text_hash", "template", "label", "base", F.when(F.col("base"), F.col("d0")).otherwise(F.greatest(F.col("lo"), F.lit(0))).cast("long").alias("first_word"),
                    F.when(F.col("base"), F.col("d0") + F.size("words")).otherwise(F.col("hi") + K).cast("long").alias("end_word"), "covered")


def scanned(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = placements(docs).groupBy("doc_id", "text_hash").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min(F.when(F.col("base"), F.col("first_word"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("covered").alias("score"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.size(words()).cast("long").alias("n_words"))
    found = found.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    return rows.join(found, rows.doc_id.eqNullSafe(found._d) & (rows.text_hash == found._t), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
