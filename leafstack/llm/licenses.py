"""License scans by diagonal voting, in column functions and joins only.

All rolling runs of ``GRAM`` words of the documents are hashed and joined with
the places of the same runs in the templates. A hit votes for its diagonal,
the place in the document less the place in the template. A phrase stands in
a document where one diagonal has a vote for each of its runs. For license
texts, neighbouring diagonals near to each other are merged, which allows for
words put in or left out; what they cover of the template, and how much of the
span they cover, decides.

Runs are compared as words wherever hashes agree, so no hash decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import settled
from .common import table
from .spans import count_words, segments, starts, words

GRAM = 3
#: Diagonals of one template this near to each other, in words, are merged.
DRIFT = 8
#: Share of a template's runs that its merged diagonals must hit, and share of the span that must be hit.
COVERED, DENSE = 0.5, 0.4
BROADCAST_RUNS = 100_000

# Phrases whose every place counts, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Openings of public licenses and notices, and their labels.
TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                "compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
           "Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
             "was not distributed with this file, You can obtain one at",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of "
             "this license, visit",
    "cc-by-sa": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To "
                "view a copy of this license, visit",
    "cc-by-nc": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. "
                "To view a copy of this license, visit",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                 "modify, publish, use, compile, sell, or distribute this software",
}


def template_table(spark: SparkSession, phrases: dict[str, str], texts: dict[str, str], gram: int) -> DataFrame:
    """``template, label, base, runs, at, run``: the runs of all templates with their places."""
    rows = [(t, label, True) for t, label in sorted(phrases.items())]
    rows += [(t, label, False) for label, t in sorted(texts.items())]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template int, text string, label string, base boolean")
    cut = frame.withColumn("words", words(F.col("text"))).filter(F.size("words") >= gram)
    return cut.select(
        "template", "label", "base", (F.size("words") - gram + 1).alias("runs"), F.posexplode(_runs(F.col("words"), gram)).alias("at", "run")
    )


def _runs(words_: Column, gram: int) -> Column:
    return F.transform(starts(words_, gram, 1 << 20), lambda i: F.array_join(F.slice(words_, i + 1, gram), " "))


def votes(documents: DataFrame, templates: DataFrame, id_col: str, text_col: str, gram: int, few: bool) -> DataFrame:
    """``doc_id, text_key, template, label, base, runs, diagonal, at, place``: every hit of a run."""
    keys = [F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key")]
    rows = segments(documents, keys, F.col(text_col), gram - 1)
    grams = F.transform(starts(F.col("words"), gram), lambda i: F.array_join(F.slice("words", i + 1, gram), " "))
    rows = rows.select("doc_id", "text_key", "first", F.posexplode(grams).alias("offset", "gram"))
    rows = rows.withColumn("hash", F.xxhash64("gram"))
    known = templates.withColumn("hash", F.xxhash64("run"))
    # equal hashes meet; equal words count
    hits = rows.join(F.broadcast(known) if few else known, "hash").filter("gram = run")
    place = F.col("first") + F.col("offset")
    return hits.select(
        "doc_id", "text_key", "template", "label", "base", "runs", (place - F.col("at")).alias("diagonal"), "at", place.alias("place")
    )


def phrase_places(found: DataFrame) -> DataFrame:
    """``doc_id, text_key, label, first``: diagonals of phrases with all their votes."""
    full = found.filter("base").groupBy("doc_id", "text_key", "template", "label", "runs", "diagonal").agg(
        F.count_distinct("at").alias("n")
    )
    return full.filter("n = runs").select("doc_id", "text_key", "label", F.col("diagonal").alias("first"))


def license_spans(
    found: DataFrame, gram: int = GRAM, drift: int = DRIFT, covered: float = COVERED, dense: float = DENSE
) -> DataFrame:
    """``doc_id, text_key, label, first, last, coverage``: verified spans of license texts.

    A template's diagonals in one document are taken in order of their place;
    one joins the span before it if both its diagonal and its place are near.
    """
    keys = ["doc_id", "text_key", "template"]
    diagonals = found.filter("not base").groupBy(*keys, "label", "runs", "diagonal", F.floor((F.col("place") / (4 * F.col("runs")))).alias("part")).agg(
        F.count_distinct("at").alias("n"), F.min("place").alias("first"), F.max("place").alias("last")
    )
    order = Window.partitionBy(*keys).orderBy("first", "diagonal")
    far = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > drift) | (
        F.col("first") - F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) > 2 * F.col("runs")
    )
    spans = diagonals.withColumn("new", F.coalesce(far, F.lit(True)).cast("int"))
    spans = spans.withColumn("span", F.sum("new").over(order))
    merged = spans.groupBy(*keys, "label", "runs", "span").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), (F.max("last") + gram - 1).alias("last")
    )
    coverage = F.least(F.lit(1.0), F.col("n") / F.col("runs"))
    density = F.col("n") / (F.col("last") - F.col("first") - gram + 2)
    return merged.filter((coverage >= covered) & (density >= dense)).select(
        "doc_id", "text_key", "label", "first", "last", coverage.alias("coverage")
    )


def license_scan(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
    texts: dict[str, str] | None = None, gram: int = GRAM,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts all places of phrases, ``first_word`` and ``last_word``
    are the smallest and largest. ``labels`` adds those of license texts. The
    score is 1 with a phrase, else the best coverage of a license text, else 0.
    NULL and empty texts have no words and no labels. Repeated rows come out
    alike. An empty table gives no rows; other columns are ignored. Templates
    shorter than ``gram`` words are an error.
    """
    phrases, texts = PHRASES if phrases is None else phrases, TEXTS if texts is None else texts
    if any(len(p.split()) < gram for p in [*phrases, *texts.values()]):
        raise ValueError("a template has fewer words than a run")
    templates = settled(template_table(documents.sparkSession, phrases, texts, gram))
    found = settled(votes(documents, templates, id_col, text_col, gram, templates.count() <= BROADCAST_RUNS))
    keys = ["doc_id", "text_key"]
    base = phrase_places(found).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_base"), F.min("first").alias("first_word"), F.max("first").alias("last_word"),
        F.collect_set("label").alias("base_labels"), F.lit(1.0).alias("base_score"),
    )
    method = license_spans(found, gram).groupBy(*keys).agg(
        F.collect_set("label").alias("more_labels"), F.max("coverage").alias("coverage")
    )
    none = F.array().cast("array<string>")
    both = base.unionByName(method, allowMissingColumns=True).groupBy(*keys).agg(
        F.max("n_base").alias("n_base"), F.max("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        F.flatten(F.collect_list(F.coalesce("base_labels", none))).alias("base_labels"),
        F.flatten(F.collect_list(F.coalesce("more_labels", none))).alias("more_labels"),
        F.max("base_score").alias("base_score"), F.max("coverage").alias("coverage"),
    ).withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"})
    docs = documents.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), count_words(F.col(text_col)).alias("n_words")
    )
    joined = docs.join(both, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left")

    def names(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    base_labels, more = F.coalesce("base_labels", none), F.coalesce("more_labels", none)
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        names(base_labels).alias("base_labels"), names(F.concat(base_labels, more)).alias("labels"),
        F.coalesce("base_score", "coverage", F.lit(0.0)).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts in all documents."""
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES: dict[str, str] = {}
