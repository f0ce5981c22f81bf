"""License scans by diagonal voting.

Every run of three words of a text is joined, by its hash, to the places where license templates have it. A hit votes for
the diagonal on which the template would lie, the text's place less the template's. Diagonals that are close are merged, as a
word more or less only moves the rest by one, and a span counts if it covers enough of the template's words.

All of it is DataFrame code in one pass over the texts: words become rows that meet a fixed, small table of templates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Letters that become ASCII, or more than one letter, when all letters are lower-cased.
ODD_CAPITALS = "[\u0130\u212a]"
#: Words in a run.
RUN = 3
#: Diagonals no further apart than this belong to one span.
NEIGHBOURS = 2
#: The share of a template's words that a span must cover, and how long it may be, in template lengths.
COVERED, STRETCH = 0.8, 1.5

# Fixed values: (label, text) of phrases whose every place is a finding.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Fixed values: (label, text) of notices, as their licenses and their publishers word them.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lower-cased, other letters in any case: words of ASCII letters are the same either way."""
    return F.when(text.rlike(ODD_CAPITALS), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def template_runs(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(h, g0, g1, g2, places): each distinct run of the templates, and where it stands in which of them.

    Templates have three words or more. Their number is fixed by the call, never by the data.
    """
    places: dict[tuple[str, ...], list[str]] = {}
    for template, (label, text) in enumerate([*phrases, *notices]):
        words = re.findall("[a-z0-9]+", text)
        if len(words) < RUN or " ".join(words) != text:
            raise ValueError(f"a template must be {RUN} or more lower-case words, one space apart: {text!r}")
        for at in range(len(words) - RUN + 1):
            exact = str(template < len(phrases)).lower()
            places.setdefault(tuple(words[at : at + RUN]), []).append(f"named_struct('template', {template}, 'label', '{label}', 'exact', {exact}, 'length', {len(words)}, 'at', {at})")
    rows = ", ".join(f"named_struct('g0', '{a}', 'g1', '{b}', 'g2', '{c}', 'places', array({', '.join(found)}))" for (a, b, c), found in places.items())
    return spark.range(1).select(F.expr(f"inline(array({rows}))")).withColumn("h", F.xxhash64("g0", "g1", "g2"))


def votes(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each hit, and one for each document: (doc_id, digest, n_words, same, at, place), place null without a hit.

    ``same`` counts rows of the table that share id and text; they are one document here.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), words_of(F.col("text")).alias("words"))
    neighbours = F.arrays_zip("words", F.slice("words", F.lit(2), F.size("words")), F.slice("words", F.lit(3), F.size("words")))
    texts = texts.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(neighbours).alias("at", "w"))
    texts = texts.select("doc_id", "digest", "n_words", "at", F.col("w.words").alias("w0"), F.col("w.1").alias("w1"), F.col("w.2").alias("w2")).withColumn("h", F.xxhash64("w0", "w1", "w2"))
    # Words of a hit are compared, so hashes that collide give none.
    equal = (texts["h"] == runs["h"]) & (texts["w0"] == runs["g0"]) & (texts["w1"] == runs["g1"]) & (texts["w2"] == runs["g2"])
    # The templates' runs are a few hundred rows, whatever the input. Every run of a text is one row before and after.
    met = texts.join(F.broadcast(runs), equal, "left").filter("places is not null or at is null or at = 0")
    first = F.sum(F.when(F.col("at").isNull() | (F.col("at") == 0), 1)).alias("same")
    once = met.groupBy("doc_id", "digest", "n_words", "at").agg(F.first("places").alias("places"), first)
    return once.select("doc_id", "digest", "n_words", "same", "at", F.explode_outer("places").alias("place"))


def spans(hits: DataFrame, covered: float = COVERED) -> DataFrame:
    """Merged diagonals of hits, and one row for each document without: (doc_id, digest, n_words, same, template, label,
    exact, first_word, end_word, share, found).

    ``share`` is the part of the template's words that hits of the span cover. A phrase's diagonals are not merged, and it
    is found only where all of it stands.
    """
    template = ["doc_id", "digest", "n_words", "template", "label", "exact", "length"]
    flat = hits.select("doc_id", "digest", "n_words", "same", "place.template", "place.label", "place.exact", "place.length", (F.col("at") - F.col("place.at")).alias("diagonal"), "at", F.col("place.at").alias("place_at"))
    lines = flat.groupBy(*template, "diagonal").agg(F.max("same").alias("same"), F.collect_set("place_at").alias("ats"), F.min("at").alias("least"), F.max("at").alias("most"))
    order = Window.partitionBy(*template).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    opens = F.when(gap.isNull() | (gap > F.when(F.col("exact"), 0).otherwise(NEIGHBOURS)), 1).otherwise(0)
    lines = lines.withColumn("opens", opens).withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = lines.groupBy(*template, "span").agg(
        F.max("same").alias("same"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("least").alias("first_word"), (F.max("most") + RUN).alias("end_word"))
    within = F.array_distinct(F.flatten(F.transform("ats", lambda i: F.sequence(i, i + RUN - 1))))
    fits = F.col("end_word") - F.col("first_word") <= STRETCH * F.col("length")
    found = F.when(F.col("exact"), F.col("share") == 1).otherwise((F.col("share") >= covered) & fits)
    return merged.withColumn("share", F.size(within) / F.col("length")).withColumn("found", found).drop("ats", "length", "span")


def license_scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, covered: float = COVERED) -> DataFrame:
    """(doc_id, n_words, spans) of every row of ``docs`` (doc_id, text): what templates cover, found or not, by template.

    A span has its template, label, ``exact`` (a phrase), first word, the word after its last, share and ``found``. Words are
    runs of ASCII digits, lower-cased letters and all non-ASCII characters of whole texts; a null text is empty. Rows that
    repeat id and text give as many equal rows; rows that only share their id, null or not, stay apart. An empty table gives
    no rows. Other columns are left out.
    """
    found = spans(votes(docs, template_runs(docs.sparkSession, phrases, notices)), covered)
    span = F.struct("template", "label", "exact", "first_word", "end_word", "share", "found")
    whole = found.groupBy("doc_id", "digest", "n_words").agg(
        F.max("same").alias("same"), F.array_sort(F.collect_list(F.when(F.col("template").isNotNull(), span))).alias("spans"))
    return whole.select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))).alias("copy")).drop("copy")


def findings(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of :func:`license_scan`'s rows."""
    base = F.filter("spans", lambda s: s["exact"] & s["found"])
    starts = F.transform(base, lambda s: s["first_word"].cast("long"))
    labels = lambda kept: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(kept, lambda s: s["label"]))))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.filter("spans", lambda s: s["found"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"))
