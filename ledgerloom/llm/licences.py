"""Licence notices in texts: MinHash bands over overlapping windows find candidates, shingle containment confirms them.

Method, by DataFrame functions alone.  A text is lower-cased and cut into runs of letters and digits; three in a row
are a shingle.  Only shingles that some template has can collide or count, so the others are left out first.  What is
left falls into windows of `window` words that overlap by half, and a template into chunks of at most half a window, so
every chunk of a notice lies wholly inside some window.  Windows and chunks get one minimum for each band; an equal
minimum in any band makes a candidate.  With 32 bands of one row a chunk whose shingles make up a fifth of a window's
(a crowded one) is found with probability 1 - (1 - 0.2)^32 > 0.999, at one half with 1 - 2e-10.  A candidate counts
the chunk's shingles that the window has, exactly; the best window of each chunk counts, and a template is reported if
its chunks together hold at least `containment` of its shingles.

Null or empty text: no rows.  A row without doc_id is reported with null.  Repeated rows are reported once.  Templates
must have three words or more; together at most MOST_SHINGLES shingles, which bounds what is sent with the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SHINGLES = 50_000

# Opening or characteristic sentences of public licences and common notices that name them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
                " associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the"
                       " License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
                " General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
           " that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
           " hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}


def _runs(text: str) -> Column:
    """Hashes of every three words in a row, in order.  The one-element array has the words computed once per text."""
    return F.expr(f"""get(transform(array(filter(split(lower({text}), '[^a-z0-9]+'), x -> x <> '')), w ->
        CASE WHEN size(w) >= 3 THEN transform(sequence(1, size(w) - 2), i -> xxhash64(w[i - 1], w[i], w[i + 1]))
             ELSE cast(array() AS array<bigint>) END), 0)""")


def template_chunks(spark: SparkSession, templates: dict[str, str], window: int) -> DataFrame:
    """template, chunk, shingles (distinct hashes of the chunk) and total (distinct over all chunks, summed)."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string")
    runs = rows.withColumn("h", _runs("text"))
    step = window // 2
    chunks = runs.select("template", F.posexplode(F.expr(
        f"transform(sequence(0, size(h) - 1, {step}), i -> array_distinct(slice(h, i + 1, {step})))")).alias("chunk", "shingles"))
    totals = chunks.groupBy("template").agg(F.sum(F.size("shingles")).alias("total"))
    return chunks.join(totals, "template")


def _minima(column: str, bands: int) -> Column:
    return F.expr(f"transform(sequence(0, {bands - 1}), b -> array_min(transform({column}, x -> xxhash64(x, b))))")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, window: int = 64,
         bands: int = 32) -> DataFrame:
    """doc_id, template, containment, shared (shingles found), total and first_word (place of the first window)."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    chunks = template_chunks(spark, templates, window)
    known = [r[0] for r in chunks.select(F.explode("shingles")).distinct().limit(MOST_SHINGLES + 1).collect()]
    if len(known) > MOST_SHINGLES or not known:
        raise ValueError(f"templates must have between 1 and {MOST_SHINGLES} shingles of three words")
    listed = ", ".join(f"{h}L" if h > -(1 << 63) else "(-9223372036854775807L - 1L)" for h in sorted(known))

    texts = docs.select("doc_id", F.xxhash64("text").alias("_text"), _runs("text").alias("h"))
    found = texts.select("doc_id", "_text", F.expr(
        f"filter(transform(h, (x, i) -> struct(i AS at, x AS h)), s -> s.h IN ({listed}))").alias("found"))
    found = found.where(F.size("found") > 0)
    half = window // 2
    # A shingle at place p lies in window p // half and in the one before; a window has 2 * half places at most.
    placed = found.select("doc_id", "_text", F.explode("found").alias("f")).select(
        "doc_id", "_text", F.col("f.h").alias("h"),
        F.explode(F.expr(f"array(f.at div {half}, f.at div {half} - 1)")).alias("number"))
    windows = placed.groupBy("doc_id", "_text", "number").agg(F.collect_set("h").alias("has"))

    signed = windows.select("doc_id", "_text", "number", "has", F.posexplode(_minima("has", bands)).alias("band", "low"))
    looked_up = chunks.select("template", "chunk", "shingles", "total", F.posexplode(_minima("shingles", bands)).alias("band", "low"))
    candidates = signed.join(looked_up, ["band", "low"]).dropDuplicates(["doc_id", "_text", "number", "template", "chunk"])
    shared = F.size(F.array_intersect("has", "shingles"))
    best = candidates.select("doc_id", "_text", "number", "template", "chunk", "total", shared.alias("shared"))
    best = best.groupBy("doc_id", "_text", "template", "chunk").agg(
        F.max("shared").alias("shared"), F.first("total").alias("total"), F.max_by("number", F.struct("shared", -F.col("number"))).alias("number"))
    whole = best.groupBy("doc_id", "_text", "template").agg(
        F.sum("shared").alias("shared"), F.first("total").alias("total"), F.min("number").alias("number"))
    return whole.where(F.col("shared") >= F.lit(containment) * F.col("total")).select(
        "doc_id", "template", (F.col("shared") / F.col("total")).alias("containment"), F.col("shared").cast("long").alias("shared"),
        F.col("total").cast("long").alias("total"), (F.greatest("number", F.lit(0)) * half).cast("long").alias("first_word"))
