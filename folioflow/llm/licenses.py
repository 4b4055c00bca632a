"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

For a template of L words, windows of ceil(1.5 L) words start every L // 2 words, so that any copy lies whole in a window
and fills at least a quarter of its shingles. With BANDS bands of one MinHash, such a window collides with probability
1 - 0.75 ** 32 = 0.9999 at least. DataFrame functions only.

Two exact filters go first. Anchors are a few words that more than a fifth of every template's shingles have: a text or
window without any can't hold four fifths of a template's shingles, hence not verify. A template of fewer than K words is one shingle.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 5
BANDS = 32
MIN_CONTAINMENT = 0.8

#: Notices as their licenses' texts and stewards publish them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
)
_WORD = r"[\p{L}\p{N}]+"


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _shingles(words: list[str], k: int = K) -> list[str]:
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]


def anchors(templates: tuple[tuple[str, str], ...]) -> list[str]:
    """Greedily, words that more than 1 - MIN_CONTAINMENT of every template's shingles have: a window that holds
    MIN_CONTAINMENT of a template has one of them."""
    left = []
    for _, text in templates:
        if words := _words(text):
            held = [set(x.split(" ")) for x in set(_shingles(words, min(K, len(words))))]
            left.append((held, (1 - MIN_CONTAINMENT) * len(held) + 1e-9))
    out: list[str] = []
    while short := [held for held, most in left if sum(any(w in h for w in out) for h in held) <= most]:
        seen = Counter(w for held in short for h in held if not any(x in h for x in out) for w in h)
        out.append(max(seen, key=lambda w: (len(w) >= 6, sum(any(w in h for h in held) for held in short), seen[w], w)))
    return out


def shingles(words: Column, k: Column) -> Column:
    """Distinct runs of k words (fewer words: the whole sequence) as 64-bit hashes."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " "))))


def _least(hashes: Column, band: int) -> Column:
    return F.array_min(F.transform(hashes, lambda s: F.xxhash64(s, F.lit(band))))


def bands(hashes: Column) -> Column:
    return F.array(*(_least(hashes, j) for j in range(BANDS)))


def license_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id") -> DataFrame:
    """One row for each row's id, and template that its text holds: id, template (its number), license, containment (the largest
    share of the template's shingles in one window), at (the first such window's first word, from 0).

    Words are runs of letters and digits, lower-cased. Null, blank and empty texts match nothing; texts and copies of any
    length are scanned whole; rows with the same id are reported as one; other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    known = [(n, name, _words(text)) for n, (name, text) in enumerate(templates) if _words(text)]
    lengths = sorted({len(w) for *_, w in known})
    found = anchors(templates)
    model = spark.createDataFrame([(n, name, len(w), w) for n, name, w in known], "template int, license string, words int, text array<string>")
    model = model.withColumn("wanted", shingles(F.col("text"), F.least(F.col("words"), F.lit(K)))).select("template", "license", "words", "wanted", F.posexplode(bands(F.col("wanted"))).alias("band", "value"))

    texts = docs.select(F.col(id_col), F.lower("text").alias("text")).where(F.col("text").rlike("|".join(found)))
    split = texts.select(id_col, F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("all"))
    some = F.array(*map(F.lit, found))
    opened = split.withColumn("anchored", F.filter(F.transform("all", lambda w, i: F.when(F.array_contains(some, w), i)), lambda i: i.isNotNull())).where("size(anchored) > 0")

    def around(n: int) -> Column:
        """The windows for templates of n words that hold an anchor; only they are copied out of the text."""
        size, step = -(-3 * n // 2), max(1, n // 2)
        starts = F.array_distinct(F.flatten(F.transform("anchored", lambda i: F.sequence(F.greatest(F.floor((i - size + step) / step), F.lit(0)).cast("int"), F.floor(i / step).cast("int")))))
        return F.transform(starts, lambda b: F.struct(F.lit(n).alias("words"), (b * step).alias("at"), F.slice("all", b * step + 1, size).alias("window")))

    windows = opened.select(id_col, F.inline(F.concat(*map(around, lengths))))
    windows = windows.withColumn("held", shingles(F.col("window"), F.least(F.col("words"), F.lit(K)))).drop("window")
    hits = windows.withColumn("m", bands(F.col("held"))).select(id_col, "words", "at", "held", F.posexplode("m").alias("band", "value"))
    # the templates are a constant of the program
    hits = hits.join(F.broadcast(model), ["words", "band", "value"])
    exact = F.size(F.array_intersect("wanted", "held")) / F.size("wanted")
    verified = hits.withColumn("containment", exact).where(F.col("containment") >= MIN_CONTAINMENT)
    best = F.max(F.struct("containment", (-F.col("at")).alias("first")))
    return verified.groupBy(id_col, "template", "license").agg(best.alias("best")).select(id_col, "template", "license", "best.containment", (-F.col("best.first")).alias("at"))
