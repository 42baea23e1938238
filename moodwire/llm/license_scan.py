"""License scan: min-hash bands over overlapping windows find templates, exact containment confirms them.

Texts are lower-cased (A-Z), words are runs of a-z and 0-9, shingles are ``WIDTH`` words. A template of s
shingles belongs to the class c, the power of two that is at least s. For each class a document has windows of
2c shingles at every multiple of c, so any run of c shingles lies whole in one of them. With a
share of ``least`` of its shingles in the window, a template's similarity to the window is at least
least * s / (2c + (1 - least) * s) > 0.19 for the default 0.8, and each of the ``bands`` one-row bands
collides with that probability: 64 bands miss with (1 - 0.19)^64 < 2e-6, and a verbatim template (similarity over
1/4) with 1e-8. Candidates are confirmed by the exact share of the template's shingles in the window.

Windows are banded only where they can hold a template at all: per template the scan takes words which
together stand in more than 1 - ``least`` of its shingles, so a window none of whose shingles has
such a word cannot reach ``least``. The same words, looked for as substrings, pick the documents first. Neither
test can lose a match.

Everything is column expressions and joins. Texts do not shuffle; rows that pass the test are landed, and
band rows meet the templates in a join (broadcast while there are at most ``broadcast_rows`` band rows).

Defined cases: null, empty and short texts have no licenses. Templates with a null id or fewer than ``WIDTH``
words take no part; templates with equal ids are variants of one license. Repeated rows are reported each.
Ties: the variant and window with the larger share, then the earlier window. Extra columns are kept;
one named like ``into`` is replaced. Empty tables: no rows, or no licenses.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import landed

WIDTH = 5

# Notices as their licenses word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "GPL-2.0",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def words_of(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, lower)
    return F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))


def _shingled(words: Column, make) -> Column:
    """``make`` of the words of each shingle; none for fewer than ``WIDTH`` words.

    The lambda sees only its own words: what it names besides would be computed at every place.
    """
    names = [f"w{k}" for k in range(WIDTH)]
    shifted = [F.slice(words, F.lit(k + 1), F.size(words) - (WIDTH - 1)).alias(n) for k, n in enumerate(names)]
    each = F.transform(F.arrays_zip(*shifted), lambda s: make([s[n] for n in names]))
    return F.when(F.size(words) >= WIDTH, each)


def shingles_of(words: Column) -> Column:
    """One hash per place."""
    return F.coalesce(_shingled(words, lambda own: F.xxhash64(*own)), F.array().cast("array<bigint>"))


def marked_shingles_of(words: Column, needed: list[str]) -> Column:
    """Hash per place, and whether a needed word is in it."""
    one = lambda own: F.struct(
        F.xxhash64(*own).alias("hash"), reduce(or_, [w.isin(needed) for w in own]).alias("mark")
    )
    return F.coalesce(_shingled(words, one), F.array().cast("array<struct<hash: bigint, mark: boolean>>"))


def bands_of(shingles: Column, bands: int) -> Column:
    """The least hash under each of ``bands`` hash functions; the function's number is part of the hash."""
    numbers = F.sequence(F.lit(0), F.lit(bands - 1))
    return F.transform(numbers, lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))))


def _windows(shingles: Column, width: Column) -> Column:
    """Windows of 2 * width shingles at every multiple of width that have a marked shingle."""
    starts = F.sequence(F.lit(0), F.size(shingles) - 1, width)
    every = F.transform(
        starts, lambda k: F.struct(k.alias("window"), F.slice(shingles, k + 1, 2 * width).alias("own"))
    )
    return F.filter(every, lambda w: F.exists(w["own"], lambda s: s["mark"]))


def _needed(texts: list[str], least: float) -> list[str]:
    """Words of which every window with ``least`` of a template's shingles has at least one."""
    needed: set[str] = set()
    for text in texts:
        words = re.findall("[a-z0-9]+", text.lower())
        shingles = {tuple(words[k : k + WIDTH]) for k in range(len(words) - WIDTH + 1)}
        left = len(shingles)
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if len(shingles) - left > (1 - least) * len(shingles) + 1e-9 or not shingles:
                break
            needed.add(word)
            left = sum(needed.isdisjoint(s) for s in shingles)
    return sorted(needed)


def scan(
    docs: DataFrame,
    notices: DataFrame,
    *,
    text: str = "text",
    least: float = 0.8,
    bands: int = 64,
    broadcast_rows: int = 1_000_000,
    into: str = "licenses",
) -> DataFrame:
    """``docs`` with ``into``: array of (license, share, window), by license.

    ``notices`` (license, text) is a library of templates and is read by the driver; ``window`` is the
    number of the first shingle of the window with the largest share.
    """
    rows = [r for r in notices.where("license is not null and text is not null").collect()]
    needed = _needed([r["text"] for r in rows], least)
    known = notices.select("license", shingles_of(words_of(F.col("text"))).alias("all")).where(
        (F.size("all") > 0) & F.col("license").isNotNull()
    )
    sizes = F.array_distinct("all")
    known = known.select(
        "license",
        sizes.alias("wanted"),
        F.pow(F.lit(2), F.ceil(F.log2(F.size("all")))).cast("int").alias("class"),
        bands_of(sizes, bands).alias("bands"),
    )
    classes = sorted(r["class"] for r in known.select("class").distinct().collect())
    kept = [c for c in docs.columns if c != into]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    kind = "array<struct<license: string, share: double, window: int>>"
    none = F.array().cast(kind)
    if not classes:
        return docs.select(*[F.col(f"`{c}`") for c in kept], none.alias(into))

    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lowered = F.lower(value)
    # Looked for as parts of the text, a word that holds another needed word adds nothing.
    parts = [w for w in needed if not any(o in w for o in needed if o != w)]
    may = reduce(or_, [F.contains(lowered, F.lit(w)) for w in parts])
    marked = marked_shingles_of(words_of(F.col(f"`{text}`")), needed)
    some = landed(docs.where(may).select(row.alias("row"), marked.alias("all")), "licenses")
    some = some.select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("number")
    )

    ks = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    windows = (
        some.where(F.size("all") > 0)
        .select("file", "number", "all", ks)
        .select("file", "number", "class", F.explode(_windows(F.col("all"), F.col("class"))).alias("w"))
        .select("file", "number", "class", "w.window", F.transform("w.own", lambda s: s["hash"]).alias("own"))
        .select("file", "number", "class", "window", "own", F.explode(bands_of(F.col("own"), bands)).alias("band"))
    )
    index = known.select("license", "class", "wanted", F.explode("bands").alias("band"))
    if index.limit(broadcast_rows + 1).count() <= broadcast_rows:
        index = F.broadcast(index)
    share = F.size(F.array_intersect("wanted", "own")) / F.size("wanted")
    found = (
        windows.join(index, ["class", "band"])
        .select("file", "number", "license", "window", share.alias("share"))
        .where(F.col("share") >= least)
        .groupBy("file", "number", "license")
        .agg(F.max(F.struct("share", (-F.col("window")).alias("before"))).alias("best"))
        .groupBy("file", "number")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "license",
                        F.col("best.share").alias("share"),
                        (-F.col("best.before")).cast("int").alias("window"),
                    )
                )
            ).alias("found")
        )
    )
    with_some = some.join(found, ["file", "number"], "left").select(
        "row.*", F.coalesce(F.col("found"), none).alias(into)
    )
    return with_some.unionByName(docs.where(~may).select(*[F.col(f"`{c}`") for c in kept], none.alias(into)))
