"""License scans, in DataFrame operations only.

Templates are license notices. A text is read through overlapping windows made for each template: a
window has the template's words and `stride - 1` more, one starts every `stride` words, and the stride is
a quarter of the template's words, so that every passage of the template's length lies in a window as a
whole. Window and template are compared by MinHash of five-word shingles with `BANDS` bands of one
minimum. A window that holds the share `CONTAINS` of a template's shingles has a Jaccard coefficient of
at least `0.8 m / (1.2 m + stride - 1)`, over 0.54 for all m, so that 24 bands collide with a probability
above 1 - 1e-8. Collisions are then verified by the exact containment of the template's shingles.

Only a window that holds the shingle of a template's minimum can collide, so texts without any of these
(at most `BANDS` for each template, a fixed number) are left out before windows are made; nothing that
could collide is lost.

Short notices have no five-word shingle. Their words are one shingle of their own length, so a window of as
many words, one of which starts at every word, holds all of it or nothing: they are found by exact equality.

Defined cases: case and characters other than letters and digits do not count; a null text matches nothing,
and a text of fewer than five words only short notices; texts of any length are read whole; repeated rows are
reported each; a passage near several templates is reported under each; documents without a match have no row;
templates of fewer than five words are refused, as they belong to the short notices; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 5
BANDS = 24
CONTAINS = 0.8

#: Notices by SPDX-like names.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Short notices.
NOTICES = {"All-rights-reserved": "All rights reserved."}

#: What stands between words of a text in lower case.
BETWEEN = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN, -1), "")


def _shingles(column: str) -> Column:
    """Hashes of the five-word shingles of a column of words, none for fewer words."""
    one = F.transform(F.sequence(F.lit(0), F.size(column) - WIDTH), lambda i: F.xxhash64(*[F.col(column)[i + k] for k in range(WIDTH)]))
    return F.when(F.size(column) >= WIDTH, one).otherwise(F.array().cast("array<bigint>"))


def _seeded(h: Column) -> Column:
    """The value of a shingle in the row's band."""
    return F.xxhash64(h, F.col("band"))


def _own_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """license, shingles (distinct), stride and length (in shingles) of the windows of every template."""
    templates = TEMPLATES if templates is None else templates
    for name, text in templates.items():
        if len(_own_words(text)) < WIDTH:
            raise ValueError(f"the template {name} has fewer than {WIDTH} words")
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates.items()])
    cut = spark.range(1).select(F.explode(rows).alias("t")).select("t.license", words(F.col("t.text")).alias("_words"))
    sized = cut.withColumn("shingles", F.array_distinct(_shingles("_words"))).withColumn("stride", F.greatest(F.lit(1), F.floor(F.size("_words") / 4)).cast("int"))
    return sized.select("license", "shingles", "stride", (F.size("_words") - WIDTH + F.col("stride")).alias("length"))


def scan_short(docs: DataFrame, notices: dict[str, str]) -> DataFrame:
    """The columns of `scan`, for every document with one of the short notices; every place is a window."""
    cut = {name: _own_words(text) for name, text in notices.items()}
    if not all(cut.values()):
        raise ValueError("a notice has no words")
    low = F.lower("text")
    some = reduce(or_, [low.rlike(BETWEEN.join(own)) for own in cut.values()], F.lit(False))  # few texts are cut into words
    rows = docs.filter(some).select("doc_id", words(F.col("text")).alias("_words"))

    def places(own: list[str]) -> Column:
        starts = F.when(F.size("_words") >= len(own), F.sequence(F.lit(0), F.size("_words") - len(own))).otherwise(F.array().cast("array<int>"))
        return F.filter(starts, lambda i: F.slice("_words", i + 1, len(own)) == F.array(*[F.lit(x) for x in own]))

    found = F.array(*[F.struct(F.lit(name).alias("license"), places(own).alias("at")) for name, own in cut.items()])
    each = rows.select("doc_id", F.explode(found).alias("x")).filter(F.size("x.at") > 0)
    return each.select("doc_id", "x.license", F.lit(1.0).alias("containment"), F.size("x.at").cast("long").alias("n_windows"), F.col("x.at")[0].cast("long").alias("first_word"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment (the best of its windows), n_windows (verified), first_word (of the first), for every match."""
    notices = NOTICES if notices is None else notices
    spark = docs.sparkSession
    known = template_table(spark, templates)
    seeds = known.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("least", F.array_min(F.transform("shingles", _seeded)))
    keyed = seeds.withColumn("key", F.filter("shingles", lambda h: _seeded(h) == F.col("least"))[0])
    keys = sorted({r["key"] for r in keyed.select("key").collect()})  # at most BANDS for each template
    longest = known.agg(F.max("length").alias("n")).first()["n"]
    wanted = F.array(*[F.lit(x).cast("long") for x in keys])
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words(F.coalesce("text", F.lit(""))).alias("_words")).withColumn("_all", _shingles("_words"))
    hits = rows.filter(F.arrays_overlap("_all", wanted)).select("_row", "doc_id", "_all", F.explode(F.filter(F.sequence(F.lit(0), F.size("_all") - 1), lambda i: F.array_contains(wanted, F.col("_all")[i]))).alias("_at"))
    low = F.greatest(F.lit(0), F.col("_at") - longest)
    near = hits.select("_row", "doc_id", "_at", F.col("_all")[F.col("_at")].alias("key"), low.alias("_low"), F.slice("_all", low + 1, F.lit(2 * longest + 1)).alias("_near"))
    met = near.join(F.broadcast(keyed), "key")  # BANDS rows for each template
    first = F.ceil(F.greatest(F.lit(0), F.col("_at") - F.col("length") + 1) / F.col("stride")).cast("int") * F.col("stride")
    placed = met.filter(first <= F.col("_at")).withColumn("_start", F.explode(F.sequence(first, F.col("_at"), F.col("stride"))))
    windows = placed.withColumn("_window", F.slice("_near", F.col("_start") - F.col("_low") + 1, F.col("length")))
    least = F.array_min(F.transform("_window", _seeded))
    collided = windows.filter(least == F.col("least")).select("_row", "doc_id", "license", "_start", (F.size(F.array_intersect("shingles", "_window")) / F.size("shingles")).alias("_share"))
    verified = collided.filter(F.col("_share") >= CONTAINS)
    long = verified.groupBy("_row", "doc_id", "license").agg(F.max("_share").alias("containment"), F.count_distinct("_start").alias("n_windows"), F.min("_start").cast("long").alias("first_word")).drop("_row")
    return long.unionByName(scan_short(docs, notices)) if notices else long
