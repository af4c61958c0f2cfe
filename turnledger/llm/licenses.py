"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

JVM functions only. Templates fall into size classes; the windows of a class are twice as wide as
its largest template and overlap by half, so every copy of a template lies whole in some window.
Windows without a single template shingle cannot match and are left out first, exactly. The others
get one minimum per hash function. With single-row bands a window that holds ``CONTAINED`` of a
template's shingles shares no band with it with probability (1 - J)^BANDS, where its Jaccard
similarity J is at least 0.19: below 2e-6 for 64 bands. Candidates are then compared shingle by
shingle, as strings.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.text import with_key
from turnledger.session import staged

SHINGLE = 5  # words
CONTAINED = 0.8
BANDS = 64

#: Notices by which texts state their license, as commonly worded.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                         "option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def template_rows() -> list[tuple[int, str, int, list[str]]]:
    """(number, license, size class, distinct shingles): a class holds up to 2^class shingles."""
    rows = []
    for number, (name, text) in enumerate(TEMPLATES):
        words = normal_words(text)
        shingles = sorted({" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})
        rows.append((number, name, (len(words) - SHINGLE).bit_length(), shingles))
    return rows


def _templates(spark: SparkSession) -> DataFrame:
    """template, license, width_class, shingles: as many rows as there are templates."""
    rows = spark.createDataFrame(template_rows(), "template int, license string, width_class int, shingles array<string>")
    return rows.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(F.split(s, " "))))


def _minima(hashes: Column) -> Column:
    """The least value of each hash function over a window's shingles."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, band)))
    )


def _words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.split(spaced, " ")


def _hashes(words: Column) -> Column:
    """A hash per shingle. The outer lambda names the words, so that they are split once a row."""
    each = lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE))
    )
    few = F.array().cast("array<bigint>")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= SHINGLE, each(w)).otherwise(few))[0]


def scan(docs: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment, n_windows, first_word: one row per document and license found.

    Of each license's templates the best counts: ``containment`` is the share of its shingles in
    one window, ``n_windows`` and ``first_word`` are those of all windows with ``contained`` or more.
    Words are runs of a-z and 0-9 after lower-casing. Null texts and those of under five words hold
    nothing. Rows that repeat an id and a text count once; null ids are kept; an empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    templates = _templates(spark)
    known = [row[0] for row in templates.select(F.explode("hashes")).distinct().collect()]  # some hundreds, as the templates
    known = F.array(*[F.lit(h) for h in known])
    keyed = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    words, hashes = _words(F.col("text")), _hashes(_words(F.col("text")))
    hashed = keyed.filter(F.arrays_overlap(hashes, known)).select(
        "doc_id", "_doc_key", "_text_key", words.alias("words"), hashes.alias("hashes"), F.array_intersect(hashes, known).alias("own")
    )
    hashed = staged(hashed, "shingles")
    classes = sorted({row[2] for row in template_rows()})
    hits = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.array_contains("own", F.element_at("hashes", i + 1)))
    # A window's number is its start over half its width; a shingle lies in two windows of each class.
    numbers = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(*[
        F.struct(F.lit(c).alias("width_class"), (F.floor(i / 2**c).cast("int") - back).alias("window"))
        for c in classes for back in (0, 1)
    ]))))
    windows = hashed.withColumn("at", F.explode(numbers)).select(
        "doc_id", "_doc_key", "_text_key", "at.width_class", "at.window", "words", "hashes"
    ).filter("window >= 0")
    half = F.expr("shiftleft(1, width_class)")
    start = F.col("window") * half
    held = windows.select(
        "doc_id", "_doc_key", "_text_key", "width_class", "window", start.alias("first_word"),
        F.slice("hashes", start + 1, half * 2).alias("part"), F.slice("words", start + 1, half * 2 + SHINGLE - 1).alias("words"),
    ).filter(F.size("part") > 0)
    banded = held.withColumn("minima", _minima(F.col("part"))).select("*", F.posexplode("minima").alias("band", "value"))
    offered = templates.select("template", "width_class", F.posexplode(_minima(F.col("hashes"))).alias("band", "value"))
    place = ["doc_id", "_doc_key", "_text_key", "width_class", "window", "first_word"]
    candidates = banded.join(F.broadcast(offered), ["width_class", "band", "value"]).groupBy(*place, "template").agg(F.first("words").alias("words"))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1)), lambda i: F.concat_ws(" ", F.slice("words", i, SHINGLE))
    )
    share = F.size(F.array_intersect(pieces, F.col("shingles"))) / F.size("shingles")
    verified = candidates.join(F.broadcast(templates.select("template", "license", "shingles")), "template").withColumn("share", share)
    verified = verified.filter(F.col("share") >= contained)
    return verified.groupBy("doc_id", "_doc_key", "_text_key", "license").agg(
        F.max("share").alias("containment"), F.count("*").alias("n_windows"), F.min("first_word").cast("long").alias("first_word")
    ).drop("_doc_key", "_text_key")


def scan_sql() -> str:
    """The same by comparing every window with every template, for DuckDB."""
    values = ",\n".join(
        f"({number}, '{name}', {1 << size}, {len(shingles)}, [{', '.join(repr(s) for s in shingles)}])"
        for number, name, size, shingles in template_rows()
    )
    return f"""WITH templates AS (SELECT * FROM (VALUES {values}) t(template, license, half, n, shingles)),
parts AS (SELECT template, license, half, n, unnest(shingles) AS shingle FROM templates),
texts AS (SELECT DISTINCT doc_id, text, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents),
places AS (SELECT *, unnest(range(len(words) - {SHINGLE - 1})) AS pos FROM texts WHERE len(words) >= {SHINGLE}),
shingles AS (SELECT doc_id, text, pos, array_to_string(words[pos + 1 : pos + {SHINGLE}], ' ') AS shingle FROM places),
hits AS (SELECT doc_id, text, template, license, half, n, shingle, unnest([pos // half, pos // half - 1]) AS w FROM shingles JOIN parts USING (shingle)),
matched AS (SELECT doc_id, text, template, license, half, w, count(DISTINCT shingle) / n AS share FROM hits WHERE w >= 0
            GROUP BY doc_id, text, template, license, half, n, w
            HAVING count(DISTINCT shingle) / n >= {CONTAINED})
SELECT doc_id, license, max(share) AS containment, count(*) AS n_windows, min(w * half)::BIGINT AS first_word
FROM matched GROUP BY doc_id, text, license"""
