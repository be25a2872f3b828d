"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Everything is DataFrame expressions. A text becomes its five-word shingles, hashed. For every template length t (in shingles) the windows
are t shingles long and start every t/4 shingles. A window's MinHash values, one band each, are joined with those of the templates
of that length. A window that shares 3/10 of a template's shingles, the least a verified window has whatever its alignment,
misses all BANDS with a probability below 0.001; half of them shared, below 1e-8. A retrieved template is verified by the share of its
shingles within the window and a stride on both sides: 0.8 or more is a match. Of templates that differ in a few words, as headers
of the versions of one licence do, a window gives the one that it contains best.

No window can share a MinHash value with a template without sharing a shingle, so texts without any template shingle, and windows that
hold none, are left out before sketches are made.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import materialise, read

SHINGLE, THRESHOLD, BANDS = 5, 0.8, 48
#: Templates are variants of each other if they share at least this part of the larger one's shingles.
VARIANT = 0.5
#: Words of all templates together; they are literals of the plan.
MAX_WORDS = 20_000

#: Public notices and the opening passages of public licences.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        " writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
        " either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions:"
    ),
    "gpl-2.0-only-header": (
        "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published"
        " by the Free Software Foundation."
    ),
    "gpl-2.0-header": (
        "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl-3.0-header": (
        "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "lgpl-2.0-header": (
        "is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published"
        " by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "lgpl-2.1-header": (
        "is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published"
        " by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "lgpl-3.0-header": (
        "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "agpl-3.0-header": (
        "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "bsd-3-clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission."
    ),
    "isc-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        " the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
        " file, You can obtain one at"
    ),
    "epl-1.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies"
        " this distribution, and is available at"
    ),
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"
    ),
    "unlicense-dedication": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,"
        " or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,"
        " and by any means."
    ),
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def template_words(text: str) -> list[str]:
    """Words as the plan makes them, for templates in ASCII."""
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).split()


def shingle_hashes(text: str) -> Column:
    """SQL: the hashes of a text's five-word shingles in order; null with fewer words."""
    words = f"filter(split(regexp_replace(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' '), w -> w <> '')"
    parts = ", ".join(f"x.w[i + {k}]" for k in range(SHINGLE))
    return F.expr(
        f"get(transform(filter(array(named_struct('w', {words})), x -> size(x.w) >= {SHINGLE}),"
        f" x -> transform(sequence(0, size(x.w) - {SHINGLE}), i -> xxhash64({parts}))), 0)"
    )


def variants(shingles: dict[str, set]) -> dict[str, list[str]]:
    """For each template its variants, itself among them, in order of their names."""
    alike = lambda a, b: len(a & b) >= VARIANT * max(len(a), len(b))
    return {name: sorted(k for k, b in shingles.items() if alike(a, b)) for name, a in shingles.items()}


def _template_rows(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, t, stride, shingles): each template's hashes, made by the same expressions as a text's."""
    words = {name: template_words(text) for name, text in templates.items()}
    if short := [name for name, w in words.items() if len(w) < SHINGLE]:
        raise ValueError(f"templates with fewer than {SHINGLE} words: {short}")
    if sum(map(len, words.values())) > MAX_WORDS:
        raise ValueError(f"templates of more than {MAX_WORDS} words")
    rows = spark.createDataFrame([(name, " ".join(w)) for name, w in words.items()], "license string, text string")
    rows = rows.withColumn("sh", shingle_hashes("text")).withColumn("t", F.size("sh"))
    return rows.select("license", "t", F.expr("cast(greatest(1, floor(t / 4)) as int)").alias("stride"), "sh")


def sketch(shingles: str) -> str:
    """SQL: the MinHash values of an array of hashes, one per band."""
    return f"transform(sequence(1, {BANDS}), k -> array_min(transform({shingles}, s -> xxhash64(s, k))))"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment): a row for each id and template that one of its rows holds.

    ``containment`` is the share of the template's shingles in the best window, rounded to six digits, 0.8 or more. A window that holds
    a template gives, of it and its variants (``VARIANT``), only the one it contains best, of equal ones the first by name. Null, empty and texts
    of fewer than five words match nothing; texts of any length are scanned whole, and an empty table gives no rows. Words are runs of letters and digits in lower case. Equal rows, and rows of one id, give one match; a
    null id is an id of its own. Other columns are not read. The templates are bounded (``MAX_WORDS``) and broadcast.
    """
    spark = docs.sparkSession
    marks = _template_rows(spark, TEMPLATES if templates is None else templates)
    known = [(r.license, r.t, r.stride, list(r.sh)) for r in marks.collect()]  # bounded by MAX_WORDS
    every = sorted({s for _, _, _, sh in known for s in sh})
    literal = "array(" + ", ".join(f"{s}L" if s > -(1 << 63) else f"(-{(1 << 63) - 1}L - 1L)" for s in every) + ")"
    held = docs.select(F.col(id_col).alias("doc_id"), shingle_hashes(f"`{text_col}`").alias("sh"))
    held = held.where(F.expr(f"arrays_overlap(sh, {literal})"))
    held, _ = materialise(held.withColumn("row", F.monotonically_increasing_id()), "candidates")
    hits = held.withColumn("n", F.size("sh")).withColumn("mine", F.expr(f"array_intersect(sh, {literal})"))
    hits = hits.withColumn("hits", F.expr("filter(sequence(0, n - 1), i -> array_contains(mine, sh[i]))"))
    windows = []
    for t, stride in sorted({(t, stride) for _, t, stride, _ in known}):
        first = f"cast(ceil(greatest(0, p - {t} + 1) / {stride}) * {stride} as int)"
        last = f"cast(floor(least(p, greatest(n - {t}, 0)) / {stride}) * {stride} as int)"
        starts = f"array_distinct(flatten(transform(hits, p -> if({first} <= {last}, sequence({first}, {last}, {stride}), array()))))"
        windows.append(
            f"transform({starts}, s -> named_struct('t', {t}, 's', s, 'mins', {sketch(f'slice(sh, s + 1, {t})')},"
            f" 'near', array_distinct(slice(sh, greatest(0, s - {stride}) + 1, s + {t} + {stride} - greatest(0, s - {stride})))))")
    cut = hits.select("doc_id", F.explode(F.expr(f"concat({', '.join(windows)})")).alias("w")).select("doc_id", "w.*")
    cut = cut.withColumn("window", F.monotonically_increasing_id())
    cut, _ = materialise(cut, "windows")
    bands = marks.select("license", "t", F.posexplode(F.expr(sketch("sh"))).alias("band", "least"))
    probe = cut.select("window", "t", F.posexplode("mins").alias("band", "least"))
    found = probe.join(F.broadcast(bands), ["t", "band", "least"]).select("window", "license").distinct()
    own = {name: set(sh) for name, _, _, sh in known}
    kin = [(name, list(own[name]), [(k, list(own[k])) for k in others]) for name, others in variants(own).items()]
    kin = spark.createDataFrame(kin, "license string, own array<long>, kin array<struct<name: string, own: array<long>>>")
    both = cut.select("window", "doc_id", "near").join(found, "window").join(F.broadcast(kin), "license")  # bounded by MAX_WORDS, as bands
    both = both.where(F.size(F.array_intersect("near", "own")) / F.size("own") >= THRESHOLD)
    top = F.expr("array_min(transform(kin, k -> named_struct('least', -size(array_intersect(near, k.own)) / size(k.own), 'name', k.name)))")
    both = both.select("doc_id", top.alias("top"))
    best = both.groupBy("doc_id", F.col("top.name").alias("license")).agg((-F.min("top.least")).alias("share"))
    return best.select("doc_id", "license", F.round("share", 6).alias("containment"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and headers in all documents."""
    return scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def _oracle() -> str:
    """Brute force: every window of the grid against every template, by the shingles as text."""
    words = {name: template_words(text) for name, text in TEMPLATES.items()}
    shingles = {name: [" ".join(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)] for name, w in words.items()}
    rows = []
    for name, others in variants({k: set(v) for k, v in shingles.items()}).items():
        t = len(shingles[name])
        rows += [f"('{name}', {t}, {max(1, t // 4)}, '{k}', '{sh}')" for k in others for sh in shingles[k]]
    shingle = " || ' ' || ".join(f"w[p + {k}]" for k in range(1, SHINGLE + 1))
    return f"""
WITH marks(license, t, stride, kin, sh) AS (VALUES {', '.join(rows)}),
sizes AS (SELECT kin, count(DISTINCT sh) AS own FROM marks GROUP BY kin),
docs AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
places AS (SELECT r, doc_id, w, len(w) - {SHINGLE} + 1 AS n, unnest(range(0, len(w) - {SHINGLE} + 1)) AS p FROM docs WHERE len(w) >= {SHINGLE}),
shingles AS (SELECT r, doc_id, n, p, {shingle} AS sh FROM places),
hits AS (SELECT DISTINCT r, doc_id, n, p, license, t, stride, kin, sh FROM shingles JOIN marks USING (sh)),
windows AS (SELECT r, doc_id, license, kin, sh, unnest(range(0, greatest(n - t, 0) + 1, stride)) AS s, p, t, stride FROM hits),
counts AS (SELECT r, doc_id, license, kin, s, count(DISTINCT sh) AS k FROM windows WHERE p >= s - stride AND p < s + t + stride GROUP BY ALL),
shares AS (SELECT r, doc_id, license, kin, s, k / own AS share FROM counts JOIN sizes USING (kin)),
best AS (SELECT doc_id, max(share) FILTER (kin = license) AS held, min(struct_pack(least := -share, name := kin)) AS top FROM shares GROUP BY r, doc_id, license, s)
SELECT doc_id, top.name AS license, round(-min(top.least), 6) AS containment FROM best WHERE held >= {THRESHOLD} GROUP BY doc_id, top.name
"""


ORACLE = _oracle()
