"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along paths.

The licence passages of a text are its lines with a licence word (the whole text if the
file is named like a licence). They are compared with short templates: words weigh by
``1 + log(tf)`` times an inverse document frequency counted over the passages of the
whole corpus; words outside the templates' vocabulary weigh like the rarest. The
template with the largest cosine names the licence if it reaches ``THRESHOLD``.

A row counts as its directory's licence file if its name says so or the passages make up
at least ``file_share`` of its text. Rows without a licence of their own inherit from
the nearest ancestor directory that has one (the directory itself first): directories
are expanded to their ancestors and equi-joined, once per distinct directory.

Texts are read once; only passages and paths go on. To the driver come document
frequencies of the templates' vocabulary, which is fixed.

Defined results: null texts have no passages; a null path is a name in the root;
a directory with several licences has the one of most files, then the last by name;
repeated rows get equal results; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import per_text
from gridload.session import written

THRESHOLD = 0.6
FILE_SHARE = 0.5
MARKS = (
    r"(?i)licen[cs]e|copyright|spdx|permission is hereby granted|redistribution and use|public domain|creative commons"
)
FILE_NAME = r"(?i)^(un)?licen[cs]e|^copying|^notice"
WORD = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
NONE = "none"

# Usual wording of licence headers, by licence identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Matcher:
    """Cosine of a passage with every template."""

    def __init__(self, templates: tuple, frequency: dict[str, int], passages: int) -> None:
        vocabulary = {w for _, t in templates for w in words(t)}
        self.idf = {w: math.log((1 + passages) / (1 + frequency.get(w, 0))) + 1 for w in vocabulary}
        self.rarest = math.log(1 + passages) + 1
        self.names = [name for name, _ in templates]
        self.by_word: dict[str, list] = defaultdict(list)
        for i, (_, text) in enumerate(templates):
            vector = self._vector(text)
            norm = math.sqrt(sum(v * v for v in vector.values()))
            for w, v in vector.items():
                self.by_word[w].append((i, v / norm))

    def _vector(self, text: str) -> dict[str, float]:
        counts = Counter(words(text))
        return {w: (1 + math.log(n)) * self.idf.get(w, self.rarest) for w, n in counts.items()}

    def best(self, texts: list[str]) -> list[dict]:
        out = []
        for text in texts:
            vector = self._vector(text)
            norm = math.sqrt(sum(v * v for v in vector.values())) or 1.0
            dots: dict[int, float] = defaultdict(float)
            for w, v in vector.items():
                for i, weight in self.by_word.get(w, ()):
                    dots[i] += v * weight
            i, dot = max(dots.items(), key=lambda x: (x[1], -x[0]), default=(0, 0.0))
            out.append({"licence": self.names[i], "cosine": min(dot / norm, 1.0)})
        return out


def directory(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"/?[^/]*$", ""), "/+$", "")


def passages(docs: DataFrame, path: Column, doc_id: str, text: str, file_share: float) -> DataFrame:
    """(doc_id, dir, passage, is_file); ``passage`` is null where there is none."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), whole.alias("text")
    )
    named = F.substring_index("path", "/", -1).rlike(FILE_NAME)
    lines = F.array_join(F.filter(F.split("text", "\n", -1), lambda line: line.rlike(MARKS)), "\n")
    found = F.when(named, F.col("text")).when(F.col("text").rlike(MARKS), lines)
    rows = rows.withColumns({"named": named, "passage": F.when(found.rlike(WORD), found)})
    large = F.length("passage") >= file_share * F.length("text")
    return rows.select("doc_id", directory(F.col("path")).alias("dir"), "passage", (F.col("named") | large).alias("is_file"))


def inherited(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """(dir, from_dir, licence) for each of ``dirs`` with an ancestor among ``files``."""
    of_dir = files.groupBy("dir", "licence").agg(F.count(F.lit(1)).alias("n"))
    of_dir = of_dir.groupBy("dir").agg(F.max(F.struct("n", "licence")).alias("top"))
    of_dir = of_dir.select(F.col("dir").alias("from_dir"), F.col("top.licence").alias("licence"))
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    depths = F.sequence(F.lit(0), F.size("parts"))
    above = dirs.select("dir", parts.alias("parts")).select("dir", "parts", F.explode(depths).alias("depth"))
    above = above.select("dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("from_dir"))
    near = above.join(of_dir, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "licence")).alias("near"))
    return near.select("dir", "near.from_dir", F.col("near.licence").alias("licence"))


def scan(
    docs: DataFrame,
    path: Column,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    file_share: float = FILE_SHARE,
    templates: tuple = TEMPLATES,
) -> DataFrame:
    """(doc_id, dir, licence, how, cosine, from_dir) per row.

    ``how`` is ``own``, ``inherited`` or ``none``; ``cosine`` is the passage's best
    (0 without passage).
    """
    rows = written(passages(docs, path, doc_id, text, file_share), "passages")
    with_text = rows.filter(F.col("passage").isNotNull())
    vocabulary = sorted({w for _, t in templates for w in words(t)})
    seen = with_text.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("passage"), F.lit(WORD), F.lit(0)))).alias("w"))
    counts = seen.filter(F.col("w").isin(vocabulary)).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    matcher = Matcher(templates, {r.w: r.n for r in counts}, with_text.count())
    shared = docs.sparkSession.sparkContext.broadcast(matcher)  # of the fixed templates
    best = per_text(lambda: shared.value.best, "struct<licence:string,cosine:double>")
    judged = written(
        with_text.withColumn("best", best(F.col("passage"))).select("doc_id", "dir", "is_file", "best.*").unionByName(
            rows.filter(F.col("passage").isNull()).select(
                "doc_id", "dir", "is_file", F.lit(None).cast("string").alias("licence"), F.lit(0.0).alias("cosine")
            )
        ),
        "licences",
    )
    own = F.col("cosine") >= threshold
    known, rest = judged.filter(own), judged.filter(~own)
    near = inherited(rest.select("dir").distinct(), known.filter("is_file").select("dir", "licence"))
    known = known.select("doc_id", "dir", "licence", F.lit("own").alias("how"), "cosine", F.col("dir").alias("from_dir"))
    got = rest.drop("licence").join(near, "dir", "left").select(
        "doc_id",
        "dir",
        F.coalesce("licence", F.lit(NONE)).alias("licence"),
        F.when(F.col("licence").isNull(), NONE).otherwise("inherited").alias("how"),
        "cosine",
        "from_dir",
    )
    return known.unionByName(got)
