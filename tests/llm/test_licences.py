from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from gridload.llm import licences, queries

MARKS = re.compile(licences.MARKS)


def brute(rows, file_share=0.5, threshold=0.6):
    """rows: (id, path, text); the same rules, row by row."""
    word = lambda t: re.findall(r"[^\W_]+(?:\.[0-9]+)*", t.lower())
    found = []
    for i, path, text in rows:
        path, text = path or "", text or ""
        folder, name = path.rsplit("/", 1) if "/" in path else ("", path)
        named = bool(re.match(r"(?i)(un)?licen[cs]e|copying|notice", name))
        passage = text if named else "\n".join(x for x in text.split("\n") if MARKS.search(x))
        passage = passage if word(passage) else None
        is_file = named or (passage is not None and len(passage) >= file_share * len(text))
        found.append((i, folder.rstrip("/"), passage, is_file))
    n = sum(p is not None for _, _, p, _ in found)
    df = Counter(w for _, _, p, _ in found if p for w in set(word(p)))
    vocabulary = {w for _, t in licences.TEMPLATES for w in word(t)}
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1 if w in vocabulary else math.log(1 + n) + 1
    vector = lambda t: {w: (1 + math.log(c)) * idf(w) for w, c in Counter(word(t)).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    judged = []
    for i, folder, p, is_file in found:
        best = (0.0, 0, None)
        for k, (name, t) in enumerate(licences.TEMPLATES if p else ()):
            a, b = vector(p), vector(t)
            best = max(best, (sum(a[w] * b.get(w, 0) for w in a) / size(a) / size(b), -k, name))
        judged.append((i, folder, best[2], best[0], is_file))
    files = Counter((f, lic) for _, f, lic, c, is_file in judged if c >= threshold and is_file)
    out = []
    for i, folder, lic, c, _ in judged:
        if c >= threshold:
            out.append((i, folder, lic, "own", round(c, 6), folder))
            continue
        at, parts = None, folder.split("/") if folder else []
        for k in range(len(parts), -1, -1):
            above = "/".join(parts[:k])
            if any(f == above for f, _ in files):
                at = above
                break
        if at is None:
            out.append((i, folder, "none", "none", round(c, 6), None))
        else:
            top = max((m, lic) for (f, lic), m in files.items() if f == at)
            out.append((i, folder, top[1], "inherited", round(c, 6), at))
    return sorted(out, key=repr)


ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/c.txt", "plain text"),
    (3, "a/b/d/e.txt", None),
    (4, "a/b/d/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (5, "a/b/d/f/g.txt", "x"),
    (6, "z/h.txt", "no licence words but license is a word here among many many others"),
    (7, None, ""),
    (8, "a/b/i.txt", "code\n// Licensed under CC BY-NC 4.0.\n" + "word " * 50_000),
    (9, "z/q/r.txt", "Licensed under the Apache License, Version 2.0."),
    (10, "z/q/s.txt", "Licensed under the Apache License, Version 2.0."),
    (11, "z/q/t.txt", "Released under the MIT License."),
    (12, "z/q/u.txt", "é"),
    (12, "z/q/u.txt", "é"),
    (None, "rootfile", "---license---"),
]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, p string, text string").withColumn("dir", F.lit(1))
    got = licences.scan(docs, F.col("p")).withColumn("cosine", F.round("cosine", 6))
    got = sorted((tuple(r) for r in got.select("doc_id", "dir", "licence", "how", "cosine", "from_dir").collect()), key=repr)
    assert got == brute(ROWS)
    kinds = {r[0]: (r[2], r[3]) for r in got}
    assert kinds[2] == ("MIT", "inherited") and kinds[5] == ("GPL-3.0", "inherited") and kinds[8] == ("CC-BY-NC-4.0", "own")
    assert kinds[12] == ("Apache-2.0", "inherited") and kinds[6] == ("none", "none")
    assert licences.scan(docs.limit(0), F.col("p")).count() == 0


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [
        (r.doc_id, f"{r.source}/{r.lang}/{r.doc_id // 100}/{r.doc_id}", r.text)
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ]
    got = queries.all_queries()["op10_licences"](spark, sf_dir)
    got = sorted((tuple(r) for r in got.select("doc_id", "dir", "licence", "how", "cosine", "from_dir").collect()), key=repr)
    assert got == brute(rows, file_share=0.1)
    assert {"own", "inherited", "none"} <= {r[3] for r in got}
