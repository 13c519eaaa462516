from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

from gridload.llm import lines, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402


def brute(rows, window=3):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[i, t] = (None, 0)
            continue
        ls = t.split("\n")
        covered = set()
        for k in range(len(ls) - window + 1):
            w = tuple(x.strip(" ") for x in ls[k : k + window])
            if not any(x.strip() for x in w):
                continue
            if w in seen:
                covered.update(range(k, k + window))
            seen.add(w)
        out[i, t] = ("\n".join(x for k, x in enumerate(ls) if k not in covered), len(covered))
    return out


PASSAGE = "\n".join(f"line {i}" for i in range(6))
ROWS = [
    (1, f"top\n{PASSAGE}\nend"),
    (2, f"other\n{PASSAGE}\ntail\n{PASSAGE}"),
    (3, PASSAGE.replace("line", "  line ")),
    (4, "a\nb"),
    (5, "a\nb"),
    (6, None),
    (7, ""),
    (8, "\n\n\n\n"),
    (9, "\n\n\n\n"),
    (10, "\n".join(f"x{i % 700}" for i in range(3000))),
    (11, "a\nb\nc"),
    (11, "a\nb\nc"),
    (12, "A\nb\nc"),
    (None, "p\nq\nr"),
    (13, "p\nq\nr\ns"),
]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("before", F.col("text"))
    clashing = ["row", "covered", "_id", "_of", "id", "of", "all", "mine", "hash", "first", "times", "seen", "at", "lines"]
    docs = docs.withColumns({name: F.lit(5) for name in clashing})
    found = lines.remove_repeated_lines(docs)
    assert found.columns == [*docs.columns, "lines_removed"]
    got = found.collect()
    want = brute(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.text, r.lines_removed) == want[r.doc_id, r.before], r.doc_id
        assert all(r[name] == 5 for name in clashing)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.remove_repeated_lines(docs).count() == 0


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = queries.all_queries()["op6_line_dedup"](spark, sf_dir)
    con = oracle.connect(sf_dir)
    assert oracle.spark_rows(df) == oracle.oracle_rows(con, queries.all_oracles()["op6_line_dedup"])
    assert df.filter("n_removed > 0").count() > 10
