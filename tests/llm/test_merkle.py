from __future__ import annotations

import hashlib
import itertools
import random
import sys
from pathlib import Path

from gridload.llm import merkle, queries
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node string, at long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    fields = (row[0], row[1], row[2], row[3], row[4])
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def sides(levels, at):
    for nodes in levels[:-1]:
        first = at - at % 16
        yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])
        at //= 16


def expected(rows, changed):
    by = lambda row: (row[1] is not None, (row[1] or "").encode())
    order = lambda row: (by(row), row[0] is not None, row[0] or 0, leaf(row))
    trees = [list(g) for _, g in itertools.groupby(sorted(rows, key=order), key=by)]
    built = [climb([leaf(r) for r in t]) for t in trees]
    top = climb([b[-1][0] for b in built])
    out = []
    for k, (tree, levels) in enumerate(zip(trees, built, strict=True)):
        for i, row in enumerate(tree):
            path = [*sides(levels, i), *sides(top, k)]
            own = leaf(changed(row))
            node, copied = own, [own]
            for left, right in path:
                node = h(left + node + right)
                copied.append(node)
            proof = h("".join(a + b for a, b in path))
            tampered = own != leaf(row)
            out.append((row[0], row[1], leaf(row), levels[-1][0], top[-1][0], proof, copied if tampered else None, node))
    return sorted(out, key=repr)


def changed(row):
    return (*row[:4], row[4].lower() if row[4] and row[0] is not None and row[0] % 5 == 0 else row[4])


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "t", "n", 5) for r in rows], SCHEMA)
    text = F.when(F.col("doc_id") % 5 == 0, F.lower("text")).otherwise(F.col("text"))
    out = merkle.manifest(df, changed={"text": text}, **options)
    assert out.columns == ["doc_id", "source", "at", "leaf", "subroot", "root", "proof_sha256", "copied", "folded_root"]
    return sorted(((r[0], r[1], *r[3:]) for r in out.collect()), key=repr)


def test_matches_sql(spark):
    df = queries.all_queries()["op13_merkle"](spark, SF)
    rows = oracle.spark_rows(df)
    assert rows == oracle.oracle_rows(oracle.connect(SF), queries.all_oracles()["op13_merkle"])
    assert {r[-1] for r in rows[1]} == {True, False}


def test_uneven_trees_nulls_ties_and_clashing_columns(spark):
    rng = random.Random(5)
    rows = [(i, "big", "en", 3, rng.choice(["AbC", "abc", "", None, "Äß"])) for i in range(700)]
    rows += [(i, None, None, None, f"T{i}") for i in range(17)]
    rows += [(None, "gaps", "de", 1, "X"), (None, "gaps", "de", 1, "Y"), (3, "gaps", "de", 1, "Q"), (5, "", "de", 1, "Q")]
    rows += [(10 + k, f"s{k:02d}é", "fr", 2, "Lone") for k in range(20)]
    rows += [(7, "long", "en", 1, "word " * 200_000 + "End"), (10, "long", "en", 1, "Word " * 200_000)]
    rng.shuffle(rows)
    assert found(spark, rows) == expected(rows, changed)


def test_many_blocks(spark):
    # blocks of 16 nodes: four sweeps up and down
    rows = [(i, "a" if i < 4500 else "b", "en", 1, f"Text {i}") for i in range(4800)]
    assert found(spark, rows, levels=1) == expected(rows, changed)


def test_versions_share_untouched_nodes():
    base = merkle.PersistentTree([h(str(i)) for i in range(300)], 3)
    kept = [list(level) for level in base.levels]
    versions = [merkle.Version(base, at, h("new")) for at in (0, 17, 299)]
    assert base.levels == kept
    for v in versions:
        assert len(v.path) == 4 and v.path[-1] != base.top
        for level, nodes in enumerate(base.levels):
            differing = [i for i in range(len(nodes)) if v.node(level, i) != nodes[i]]
            assert differing == [v.at // 16**level]


def test_empty_and_single(spark):
    assert found(spark, []) == []
    rows = [(1, "s", "en", 1, "Only")]
    assert found(spark, rows) == expected(rows, changed)
