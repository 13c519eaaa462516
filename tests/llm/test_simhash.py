from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridload.llm import graph, queries, simhash


def brute_print(text, size=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    n = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), seed=42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, budget=4):
    values = np.array(sorted(values), np.uint64)
    root = {int(v): int(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v in enumerate(values):
        for w in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ v) <= budget]:
            a, b = find(int(v)), find(int(w))
            root[max(a, b)] = min(a, b)
    return {int(v): find(int(v)) for v in values}


def brute_classes(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    roots = brute_roots({p for _, p in prints})
    names = {}
    for i, p in prints:
        if i is not None:
            names[roots[p]] = min(i, names.get(roots[p], i))
    return sorted(((i, f"{p:016x}", names.get(roots[p])) for i, p in prints), key=repr)


@pytest.mark.parametrize("cell,most", [(16_384, 65_536), (32, 65_536), (16, 8)])
def test_links_of_random_and_dense_fingerprints(spark, cell, most):
    rng = random.Random(cell)
    values = {0, (1 << 64) - 1}
    for _ in range(150):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(2):
            values.add(v ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(3, 6)))))
    centre = rng.getrandbits(64)
    for _ in range(200):
        values.add(centre ^ sum(1 << b for b in set(rng.choices(range(64), k=5))))
    signed = [(v - (1 << 64) if v >> 63 else v) for v in values]
    table = spark.createDataFrame([(v, [v]) for v in signed], "node long, fp array<long>")
    edges = simhash.link_fingerprints(table, cell=cell, cell_most=most)
    got = {}
    for r in graph.components(edges).collect():
        got[r.node % (1 << 64)] = r.root % (1 << 64)
    want = brute_roots(values)
    groups = lambda m: {frozenset(k for k, v in m.items() if v == r) for r in set(m.values())}
    assert groups({v: got.get(v, v) for v in values}) == groups(want)
    assert edges.count() <= 3 * (1 + 22) * len(values)


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "one"), (8, "ONE"), (7, "a b c"), (7, "a b c"), (None, "a b c")]
    rows += [(20, "w " * 60_000), (21, "W\n" * 60_000), (None, "alone here"), (30, "É a b c d"), (31, "é a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn(
        "component_id", F.lit(1)
    )
    got = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(F.col("fp")[0]).alias("f"), "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_classes(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_stays_per_class(spark):
    rows = [(5, "a b c d e"), (3, "A b c d e"), (3, "A b c d e"), (None, "a b c d e"), (6, "other text"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copies", F.lit(0))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [3, 6, 7, None]


def test_query_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.all_queries()["op2_simhash"](spark, sf_dir).select("doc_id", "fingerprint", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_classes(rows)


def test_long_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


@pytest.mark.parametrize("cell,most", [(32_768, 65_536), (40, 30)])
def test_links_of_long_fingerprints(spark, cell, most):
    rng = random.Random(7)
    values = []
    for _ in range(60):
        v = rng.getrandbits(256)
        values += [v] + [v ^ sum(1 << b for b in rng.sample(range(256), rng.randint(5, 60))) for _ in range(3)]
    centre = rng.getrandbits(192)
    values += [(rng.getrandbits(64) << 192) | centre ^ (1 << rng.randrange(192)) for _ in range(60)]  # one lead word
    words = lambda v: [(w - (1 << 64) if w >> 63 else w) for w in (v >> 64 * k & (1 << 64) - 1 for k in range(4))]
    table = spark.createDataFrame([(i, words(v)) for i, v in enumerate(values)], "node long, fp array<long>")
    edges = simhash.link_fingerprints(
        table, bands=simhash.LONG_BANDS, budget=simhash.LONG_BUDGET, cell=cell, cell_most=most
    )
    got = {r.node: r.root for r in graph.components(edges).collect()}
    root = list(range(len(values)))

    def find(x):
        return x if root[x] == x else find(root[x])

    def banded(x):
        return any(bin(x >> 64 * w >> 64 - by - n & (1 << n) - 1).count("1") <= 1 for w, by, n in simhash.LONG_BANDS)

    for i, v in enumerate(values):
        for j in range(i):
            x = v ^ values[j]
            if bin(x).count("1") <= simhash.LONG_BUDGET and banded(x):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: got.get(i, i) for i in range(len(values))} == {i: find(i) for i in range(len(values))}


def test_long_fingerprints_find_similar_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, pairs = [], []
    for i in range(0, 400, 2):
        words = [word() for _ in range(200)]
        rows.append((i, " ".join(words)))
        for k in rng.sample(range(200), 2):  # ten of 196 shingles change: similarity 0.9
            words[k] = word()
        rows.append((i + 1, " ".join(words)))
    for i in (1000, 1001):  # one repeated shingle does not make texts alike
        rows.append((i, "x " * 500 + " ".join(word() for _ in range(40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(
        docs,
        size=simhash.LONG_SHINGLE,
        words=simhash.LONG_WORDS,
        repeats=False,
        bands=simhash.LONG_BANDS,
        budget=simhash.LONG_BUDGET,
    )
    classes = {r.doc_id: r.component_id for r in got.collect()}
    assert sum(classes[i + 1] == i for i in range(0, 400, 2)) >= 196
    assert all(c in (i, i - i % 2) for i, c in classes.items())
