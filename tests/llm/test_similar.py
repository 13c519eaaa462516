"""Near-duplicates of the pipeline against the Jaccard similarity of shingle sets."""

from __future__ import annotations

import random

import corpus_pipeline as cp
import pytest
from gridload.llm import graph, simhash


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(6))


def edited(rng, base, edits):
    words = base.split()
    for k in rng.sample(range(len(words)), edits):
        words[k] = word(rng)
    return " ".join(words)


def brute_classes(texts):
    """The smallest id each text reaches over pairs of 0.8 and more."""
    root = {i: i for i in texts}
    ids = sorted(texts)
    sets = {i: shingles(t) for i, t in texts.items()}
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if root[i] != root[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_documents_below_the_limit_stay(spark):
    rng = random.Random(4)
    texts = {}
    for i in range(0, 240, 2):
        texts[i] = " ".join(word(rng) for _ in range(200))
        texts[i + 1] = edited(rng, texts[i], rng.choice((4, 5, 6, 7)))
    below = [i for i in range(0, 240, 2) if jaccard(texts[i], texts[i + 1]) < 0.8]
    assert sum(jaccard(texts[i], texts[i + 1]) > 0.69 for i in below) > 30
    kept = {r.doc_id for r in cp.dedup_documents(spark, docs_of(spark, texts), "").collect()}
    assert all(i + 1 in kept for i in below)


def test_versions_of_one_template(spark):
    rng = random.Random(5)
    texts, base = {}, " ".join(word(rng) for _ in range(150))
    for i in range(120):  # drifting versions: some chains hold, others break
        texts[i] = base if not i else edited(rng, texts[rng.randrange(max(0, i - 8), i)], rng.choice((2, 3, 5)))
    texts[120], texts[121] = texts[7].upper(), texts[7]
    want = brute_classes(texts)
    assert 3 < len(set(want.values())) < 110
    docs = docs_of(spark, texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert got == want
    kept = [r.doc_id for r in cp.dedup_documents(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(want.values()))


@pytest.mark.parametrize("cell", [1 << 20, 900])
def test_cells_and_parts_give_the_same_classes(spark, cell):
    rng = random.Random(6)
    base = " ".join(word(rng) for _ in range(60))
    texts = {i: edited(rng, base, rng.choice((1, 2, 3))) for i in range(60)}
    texts |= {i: edited(rng, texts[i - 60], 1) for i in range(60, 90)}
    want = brute_classes(texts)
    docs = docs_of(spark, texts).withColumns(
        {"s": simhash.sketch(cp.F.col("text"), 5, 4), "shingles": simhash.shingle_set(cp.F.col("text"), 5)}
    )
    rows = docs.select("doc_id", "s.*", "shingles").collect()
    members = spark.createDataFrame(
        [(r.doc_id, 0, r.fp, r.n, r.shingles) for r in rows],
        "node long, root long, fp array<long>, n int, shingles array<long>",
    )
    edges = simhash.similar_sets(members, least=0.8, budget=256, cell=cell)
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert {i: got.get(i, i) for i in texts} == want


@pytest.mark.parametrize("words,edits", [(9, None), (10, None), (85, None), (184, 4), (364, 8)])
def test_pairs_at_the_limit_are_found(spark, words, edits):
    """Pairs at a similarity of 0.80: words changed apart from each other, or an end cut off."""
    rng = random.Random(words)
    texts = {}
    for i in range(0, 1000, 2):
        found = [word(rng) for _ in range(words)]
        texts[i] = " ".join(found)
        if edits is None:
            texts[i + 1] = " ".join(found[: -((words - 4) // 5 or 1)])
        else:
            for k in rng.sample(range(8, words - 8, 10), edits):
                found[k] = word(rng)
            texts[i + 1] = " ".join(found)
    similarity = {round(jaccard(texts[i], texts[i + 1]), 3) for i in range(0, 1000, 2)}
    assert len(similarity) == 1 and 0.8 <= similarity.pop() < 0.84
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(spark, texts)).collect()}
    found = sum(got[i + 1] == i for i in range(0, 1000, 2))
    print("found", words, edits, found)
    assert found >= (500 if words <= 16 else 495) and all(got[i] == i for i in range(0, 1000, 2))
