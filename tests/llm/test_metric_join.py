from __future__ import annotations

import random
import re

import numpy as np
import pytest
from gridload.llm import metric_join, queries

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < 5:
        return frozenset([" ".join(words)])
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4))


def expected(rows):
    """Every pair of distinct sets that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = {}
    for held in holders.values():
        for k, i in enumerate(held):
            for j in held[k + 1 :]:
                seen[i, j] = seen.get((i, j), 0) + 1
    for (i, j), shared in seen.items():
        if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
            root[find(j)] = find(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    names = [doc_id if not sets[i] else least.get(find(i)) for i, (doc_id, _) in enumerate(rows)]
    return sorted(((d, len(s), n) for (d, _), s, n in zip(rows, sets, names, strict=True)), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, region int")
    out = metric_join.similar_documents(df, **options)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def words(rng, n, pool=5000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def changed(rng, text, count):
    out = list(text)
    for _ in range(count):
        out[rng.randrange(len(out))] = f"v{rng.randrange(10**6)}"
    return out


def corpus(seed):
    """Copies, near copies around the limit, a shared passage, short, empty and repeated rows."""
    rng = random.Random(seed)
    rows = []
    add = lambda text: rows.append((len(rows), " ".join(text)))
    passage = words(rng, 60)
    for _ in range(40):
        base = words(rng, rng.choice([6, 20, 120, 300]))
        add(base)
        for _ in range(rng.randrange(8)):
            add(changed(rng, base, rng.randint(0, max(1, len(base) // 45))))
    for _ in range(60):
        add(words(rng, 20) + passage + words(rng, rng.choice([2, 5, 20])))
    drift = words(rng, 200)
    for _ in range(80):
        add(drift)
        drift = changed(rng, drift, 4)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "one"), (905, "one")]
    rows += [(None, "one"), (None, None), (None, "no id here at all but words"), (907, "Ä b"), (908, "ä b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == expected(rows)


@pytest.mark.parametrize("rounds", [1, 4])
def test_regions_of_several_parts(spark, rounds):
    # a task holds few documents: large regions take rounds of jobs, then pairs of parts
    rows = corpus(3)
    assert found(spark, rows, cell=2000, rounds=rounds) == expected(rows)


def test_a_hot_group_and_a_long_text(spark):
    rng = random.Random(4)
    base = words(rng, 150)
    rows = [(i, " ".join(changed(rng, base, rng.randrange(5)))) for i in range(400)]
    rows += [(1000 + i, " ".join(words(rng, 50))) for i in range(50)]
    long = words(rng, 100_000, 10**6)
    rows += [(2000, " ".join(long)), (2001, " ".join([*long, "end"])), (2002, " ".join(long[:50_000]))]
    assert found(spark, rows, cell=1 << 14) == expected(rows)


@pytest.mark.parametrize("spread", [2, 30, 200])
def test_recursion_in_a_task(spread):
    rng = np.random.default_rng(spread)
    bases = [rng.choice(100_000, 120, replace=False) for _ in range(spread)]
    sets = []
    for i in range(400):
        keep = bases[i % spread][rng.random(120) > rng.uniform(0, 0.25)]
        sets.append(np.unique(np.concatenate([keep, rng.choice(100_000, rng.integers(0, 20))])))
    sizes = np.array([len(s) for s in sets])
    tried = metric_join.Sets(np.concatenate(sets), sizes)
    tried.join(np.arange(400))
    plain = metric_join.Sets(np.concatenate(sets), sizes)
    for i in range(400):
        plain.compare(i, np.arange(i + 1, 400))
    same = lambda root: {frozenset(np.flatnonzero(root == r).tolist()) for r in root}
    assert same(tried.root) == same(plain.root)
    assert 1 < len(same(tried.root)) < 400


def test_exact_limit():
    # 8 of 10 link, 7 of 9 do not
    a, b = np.arange(9), np.append(np.arange(8), 99)
    sets = metric_join.Sets(np.concatenate([a, b, a]), np.array([9, 9, 9]))
    sets.compare(0, np.array([1, 2]))
    assert sets.root.tolist() == [0, 0, 0]
    sets = metric_join.Sets(np.concatenate([a[:8], np.append(a[:7], 99)]), np.array([8, 8]))
    sets.compare(0, np.array([1]))
    assert sets.root.tolist() == [0, 1]


def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.all_queries()["op11_jaccard"](spark, SF)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == [(1, 0, 1)]
