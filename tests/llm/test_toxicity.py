from __future__ import annotations

import itertools
import random
import zlib

import numpy as np

from gridload.llm import queries, toxicity


def brute_marginals(emit, start, moves):
    total, on = 0.0, np.zeros(len(emit))
    for path in itertools.product((0, 1), repeat=len(emit)):
        s = start[path[0]] + sum(e for e, y in zip(emit, path, strict=True) if y)
        s += sum(moves[a][b] for a, b in itertools.pairwise(path))
        total += np.exp(s)
        on += np.exp(s) * np.array(path)
    return on / total


def test_forward_backward_matches_all_paths():
    rng = np.random.default_rng(0)
    start, moves = rng.normal(size=2), rng.normal(size=(2, 2)) * 2
    sizes = [1, 7, 3, 1, 10, 5, 8]
    emit = rng.normal(size=sum(sizes)) * 3
    starts = np.zeros(len(emit), bool)
    starts[np.cumsum([0, *sizes[:-1]])] = True
    got = toxicity.marginals(emit, starts, start, moves)[0]
    want = np.concatenate([brute_marginals(e, start, moves) for e in np.split(emit, np.cumsum(sizes)[:-1])])
    assert np.allclose(got, want)


def sample():
    rng = random.Random(4)
    text = lambda n, bad: " ".join(
        rng.choice(["grok", "blag", "zuwort" + rng.choice("abcdef")]) if bad and rng.random() < 0.2 else
        rng.choice("the of and in from with this that house tree road".split()) for _ in range(n)
    )
    return [(i, text(rng.randint(8, 60), i % 5 == 0), i % 5 == 0) for i in range(600)]


def test_spans_scores_and_edge_cases(spark):
    rows = sample()
    docs = [(i, t) for i, t, _ in rows]
    extra = [(9000, None), (9001, ""), (9002, "?!"), (9003, "the house " * 40_000 + "grok blag"), (None, "the house grok")]
    extra += [(9004, "the road"), (9004, "the road"), (9005, "of zuwortz the tree GROK")]
    docs = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumnRenamed("text", "body")
    labels = spark.createDataFrame(
        [(i, int(bad)) for i, _, bad in rows] + [(None, 1), (3, None), (4, 0)], "doc_id long, toxic int"
    )
    model = toxicity.learn(docs, labels, text="body")
    got = {r.doc_id: r for r in toxicity.score(docs, model, text="body").collect()}
    for i, _, bad in rows:
        assert (got[i].toxicity.score >= 0.7) == bad or "grok" not in got[i].body
    assert len({got[i].toxicity.score for i in (9000, 9001, 9002)}) == 1 and got[9000].toxicity.score < 0.5
    assert got[9003].toxicity.score > 0.7 and [s.start for s in got[9003].toxicity.spans] == [400_000]
    assert [got[9005].body[s.start : s.end] for s in got[9005].toxicity.spans] == ["zuwortz", "GROK"]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, none)).first().toxicity.score == 0.0
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), none)).count() == 0


def test_query_separates_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.all_queries()["op4_toxicity"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    wrong = sum(p for p, y in held if not y) / sum(1 - y for _, y in held)
    assert caught > 0.85 and wrong < 0.02, (caught, wrong)
