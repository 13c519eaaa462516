from __future__ import annotations

import hashlib
import random
import re

from gridload.llm import decontaminate as d
from gridload.llm import queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    ws = words(text)
    hit, found = set(), set()
    for name, item in items:
        iw = words(item)
        n = min(len(iw), window)
        if not n:
            continue
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(ws) - n + 1):
            if tuple(ws[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(name)
    return len(ws), len(hit), sorted({str(x) for x in found if x is not None})


def sample(seed=3, letters="ab c,d É"):
    rng = random.Random(seed)
    vocab = ["a", "b", "Cc", "dé", "9"]
    text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(1, 14))) for i in range(12)]
    items += [(3, "a b Cc"), (None, "b b b 9"), (50, ""), (51, None), (52, "...")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, items[0][1] * 3), (62, items[0][1] * 3), (None, "x y z"), (63, "q " * 50_000)]
    return docs, items


def check(spark, docs, items, **options):
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = d.find_leaks(left, right, window=4, **options).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.leaks.n_words, r.leaks.n_hit, r.leaks["items"]) == brute(r.text, items, 4), r
        for s in r.leaks.spans:
            assert words(r.text[s.start : s.end]) == words(r.text)[s.first : s.last]


def test_matches_brute_force(spark):
    check(spark, *sample())


def test_several_blocks_give_the_same(spark):
    check(spark, *sample(5), block_words=20)


def test_rare_overlaps(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    items = [(i, text(rng.randint(3, 40))) for i in range(30)]
    docs = [(i, text(5) + " " + rng.choice(items)[1] + " " + text(30)) for i in range(50)]
    check(spark, docs, items)


def test_no_items_and_no_documents(spark):
    check(spark, sample()[0], [])
    check(spark, [], sample()[1])


def test_removal_keeps_clean_rows_and_columns(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame(
        [(1, f"Before, {item}! After " + "word " * 30, 7), (2, item, 7), (3, "clean text", 7), (4, None, 7)],
        "doc_id long, text string, leaks int",
    )
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in d.remove_leaks(docs, bench).collect()}
    assert set(got) == {1, 3, 4} and got[3].text == "clean text" and got[4].text is None
    assert got[1].text.startswith("Before, ! After") and got[1].leaks == 7


def test_query_matches_brute_force(spark, sf_dir):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.all_queries()["op5_decontaminate"](spark, sf_dir).collect()
    assert len(got) == len(texts) and any(r.contaminated for r in got)
    for r in got:
        n, hit, found = brute(texts[r.doc_id], bench)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
