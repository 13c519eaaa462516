from __future__ import annotations

import zlib

from gridload.llm import language, queries


def brute_phrases(text, train, lane):
    norm = lambda t: " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split(" "))
    squeeze = lambda t: "".join(c for i, c in enumerate(t) if c != " " or (i and t[i - 1] != " "))
    text, train = squeeze(norm(text)), squeeze(norm(train))
    count = 0
    for a in range(0, len(text), lane):
        rest = text[a : a + lane]
        while rest:
            n = 1
            while n < len(rest) and rest[: n + 1] in train:
                n += 1
            n = n if rest[:n] in train else 1
            count, rest = count + 1, rest[n:]
    return count


def test_phrases_match_brute_force():
    train = {"x": ["abra cadabra, Ébène!", "bracket"], "y": ["12 dog's day", "zebra"]}
    parser = language.CrossParser(list(train.items()))
    texts = ["", "Abracadabra; dog", "  ---  ", "ébène zebra 日本 day", "cab " * 700, "A", "日", "!a"]
    got, _, letters = parser.phrases(texts)
    for t, row in zip(texts, got.tolist(), strict=True):
        assert row == [brute_phrases(t, "\n".join(ts), language.LANE) for ts in train.values()], t
    assert (letters > 0).tolist() == [any(c.isalpha() for c in t) for t in texts]


ROWS = [(i, f"the quick brown fox number {i} jumps over the lazy dog", "en") for i in range(20)]
ROWS += [(100 + i, f"der schnelle braune Fuchs {i} springt über den faulen Hund", "de") for i in range(10)]
EXTRA = [(200, None, "en"), (201, "", None), (202, "123 !?", "de"), (203, "über den Hund " * 9000, None)]
EXTRA += [(None, "the lazy dog", "xx"), (204, "the lazy dog", None), (204, "the lazy dog", None)]


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS + EXTRA, "doc_id long, text string, lang string")
    samples = language.learn(docs)
    assert [lang for lang, _ in samples] == ["en", "de"]
    got = [(r.doc_id, r.language.lang, r.language.score) for r in language.predict(docs, samples).collect()]
    assert len(got) == len(ROWS + EXTRA) and all(0 <= s <= 1 for _, _, s in got)
    by_id = {i: lang for i, lang, _ in got}
    assert all(by_id[i] == lang for i, _, lang in ROWS)
    assert [by_id[i] for i in (200, 201, 202, 203, 204, None)] == ["und", "und", "und", "de", "en", "en"]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert language.learn(docs) == [] and language.learn(docs.limit(0)) == []
    assert language.predict(docs, []).first().language.lang == "und"


def test_query_is_accurate_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    want = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.all_queries()["op8_language"](spark, sf_dir).collect()
    assert len(got) == len(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and any(c.isalpha() for c in want[r.doc_id].text or "")]
    right = sum(r.lang_pred == want[r.doc_id].lang for r in held)
    assert right / len(held) > 0.97, right / len(held)
