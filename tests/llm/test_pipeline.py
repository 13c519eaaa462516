from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline as cp
from gridload.llm import mixing, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def frame(spark, rows):
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_keep_columns_and_clean_rows(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    lines = [text(12) for _ in range(5)]
    base = text(120)
    near = base.split()
    near[60] = "changed"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [
        (1, "\n".join([text(30), *lines, text(30)])),
        (2, "\n".join([text(30), *lines, text(30)])),
        (3, "\n".join(lines)),
        (10, base),
        (11, base),
        (12, " ".join(near)),
        (20, f"{text(60)} {item} {text(60)}"),
        (21, item),
        (30, None),
        (31, ""),
        (40, text(80)),
    ]
    docs = frame(spark, rows)
    after = {}
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, SF), name)
        assert docs.columns[: len(COLUMNS)] == COLUMNS
        after[name] = {r.doc_id: r for r in docs.collect()}
    assert set(after["toxicity"]) == {i for i, _ in rows}
    lines_left = after["line_dedup"]
    assert set(lines_left) == {i for i, _ in rows} - {3}
    assert lines_left[2].text.count("\n") == 1 and lines_left[2].n_chars == len(lines_left[2].text)
    assert lines_left[1].text == rows[0][1]
    dedup = after["simhash_near_dedup"]
    assert set(dedup) == set(lines_left) - {11, 12}  # rows without words stay
    clean = after["benchmark_decontamination"]
    assert set(clean) == set(dedup) - {21} and item not in clean[20].text and clean[40].text == rows[-1][1]
    assert set(after["mixing"]) == set(clean) and "slot" in docs.columns


def uncovered_lines(rows):
    """Texts without the lines of later occurrences of three-line windows, in id order."""
    seen, out = set(), {}
    for i in sorted(rows):
        ls = rows[i].split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            w = tuple(x.strip(" ") for x in ls[k : k + 3])
            if not "".join(w).strip():
                continue
            if w in seen:
                gone.update(range(k, k + 3))
            seen.add(w)
        text = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        if not gone or text.strip():
            out[i] = text
    return out


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def one_of_each(rows):
    sets, root, holders, shared = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}, {}, {}
    for i in sorted(rows):
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    for held in holders.values():
        for k, i in enumerate(held):
            for j in held[k + 1 :]:
                shared[i, j] = shared.get((i, j), 0) + 1

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in shared.items():
        if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: t for i, t in rows.items() if find(i) == i}


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def unhit_words(rows, items):
    """The words of every row outside item windows; rows with more than half of them hit go."""
    windows = set()
    for text in items:
        words = item_words(text)
        n = min(10, len(words))
        windows |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    out = {}
    for i, text in rows.items():
        words = item_words(text)
        hit = set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if len(hit) <= 0.5 * len(words):
            out[i] = ([w for k, w in enumerate(words) if k not in hit], bool(hit))
    return out


def slots(sources):
    """(slot, place) of every row: by the digest of the id within its source."""
    by = {}
    for i, s in sources.items():
        by.setdefault(s, []).append(i)
    parts = mixing.parts_of({s: len(ids) ** mixing.POWER for s, ids in by.items()})
    length = sum(parts.values())
    at = {(name, nth): slot for name, nth, slot in mixing.cycle_schedule(parts)}
    out = {}
    for s, ids in by.items():
        for r, i in enumerate(sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())):
            block = r // mixing.BLOCK_ROWS
            out[i] = (block // parts[s] * length + at[s, block % parts[s]], r % mixing.BLOCK_ROWS)
    return out


def test_run_row_by_row(spark):
    """Every stage again in plain Python, but for the scores of the fitted model."""
    table = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    given = {r.doc_id: r for r in table("documents").collect()}
    toxic = {r.doc_id: r.predicted for r in queries.all_queries()["op4_toxicity"](spark, SF).collect()}
    rows = {i: r.text for i, r in given.items() if not toxic[i]}
    cut = uncovered_lines(rows)
    clean = unhit_words(one_of_each(cut), [r.text for r in table("benchmark").collect()])
    out = cp.run(spark, SF)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(got) and set(got) == set(clean)
    assert len(rows) < len(given) and len(cut) > len(clean) and any(hit for _, hit in clean.values())
    for i, (words, hit) in clean.items():
        assert item_words(got[i].text) == words
        assert hit or got[i].text == cut[i]
        assert (got[i].lang, got[i].source, got[i].n_chars) == (given[i].lang, given[i].source, len(got[i].text))
    assert {i: (r.slot, r.place) for i, r in got.items()} == slots({i: given[i].source for i in got})


def test_equal_ids_clashing_columns_and_rows_without_words(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randrange(999)}" for _ in range(n))
    same = text(90)
    rows = [(3, text(90)), (3, text(90)), (4, same), (4, same), (None, same), (None, text(50)), (9, same)]
    rows += [(20 + k, t) for k, t in enumerate((None, None, "", " \n", None))]
    docs = frame(spark, rows)
    clashing = ["_before", "_toxicity", "_leaks", "lines_removed", "_order", "_cell", "_nth", "_source", "_here", "_all", "key", "node", "n", "all", "named", "slot"]
    docs = docs.withColumns({c: F.lit(7) for c in clashing})
    after = {}
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, SF), name)
        after[name] = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
        assert docs.columns[: len(COLUMNS)] == COLUMNS
        if name != "mixing":
            assert all(r[c] == 7 for r in docs.collect() for c in clashing)
    assert len(after["line_dedup"]) == len(rows)
    kept = [(i or 0, t) for k, (i, t) in enumerate(rows) if k in (0, 1, 2, 5)]
    assert after["simhash_near_dedup"] == sorted(kept + [(20 + k, t or "") for k, (_, t) in enumerate(rows[7:])])
    assert after["mixing"] == after["simhash_near_dedup"]


def test_empty_documents(spark):
    docs = frame(spark, [])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
