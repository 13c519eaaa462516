from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from gridload.llm import queries, repair

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, group string, at string, chunk int, size int"
GOAL = re.compile(r"(s?(ua)+)?\Z")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else ""
        out.append(fault or ("" if solid[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """All edit lists, up to two insertions in every place."""
    best = None
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    ways = []
    for (_, role, text), fault in zip(rows, bad, strict=True):
        own = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            own.append((more, "K", [(role, text)]))
            own += [(2 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        ways.append([(2 * len(i) + c, "I" * len(i) + e, [(r, "") for r in i] + out) for i in inserts for c, e, out in own])
    ways.append([(2 * len(i), "I" * len(i), [(r, "") for r in i]) for i in inserts])
    for choice in itertools.product(*ways):
        out = [line for _, _, lines in choice for line in lines]
        if GOAL.match("".join(r[:1] or "?" for r, _ in out)):
            key = (sum(c for c, _, _ in choice), "".join(e for _, e, _ in choice))
            if best is None or key < best[0]:
                best = key, out
    return best


def shortest(rows, bad):
    """The same by a plain search forward over (cost, audit, lines) per state of the automaton."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    after = lambda state: "a" if state == "u" else "u"
    name = {"u": "user", "a": "assistant"}

    def inserted(table):
        for _ in range(2):
            new = dict(table)
            for state, (cost, audit, out) in table.items():
                to = after(state)
                way = (cost + 2, audit + "I", [*out, (name[to], "")])
                new[to] = min(new.get(to, way), way, key=lambda w: w[:2])
            table = new
        return table

    table = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, bad, strict=True):
        new = {}

        def offer(state, way, new=new):
            new[state] = min(new.get(state, way), way, key=lambda w: w[:2])

        for state, (cost, audit, out) in inserted(table).items():
            offer(state, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            to = after(state)
            offer(to, (cost + 2 + more, audit + "R", [*out, (name[to], text)]))
            if (state, role[:1]) in step:
                offer(step[state, role[:1]], (cost + more, audit + "K", [*out, (role, text)]))
        table = new
    table = inserted(table)
    cost, audit, out = min((table[s] for s in ("", "a") if s in table), key=lambda w: w[:2])
    return (cost, audit), out


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def summary(rows, solve):
    rows = ordered(rows)
    bad = faults(rows)
    (cost, audit), out = solve(rows, bad)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (gaps, *[bad.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest(out))


def found(spark, rows, **options):
    full = [(*r, "g", "x", 1, 2) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    edits, counts = repair.repair(df, **options)
    both = counts.join(repair.told(edits), "group").collect()
    return {None if r["group"] == "-" else int(r["group"][1:]): tuple(r[c] for c in COLUMNS[1:]) for r in both}


def conversations(seed, count, most):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", "  \n", "Why?", "Why?", "so it goes", "End! ", "x.\t"]
    roles = ["user", "assistant", "system", "user", "assistant", "unknown", "", "tool", "User"]
    return [
        (c, i if rng.random() < 0.9 else None, rng.choice(roles), f"{rng.choice(texts)}")
        for c in range(count)
        for i in range(rng.randint(1, most))
    ]


@pytest.mark.parametrize("chunk", [1, 2, 1024])
def test_all_edit_lists(spark, chunk):
    rows = conversations(3, 60, 4)
    want = {c: summary([r[1:] for r in rows if r[0] == c], cheapest) for c in {r[0] for r in rows}}
    assert found(spark, rows, chunk=chunk) == want


@pytest.mark.parametrize("chunk", [3, 7, 1024])
def test_longer_conversations(spark, chunk):
    rows = conversations(4, 40, 40)
    rows = [(c, t, r, x if x.strip() == "" else f"{k % 7}{x}") for k, (c, t, r, x) in enumerate(rows)]
    want = {c: summary([r[1:] for r in rows if r[0] == c], shortest) for c in {r[0] for r in rows}}
    assert found(spark, rows, chunk=chunk) == want


def test_a_long_conversation_null_ids_and_long_texts(spark):
    rng = random.Random(9)
    roles = ["user", "assistant", "user", "assistant", "system"]
    rows = [(None, i, rng.choice(roles), f"row {i}{rng.choice(['.', ''])}") for i in range(3000)]
    rows += [(7, 1, "user", "word " * 200_000 + "end."), (7, 2, None, "Hm."), (7, 3, "assistant", None)]
    plain = [(c, t, r or " ", x or " ") for c, t, r, x in rows]
    want = {c: summary([r[1:] for r in plain if r[0] == c], shortest) for c in (None, 7)}
    assert found(spark, rows) == want


def test_edits_are_the_rows(spark):
    rows = [(1, 5, "user", "Hi."), (1, 5, "user", "Hi."), (1, 8, "user", "more"), (2, 1, "system", "Be kind.")]
    edits, _ = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [tuple(r)[3:] for r in edits.orderBy("group", "chunk", "nth").collect()]
    assert got == [("K", 0, "user", "Hi."), ("D", 1, None, None), ("R", 2, "assistant", "more"), ("D", 0, None, None)]


def damaged(rows):
    out = []
    told = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        key = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        if key == 1:
            text = ""
        if key == 2:
            text = re.sub("[.!?]", "", text)
        row = (conv, turn, "user" if key == 4 else role, text)
        out += [row] * (0 if key == 0 else 2 if key == 3 else 1)
    return out


def check_query(spark, sf_dir, rows):
    hit = {}
    for row in damaged(rows):
        hit.setdefault(row[0], []).append(row[1:])
    none = (0, 0, 0, 0, 0, 0, "", digest([]))
    want = {c: summary(hit[c], shortest) if c in hit else none for c in {r[0] for r in rows}}
    df = queries.all_queries()["op12_repair"](spark, sf_dir)
    assert df.columns == COLUMNS
    assert [t for _, t in df.dtypes[1:7]] == ["bigint"] * 6
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == want
    return want


def test_query_against_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_query(spark, SF, rows)


def test_query_with_nulls_and_without_rows(spark, tmp_path):
    gone = next(c for c in range(10, 999) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "A."), (None, 1, "user", "A."), (None, None, None, None), (4, None, "user", "B"), (4, 2, "assistant", None), (5, 11, "user", "Q?")]
    for k, part in enumerate((rows, [])):
        df = spark.createDataFrame([(*r, 1) for r in part], "conv_id long, turn long, role string, text string, size int")
        df.write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        want = check_query(spark, f"{tmp_path}/{k}", part)
        assert not part or want[gone] == (0, 0, 0, 0, 0, 0, "", digest([]))
