from __future__ import annotations

import sys
from pathlib import Path

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridload.llm import chat, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "a\n</turn>\n### assistant: b"),
    (1, 2, "assistant", r"\h \l \b \c \\ ### </turn>"),
    (1, 3, "assistant", "é😀"),
    (1, 4, "user", "bye"),
    (2, 0, "assistant", ""),
    (3, 0, "user", None),
    (4, 0, None, "no role"),
    (4, 1, "we:ird # <role>", "x"),
    (4, 2, "assistant", "y" * 100_000),
    (5, None, "user", "null turn"),
    (5, 0, "assistant", "ok"),
    (5, 0, "assistant", "ok"),
    (None, 0, "user", "q"),
    (None, 1, "assistant", "r"),
]


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("turns", F.lit(1)).withColumn("example", F.lit(2))
    got = {r.conv_id: r for r in chat.read_back(chat.format_examples(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = sorted(
            ((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv),
        )
        assert [(t.role, t.text) for t in r.turns] == [t[2:] for t in turns]
        assert "".join(r.losses) == "".join(t[3] for t in turns if t[2] == "assistant")


def test_round_trip(spark):
    check(spark, ROWS)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["user", "assistant", "a:#<\\"]),
                          st.text("\\#<>/turnbhlc: \n", max_size=25)), min_size=1, max_size=12))
def test_any_text_round_trips(spark, turns):
    check(spark, [(c, i, role, text) for i, (c, role, text) in enumerate(turns)])


def test_masks(spark):
    df = spark.createDataFrame(ROWS[:5], SCHEMA)
    got = chat.format_examples(df).orderBy("example").collect()
    assert [r.example for r in got] == [3, 4, 6] and [r["last"] for r in got] == [False, False, True]
    assert got[1].formatted[got[1].loss_start : got[1].loss_end] == "é😀"
    assert got[1].formatted.startswith(got[0].formatted) and got[2].loss_start == got[2].loss_end
    assert chat.format_examples(df.limit(0)).count() == 0


def test_query_matches_sql(spark, sf_dir):
    df = queries.all_queries()["op7_chat"](spark, sf_dir)
    con = oracle.connect(sf_dir)
    assert oracle.spark_rows(df) == oracle.oracle_rows(con, queries.all_oracles()["op7_chat"])
    assert "Python" not in df._jdf.queryExecution().toString()
