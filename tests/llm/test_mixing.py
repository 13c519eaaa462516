from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridload.llm import mixing, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402


@pytest.mark.parametrize(
    "parts", [{"a": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 900, "b": 99, "c": 1}, {f"s{i}": i * i + 1 for i in range(20)}]
)
def test_less_than_one_block_from_target_in_every_slot(parts):
    length, done = sum(parts.values()), dict.fromkeys(parts, 0)
    for name, nth, slot in mixing.cycle_schedule(parts):
        assert nth == done[name]
        assert nth * length // parts[name] <= slot < -(-(nth + 1) * length // parts[name])
        done[name] += 1
        assert all(abs(done[n] * length - (slot + 1) * k) < length for n, k in parts.items())
    assert done == parts


def test_every_row_once_in_its_slot(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "t") for i in range(3000)]
    rows += [(None, None, None)] * 3 + [(5, "s1", "t"), (5, "s1", "t"), (9, "unlisted", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("slot", F.lit("x"))
    weights = {"hot": 2.0, **{f"s{i}": 1.0 for i in range(7)}, "absent": 1.0}
    got = mixing.mix(docs, weights, parts=50, block_rows=4, cell_rows=100)
    assert got.columns == ["doc_id", "source", "text", "slot", "block", "release", "deadline", "place"]
    out = got.collect()
    assert sorted((tuple(r)[:3] for r in out), key=repr) == sorted(rows, key=repr)
    places = {(r.source, r.block, r.place) for r in out}
    assert len(places) == len(rows)
    owner = {}
    for r in out:
        assert r.release <= r.slot < r.deadline and 0 <= r.place < 4
        assert owner.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    for name in {r.source for r in out}:
        nth = sorted((r.block - 1) * 4 + r.place for r in out if r.source == name)
        assert nth == list(range(len(nth)))


def test_cells_do_not_change_the_result(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"))
    one = mixing.mix(docs).collect()
    many = mixing.mix(docs, cell_rows=20).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_empty_and_order(spark):
    docs = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix(docs).count() == 0
    docs = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    out = [(r.slot, r.place) for r in mixing.mixed(docs).collect()]
    assert out == sorted(out)


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    df = queries.all_queries()["op9_mixing"](spark, sf_dir)
    con = oracle.connect(sf_dir)
    assert oracle.spark_rows(df) == oracle.oracle_rows(con, queries.all_oracles()["op9_mixing"])


def test_rows_without_id_are_dealt_to_cells(spark):
    """A third of the rows without id: first in their source, in many cells, same numbers."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("hot").alias("source"),
        F.col("id").cast("string").alias("text"),
    )
    one, many = mixing.mix(docs).collect(), mixing.mix(docs, cell_rows=20).collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, many), key=repr)
    first = sorted(one, key=lambda r: (r.block, r.place))[:1000]
    assert all(r.doc_id is None for r in first)
    order = F.coalesce(mixing.order_key("doc_id", None), mixing.spread_key(docs))
    keyed = docs.select("source", order.alias("_order")).withColumnRenamed("source", "_source")
    assert keyed.filter(F.startswith("_order", F.lit("!"))).select(F.substring("_order", 1, 3)).distinct().count() > 200
    assert mixing.numbered(keyed, 3000, 20).agg(F.max("_nth"), F.count_distinct("_nth")).first()[:] == (2999, 3000)
