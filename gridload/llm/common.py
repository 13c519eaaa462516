"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from gridload.session import written

HELD_OUT = 1
#: rows of one result batch of ``sorted_groups``
_RESULT_ROWS = 2048


def fold(doc_id: Column) -> Column:
    """``crc32`` of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """True where labels may not be learned from; false for a null id."""
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def for_learning(doc_id: Column) -> Column:
    """True where labels may be learned from; false for a null id."""
    return F.coalesce(fold(doc_id) != HELD_OUT, F.lit(False))


def per_text(
    make: Callable[[], Callable[[list[str]], list]], returns: T.DataType | str
) -> Callable[[Column], Column]:
    """Column function that maps batches of texts in Python.

    ``make`` runs once per task and gives a function from a list of texts to a list of
    results. Only the text goes to Python, and once: Spark keeps the other columns and
    neither repeats nor moves the call.
    """
    kind = to_arrow_type(_parse_datatype_string(returns) if isinstance(returns, str) else returns)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for batch in batches:
            yield pa.array(fn(["" if t is None else t for t in batch.to_pylist()]), kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, returns).asNondeterministic()
    return lambda text: udf(text.cast("string"))


def numbered(rows: DataFrame, group: str, order: list[str], name: str, size: str) -> DataFrame:
    """Add each row's place (from 0) in ``order`` within its ``group``, and the group's size.

    ``group`` holds no nulls. ``order`` should end in a column that tells equal rows apart:
    a range shuffle over it cuts groups of any size into even pieces, pieces are counted per
    group, and only a piece is ranked in a task.
    """
    pieces = written(
        rows.repartitionByRange(group, *order).withColumn("_piece", F.spark_partition_id()), "pieces"
    )
    counts = pieces.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_here"))
    whole = Window.partitionBy(group)
    starts = counts.select(
        group,
        "_piece",
        (F.sum("_here").over(whole.orderBy("_piece")) - F.col("_here")).alias("_start"),
        F.sum("_here").over(whole).alias(size),
    )
    inside = Window.partitionBy(group, "_piece").orderBy(*order)
    ranked = pieces.withColumn("_rank", F.row_number().over(inside) - 1)
    placed = ranked.join(starts, [group, "_piece"]).withColumn(name, F.col("_start") + F.col("_rank"))
    return placed.drop("_piece", "_start", "_rank")


def sorted_groups(
    rows: DataFrame, cell: list[str], order: list[str], make: Callable[[], Callable], returns: str
) -> DataFrame:
    """Stream rows to Python group by group, each group whole in one task and in ``order``.

    ``make`` runs once per task and gives a function from an iterator of
    (group key, iterator of row tuples) to an iterator of result tuples. A group is never
    gathered: memory is that of an Arrow batch and whatever the function keeps.
    """
    names = rows.columns
    places = [names.index(c) for c in cell]
    schema = _parse_datatype_string(returns)
    kind = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        groups = itertools.groupby(lines, key=lambda row: tuple(row[i] for i in places))
        found = make()(groups)
        while some := list(itertools.islice(found, _RESULT_ROWS)):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kind, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    dealt = rows.repartition(*cell).sortWithinPartitions(*cell, *order)
    return dealt.mapInArrow(run, schema)
