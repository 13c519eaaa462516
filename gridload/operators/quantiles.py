"""Exact, linearly interpolated quantiles of groups of any size."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.operators.ordering import running_totals
from gridload.session import discard, durable

COLUMN, VALUE, PROB = "column", "value", "prob"
#: evenly spaced quantiles a sketch gives; fewer with keys, where there are many sketches
POINTS, KEYED_POINTS = 1000, 128
#: bytes of brackets that may be broadcast
SMALL = 64 * 1024 * 1024


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, value) rows, one per cell; values become doubles."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias(COLUMN), F.col(c).cast("double").alias(VALUE))
            for c in columns
        ]
    )
    return df.select(*keys, F.explode(cells).alias("_cell")).select(
        *keys, f"_cell.{COLUMN}", f"_cell.{VALUE}"
    )


def interpolate(low: Column, high: Column, fraction: Column) -> Column:
    return F.when(low == high, low).otherwise(low + (high - low) * fraction)


def _rank_pairs(total: str, probs: Sequence[float]) -> list[tuple[Column, Column, Column]]:
    """Per probability: the two 0-based ranks around it, and the way between them."""
    pairs = []
    for p in probs:
        h = (F.col(total) - 1) * F.lit(float(p))
        pairs.append((F.floor(h), F.ceil(h), h - F.floor(h)))
    return pairs


def _pick(ranked: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(group, prob, value) from rows with ``_first`` and ``_last`` rank and ``_total``."""
    picks = []
    for i, (low, high, part) in enumerate(_rank_pairs("_total", probs)):
        for name, rank in (("low", low), ("high", high)):
            holds = rank.between(F.col("_first"), F.col("_last"))
            picks.append(F.max(F.when(holds, F.col(VALUE))).alias(f"_{name}{i}"))
        picks.append(F.max(part).alias(f"_part{i}"))
    picked = ranked.groupBy(*group).agg(*picks)
    cells = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias(PROB),
                interpolate(
                    F.col(f"_low{i}"), F.col(f"_high{i}"), F.col(f"_part{i}")
                ).alias(VALUE),
            )
            for i, p in enumerate(probs)
        ]
    )
    return picked.select(*group, F.explode(cells).alias("_q")).select(
        *group, f"_q.{PROB}", f"_q.{VALUE}"
    )


def _collapsed(cells: DataFrame, group: Sequence[str]) -> DataFrame:
    return cells.groupBy(*group, VALUE).agg(F.count(F.lit(1)).alias("n"))


def sketch_brackets(
    cells: DataFrame, group: Sequence[str], probs: Sequence[float], points: int
) -> DataFrame:
    """(group, _lo0, _hi0, _lo1, ...): where each quantile lies, most likely.

    Sketches are merged in two levels: first those of some of the input partitions, into
    ``points`` evenly spaced quantiles; then these bounded lists, weighted by their rows.
    """
    width = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    salts = math.isqrt(max(width, 1)) + 1
    accuracy = 10 * points
    grid = F.expr("array(" + ", ".join(f"{i / points!r}D" for i in range(points + 1)) + ")")
    part = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_part")
    lists = (
        cells.select(*group, VALUE, part)
        .groupBy(*group, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(VALUE, grid, accuracy).alias("_at"))
        .select(*group, "_n", F.explode("_at").alias("_point"))
    )
    slack = 1.5 / points + 2 / accuracy
    edges = [min(max(p + side, 0.0), 1.0) for p in probs for side in (-slack, slack)]
    found = lists.groupBy(*group).agg(
        F.percentile("_point", edges, F.col("_n")).alias("_edge")
    )
    bounds = []
    for i, p in enumerate(probs):
        low, high = F.get("_edge", F.lit(2 * i)), F.get("_edge", F.lit(2 * i + 1))
        bounds.append((low if p > slack else F.lit(float("-inf"))).alias(f"_lo{i}"))
        bounds.append((high if p < 1 - slack else F.lit(float("inf"))).alias(f"_hi{i}"))
    return found.select(*group, *bounds)


def _inside(i: int) -> Column:
    return F.col(VALUE).between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))


def _inside_any(probs: Sequence[float]) -> Column:
    return functools.reduce(Column.__or__, [_inside(i) for i in range(len(probs))])


def checked_brackets(
    cells: DataFrame, group: Sequence[str], probs: Sequence[float], brackets: DataFrame
) -> DataFrame:
    """Brackets that are sure to hold their quantiles, with exact counts.

    Adds ``_total`` (values of the group) and ``_out<i>`` (values in no bracket below
    bracket ``i``). A group in which a wanted rank lies outside its bracket, which small
    groups may have, gets brackets without limits instead.
    """
    value = F.col(VALUE)
    counts = [F.count(F.lit(1)).alias("_total")]
    for i in range(len(probs)):
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        counts += [
            F.count_if(value < low).alias(f"_below{i}"),
            F.count_if(value <= high).alias(f"_upto{i}"),
            F.count_if((value < low) & ~_inside_any(probs)).alias(f"_out{i}"),
        ]
    counted = cells.join(brackets, group).groupBy(*group).agg(*counts)
    sure = F.lit(True)
    for i, (low, high, _) in enumerate(_rank_pairs("_total", probs)):
        sure = sure & (F.col(f"_below{i}") <= low) & (high < F.col(f"_upto{i}"))
    limits = [F.col(c) for c in (*group, "_total")]
    for i in range(len(probs)):
        limits += [
            F.when(sure, F.col(f"_lo{i}")).otherwise(F.lit(float("-inf"))).alias(f"_lo{i}"),
            F.when(sure, F.col(f"_hi{i}")).otherwise(F.lit(float("inf"))).alias(f"_hi{i}"),
            F.when(sure, F.col(f"_out{i}")).otherwise(F.lit(0)).alias(f"_out{i}"),
        ]
    return counted.join(brackets, group).select(*limits)


def _fits(brackets: DataFrame, group: Sequence[str], probs: Sequence[float]) -> bool:
    """Whether a written table of brackets, once it has its counts, is small enough to
    send to every task: measured from its rows and the length of its keys."""
    width = sum((F.octet_length(F.col(c).cast("string")) + 32 for c in group), F.lit(0))
    size = brackets.agg(F.sum(width + F.lit(8 + 48 * len(probs))).alias("s")).first()["s"]
    return (size or 0) <= SMALL


def _local(brackets: DataFrame) -> DataFrame:
    """Brackets without keys, one row per column of the request, by way of the driver."""
    return brackets.sparkSession.createDataFrame(brackets.collect(), brackets.schema)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    buckets: int | None = None,
) -> DataFrame:
    """(keys, column, prob, value): exact quantiles, nulls and NaN ignored.

    A sketch names a narrow bracket of values for each quantile, a second scan counts
    what lies below and beside it, and only the values within brackets are shuffled and
    ranked. The table is read three times; what crosses the network is sketches, counts
    and about ``3 / points`` of the values per probability. With more groups than a
    broadcast holds, all distinct values are ranked instead. No group is ever gathered
    in one task. Rows with a null key take no part.
    """
    group = [*keys, COLUMN]
    cells = melt(df, keys, columns).filter(F.col(VALUE).isNotNull() & ~F.isnan(VALUE))
    for key in keys:
        cells = cells.filter(F.col(key).isNotNull())
    if keys:
        brackets = durable(sketch_brackets(cells, group, probs, KEYED_POINTS))
        if not _fits(brackets, group, probs):
            discard(brackets)
            return _quantiles_of_all(cells, group, columns, probs, buckets)
        limits = durable(checked_brackets(cells, group, probs, F.broadcast(brackets)))
        discard(brackets)
    else:
        brackets = _local(sketch_brackets(cells, group, probs, POINTS))
        limits = _local(checked_brackets(cells, group, probs, F.broadcast(brackets)))
    inside = _collapsed(cells.join(F.broadcast(limits), group).filter(_inside_any(probs)), group)
    ranked = running_totals(
        inside, group, VALUE, ["n"], buckets=buckets, split_keys=[COLUMN], split_rows=len(columns)
    ).join(F.broadcast(limits), group)
    out = F.coalesce(*[F.when(_inside(i), F.col(f"_out{i}")) for i in range(len(probs))])
    ranked = ranked.withColumns(
        {"_first": F.col("cum_n") - F.col("n") + out, "_last": F.col("cum_n") - 1 + out}
    )
    return _pick(ranked, group, probs)


def _quantiles_of_all(
    cells: DataFrame,
    group: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    buckets: int | None,
) -> DataFrame:
    """Equal values are collapsed, cut into ranges, and only the ranges that hold a
    wanted rank are ranked."""

    def holds_wanted_rank() -> Column:
        wanted = F.lit(False)
        first, last = F.col("_before_n"), F.col("_before_n") + F.col("_here_n") - 1
        for low, high, _ in _rank_pairs("total_n", probs):
            wanted = wanted | low.between(first, last) | high.between(first, last)
        return wanted

    ranked = running_totals(
        _collapsed(cells, group),
        group,
        VALUE,
        ["n"],
        buckets=buckets,
        split_keys=[COLUMN],
        split_rows=len(columns),
        keep_bucket=holds_wanted_rank,
    )
    ranked = ranked.withColumns(
        {
            "_first": F.col("cum_n") - F.col("n"),
            "_last": F.col("cum_n") - 1,
            "_total": F.col("total_n"),
        }
    )
    return _pick(ranked, group, probs)


def quantile_columns(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[str, float]],
    buckets: int | None = None,
) -> DataFrame:
    """One row per group with a column per wanted ``name: (column, prob)``."""
    columns = sorted({c for c, _ in wanted.values()})
    probs = sorted({p for _, p in wanted.values()})
    cells = quantiles(df, keys, columns, probs, buckets)
    return cells.groupBy(*keys).agg(
        *[
            F.max(
                F.when((F.col(COLUMN) == c) & (F.col(PROB) == float(p)), F.col(VALUE))
            ).alias(name)
            for name, (c, p) in wanted.items()
        ]
    )
