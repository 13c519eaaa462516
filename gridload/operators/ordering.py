"""Row positions, trailing windows and running totals without whole-series tasks.

A plain ``Window.partitionBy("series")`` puts every row of a series into one task, so
one hot series stalls the job. Everything here works on bounded pieces instead:

* ``add_position`` numbers rows exactly from per-bucket counts plus an in-bucket rank,
  ``global_position`` does so for a whole table;
* ``with_series_windows`` cuts each series into chunks of ``chunk_rows`` rows, lends
  every chunk the last rows of the one before it (the halo), and evaluates any number
  of trailing-window columns in one pass;
* ``running_totals`` is an exact cumulative sum over an ordered column.

``(series, ts)`` is the key of every series table; neither column may be null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridload.session import durable

_BUCKET, _COUNT, _OFFSET, _RANK = "_bucket", "_bucket_rows", "_bucket_offset", "_bucket_rank"
_POSITION, _CHUNK, _HOME, _SPLITS = "_position", "_chunk", "_home", "_splits"


@dataclass(frozen=True)
class SeriesLayout:
    """How a long table is ordered and cut.

    ``span_hours`` is the width of the time buckets used for numbering rows and
    ``chunk_rows`` the size of the pieces windows run on. ``chunk_rows=None`` keeps
    each series in one piece: one shuffle less, for tables whose series are known
    to be short.
    """

    keys: tuple[str, ...] = ("series",)
    time: str = "ts"
    span_hours: float = 24 * 366
    chunk_rows: int | None = 131_072

    def with_keys(self, *keys: str) -> SeriesLayout:
        return replace(self, keys=keys)


DEFAULT_LAYOUT = SeriesLayout()


def time_bucket(time: str | Column, span_hours: float) -> Column:
    """Number of the ``span_hours``-wide slot a timestamp falls in."""
    ts = F.col(time) if isinstance(time, str) else time
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    return F.floor(seconds / F.lit(int(span_hours * 3600))).cast("bigint")


def add_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row in ``order`` within ``keys``.

    ``bucket`` must not decrease along ``order``. Rows are ranked inside their
    bucket; the offset of a bucket is the row count of the buckets before it, taken
    from a table with one row per bucket. ``total`` adds the group's row count.
    """
    bucketed = df.withColumn(_BUCKET, bucket)
    cell = [*keys, _BUCKET]
    counts = bucketed.groupBy(*cell).agg(F.count(F.lit(1)).alias(_COUNT))
    along = Window.partitionBy(*keys).orderBy(_BUCKET)
    offset_columns = [(F.sum(_COUNT).over(along) - F.col(_COUNT)).alias(_OFFSET)]
    if total:
        offset_columns.append(F.sum(_COUNT).over(Window.partitionBy(*keys)).alias(total))
    offsets = counts.select(*cell, *offset_columns)
    ranked = bucketed.withColumn(
        _RANK, F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    )
    return (
        ranked.join(offsets, cell)
        .withColumn(name, F.col(_OFFSET) + F.col(_RANK) - 1)
        .drop(_BUCKET, _OFFSET, _RANK)
    )


def global_position(
    df: DataFrame, order: Sequence[str], name: str = "position", total: str | None = None
) -> DataFrame:
    """0-based position of each row of the table in the order of unique ``order`` columns.

    A range shuffle over all order columns gives balanced, sorted pieces whatever the
    values look like; its outcome is checkpointed so that piece numbers stay put.
    """
    pieces = durable(
        df.repartitionByRange(*order).withColumn(_BUCKET, F.spark_partition_id())
    )
    counts = pieces.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias(_COUNT))
    # one row per shuffle partition from here on
    running = F.sum(_COUNT).over(Window.partitionBy().orderBy(_BUCKET))
    columns = [(running - F.col(_COUNT)).alias(_OFFSET)]
    if total:
        columns.append(F.sum(_COUNT).over(Window.partitionBy()).alias(total))
    offsets = counts.select(_BUCKET, *columns)
    inside = Window.partitionBy(_BUCKET).orderBy(*order)
    ranked = pieces.withColumn(_RANK, F.row_number().over(inside))
    return (
        ranked.join(offsets, _BUCKET)
        .withColumn(name, F.col(_OFFSET) + F.col(_RANK) - 1)
        .drop(_BUCKET, _OFFSET, _RANK)
    )


def time_position(
    df: DataFrame,
    layout: SeriesLayout = DEFAULT_LAYOUT,
    name: str = "position",
    total: str | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Position of each row in time order within the layout's keys.

    Without keys the whole table is one sequence, in which a single timestamp may hold
    any number of rows; see ``global_position``.
    """
    if not layout.keys:
        return global_position(df, [layout.time, *ties], name, total)
    return add_position(
        df,
        layout.keys,
        [layout.time, *ties],
        time_bucket(layout.time, layout.span_hours),
        name,
        total,
    )


@dataclass(frozen=True)
class SeriesWindows:
    """Window specifications handed to the column builder of ``with_series_windows``."""

    partition: tuple[str, ...]
    order: str

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(self.order)

    def trailing(self, rows: int) -> WindowSpec:
        return self.ordered().rowsBetween(-(rows - 1), 0)


@dataclass(frozen=True)
class TrailingQuantiles:
    """Exact interpolated quantiles of full trailing frames.

    ``wanted`` maps an output name to (column, probability, rows). Spark evaluates a
    collecting window function anew for every row; here each sorted chunk goes through
    an incremental rolling quantile in one Arrow batch instead, so the cost per row
    hardly grows with the frame. Frames with missing values give null.
    """

    wanted: dict[str, tuple[str, float, int]]

    def apply(self, df: DataFrame, windows: SeriesWindows) -> DataFrame:
        wanted, order = dict(self.wanted), windows.order
        kept = df.drop(*[c for c in wanted if c in df.columns])
        fields = [T.StructField(name, T.DoubleType()) for name in wanted]
        schema = T.StructType([*kept.schema.fields, *fields])

        def rolling(chunk: pa.Table) -> pa.Table:
            chunk = chunk.sort_by(order)
            for name, (column, prob, rows) in wanted.items():
                values = pc.cast(chunk[column], pa.float64()).to_numpy()
                found = pd.Series(values).rolling(rows).quantile(prob)
                chunk = chunk.append_column(name, pa.array(found, pa.float64(), from_pandas=True))
            return chunk

        return kept.groupBy(*windows.partition).applyInArrow(rolling, schema)


Stage = Callable[[SeriesWindows], dict[str, Column]] | TrailingQuantiles


def _evaluate(df: DataFrame, windows: SeriesWindows, stages: Sequence[Stage]) -> DataFrame:
    for stage in stages:
        if isinstance(stage, TrailingQuantiles):
            df = stage.apply(df, windows)
        else:
            df = df.withColumns(stage(windows))
    return df


def number_rows(df: DataFrame, layout: SeriesLayout = DEFAULT_LAYOUT) -> DataFrame:
    """Attach row positions for several window passes to share.

    Later ``with_series_windows`` calls on the result skip the numbering and keep the
    ``_position`` column; valid as long as no row is added or removed in between.
    """
    return time_position(df, layout, _POSITION)


def drop_numbers(df: DataFrame) -> DataFrame:
    return df.drop(_POSITION)


def with_series_windows(
    df: DataFrame,
    halo: int,
    stages: Stage | Sequence[Stage],
    layout: SeriesLayout = DEFAULT_LAYOUT,
) -> DataFrame:
    """Add window columns that look back at most ``halo`` rows.

    All columns of all stages share one partitioning and sort order, so the whole set
    costs one window pass (a second ``TrailingQuantiles`` stage shuffles again; put
    window columns before the first). A later stage may read columns of an earlier one;
    ``halo`` is then the sum of the stages' look-backs.
    """
    stages = list(stages) if isinstance(stages, list | tuple) else [stages]
    if layout.chunk_rows is None:
        return _evaluate(df, SeriesWindows(layout.keys, layout.time), stages)
    size = layout.chunk_rows
    numbered = _POSITION in df.columns
    cut = df if numbered else number_rows(df, layout)
    home = F.floor(F.col(_POSITION) / size)
    last = F.floor((F.col(_POSITION) + halo) / size)  # a look-back may span several chunks
    cut = cut.withColumn(_HOME, home).withColumn(_CHUNK, F.explode(F.sequence(home, last)))
    spec = SeriesWindows((*layout.keys, _CHUNK), _POSITION)
    cut = _evaluate(cut, spec, stages)
    extra = [_CHUNK, _HOME] + ([] if numbered else [_POSITION])
    return cut.filter(F.col(_CHUNK) == F.col(_HOME)).drop(*extra)


def split_index(splits: Column, value: Column, buckets: int) -> Column:
    """How many of the sorted ``splits`` are below ``value`` (binary search)."""
    steps = []
    step = 1
    while step <= buckets:
        steps.append(step)
        step *= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda found, jump: F.when(
            F.coalesce(F.get(splits, found + jump - 1) < value, F.lit(False)), found + jump
        ).otherwise(found),
    )


def range_count(df: DataFrame) -> int:
    """Value ranges to cut an ordering into: follows the session's shuffle width."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(max(2 * width, 32), 8192)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    descending: bool = False,
    buckets: int | None = None,
    split_keys: Sequence[str] = (),
    split_rows: int = 1,
    keep_bucket: Callable[[], Column] | None = None,
) -> DataFrame:
    """Cumulative sums along ``order`` within ``keys``, one row per (keys, order).

    Adds ``cum_<s>`` (this row included) and ``total_<s>`` for each name in ``sums``.
    The order column is cut at approximate quantiles into ``buckets`` ranges; range
    totals give each range its starting value, so only one range is ever sorted in a
    task and the result is exact wherever the cuts fall. ``split_keys`` (a subset of
    ``keys`` with at most ``split_rows`` distinct values) get cuts of their own.
    ``keep_bucket`` may skip ranges: a predicate over ``_before_<s>``, ``_here_<s>``
    and ``total_<s>``.
    """
    buckets = buckets or range_count(df)
    fractions = F.expr("array(" + ", ".join(f"{i / buckets!r}D" for i in range(1, buckets)) + ")")
    # Every branch below filters and reads the same columns, so that Spark runs the
    # shuffle behind ``df`` once and reuses it; hence the explicit null filters and
    # the otherwise idle maxima.
    df = df.select(*keys, order, *sums)
    for column in (*keys, order):
        df = df.filter(F.col(column).isNotNull())
    cuts = (
        df.groupBy(*split_keys)
        .agg(
            F.percentile_approx(order, fractions, 10 * buckets).alias(_SPLITS),
            *[F.max(s).alias(f"_max_{s}") for s in sums],
        )
        .filter(" and ".join(f"_max_{s} is not null" for s in sums))
        .select(*split_keys, _SPLITS)
    )
    if split_keys:
        # cut tables are at most split_rows * buckets doubles: hint only below 64 MB
        small = split_rows * buckets * 8 <= 64 * 1024 * 1024
        located = df.join(F.broadcast(cuts) if small else cuts, list(split_keys))
    else:
        located = df.withColumn(_SPLITS, cuts.scalar())
    located = located.withColumn(
        _BUCKET, split_index(F.col(_SPLITS), F.col(order), buckets)
    ).drop(_SPLITS)

    cell = [*keys, _BUCKET]
    by_range = located.groupBy(*cell).agg(*[F.sum(s).alias(f"_here_{s}") for s in sums])
    rank = F.desc(_BUCKET) if descending else F.asc(_BUCKET)
    along = Window.partitionBy(*keys).orderBy(rank)
    whole = Window.partitionBy(*keys)
    for s in sums:
        by_range = by_range.withColumn(
            f"_before_{s}", F.sum(f"_here_{s}").over(along) - F.col(f"_here_{s}")
        ).withColumn(f"total_{s}", F.sum(f"_here_{s}").over(whole))
    if keep_bucket is not None:
        by_range = by_range.filter(keep_bucket())
    by_range = by_range.drop(*[f"_here_{s}" for s in sums])
    inside = (
        Window.partitionBy(*cell)
        .orderBy(F.desc(order) if descending else F.asc(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    # without keys the range table has at most `buckets` rows
    joined = located.join(F.broadcast(by_range) if not keys else by_range, cell)
    return joined.withColumns(
        {f"cum_{s}": F.col(f"_before_{s}") + F.sum(s).over(inside) for s in sums}
    ).drop(_BUCKET, *[f"_before_{s}" for s in sums])
