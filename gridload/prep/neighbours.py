"""Exact k-nearest-neighbour imputation with missing-aware distances.

Distance between two rows: squared differences over the columns both have, scaled up
by (all columns / shared columns). A missing cell becomes the mean of that column over
the ``k`` nearest rows having it; equal distances go to the earlier row.

Comparing all pairs of rows does not scale, and neither does gathering a series. Donors
are cut into tiles of bounded size in value space, each with a bounding box:

* Donors with the same columns missing are tiled together, so that in nearly every box a
  column is wholly present or wholly absent and its bounds are exact.
* Receivers with the same columns missing share a tiling that sorts donors along a Z-order
  of just the columns those receivers have. Rare patterns share one tiling over all.
* A tree of boxes is walked top-down. Every level bounds a receiver's k-th distance from
  above (the farthest corner of a box with ``k`` usable rows) and drops boxes whose nearest
  corner is farther away.
* The nearest tile left is searched first; its k-th distance drops most of the others.

Only boxes that cannot hold a nearer row are dropped, so the result is that of the full
comparison. Tiles and probe groups have bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridload.functions.scalars import clean, numeric_columns
from gridload.operators.ordering import (
    DEFAULT_LAYOUT,
    SeriesLayout,
    global_position,
    time_position,
)
from gridload.session import durable

_ROW, _TILE, _SALT, _DONOR, _BOUND = "_row", "_tile", "_salt", "_donor", "_bound"
_ORDER, _KIND, _LOW = "_order", "_kind", "_low"
_PROBES_PER_GROUP = 2048
_SLACK = 1 + 1e-9
#: missing patterns that get tilings of their own, and bits of a Z-order code
PATTERNS, CODE_BITS = 16, 40
_REST = "rest"


def nearest(
    receivers: np.ndarray,
    receiver_rows: np.ndarray,
    donors: np.ndarray,
    donor_rows: np.ndarray,
    k: int,
) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(receiver rows, column, distances, values, donor rows) of the k best donors.

    Donors come in the order of their rows, so of equal distances the first are taken.
    """
    width = receivers.shape[1]
    have = ~np.isnan(donors)
    block = max(1, 4_000_000 // max(len(donors), 1))
    for start in range(0, len(receivers), block):
        part = receivers[start : start + block]
        total = np.zeros((len(part), len(donors)))
        shared = np.zeros((len(part), len(donors)))
        for c in range(width):
            gap = part[:, c, None] - donors[None, :, c]
            known = ~np.isnan(gap)
            total += np.where(known, gap * gap, 0.0)
            shared += known
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.where(shared > 0, total * (width / shared), np.inf)
        for c in range(width):
            lines, usable = np.flatnonzero(np.isnan(part[:, c])), np.flatnonzero(have[:, c])
            if not len(lines) or not len(usable):
                continue
            d = distance[np.ix_(lines, usable)]
            most = min(k, len(usable))
            last = np.partition(d, most - 1, axis=1)[:, most - 1, None]
            tied = d == last
            room = most - (d < last).sum(axis=1, keepdims=True)
            take = ((d < last) | (tied & (np.cumsum(tied, axis=1) <= room))) & np.isfinite(d)
            i, j = np.nonzero(take)
            yield receiver_rows[start + lines[i]], c, d[i, j], donors[usable[j], c], donor_rows[usable[j]]


def _searcher(keys: list[str], columns: list[str], k: int) -> Callable:
    names = [*keys, _ROW, "column", "distance", "value", "donor_row"]

    def search(key: tuple, probes: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(_ROW)
        found = [pd.DataFrame(columns=names)]
        for rows, c, distances, values, donor_rows in nearest(
            probes[columns].to_numpy(dtype="float64", na_value=np.nan),
            probes[_ROW].to_numpy(),
            tile[columns].to_numpy(dtype="float64", na_value=np.nan),
            tile[_ROW].to_numpy(),
            k,
        ):
            part = {name: value for name, value in zip(keys, key, strict=False)}
            part |= {_ROW: rows, "column": columns[c], "distance": distances}
            found.append(pd.DataFrame(part | {"value": values, "donor_row": donor_rows})[names])
        return pd.concat(found[1:] or found, ignore_index=True)

    return search


def _found_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    return T.StructType(
        [
            *fields,
            T.StructField(_ROW, T.LongType()),
            T.StructField("column", T.StringType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("donor_row", T.LongType()),
        ]
    )


def _boxes(donors: DataFrame, cell: list[str], columns: list[str]) -> DataFrame:
    """Bounding box per tile; ``_full_c`` and ``_none_c``: present in all rows, in none."""
    return donors.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min(c).alias(f"_lo_{c}") for c in columns],
        *[F.max(c).alias(f"_hi_{c}") for c in columns],
        *[(F.count(c) == F.count(F.lit(1))).alias(f"_full_{c}") for c in columns],
        *[(F.count(c) == 0).alias(f"_none_{c}") for c in columns],
    )


def _merge_boxes(boxes: DataFrame, cell: list[str], columns: list[str], fan: int) -> DataFrame:
    return (
        boxes.withColumn(_TILE, F.floor(F.col(_TILE) / fan))
        .groupBy(*cell)
        .agg(
            F.sum("_n").alias("_n"),
            *[F.min(f"_lo_{c}").alias(f"_lo_{c}") for c in columns],
            *[F.max(f"_hi_{c}").alias(f"_hi_{c}") for c in columns],
            *[F.bool_and(f"_full_{c}").alias(f"_full_{c}") for c in columns],
            *[F.bool_and(f"_none_{c}").alias(f"_none_{c}") for c in columns],
        )
    )


def _sum(parts: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for part in parts:
        total = total + part
    return total


def _all_of(parts: Sequence[Column]) -> Column:
    total = F.lit(True)
    for part in parts:
        total = total & part
    return total


def _bounds(columns: list[str], k: int) -> tuple[Column, Column, Column]:
    """(no row of the box is nearer, k rows for every missing cell are no farther, the
    box is of use) for a receiver joined with a box; distances are squared."""
    width = F.lit(float(len(columns)))
    known = {c: F.col(c).isNotNull() for c in columns}
    full, none = ({c: F.col(f"_{kind}_{c}") for c in columns} for kind in ("full", "none"))
    low = {c: F.greatest(F.col(f"_lo_{c}") - F.col(c), F.col(c) - F.col(f"_hi_{c}"), F.lit(0.0)) for c in columns}
    high = {c: F.greatest(F.abs(F.col(c) - F.col(f"_lo_{c}")), F.abs(F.col(c) - F.col(f"_hi_{c}"))) for c in columns}
    shared = _sum([F.when(known[c] & ~none[c], 1.0).otherwise(0.0) for c in columns])
    nearest_corner = _sum([F.when(known[c] & full[c], low[c] * low[c]).otherwise(0.0) for c in columns])
    farthest_corner = _sum([F.when(known[c] & full[c], high[c] * high[c]).otherwise(0.0) for c in columns])
    exact = _all_of([~known[c] | full[c] | none[c] for c in columns])
    supplies = _all_of([known[c] | full[c] for c in columns]) & (F.col("_n") >= k)
    useful = (shared > 0) & ~_all_of([known[c] | none[c] for c in columns])
    lower = F.coalesce(nearest_corner * F.try_divide(width, shared), F.lit(0.0))
    upper = F.when(exact & supplies, farthest_corner * F.try_divide(width, shared))
    return lower, F.coalesce(upper, F.lit(float("inf"))), useful


def _pattern(columns: list[str]) -> Column:
    """``1`` per present and ``0`` per missing column."""
    return F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])


def _frequent(df: DataFrame) -> list[str]:
    """The most frequent missing patterns: ``PATTERNS`` texts come to the driver."""
    counts = df.groupBy("_pattern").agg(F.count(F.lit(1)).alias("n"))
    return [r["_pattern"] for r in counts.orderBy(F.desc("n"), "_pattern").limit(PATTERNS).collect()]


def _shares(columns: list[str], ranges: dict[str, tuple[float, float]]) -> Column:
    """Where each cell lies in its column's range, 0 to 1; 0 if missing."""
    cells = []
    for c in columns:
        low, high = ranges[c]
        share = (F.col(c) - F.lit(low)) / F.lit((high - low) or 1.0)
        # least and greatest pass over nulls
        cells.append(F.greatest(F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))
    return F.array(*cells)


def _order_table(orders: list[str], columns: list[str]) -> Column:
    """(order, the columns its receivers have, bits of each in the code), as a literal."""
    entries = []
    for order in orders:
        used = [i for i in range(len(columns)) if order == _REST or order[i] == "1"][:CODE_BITS]
        bits = CODE_BITS // len(used) if used else 0
        indexes = F.array(*[F.lit(i) for i in used]).cast("array<int>")
        entries.append(
            F.struct(F.lit(order).alias(_ORDER), indexes.alias("_used"), F.lit(bits).alias("_bits"))
        )
    return F.array(*entries)


def _code() -> Column:
    """Z-order code of ``_shares`` over ``_used``: the leading bits of all, then the next.

    One small expression for every order: spelled out per order and bit, it outgrows what
    can be compiled.
    """
    most = F.pow(F.lit(2.0), F.col("_bits")) - 1
    cells = F.transform("_used", lambda i: F.floor(F.col("_shares")[i] * most).cast("bigint"))
    places = F.sequence(F.col("_bits") - 1, F.lit(0), F.lit(-1))

    def interleave(code: Column, bit: Column) -> Column:
        one = F.lit(1).cast("bigint")
        return F.aggregate(
            cells, code, lambda c, cell: c * 2 + F.call_function("shiftright", cell, bit).bitwiseAND(one)
        )

    code = F.aggregate(places, F.lit(0).cast("bigint"), interleave)
    return F.when(F.col("_bits") > 0, code).otherwise(F.lit(0).cast("bigint"))


def _tiled(rows: DataFrame, orders: list[str], columns: list[str], keys: list[str], tile_rows: int) -> DataFrame:
    """Donors once per order, sorted by its code within their kind and cut into tiles."""
    limits = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    ranges = {c: (limits[f"lo_{c}"] or 0.0, limits[f"hi_{c}"] or 0.0) for c in columns}
    kinds = rows.withColumn("_pattern", _pattern(columns))
    own = _frequent(kinds)
    kinds = kinds.withColumn(_KIND, F.when(F.col("_pattern").isin(own), F.col("_pattern")).otherwise(_REST))
    kinds = kinds.withColumn("_shares", _shares(columns, ranges))
    spread = kinds.select(
        *keys, _ROW, _KIND, *columns, "_shares", F.inline(_order_table(orders, columns))
    )
    coded = spread.withColumn("_code", _code()).drop("_shares", "_used", "_bits")
    placed = global_position(coded, [_ORDER, *keys, _KIND, "_code", _ROW], "_place")
    return placed.withColumn(_TILE, F.floor(F.col("_place") / tile_rows)).drop("_place", "_code")


def _search_pairs(
    probes: DataFrame, rows: DataFrame, cell: list[str], keys: list[str], columns: list[str], k: int,
    schema: T.StructType,
) -> DataFrame:
    """The k best donors of each (receiver, tile); a tile many ask for gets several tasks."""
    salts = probes.groupBy(*cell).agg(
        F.ceil(F.count(F.lit(1)) / _PROBES_PER_GROUP).cast("int").alias("_salts")
    )
    salted_probes = probes.join(salts, cell).withColumn(
        _SALT, F.pmod(F.xxhash64(_ROW), F.col("_salts")).cast("int")
    )
    salted_rows = rows.join(salts, cell).withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    )
    group = [*keys, *[c for c in cell if c not in keys], _SALT]
    left = salted_probes.select(*[F.col(c).alias(c) for c in (*group, _ROW, *columns)])
    right = salted_rows.select(*[F.col(c).alias(c) for c in (*group, _ROW, *columns)])
    found = left.groupBy(*group).cogroup(right.groupBy(*group))
    return found.applyInPandas(_searcher(keys, columns, k), schema)


def knn_impute(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    k: int = 5,
    donors: DataFrame | None = None,
    layout: SeriesLayout = DEFAULT_LAYOUT,
    tile_rows: int = 4096,
    levels: int = 3,
    fan: int = 64,
    effort: dict[str, int] | None = None,
) -> DataFrame:
    """Fill missing cells of ``columns`` (default: all numeric) from nearest rows.

    Neighbours are searched within the layout's keys, among the rows of ``donors`` or
    of ``df`` itself. A cell no row can be compared for gets the column's mean within
    the keys. ``levels`` box-tree levels with ``fan`` children each cover
    ``tile_rows * fan**levels`` rows per top node. Intermediate tables are written to the
    shared folder, so calling this runs jobs. ``effort`` receives the number of (receiver,
    tile) pairs searched, and of all pairs.
    """
    columns = list(columns) if columns else numeric_columns(df)
    if not layout.keys:
        whole = knn_impute(
            df.withColumn("_all", F.lit(0)),
            columns,
            k,
            None if donors is None else donors.withColumn("_all", F.lit(0)),
            layout.with_keys("_all"),
            tile_rows,
            levels,
            fan,
            effort,
        )
        return whole.drop("_all")
    keys, time = list(layout.keys), layout.time
    doubles = {c: clean(F.col(c).cast("double")) for c in columns}
    base = df.withColumns(doubles)
    if donors is None:
        pool = base.withColumn(_DONOR, F.lit(True)).withColumn("_own", F.lit(True))
        ties: list[str] = []
    else:
        known = donors.select(*keys, time, *[doubles[c].alias(c) for c in columns])
        pool = base.withColumn(_DONOR, F.lit(False)).withColumn("_own", F.lit(True)).unionByName(
            known.withColumn(_DONOR, F.lit(True)).withColumn("_own", F.lit(False)),
            allowMissingColumns=True,
        )
        ties = ["_own"]
    numbered = durable(time_position(pool, layout, _ROW, ties=ties))
    slim = numbered.select(*keys, _ROW, _DONOR, "_own", *columns)
    rows = slim.filter(_DONOR).select(*keys, _ROW, *columns)
    receivers = slim.filter(F.col("_own") & ~_all_of([F.col(c).isNotNull() for c in columns]))
    receivers = receivers.select(*keys, _ROW, *columns).withColumn("_pattern", _pattern(columns))
    frequent = _frequent(receivers)
    receivers = receivers.withColumn(
        _ORDER, F.when(F.col("_pattern").isin(frequent), F.col("_pattern")).otherwise(_REST)
    ).drop("_pattern")
    tiles = durable(_tiled(rows, [*frequent, _REST], columns, keys, tile_rows))
    schema = _found_schema(df, keys)

    cell = [_ORDER, *keys, _KIND, _TILE]
    tree = [_boxes(tiles, cell, columns)]
    for _ in range(levels):
        tree.append(_merge_boxes(tree[-1], cell, columns, fan))
    tree[0] = durable(tree[0])
    corners = [f"_{p}_{c}" for c in columns for p in ("lo", "hi", "full", "none")] + ["_n"]
    lower, upper, useful = _bounds(columns, k)
    mine = Window.partitionBy(*keys, _ROW)

    def within(met: DataFrame) -> DataFrame:
        """Boxes that may hold one of the k nearest."""
        bounds = met.filter(useful).withColumns({_LOW: lower, "_up": upper}).drop(*corners)
        bounds = bounds.withColumn(_BOUND, F.min("_up").over(mine))
        return bounds.filter(F.col(_LOW) <= F.col(_BOUND) * _SLACK).drop(_LOW, "_up", _BOUND)

    def lowest(met: DataFrame) -> DataFrame:
        bounds = met.filter(useful).withColumns({_LOW: lower, "_up": upper}).drop(*corners)
        bounds = bounds.withColumns(
            {
                _BOUND: F.min("_up").over(mine),
                "_home": F.min(F.struct(_LOW, "_up", _KIND, _TILE)).over(mine),
            }
        )
        home = F.struct(_LOW, "_up", _KIND, _TILE) == F.col("_home")
        near = F.col(_LOW) <= F.col(_BOUND) * _SLACK
        return bounds.filter(near).withColumn("_first", home).drop("_home", "_up")

    probes = receivers.join(tree[-1], [_ORDER, *keys])
    for boxes in reversed(tree[:-1]):
        child = boxes.withColumn("_parent", F.floor(F.col(_TILE) / fan))
        probes = (
            within(probes)
            .withColumnRenamed(_TILE, "_parent")
            .join(child, [_ORDER, *keys, _KIND, "_parent"])
            .drop("_parent")
        )
    probes = durable(lowest(probes))
    missing = _sum([F.when(F.col(c).isNull(), 1).otherwise(0) for c in columns])
    seeds = probes.filter("_first")
    own = durable(_search_pairs(seeds, tiles, cell, keys, columns, k, schema))
    per_column = own.groupBy(*keys, _ROW, "column").agg(
        F.count(F.lit(1)).alias("_count"), F.max("distance").alias("_d")
    )
    reach = per_column.filter(F.col("_count") >= k).groupBy(*keys, _ROW).agg(
        F.max("_d").alias("_reach"), F.count(F.lit(1)).alias("_found")
    )
    others = probes.filter("not _first").join(reach, [*keys, _ROW], "left")
    limit = F.when(F.col("_found") == missing, F.least("_reach", _BOUND)).otherwise(F.col(_BOUND))
    others = others.filter(F.col(_LOW) <= limit * _SLACK)
    if effort is not None:
        others = durable(others)
        effort["searched"] = seeds.count() + others.count()
        effort["pairs"] = receivers.count() * -(-rows.count() // tile_rows)
    elsewhere = _search_pairs(others, tiles, cell, keys, columns, k, schema)

    order = Window.partitionBy(*keys, _ROW, "column").orderBy("distance", "donor_row")
    filled = (
        own.unionByName(elsewhere)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= k)
        .groupBy(*keys, _ROW)
        .agg(*[F.avg(F.when(F.col("column") == c, F.col("value"))).alias(f"_fill_{c}") for c in columns])
    )
    means = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    result = (
        numbered.filter("_own").join(filled, [*keys, _ROW], "left").join(means, keys, "left")
    )
    return result.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_fill_{c}"), F.col(f"_mean_{c}")) for c in columns}
    ).select(*df.columns)
