"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is cut into blocks of ``block_rows`` documents. With weight ``w`` its block
``i`` (from 1) is released at slot ``floor((i - 1) / w)`` and due by slot
``ceil(i / w)``; in every slot the released block with the earliest deadline goes
next. The weights are whole parts of a cycle, so the schedule repeats: only one cycle is
scheduled (its length is the number of parts, a parameter), and every block of the
corpus finds its slot by an equi-join with that cycle. At the end of every slot each
source is less than one block away from its target share, until one runs out; from there
on the slots of finished sources stay empty and the others go on, so no row is lost.

Rows are numbered within a source by a hash of the id, in cells of bounded size: the
cells' counts give each cell its first number, so no task holds a whole source.

Defined results: a null source is the source ``''``; sources without a given weight get
one part; repeated rows are rows of their own; rows without id come first in their
source, by a hash of their other columns, which deals them to cells as ids do; rows of one
id, or without id and equal throughout, share a cell; no rows give no rows. ``slot``, ``block``, ``release``, ``deadline`` and
``place`` replace columns of that name; other columns travel as one struct, whatever their names.
Texts of any length are taken whole.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridload.operators.ordering import split_index
from gridload.session import written

PARTS = 1000
BLOCK_ROWS = 8
POWER = 0.5
#: a cell aims at this many rows, or at the root of all rows if that is more
CELL_ROWS = 1_000
#: a cycle of at most this many slots is broadcast, a longer one is joined by a shuffle
BROADCAST_SLOTS = 100_000
#: sorts before every hexadecimal digit
FIRST = "!"
#: columns of the schedule
NAMES = ["slot", "block", "release", "deadline", "place"]


def parts_of(weights: dict[str, float], parts: int = PARTS) -> dict[str, int]:
    """Whole parts per source, at least one each; their sum is the cycle's length."""
    total = sum(weights.values())
    return {name: max(1, int(parts * w / total + 0.5)) for name, w in sorted(weights.items())}


def cycle_schedule(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block within the cycle from 0, slot) by earliest deadline first."""
    length = sum(parts.values())
    waiting = [(0, name, 0) for name in sorted(parts)]  # release, source, block
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    out = []
    for slot in range(length):
        while waiting and waiting[0][0] <= slot:
            _, name, nth = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(nth + 1) * length // parts[name]), name, nth))
        _, name, nth = heapq.heappop(ready)
        out.append((name, nth, slot))
        if nth + 1 < parts[name]:
            heapq.heappush(waiting, ((nth + 1) * length // parts[name], name, nth + 1))
    return out


def source_key(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(""))


def counted(docs: DataFrame, source: str = "source") -> dict[str, int]:
    """Rows per source; one number for each source comes to the driver."""
    rows = docs.groupBy(source_key(source).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.s: r.n for r in rows}


def _cell_digits(rows: int, cell_rows: int) -> int:
    digits = 0
    while rows > max(cell_rows, math.isqrt(rows)) * 16**digits:
        digits += 1
    return digits


def order_key(doc_id: str, without: str | None = "") -> Column:
    """Order within a source: the digest of the id; rows without id come first."""
    return F.coalesce(F.md5(F.col(doc_id).cast("string")), F.lit(without))


def spread_key(docs: DataFrame) -> Column:
    """Order of the rows without id, before all digests: a hash of their other columns."""
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.concat(F.lit(FIRST), F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in plain])), 16, "0"))


def numbered(keyed: DataFrame, rows: int, cell_rows: int) -> DataFrame:
    """Add ``_nth``, the row's number (from 0) in its ``_source`` by ``_order``."""
    digits = _cell_digits(rows, cell_rows)
    cell = F.when(F.startswith("_order", F.lit(FIRST)), F.substring("_order", 1, digits + 1))
    keyed = keyed.withColumn("_cell", cell.otherwise(F.substring("_order", 1, digits)))
    along = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = keyed.groupBy("_source", "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    cells = cells.select("_source", "_cell", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_cell").orderBy("_order")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        ranked.join(cells, ["_source", "_cell"])
        .withColumn("_nth", F.col("_before") + F.col("_rank"))
        .drop("_cell", "_before", "_rank")
    )


class Schedule:
    """The cycle for some sources and weights: from a row's number in its source to its slot."""

    def __init__(self, docs: DataFrame, weights: dict[str, float] | None, source: str, parts: int, block_rows: int):
        counts = counted(docs, source)
        self.rows, self.block_rows = sum(counts.values()), block_rows
        if weights is None:
            weights = {name: n**POWER for name, n in counts.items()}
        share = parts_of(weights, max(parts, 2 * len(weights)))
        share = {name: share.get(name, 1) for name in sorted({*share, *counts})} or {"": 1}
        self.length, self.sources = sum(share.values()), len(share)
        plan = [
            {"s": name, "nth": nth, "at": slot, "parts": share[name]} for name, nth, slot in cycle_schedule(share)
        ]
        spark = docs.sparkSession
        self.cycle = spark.range(1).select(
            F.inline(F.from_json(F.lit(json.dumps(plan)), "array<struct<s:string,nth:bigint,at:bigint,parts:bigint>>"))
        )

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with ``_source`` and ``_nth``, with the columns ``NAMES``."""
        sizes = self.cycle.filter("nth = 0").select(F.col("s").alias("_source"), F.col("parts").alias("_parts"))
        slots = self.cycle.select(F.col("s").alias("_source"), F.col("nth").alias("_here"), F.col("at").alias("_at"))
        if self.length <= BROADCAST_SLOTS:
            sizes, slots = F.broadcast(sizes), F.broadcast(slots)
        rows = rows.join(sizes, "_source")
        block = F.floor(F.col("_nth") / self.block_rows)
        rows = rows.withColumns({"block": block + 1, "place": (F.col("_nth") % self.block_rows).cast("bigint")})
        rows = rows.withColumn("_here", F.pmod(F.col("block") - 1, F.col("_parts")))
        return (
            rows.join(slots, ["_source", "_here"])
            .withColumns(
                {
                    "slot": F.expr("(block - 1) div _parts") * self.length + F.col("_at"),
                    "release": F.expr(f"(block - 1) * {self.length} div _parts"),
                    "deadline": F.expr(f"(block * {self.length} + _parts - 1) div _parts"),
                }
            )
            .drop("_here", "_at", "_parts")
        )


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns kept in the struct ``_all``, and those of the schedule."""
    return rows.select(*[F.col("_all")[c].alias(c) for c in columns], *NAMES)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    parts: int = PARTS,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``docs`` with slot, block, release, deadline and place within the block.

    Without ``weights`` a source weighs its number of rows to the power ``POWER``.
    """
    schedule = Schedule(docs, weights, source, parts, block_rows)
    kept = [c for c in docs.columns if c not in NAMES]
    order = F.coalesce(order_key(doc_id, None), spread_key(docs))
    keyed = docs.select(F.struct(*kept).alias("_all"), source_key(source).alias("_source"), order.alias("_order"))
    return _unpacked(schedule.placed(numbered(keyed, schedule.rows, cell_rows)), kept)


def _partition_keys(spark: SparkSession, width: int) -> list[int]:
    """A number for each of ``width`` partitions that hash partitioning puts there."""
    most = 64 * width + 1024
    found = spark.range(most).select(F.col("id").cast("int").alias("k"))
    found = found.groupBy(F.pmod(F.hash("k"), F.lit(width)).alias("p")).agg(F.min("k").alias("k")).collect()
    keys = {r["p"]: r["k"] for r in found}
    return [keys[p] for p in range(width)]


def mixed(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    parts: int = PARTS,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The documents, written in the order of the schedule, with the columns of ``mix``.

    Slots are found on rows of a source and a hash alone. A source's order is that of the
    hashes, so a range of slots holds an interval of hashes of each source; a row finds its range
    from these intervals, goes there in the one shuffle of texts, and is numbered
    within it from the range's first number. Rows with equal hashes (repeated rows) share a range.
    """
    spark = docs.sparkSession
    schedule = Schedule(docs, weights, source, parts, block_rows)
    kept = [c for c in docs.columns if c not in NAMES]
    whole = F.xxhash64(F.col(text).cast("string")) if text in docs.columns else F.lit(0)
    order = F.concat(order_key(doc_id), F.lpad(F.hex(whole), 16, "0"))
    narrow = docs.select(source_key(source).alias("_source"), order.alias("_order"))
    placed = schedule.placed(numbered(narrow, schedule.rows, cell_rows))
    groups = placed.groupBy("_source", "_order").agg(F.min("slot").alias("slot"), F.min("_nth").alias("_nth"))
    groups = written(groups, "slots")
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = groups.agg(F.percentile_approx("slot", [i / width for i in range(1, width)] or [0.5], 100 * width)).first()[0]
    ranged = groups.withColumn("_range", split_index(F.lit(cuts or [0]), F.col("slot"), width))
    ends = ranged.groupBy("_source", "_range").agg(F.max("_order").alias("last"), F.min("_nth").alias("first"))
    ends = ends.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("last", "_range", "first"))).alias("_ends"))
    if schedule.sources * width <= BROADCAST_SLOTS:
        ends = F.broadcast(ends)
    keyed = docs.select(F.struct(*kept).alias("_all"), source_key(source).alias("_source"), order.alias("_order"))
    lasts = F.transform("_ends", lambda e: e["last"])
    found = keyed.join(ends, "_source").withColumn("_lasts", lasts)
    end = F.get("_ends", split_index(F.col("_lasts"), F.col("_order"), width + 1))
    keys = F.lit(_partition_keys(spark, width))
    found = found.withColumn("_end", end).select(
        "_all", "_source", "_order", F.get(keys, F.col("_end")["_range"]).alias("_key"), F.col("_end")["first"].alias("_first")
    )
    inside = Window.partitionBy("_key", "_source").orderBy("_order")
    dealt = found.repartition(width, "_key")
    dealt = dealt.withColumn("_nth", F.col("_first") + F.row_number().over(inside) - 1)
    return _unpacked(schedule.placed(dealt), kept).sortWithinPartitions("slot", "place")
