"""Jaccard join in the metric space of shingle sets: pivots, regions, windows, recursion.

A document is its set of distinct shingles of ``size`` words (A-Z in lower case, words
between ASCII blanks; a shorter text is one shingle, a text without words the empty set). Two documents
link at a Jaccard similarity of 0.8 or more, that is at a distance of 0.2 or less; the distance
``1 - intersection / union`` is a metric, and every test here is made in whole numbers.

Pivots and regions. Almost all pairs of documents lie at a distance of 1, where no pivot can
tell them apart, so pivots drawn at random would copy every document to every region.
Instead the shingles draw them: of the first three tenths of their shingles in any common order
linked documents share a tenth, and the least document that holds such a shingle there is the pivot for it.
A document belongs to the regions of its pivots, less those with the fewest of its shingles, a twenty-fifth in all
(a window of mass: partners cannot differ by that much there); linked documents meet in one at least.
The order puts rare shingles first: shingles are counted in 2**18 buckets by hash over all documents,
a table of one byte each. It is a matter of speed only: any order gives the same links.

Within a region distances to pivots are exact, and the triangle inequality does the rest. Each
document goes to the cell of its nearest pivot and, as a boundary document, to every cell whose
pivot is at most 0.4 farther. Documents linked to pivots that are joined already need no
comparison with each other, only with the others whose distance to the cell's pivot is within
0.2 of theirs. Cells are joined in the same way, recursively, until all is joined or few documents are left.
These, and regions whose cells overlap too much to be a gain, are compared one by one, less the pairs that
the distances to the pivots rule out. A pivot is compared with its whole region, so it leaves the recursion.

Where it runs. Sets are several times the size of the texts, so they never travel: first shingles do,
packed (six bytes of the hash, where a collision can only add a candidate), dealt by hash, and then the texts
of documents that have a region; tasks hash these again. Small regions are packed into tasks of about ``cell`` shingles. Larger ones take a
round of the same step as Spark jobs: parts of bounded size meet the region's
pivots, and what is left makes new regions. Where cells are no gain, and after ``rounds`` rounds, the parts
of a region that is still too large meet in pairs. Edges are a forest per task, classes are its connected components.

Defined results: null and blank texts are empty sets and link with nothing; copies have one
set and are compared once; a repeated row gets the class of its like; rows without id get the
class of their set, whose name is its smallest id (null if there is none, and for rows without id
and words). Shingles and sets are 64-bit hashes (XXH64, seed 42); texts are taken whole,
their sets must fit in a task. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridload.llm.common import per_text
from gridload.llm.graph import components
from gridload.llm.simhash import _digest, _hashes_of
from gridload.session import discard, written

SIZE = 5
#: linked where 100 * intersection >= 80 * union
NUMERATOR, DENOMINATOR = 80, 100
RADIUS = 1 - NUMERATOR / DENOMINATOR
_SLACK = 1e-9
#: shingles that a task compares
CELL = 1 << 20
#: pivots of a region in one step, and documents that are compared one by one
PIVOTS, FEW = 8, 24
#: steps that run as Spark jobs before parts meet in pairs
ROUNDS = 4
#: buckets of the count of shingles
BUCKETS = 1 << 18
#: bytes of a hash that travel, and first shingles of one part
KEPT_BYTES, PART = 6, 1 << 22


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return DENOMINATOR * shared >= NUMERATOR * (a + b - shared)


class Sets:
    """Sets of shingle numbers, their known links, and exact distances between them."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        vocabulary, self.ids = np.unique(values, return_inverse=True)
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.marked = np.zeros(len(vocabulary), bool)
        self.root = np.arange(len(sizes))

    def _of(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] - self.sizes[i] : self.ends[i]]

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        if not len(others):
            return np.empty(0, np.int64)
        self.marked[self._of(i)] = True
        starts = np.cumsum(self.sizes[others]) - self.sizes[others]
        found = np.add.reduceat(self.marked[np.concatenate([self._of(k) for k in others])].astype(np.int64), starts)
        self.marked[self._of(i)] = False
        return found

    def _unite(self, i: int, others: np.ndarray) -> None:
        if len(others):
            trees = np.unique(self.root[np.append(others, i)])
            if len(trees) > 1:
                self.root[np.isin(self.root, trees)] = trees[0]

    def compare(self, i: int, others: np.ndarray) -> None:
        """Link ``i`` with those of ``others`` that are not in its tree."""
        others = others[self.root[others] != self.root[i]]
        low, high = np.minimum(self.sizes[i], self.sizes[others]), np.maximum(self.sizes[i], self.sizes[others])
        others = others[DENOMINATOR * low >= NUMERATOR * high]
        shared = self.shared(i, others)
        self._unite(i, others[linked(shared, self.sizes[i], self.sizes[others])])

    def distances(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Distances to a pivot, which is linked with all within reach."""
        shared, total = self.shared(pivot, others), self.sizes[pivot] + self.sizes[others]
        self._unite(pivot, others[linked(shared, self.sizes[pivot], self.sizes[others])])
        return 1 - shared / (total - shared)

    def join(self, members: np.ndarray) -> None:
        """Find all links among ``members`` that connect different trees."""
        waiting = [members]
        while waiting:
            members = waiting.pop()
            if len(np.unique(self.root[members])) < 2:
                continue
            if len(members) <= FEW:
                for nth, i in enumerate(members):
                    self.compare(i, members[nth + 1 :])
                continue
            pivots = members[np.linspace(0, len(members) - 1, PIVOTS).astype(int)]
            to = np.array([self.distances(p, members) for p in pivots])
            rest = ~np.isin(members, pivots)
            members, to = members[rest], to[:, rest]
            cells = [self._cell(members, to, nth) for nth in range(PIVOTS)]
            # cells that overlap too much are no gain
            if 2 * sum(len(c) ** 2 for c in cells) <= len(members) ** 2:
                waiting += cells
            else:
                self._one_by_one(members, to)

    def _other(self, members: np.ndarray) -> np.ndarray:
        """Who is not in the largest tree."""
        trees, counts = np.unique(self.root[members], return_counts=True)
        return self.root[members] != trees[np.argmax(counts)]

    def _cell(self, members: np.ndarray, to: np.ndarray, nth: int) -> np.ndarray:
        inside = cell_of(to, nth)
        cell, near = members[inside], to[nth, inside]
        other = self._other(cell) if len(cell) else np.zeros(0, bool)
        if not other.any():
            return cell[:0]
        low, high = near[other].min() - RADIUS - _SLACK, near[other].max() + RADIUS + _SLACK
        return cell[other | ((near >= low) & (near <= high))]

    def _one_by_one(self, members: np.ndarray, to: np.ndarray) -> None:
        if not len(members):
            return
        other = self._other(members)
        late = np.cumsum(other)
        for i in np.flatnonzero(other):
            close = (np.abs(to - to[:, i : i + 1]) <= RADIUS + _SLACK).all(axis=0)
            self.compare(members[i], members[close & (~other | (late > late[i]))])


def cell_of(to: np.ndarray, nth: int) -> np.ndarray:
    """Who is nearest to a pivot, or at its boundary; ``to`` holds a row per pivot."""
    return to[nth] <= to.min(axis=0) + 2 * RADIUS + _SLACK


def _sets(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(all shingles, sizes) of the texts of a table."""
    found = [np.unique(_hashes_of(text, size)) for text in table.column("text").to_pylist()]
    return np.concatenate([np.empty(0, "<u8"), *found]), np.fromiter(map(len, found), np.int64, len(found))


def _join_cell(size: int):
    def join(table: pa.Table) -> pa.Table:
        """All regions of a task, one after the other."""
        table = table.combine_chunks().sort_by([("region", "ascending"), ("node", "ascending")])
        regions, nodes = table.column("region").to_numpy(), table.column("node").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(regions)) + 1).tolist(), len(nodes)]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high - low < 2:
                continue
            sets = Sets(*_sets(table.slice(low, high - low), size))
            sets.join(np.arange(high - low))
            tied = np.flatnonzero(sets.root != np.arange(high - low))
            a.append(nodes[low:high][tied])
            b.append(nodes[low:high][sets.root[tied]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return join


def _distances(size: int):
    def measure(table: pa.Table, pivots: pa.Table) -> pa.Table:
        """(node, to, links): distances of a part's documents to the region's pivots, in order."""
        pivots = pivots.combine_chunks().sort_by([("nth", "ascending")])
        table = table.combine_chunks()
        both = [_sets(pivots, size), _sets(table, size)]
        sets = Sets(np.concatenate([v for v, _ in both]), np.concatenate([s for _, s in both]))
        count, others = len(pivots), np.arange(len(pivots), len(pivots) + len(table))
        shared = np.array([sets.shared(p, others) for p in range(count)])
        total = sets.sizes[:count, None] + sets.sizes[None, others]
        to, links = 1 - shared / (total - shared), linked(shared, sets.sizes[:count, None], sets.sizes[None, others])
        return pa.table(
            {
                "region": table.column("region"),
                "node": table.column("node"),
                "n": table.column("n"),
                "to": pa.array(list(to.T), pa.list_(pa.float64())),
                "links": pa.array(list(links.T), pa.list_(pa.bool_())),
                "pivots": pa.array([pivots.column("node").to_pylist()] * len(table), pa.list_(pa.int64())),
            }
        )

    return measure


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def common(n: int) -> int:
    """How many first shingles linked sets, the smaller of ``n``, share at least."""
    return max(1, n // 10)


def _most(n: int) -> int:
    """Size of the beginning of a set of ``n`` of which a linked set shares ``common``."""
    return n - -(-n * NUMERATOR // DENOMINATOR) + common(n)


def spare(n: Column) -> Column:
    """How many of its first shingles a set of ``n`` may do without: linked sets share
    ``common`` of them, and each of the two leaves out less than half of that."""
    least = F.ceil(n * NUMERATOR / DENOMINATOR)
    return F.floor((F.greatest(F.lit(1), F.floor(least / 10)) - 1) / 2)


def shingle_levels(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """A byte per bucket of shingles: the logarithm of its count, 0 if that is usual.

    Counted are the shingles that come first by hash, over all documents; a task adds its
    own up.
    """

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for some in batch.column(0).to_pylist():
                every = np.unique(_hashes_of(some or "", size))
                np.add.at(total, _bucket(every[: _most(len(every)) if len(every) else 0]), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "rows"])

    texts = docs.select(F.col(text).cast("string"))
    counts = texts.mapInArrow(count, "bucket bigint, rows bigint").groupBy("bucket").agg(F.sum("rows").alias("rows"))
    counts = written(counts, "buckets")
    mean = (counts.agg(F.sum("rows")).first()[0] or 0) / BUCKETS
    # at most one row per bucket comes to the driver, and only those above the usual
    hot = counts.filter(F.col("rows") > mean + 8 * mean**0.5 + 16).toPandas()
    levels = np.zeros(BUCKETS, np.uint8)
    levels[hot["bucket"].to_numpy()] = np.ceil(np.log2(hot["rows"].to_numpy() + 1)).astype(np.uint8)
    return levels


def mark(text: Column, levels: np.ndarray, size: int) -> Column:
    """(node, n, first) of a text: the name of its set, its size, and its first shingles in the
    common order, rare ones before others, six bytes each."""

    def one(text: str) -> dict:
        every = np.unique(_hashes_of(text, size))
        if not len(every):
            return {"node": 0, "n": 0, "first": b""}
        level = levels[_bucket(every)]
        # the set is sorted by hash: a stable sort by level keeps that order
        first = (every[np.argsort(level, kind="stable")] if level.any() else every)[: _most(len(every))]
        packed = first.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes()
        return {"node": _digest(every), "n": len(every), "first": packed}

    def all_of(texts: list[str]) -> list[dict]:
        return [one(t) for t in texts]

    return per_text(lambda: all_of, "struct<node:bigint,n:int,first:binary>")(text)


def _dealt(parts: int):
    """Deal first shingles to ``parts`` by hash: per batch and part one row of packed arrays."""

    def deal(batches):
        for batch in batches:
            nodes, which = np.unique(batch.column(0).to_numpy(), return_index=True)  # copies once
            heads = batch.column(1).take(pa.array(which)).to_pylist()
            counts = np.fromiter((len(h) // KEPT_BYTES for h in heads), np.int64, len(heads))
            wide = np.zeros((counts.sum(), 8), np.uint8)
            wide[:, :KEPT_BYTES] = np.frombuffer(b"".join(heads), np.uint8).reshape(-1, KEPT_BYTES)
            hashes, of = wide.view("<u8").ravel(), np.repeat(np.arange(len(nodes)), counts)
            part = (hashes % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            found, starts = np.unique(part[order], return_index=True)
            rows = []
            for p, some in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
                here, at = np.unique(of[some], return_inverse=True)
                packed = wide[some, :KEPT_BYTES].tobytes()
                rows.append((p, packed, at.astype("<u4").tobytes(), nodes[here].tobytes()))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "hashes", "at", "nodes"])

    return deal


def _owned(table: pa.Table) -> pa.Table:
    """(region, node, times) of a part: the holders of a shingle belong to the least of them."""
    hashes, nodes = [], []
    for packed, at, held in zip(*(table.column(c).to_pylist() for c in ("hashes", "at", "nodes")), strict=True):
        wide = np.zeros((len(packed) // KEPT_BYTES, 8), np.uint8)
        wide[:, :KEPT_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, KEPT_BYTES)
        hashes.append(wide.view("<u8").ravel())
        nodes.append(np.frombuffer(held, "<i8")[np.frombuffer(at, "<u4")])
    hash_, node = np.concatenate(hashes), np.concatenate(nodes)
    order = np.lexsort((node, hash_))
    hash_, node = hash_[order], node[order]
    starts = np.flatnonzero(np.append(True, hash_[1:] != hash_[:-1]))
    sizes = np.diff(np.append(starts, len(hash_)))
    region = np.repeat(node[starts], sizes)
    shared = np.repeat(node[starts] != node[starts + sizes - 1], sizes)
    region, node = region[shared], node[shared]
    order = np.lexsort((node, region))
    region, node = region[order], node[order]
    starts = np.flatnonzero(np.append(True, (region[1:] != region[:-1]) | (node[1:] != node[:-1]))[: len(node)])
    times = np.diff(np.append(starts, len(node)))
    return pa.table({"region": region[starts], "node": node[starts], "times": times})


def regions_of(marked: DataFrame) -> DataFrame:
    """(region, node, n, key): the regions of every document that shares a first shingle."""
    width = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = marked.agg(F.sum(F.octet_length("first"))).first()[0] or 0
    parts = max(width, -(-total // (KEPT_BYTES * PART)))
    packed = marked.filter("n > 0").select("node", "first").mapInArrow(
        _dealt(parts), "part bigint, hashes binary, at binary, nodes binary"
    )
    owned = packed.groupBy("part").applyInArrow(_owned, "region bigint, node bigint, times bigint")
    owned = owned.groupBy("region", "node").agg(F.sum("times").alias("times"))
    one = marked.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("key").alias("key"))
    # a set has at most as many regions as first shingles
    smallest = Window.partitionBy("node").orderBy("times", "region")
    kept = owned.withColumn("upto", F.sum("times").over(smallest)).join(one, "node")
    return kept.filter(F.col("upto") > spare(F.col("n"))).select("region", "node", "n", "key")


def _sizes(members: DataFrame, cell: int) -> DataFrame:
    """(region, parts) of regions too large for a task."""
    sizes = members.groupBy("region").agg(F.sum("n").alias("weight")).filter(F.col("weight") > cell)
    return sizes.select("region", F.ceil(F.col("weight") / cell).cast("int").alias("parts"))


class Texts:
    """The texts of documents by the hash ``key``; copies count once."""

    def __init__(self, docs: DataFrame, text: str, size: int) -> None:
        whole = F.col(text).cast("string")
        self.docs, self.size = docs.select(F.xxhash64(whole).alias("key"), whole.alias("text")), size

    def of(self, members: DataFrame) -> DataFrame:
        """``members`` (with ``key``) and their texts."""
        keys = members.select("key").distinct()
        # both joins are sorted merges at every size: they meet in one shuffle by key
        one = self.docs.join(keys.hint("merge"), "key", "left_semi").dropDuplicates(["key"])
        return members.hint("merge").join(one, "key").drop("key")


def _in_small(members: DataFrame, texts: Texts, cell: int) -> DataFrame:
    """Edges of regions that fit in a task; many share one."""
    width = 4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = members.agg(F.sum("n")).first()[0] or 0
    tasks = max(width, -(-total // cell))
    bucket = F.pmod(F.xxhash64("region"), F.lit(tasks)).alias("task")
    cells = texts.of(members).select(bucket, "region", "node", "text")
    return cells.groupBy("task").applyInArrow(_join_cell(texts.size), "a bigint, b bigint")


def _star(members: DataFrame, texts: Texts, parts: DataFrame) -> DataFrame:
    """(region, node, n, to, links, pivots): documents of large regions and their pivots."""
    order = Window.partitionBy("region").orderBy(F.col("node") != F.col("region"), F.xxhash64("region", "node"))
    pivots = members.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= PIVOTS)
    pivots = texts.of(pivots).join(parts, "region")
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = F.pmod(F.xxhash64("node"), "parts").cast("int")
    met = texts.of(members).join(parts, "region").withColumn("part", part)
    fresh = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names])
    left = fresh(met, "region", "part", "node", "n", "text").groupBy("region", "part")
    right = fresh(pivots, "region", "part", "nth", "node", "text").groupBy("region", "part")
    return left.cogroup(right).applyInArrow(
        _distances(texts.size),
        "region bigint, node bigint, n int, to array<double>, links array<boolean>, pivots array<bigint>",
    )


def _main(masks: pa.Array) -> pa.Array:
    """Per region, the pivots (as bits) joined with the first, from the sets of pivots that
    some document is linked with."""
    found = []
    for some in masks.to_pylist():
        main, before = 1, 0
        while main != before:
            before = main
            for mask in some:
                if mask & main:
                    main |= mask
        found.append(main)
    return pa.array(found, pa.int64())


_main.__annotations__ = {"masks": pa.Array, "return": pa.Array}


def _split(star: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, node, n), twice, of what large regions have left to compare: their cells where
    these are a gain, and whole where they overlap too much."""
    bits = [F.when(F.get("links", F.lit(k)), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(PIVOTS)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    seen = star.withColumn("mask", mask.cast("bigint"))
    # at most 2**PIVOTS sets of pivots per region
    main = seen.groupBy("region").agg(F.collect_set("mask").alias("masks"))
    main = main.select("region", F.arrow_udf(_main, "bigint")("masks").alias("main"))
    seen = seen.join(main, "region").withColumn("other", F.col("mask").bitwiseAND(F.col("main")) == 0)
    seen = seen.filter(~F.array_contains("pivots", F.col("node")))
    nearest = F.array_min("to") + 2 * RADIUS + _SLACK
    cells = seen.select("region", "node", "n", "other", nearest.alias("most"), F.posexplode("to").alias("nth", "d"))
    cells = cells.filter("d <= most")
    limits = cells.filter("other").groupBy("region", "nth").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    reach = RADIUS + _SLACK
    within = F.col("other") | F.col("d").between(F.col("low") - reach, F.col("high") + reach)
    cells = written(cells.join(limits, ["region", "nth"]).filter(within).select("region", "nth", "node", "n"), "cells")
    left = cells.select("region", "node", "n").distinct()
    squares = cells.groupBy("region", "nth").agg(F.sum("n").cast("double").alias("w")).groupBy("region")
    squares = squares.agg(F.sum(F.col("w") * F.col("w")).alias("cost"))
    weights = left.groupBy("region").agg(F.sum("n").cast("double").alias("w"))
    gain = written(
        squares.join(weights, "region").select("region", (2 * F.col("cost") <= F.col("w") * F.col("w")).alias("gain")), "gain"
    )
    cut = cells.join(gain.filter("gain").select("region"), "region", "left_semi")
    whole = left.join(gain.filter("not gain").select("region"), "region", "left_semi")
    return cut.select(F.xxhash64("region", "nth").alias("region"), "node", "n"), whole


def _in_pairs(members: DataFrame, texts: Texts, parts: DataFrame) -> DataFrame:
    """Edges of large regions whose parts meet in pairs."""
    met = texts.of(members).join(parts, "region").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part <> with")
    cells = met.select(
        "region", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "node", "text"
    )
    return cells.groupBy("region", "i", "j").applyInArrow(_join_cell(texts.size), "a bigint, b bigint")


def join_regions(members: DataFrame, texts: Texts, *, cell: int = CELL, rounds: int = ROUNDS) -> DataFrame:
    """Edges (a, b) between nodes that connect all linked sets of (region, node, n, key)."""
    names, edges = members.select("node", "key").distinct(), []

    def finish(members: DataFrame) -> None:
        """Regions that are cut no further."""
        parts = written(_sizes(members, cell // 2), "parts")
        small = members.join(parts, "region", "left_anti")
        edges.append(written(_in_small(small, texts, cell), "links"))
        if parts.take(1):
            edges.append(_in_pairs(members, texts, parts))

    for _ in range(rounds):
        parts = written(_sizes(members, cell), "parts")
        small = members.join(parts, "region", "left_anti")
        edges.append(written(_in_small(small, texts, cell), "links"))
        if not parts.take(1):
            break
        members = members.join(parts.select("region"), "region", "left_semi")
        star = written(_star(members, texts, parts), "distances")
        near = star.select("node", F.explode(F.arrays_zip("links", "pivots")).alias("p")).filter("p.links")
        edges.append(near.select(F.col("node").alias("a"), F.col("p.pivots").alias("b")).filter("a <> b"))
        cut, whole = (some.join(names, "node") for some in _split(star))
        whole = written(whole, "regions")
        if whole.take(1):
            finish(whole)
        members = written(cut, "regions")
        if not members.take(1):
            break
    else:
        finish(members)
    found = edges[0]
    for some in edges[1:]:
        found = found.unionByName(some)
    return found


def similar_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, **options
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row. ``options`` are those of ``join_regions``."""
    levels = shingle_levels(docs, text, size)
    whole = F.col(text).cast("string")
    marked = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("key"), mark(whole, levels, size).alias("m")
    )
    marked = written(marked.select("doc_id", "key", "m.*"), "first")
    members = written(regions_of(marked), "regions")
    sets = written(marked.select("doc_id", "node", "n"), "sets")
    discard(marked)
    classes = components(join_regions(members, Texts(docs, text, size), **options))
    groups = sets.groupBy("node").agg(F.min("doc_id").alias("least"))
    named = groups.join(classes, "node", "left")
    names = named.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("name"))
    named = named.join(names, "root", "left").select(
        "node", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("name")).alias("name")
    )
    found = sets.select("doc_id", "node", "n").join(named, "node")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("name"))
    return found.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), own.alias("component_id"))
