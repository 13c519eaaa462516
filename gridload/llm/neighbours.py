"""Approximate nearest neighbours: a navigable small-world graph per shard.

Rows are dealt by hash into shards of about ``SHARD_ROWS``. Each shard becomes one row
of the index table: its distinct vectors, their ids, and per level one flat array of
neighbour numbers (fixed width, -1 for none). Levels thin out geometrically; a node
links to near nodes in different directions (a candidate closer to a chosen neighbour
than to the node is passed over first) and back; nodes that the entry would not reach
are tied in by a bridge. Candidates for links come from exact distances within the
shard and level.

A search descends greedily to level 1, takes several entries there and widens at level
0 to a beam of ``BEAM`` nodes; queries of a block step together. What the beam holds is
ranked by exact double-precision distance. Blocks of queries meet every shard by an
equi-join on (shard, block), and the shards' results are merged.

Defined results: vectors that are null, empty, all zero or hold null or non-finite
components take no part, nor do rows without id; repeated rows (same id and vector)
count once; equal vectors share a node and are all found, smaller ids first; vectors
are compared with those of their own length only; an id's own rows are no candidates;
an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridload.session import written

SHARD_ROWS = 4096
QUERY_BLOCK = 2048
LINKS = 16
CANDIDATES = 64
BEAM = 160
ENTRIES = 16
NEIGHBOURS = 10
_INDEX = (
    "dim int, shard int, ids array<bigint>, id_ends array<int>, vectors array<double>, "
    "level_nodes array<array<int>>, level_links array<array<int>>"
)


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Distinct (vec_id, vec, dim) of the rows that take part."""
    vec = F.col(embedding).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), vec.alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad)
    rows = rows.filter(F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec"))
    return rows.distinct()


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, good enough to pick candidates."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def link(vectors: np.ndarray, width: int) -> np.ndarray:
    """Neighbour numbers of one level: (nodes, 2 * width + 1), -1 for none."""
    n = len(vectors)
    links = np.full((n, 2 * width + 1), -1, np.int32)
    if n < 2:
        return links
    reach = min(CANDIDATES, n - 1)
    chosen = np.full((n, width), -1, np.int64)
    far = np.full((n, width), np.inf)
    step = max(1, 2_000_000 // (reach * vectors.shape[1] + n))
    for at in range(0, n, step):
        own = np.arange(at, min(at + step, n))
        d = _distances(vectors[own], vectors)
        d[np.arange(len(own)), own] = np.inf
        near = np.argpartition(d, reach - 1, axis=1)[:, :reach]
        near_d = np.take_along_axis(d, near, 1)
        order = np.argsort(near_d, axis=1, kind="stable")
        near, near_d = np.take_along_axis(near, order, 1), np.take_along_axis(near_d, order, 1)
        v = vectors[near]
        sq = (v * v).sum(-1)
        between = sq[:, :, None] + sq[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        kept = np.zeros(near.shape, bool)
        for c in range(reach):
            hidden = (kept[:, :c] & (between[:, c, :c] < near_d[:, c, None])).any(axis=1)
            kept[:, c] = ~hidden & (kept.sum(axis=1) < width)
        rank = np.argsort(~kept, axis=1, kind="stable")[:, :width]  # passed-over ones fill up
        k = rank.shape[1]
        chosen[own, :k] = np.take_along_axis(near, rank, 1)
        far[own, :k] = np.take_along_axis(near_d, rank, 1)
    out = chosen >= 0
    source = np.repeat(np.arange(n), width).reshape(n, width)
    a = np.concatenate((source[out], chosen[out]))
    b = np.concatenate((chosen[out], source[out]))
    back = np.repeat([0, 1], out.sum())
    d = np.concatenate((far[out], far[out]))
    order = np.lexsort((d, back, a))
    a, b = a[order], b[order]
    seen = set()
    filled = np.zeros(n, np.int64)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if filled[x] < 2 * width and (x, y) not in seen:
            seen.add((x, y))
            links[x, filled[x]] = y
            filled[x] += 1
    _bridge(links)
    return links


def _bridge(links: np.ndarray) -> None:
    """Make every node reachable from node 0; the last column holds the bridges."""
    reached = np.zeros(len(links), bool)
    root = 0
    while True:
        frontier = np.array([root])
        reached[root] = True
        while len(frontier):
            ahead = np.unique(links[frontier])
            frontier = ahead[(ahead >= 0) & ~reached[ahead]]
            reached[frontier] = True
        left = np.flatnonzero(~reached)
        if not len(left):
            return
        links[root, -1] = left[0]
        root = int(left[0])


class ShardGraph:
    """Levels of one shard over its distinct vectors."""

    def __init__(self, vectors: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]) -> None:
        self.vectors = vectors
        self.nodes = nodes  # node numbers of each level; level 0 holds all
        self.links = links

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> ShardGraph:
        u = np.random.default_rng(seed).random(len(vectors))
        level = np.floor(-np.log(np.maximum(u, 1e-12)) / math.log(LINKS)).astype(int)
        nodes, links = [], []
        for k in range(int(level.max(initial=0)) + 1):
            own = np.flatnonzero(level >= k)
            if k and len(own) < 2:
                break
            nodes.append(own)
            links.append(link(vectors[own], LINKS))
        return cls(vectors, nodes, links)

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Node numbers near each query, (queries, beam), -1 for none."""
        entries = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.nodes) - 1, -1, -1):
            width = min(beam if k == 0 else ENTRIES, len(self.nodes[k]))
            found = self._widen(k, queries, entries, width)
            if k:
                real = np.where(found >= 0, self.nodes[k][found], self.nodes[k][found[:, :1]])
                entries = np.searchsorted(self.nodes[k - 1], real)
        return found

    def _widen(self, k: int, queries: np.ndarray, entries: np.ndarray, width: int) -> np.ndarray:
        vectors, links = self.vectors[self.nodes[k]], self.links[k]
        q = len(queries)
        norms = (vectors * vectors).sum(1)
        own = (queries * queries).sum(1)
        seen = np.zeros((q, len(vectors) + 1), bool)
        seen[:, -1] = True  # number -1: none
        ids = np.full((q, width), -1, np.int64)
        dist = np.full((q, width), np.inf)
        open_ = np.zeros((q, width), bool)
        rows, new = np.arange(q), entries
        while len(rows):
            # repeated numbers within a row count once
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.where(seen[rows[:, None], new], -1, new)
            seen[rows[:, None], new] = True
            d = own[rows, None] + norms[new] - 2 * np.einsum("ijk,ik->ij", vectors[new], queries[rows])
            d[new < 0] = np.inf
            all_d = np.concatenate((dist[rows], d), axis=1)
            all_i = np.concatenate((ids[rows], new), axis=1)
            all_o = np.concatenate((open_[rows], new >= 0), axis=1)
            best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            dist[rows] = np.take_along_axis(all_d, best, 1)
            ids[rows] = np.take_along_axis(all_i, best, 1)
            open_[rows] = np.take_along_axis(all_o, best, 1)
            nearest = np.where(open_[rows], dist[rows], np.inf)
            pick = nearest.argmin(axis=1)
            go = open_[rows, pick]
            rows, pick = rows[go], pick[go]
            open_[rows, pick] = False
            new = links[ids[rows, pick]].astype(np.int64)
        ids[~np.isfinite(dist)] = -1
        return ids


def _build(key: tuple, table: pa.Table) -> pa.Table:
    dim, shard = key[0].as_py(), key[1].as_py()
    vectors = table.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    ids = table.column("vec_id").to_numpy()
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, node.ravel()))
    graph = ShardGraph.build(distinct, shard)
    row = {
        "dim": dim,
        "shard": shard,
        "ids": ids[order],
        "id_ends": np.cumsum(np.bincount(node.ravel(), minlength=len(distinct))).astype(np.int32),
        "vectors": distinct.ravel(),
        "level_nodes": [n.astype(np.int32) for n in graph.nodes],
        "level_links": [k.ravel() for k in graph.links],
    }
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
    kinds += [pa.list_(pa.list_(pa.int32()))] * 2
    return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), kinds, strict=True)})


def build_index(
    df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The index table, written to the shared folder: one row per shard and vector length."""
    rows = written(usable(df, vec_id, embedding), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("dim", "shard").applyInArrow(_build, _INDEX), "graphs")


def _search(k: int, beam: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            row = {c: left.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("ids", "id_ends", "vectors")}
            dim = left.column("dim")[0].as_py()
            vectors = row["vectors"].reshape(-1, dim)
            nodes = [np.array(x, np.int64) for x in left.column("level_nodes")[0].as_py()]
            links = [
                np.array(x, np.int32).reshape(len(n), -1)
                for n, x in zip(nodes, left.column("level_links")[0].as_py(), strict=True)
            ]
            queries = right.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            names, of = right.column("query_id").to_numpy(), right.column("query_row").to_numpy()
            begins = np.concatenate(([0], row["id_ends"][:-1]))
            graph = ShardGraph(vectors, nodes, links)
            for at in range(0, len(queries), 256):
                found = graph.search(queries[at : at + 256], beam)
                for i, near in enumerate(found, at):
                    near = near[near >= 0]
                    gap = vectors[near] - queries[i]
                    exact = np.sqrt((gap * gap).sum(axis=1))
                    # equal vectors: the k smallest ids and perhaps the query's own
                    ids = [row["ids"][b : min(b + k + 1, e)] for b, e in zip(begins[near], row["id_ends"][near], strict=True)]
                    scores = np.repeat(exact, [len(x) for x in ids])
                    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                    other = ids != names[i]
                    ids, scores = ids[other], scores[other]
                    best = np.lexsort((ids, scores))[:k]
                    out["query_id"] += [names[i]] * len(best)
                    out["query_row"] += [of[i]] * len(best)
                    out["vec_id"] += ids[best].tolist()
                    out["score"] += scores[best].tolist()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    return search


def search(
    index: DataFrame,
    queries: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = NEIGHBOURS,
    beam: int = BEAM,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query row."""
    asked = written(usable(queries, vec_id, embedding), "queries").withColumnRenamed("vec_id", "query_id")
    asked = asked.withColumn("query_row", F.xxhash64("vec"))
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "vec"), F.lit(blocks)).cast("int"))
    every = asked.join(index.select("dim", F.col("shard").alias("of_shard")), "dim")
    every = every.select("query_id", "query_row", "vec", F.col("dim").alias("of_dim"), "of_shard", F.col("block").alias("of_block"))
    tiles = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sides = tiles.groupBy("dim", "shard", "block"), every.groupBy("of_dim", "of_shard", "of_block")
    found = sides[0].cogroup(sides[1]).applyInArrow(
        _search(k, beam), "query_id bigint, query_row bigint, vec_id bigint, score double"
    )
    best = found.groupBy("query_id", "query_row", "vec_id").agg(F.min("score").alias("score"))
    nearest = Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
