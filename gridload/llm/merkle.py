"""Merkle manifest of a dataset: one tree per source, one tree over the sources.

A row's leaf is H (lower-case hex SHA-256) of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and the value. Within a tree every 16 consecutive nodes (the last run may be
shorter, even a single one) become their H, until one node is left. The nodes of each source's
leaves, ascending by id, give its subroot; the subroots, by source, give the root.

Trees are persistent. A changed leaf makes a version of the tree that owns new copies of its
ancestors only and shares all other nodes with the base; no version is ever built anew.

How it runs. Leaves are numbered within their source by a range shuffle (``common.numbered``).
A block is an aligned run of ``16**LEVELS`` nodes, whatever the size of the source: the first
sweep folds each block to its top node in one task of bounded memory, the tops are the nodes of
the next, 4,096 times smaller table, and so on until every tree has one node. The way
back goes from the top table down: each block gets the siblings above it (16 digests a
level), and passes them on, extended, to the blocks below. In the last sweep a block of leaves
holds its own persistent tree; a changed leaf copies its ancestors within the block, and the
version goes on upwards along the block's siblings. Versions of one dataset thus grow
side by side in all tasks; no task or driver holds a tree.

Defined results: a null source is a tree of its own and sorts first; an empty text is
a value of zero bytes; rows without id come first in their source and are never tampered
with by the query; equal ids are ordered by leaf; repeated rows are leaves of their own, and
each has its own siblings (so proofs of equal rows may differ in order only). Texts of any
length are hashed whole by Spark; only digests travel. No rows give no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import numbered, sorted_groups
from gridload.session import discard, written

FAN = 16
#: levels of a block: 4,096 nodes
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: the tree over the sources
ROOTS = ""


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf(values: list[Column]) -> Column:
    """Digest of a row's fields."""

    def told(value: Column) -> Column:
        text = value.cast("string")
        size = F.octet_length(text).cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), text))

    return F.sha2(F.concat(*[told(v) for v in values]), 256)


def height(size: int) -> int:
    """Levels above ``size`` nodes."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


class PersistentTree:
    """A block's base tree: ``levels[0]`` are its nodes, ``levels[-1]`` its top."""

    def __init__(self, nodes: list[str], levels: int) -> None:
        self.levels = [nodes]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """(digests to the left, to the right) in the node's run, level by level."""
        found = []
        for nodes in self.levels[:-1]:
            first = at - at % FAN
            found.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + FAN])))
            at //= FAN
        return found


class Version:
    """The tree with another digest in one place: owns the path from there to the top,
    shares every other node with ``base``."""

    def __init__(self, base: PersistentTree, at: int, node: str) -> None:
        self.base, self.at = base, at
        self.path = [node]
        for left, right in base.siblings(at):
            self.path.append(digest(left + self.path[-1] + right))

    def node(self, level: int, at: int) -> str:
        return self.path[level] if at == self.at // FAN**level else self.base.levels[level][at]

    def grown(self, above: list[tuple[str, str]]) -> list[str]:
        """Its path continued over the siblings above the block."""
        path = list(self.path)
        for left, right in above:
            path.append(digest(left + path[-1] + right))
        return path


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """One sweep up: (tree, at, node, size) of the top nodes of all blocks of ``nodes``."""

    block = FAN**levels

    def make():
        def fold(groups) -> Iterator[tuple]:
            for (tree, at), rows in groups:
                rows = [(node, size) for _, _, node, size, _ in rows]
                size = rows[0][1]
                top = PersistentTree([n for n, _ in rows], min(levels, height(size))).top
                yield tree, at, top, -(-size // block)

        return fold

    cut = nodes.select("tree", "at", "node", "size", F.floor(F.col("at") / block).alias("block"))
    return sorted_groups(cut, ["tree", "block"], ["at"], make, "tree string, at bigint, node string, size bigint")


_PAIRS = "array<struct<left:string,right:string>>"


def _with_above(nodes: DataFrame, above: DataFrame, levels: int, *extra: str) -> DataFrame:
    """Nodes and, ahead of them in each block, the block's row of ``above``."""
    block = F.floor(F.col("at") / FAN**levels)
    below = nodes.select("tree", block.alias("block"), "at", "node", "size", F.lit(None).cast(_PAIRS).alias("above"), *extra)
    lead = above.select("tree", F.col("at").alias("block"), F.lit(-1).cast("bigint").alias("at"), "node",
                        F.lit(0).cast("bigint").alias("size"), "above",
                        *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in extra])
    return below.unionByName(lead)


def _led(rows: Iterator[tuple], levels: int) -> tuple[list, str, list[tuple], PersistentTree]:
    """(siblings above, node above, rows, tree) of a block led by its row of ``above``."""
    lead = next(rows)
    above = [(p["left"], p["right"]) for p in lead[5]]
    rows = list(rows)
    return above, lead[3], rows, PersistentTree([r[3] for r in rows], min(levels, height(rows[0][4])))


def _descend(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """One sweep down: (tree, at, node, above) of ``nodes``; ``above`` lists siblings up to
    the root, ``node`` carries the subroot."""

    def make():
        def extend(groups) -> Iterator[tuple]:
            for (tree, _), rows in groups:
                higher, subroot, rows, base = _led(rows, levels)
                for nth, row in enumerate(rows):
                    pairs = base.siblings(nth) + higher
                    yield tree, row[2], subroot, [{"left": a, "right": b} for a, b in pairs]

        return extend

    met = _with_above(nodes, above, levels)
    return sorted_groups(
        met, ["tree", "block"], ["at"], make, f"tree string, at bigint, node string, above {_PAIRS}"
    )


def _raised(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` and the tables of block tops above them; the last has one node per tree."""
    tables = [nodes]
    while (tables[-1].agg(F.max("size")).first()[0] or 0) > 1:
        tables.append(written(_tops(tables[-1], levels), "tops"))
    return tables


def _siblings_of_tops(tops: DataFrame, levels: int) -> tuple[DataFrame, str | None]:
    """(tree, at, node, above) of every tree's subroot, and the root of all."""
    named = tops.select(F.lit(ROOTS).alias("root_tree"), "tree", "node")
    placed = numbered(named, "root_tree", ["tree"], "at", "size")
    placed = written(placed, "subroots")
    nodes = placed.select(F.col("root_tree").alias("tree"), "at", "node", "size")
    tables = _raised(nodes, levels)
    root = tables[-1].first()
    if root is None:
        return tops.select("tree", "at", "node", F.array().cast(_PAIRS).alias("above")), None
    above = tables[-1].select("tree", "at", "node", F.array().cast(_PAIRS).alias("above"))
    for table in reversed(tables[:-1]):
        above = _descend(table, above, levels)
    found = placed.join(above.select("at", "above"), "at")
    return found.select("tree", F.lit(0).cast("bigint").alias("at"), "node", "above"), root["node"]


def manifest(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    fields: tuple = FIELDS,
    changed: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """(doc_id, source, at, leaf, subroot, root, proof_sha256, copied, folded_root) per row.

    ``changed`` names fields with another value in a tampered row: such a row's version owns
    the digests ``copied``, from its leaf to its root (null where nothing changed), and
    ``folded_root`` is the version's root, else the root folded from leaf and siblings.
    Blocks have ``levels`` levels.
    """
    changed = changed or {}
    mine = leaf([F.col(f) for f in fields])
    other = leaf([changed.get(f, F.col(f)) for f in fields])
    source_text = F.col(source).cast("string")
    leaves = docs.select(
        F.col(doc_id).alias("doc_id"),
        # null sorts before every source
        F.when(source_text.isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), source_text)).alias("tree"),
        mine.alias("node"),
        F.when(other != mine, other).alias("other"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = written(leaves, "leaves")
    placed = written(numbered(leaves, "tree", ["doc_id", "node", "row"], "at", "size"), "numbered")
    discard(leaves)
    tables = _raised(placed.select("tree", "at", "node", "size"), levels)
    above, root = _siblings_of_tops(tables[-1], levels)
    for table in reversed(tables[1:-1]):
        above = _descend(table, above, levels)

    def make():
        def versions(groups) -> Iterator[tuple]:
            for (tree, _), rows in groups:
                higher, subroot, rows, base = _led(rows, levels)
                upper = "".join(a + b for a, b in higher)
                for nth, (_, _, at, node, _, _, of, other) in enumerate(rows):
                    siblings = base.siblings(nth)
                    proof = digest("".join(a + b for a, b in siblings) + upper)
                    if other is None:
                        copied, folded = None, node
                        for left, right in siblings + higher:
                            folded = digest(left + folded + right)
                    else:
                        copied = Version(base, nth, other).grown(higher)
                        folded = copied[-1]
                    yield of, None if tree == "-" else tree[1:], at, node, subroot, root, proof, copied, folded

        return versions

    kind = docs.schema[doc_id].dataType.simpleString()
    met = _with_above(placed, above, levels, "doc_id", "other")
    return sorted_groups(
        met,
        ["tree", "block"],
        ["at"],
        make,
        f"doc_id {kind}, source string, at bigint, leaf string, subroot string, root string, "
        "proof_sha256 string, copied array<string>, folded_root string",
    )
