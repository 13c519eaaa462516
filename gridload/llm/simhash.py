"""SimHash near-duplicates: fingerprints, trie self-join, connected components.

Fingerprint: A-Z to lower case, words between ASCII blanks, shingles of ``size`` words
(repeats included by default), one XXH64 each; a bit is set where more than half the hashes have
it. Two fingerprints link at ``budget`` or fewer differing bits.

Longer fingerprints (``words`` of 64 bits, the further ones mixed from the same hashes)
estimate similarity: a share ``d`` of differing bits means a cosine of ``cos(pi d)``.
The stage of the corpus pipeline (``similar_documents``) uses 256 bits over distinct
five-word shingles. There links only name candidates: within the classes that they connect,
the sets of shingles are compared before two texts are united. With 55 bits and bands in
all four words about 99 % of pairs at a similarity of 0.8 are candidates; sets of ten
shingles or less are also candidates by exact parts.

Self-join. Only distinct fingerprints take part, so exact copies cost nothing. A pair
links if it differs in at most ``budget`` bits and in at most one bit of some band. The
three bands of the 64-bit fingerprint make the second condition follow from the first. The
pipeline's 16-bit bands are dealt by halves (see ``link_fingerprints``): 32 rows per fingerprint at any size.
Per band the fingerprints are rotated so that this band leads; they form a binary trie
that is walked as pairs of nodes, adding differing bits and dropping a pair of nodes as
soon as it has more than one in the band or more than ``budget`` in all. The top ``p``
levels of the walk are Spark's: a cell is a pair of prefixes with at most one differing
bit, each fingerprint goes to ``p + 1`` cells per band, and ``p`` follows the number of
fingerprints, so a cell stays small. Prefixes that hold too many all the same are cut
into parts and their cells into pairs of parts: every pair of fingerprints still meets,
in a task of bounded size. A cell returns a spanning forest (at most one edge per
fingerprint), not its pairs, and skips node pairs already in one tree.

Defined results: null and wordless texts have fingerprint zero and link like any other;
a text of fewer words than a shingle is one shingle; repeated rows get the same class;
rows without id belong to the class of their fingerprint, whose name is the smallest
non-null id (null if there is none). No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridload.llm.common import per_text
from gridload.llm.graph import components
from gridload.session import written

SHINGLE = 4
BUDGET = 4
BITS = 64
#: (word, first bit, bits): a pair within BUDGET has a band with one differing bit at most
BANDS = ((0, 0, 21), (0, 21, 21), (0, 42, 22))
#: shingle, words, budget and bands for similarities of 0.8 and more
LONG_SHINGLE, LONG_WORDS, LONG_BUDGET = 5, 4, 55
LONG_BANDS = tuple((k // 4, k % 4 * 16, 16) for k in range(16))
LONG_LEAST = 0.8
#: bands of this many bits are joined by halves
HALVED = 16
#: sets up to this size are too coarse for SimHash and are candidates if they differ by an element
TINY = 10
#: shingles of the sets that one cell compares
SETS_CELL = 1 << 20
#: fingerprints aimed at per prefix, and the most that one cell takes from a prefix
CELL, CELL_MOST = 32_768, 65_536
_CHUNK = 1 << 17
_SMALL, _LARGE = 16, 1 << 12
#: what stands between words
WHITE = " \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes for a word of the fingerprint; the first takes them as they are."""
    if not word:
        return hashes
    h = hashes + np.uint64(0x9E3779B97F4A7C15 * word % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes_of(text: str, size: int) -> np.ndarray:
    """The hash of every shingle of a text, in order; none for a text without words."""
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, "<u8")
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    last = min(size, len(found)) - 1
    ends, starts = ends[last:], starts[: len(found) - last]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    every = np.empty(len(starts), "<u8")
    for at in range(0, len(starts), _CHUNK):
        some = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        every[at : at + _CHUNK] = [digest(view[a:b], seed=42) for a, b in some]
    return every


def _voted(every: np.ndarray, words: int) -> list[int]:
    votes, total = np.zeros((words, BITS), np.int64), len(every)
    for at in range(0, total, _CHUNK):
        for word in range(words):
            octets = np.ascontiguousarray(_mixed(every[at : at + _CHUNK], word)).view(np.uint8).reshape(-1, 8)
            votes[word] += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > total, axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprint(text: Column, size: int = SHINGLE, words: int = 1, repeats: bool = True) -> Column:
    """SimHash of a text: an array of ``words`` signed longs. ``repeats``: a shingle votes
    as often as it occurs, else once."""

    def one(text: str) -> list[int]:
        every = _hashes_of(text, size)
        return _voted(every if repeats else np.unique(every), words)

    def all_of(texts: list[str]) -> list[list[int]]:
        return [one(t) for t in texts]

    return per_text(lambda: all_of, "array<bigint>")(text)


def _digest(every: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(every.tobytes(), seed=42)).astype(np.int64))


def sketch(text: Column, size: int, words: int) -> Column:
    """(fp, node, n, parts) of a text's set of distinct shingles: its fingerprint, a 64-bit
    hash of the set, its size, and for sets of ``TINY`` or less the hashes of the set
    without one element."""

    def one(every: np.ndarray) -> dict:
        parts = [_digest(np.delete(every, k)) for k in range(len(every))] if 1 < len(every) <= TINY else []
        return {"fp": _voted(every, words), "node": _digest(every), "n": len(every), "parts": parts}

    def all_of(texts: list[str]) -> list[dict]:
        return [one(np.unique(_hashes_of(t, size))) for t in texts]

    return per_text(lambda: all_of, "struct<fp:array<bigint>,node:bigint,n:int,parts:array<bigint>>")(text)


def shingle_set(text: Column, size: int) -> Column:
    """The distinct shingle hashes of a text, sorted as unsigned numbers."""

    def all_of(texts: list[str]) -> list[np.ndarray]:
        return [np.unique(_hashes_of(t, size)).view("<i8") for t in texts]

    return per_text(lambda: all_of, "array<bigint>")(text)


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


class TrieWalk:
    """Walk of node pairs over tries of fingerprints.

    ``lead`` is the rotated word with the band in front, sorted within each trie;
    ``full`` holds all words in the same order.
    """

    def __init__(self, lead: np.ndarray, full: np.ndarray, band_bits: int, budget: int) -> None:
        self.lead, self.full = lead, full
        self.band_bits, self.budget = band_bits, budget
        self.root = np.arange(len(lead))
        self.ones: dict[int, np.ndarray] = {}
        self.changes: np.ndarray | None = None

    def join(self, a: tuple[int, int], b: tuple[int, int], depth: int, differing: int) -> None:
        """Link the fingerprints at ``a`` with those at ``b``, two nodes (or one) at ``depth``."""
        stack = [(depth, np.array([[*a, *b, differing]], np.int64))]
        while stack:
            depth, pairs = stack.pop()
            if len(pairs) > _CHUNK:
                stack += [(depth, pairs[i : i + _CHUNK]) for i in range(0, len(pairs), _CHUNK)]
                continue
            pairs = self._not_yet_joined(pairs)
            size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
            small = size <= (_SMALL if depth < BITS else _LARGE)
            self._compare(pairs[small])
            pairs = pairs[~small]
            if not len(pairs):
                continue
            if depth < BITS:
                stack.append((depth + 1, self._children(pairs, depth)))
            else:  # the same word many times over: halve, so that joined parts are skipped
                stack += [(depth, some) for some in np.array_split(self._halves(pairs), 4) if len(some)]

    def _not_yet_joined(self, pairs: np.ndarray) -> np.ndarray:
        if self.changes is None or not len(pairs):
            return pairs
        first, last = pairs[:, [0, 2]], pairs[:, [1, 3]] - 1
        whole = (self.changes[first] == self.changes[last]).all(axis=1)
        return pairs[~(whole & (self.root[first[:, 0]] == self.root[first[:, 1]]))]

    @staticmethod
    def _split(pairs: np.ndarray, a1: np.ndarray, b1: np.ndarray) -> np.ndarray:
        a0, a2, b0, b2, diff = pairs.T
        cross = a0 != b0
        out = np.concatenate(
            (
                np.column_stack((a0, a1, b0, b1, diff)),
                np.column_stack((a1, a2, b1, b2, diff)),
                np.column_stack((a0, a1, b1, b2, diff + 1)),
                np.column_stack((a1, a2, b0, b1, diff + 1))[cross],
            )
        )
        return out[(out[:, 0] < out[:, 1]) & (out[:, 2] < out[:, 3])]

    def _halves(self, pairs: np.ndarray) -> np.ndarray:
        out = self._split(pairs, pairs[:, :2].sum(axis=1) // 2, pairs[:, 2:4].sum(axis=1) // 2)
        out[:, 4] = 0
        return out

    def _children(self, pairs: np.ndarray, depth: int) -> np.ndarray:
        if depth not in self.ones:
            bit = (self.lead >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self.ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        ones = self.ones[depth]
        a0, a2, b0, b2, _ = pairs.T
        out = self._split(pairs, a2 - (ones[a2] - ones[a0]), b2 - (ones[b2] - ones[b0]))
        return out[out[:, 4] <= (min(1, self.budget) if depth < self.band_bits else self.budget)]

    def _compare(self, pairs: np.ndarray) -> None:
        width = pairs[:, 3] - pairs[:, 2]
        count = (pairs[:, 1] - pairs[:, 0]) * width
        total = np.cumsum(count)
        at = 0
        while at < len(pairs):  # about a million comparisons at a time
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")))
            some, wide, n = pairs[at:to], width[at:to], count[at:to]
            of = np.repeat(np.arange(len(some)), n)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            i, j = some[of, 0] + nth // wide[of], some[of, 2] + nth % wide[of]
            differing = np.bitwise_count(self.full[i] ^ self.full[j]).sum(axis=1, dtype=np.int64)
            band = np.bitwise_count((self.lead[i] ^ self.lead[j]) >> np.uint64(BITS - self.band_bits))
            near = (differing <= self.budget) & (band <= 1)
            self._unite(i[near], j[near])
            at = to

    def _unite(self, i: np.ndarray, j: np.ndarray) -> None:
        changed = False
        while True:
            low, high = np.minimum(self.root[i], self.root[j]), np.maximum(self.root[i], self.root[j])
            apart = low != high
            if not apart.any():
                break
            np.minimum.at(self.root, high[apart], low[apart])
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
            changed = True
        if changed:
            steps = np.diff(self.root, prepend=self.root[:1]) != 0
            self.changes = np.cumsum(steps)


def _rotate(values: np.ndarray, by: int) -> np.ndarray:
    return (values << np.uint64(by)) | (values >> np.uint64(BITS - by)) if by else values


def _halves_swapped(lead: np.ndarray, bits: int) -> np.ndarray:
    """The leading ``bits`` with their two halves exchanged."""
    half = bits // 2
    rest = lead & np.uint64((1 << (BITS - bits)) - 1)
    first, second = lead >> np.uint64(BITS - half), (lead >> np.uint64(BITS - bits)) & np.uint64((1 << half) - 1)
    return second << np.uint64(BITS - half) | first << np.uint64(BITS - bits) | rest


def _walk_cells(bands: tuple, prefix_bits: int, budget: int, halves: bool = False):
    def walk(key: tuple, table: pa.Table) -> pa.Table:
        band, low, high, first, second = (k.as_py() for k in key)
        word, by, band_bits = bands[band // 2 if halves else band]
        nodes = table.column("node").to_numpy()
        full = table.column("fp").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
        full = np.ascontiguousarray(full, "<i8").view("<u8")
        lead = _rotate(full[:, word], by)
        if halves and band % 2:
            lead = _halves_swapped(lead, band_bits)
        prefix, part = table.column("prefix").to_numpy(), table.column("part").to_numpy()
        left = np.flatnonzero((prefix == low) & (part == first))
        order = left = left[np.argsort(lead[left])]
        one_side = low == high and first == second
        if not one_side:
            right = np.flatnonzero((prefix == high) & (part == second))
            order = np.concatenate((left, right[np.argsort(lead[right])]))
        walker = TrieWalk(lead[order], full[order], band_bits, budget)
        a = (0, len(left))
        walker.join(a, a if one_side else (len(left), len(order)), prefix_bits, int(low != high))
        linked = np.flatnonzero(walker.root != np.arange(len(order)))
        return pa.table({"a": nodes[order[linked]], "b": nodes[order[walker.root[linked]]]})

    return walk


def link_fingerprints(
    distinct: DataFrame,
    *,
    bands: tuple = BANDS,
    budget: int = BUDGET,
    cell: int = CELL,
    cell_most: int = CELL_MOST,
    halves: bool = False,
) -> DataFrame:
    """Edges (a, b) between nodes that connect all linked fingerprints.

    ``distinct`` holds each fingerprint ``fp`` once, with a long ``node`` for it. The
    edges have the same connected components as the full set of links. With ``halves`` a cell
    is a value of half a band (of an even number of bits): two fingerprints with at most one differing
    bit in the band agree in one half, so each goes to two cells per band, however many there are; only where
    such cells grow too large, bits of the other half are added.
    """
    total = distinct.count()
    most = min(b for _, _, b in bands)
    fixed = most // 2 if halves else 0
    bits = min(max(fixed, int(np.ceil(np.log2(max(total, 1) / cell)))), most)
    leads = []
    for k, (word, by, band_bits) in enumerate(bands):
        lead = f"shiftleft(fp[{word}], {by}) | shiftrightunsigned(fp[{word}], {BITS - by})" if by else f"fp[{word}]"
        if not halves:
            leads.append(F.struct(F.lit(k).alias("band"), F.expr(lead).alias("lead")))
            continue
        half, tail = band_bits // 2, BITS - band_bits
        first, low = f"shiftrightunsigned({lead}, {BITS - half})", (1 << half) - 1
        second = f"(shiftrightunsigned({lead}, {tail}) & {low}L)"
        # only the band is looked at here: the bits after it stay zero
        ways = ((first, second), (second, first))
        for nth, (one, other) in enumerate(ways):
            led = f"shiftleft({one}, {BITS - half}) | shiftleft({other}, {tail})"
            leads.append(F.struct(F.lit(2 * k + nth).alias("band"), F.expr(led).alias("lead")))
    prefix = F.shiftrightunsigned("lead", BITS - bits) if bits else F.lit(0).cast("bigint")
    homes = distinct.select("node", "fp", F.inline(F.array(*leads)))
    homes = homes.select("node", "fp", "band", prefix.alias("prefix"))
    parts = (
        homes.groupBy("band", "prefix").count().filter(F.col("count") > cell_most)
        .select("band", "prefix", F.ceil(F.col("count") / cell_most).cast("int").alias("parts"))
    )
    parts = written(parts, "parts")  # of known size: the joins below need no shuffle while it is small
    others = [F.col("prefix")] + [F.col("prefix").bitwiseXOR(F.lit(1 << i)) for i in range(bits - fixed)]
    met = homes.withColumn("other", F.explode(F.array(*others)))
    met = met.join(parts, ["band", "prefix"], "left").join(
        parts.select("band", F.col("prefix").alias("other"), F.col("parts").alias("other_parts")),
        ["band", "other"],
        "left",
    )
    own, other = F.coalesce("parts", F.lit(1)), F.coalesce("other_parts", F.lit(1))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), own).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), other - 1)))
    below = F.col("prefix") < F.col("other")
    low, high = F.least("prefix", "other"), F.greatest("prefix", "other")
    same = F.col("prefix") == F.col("other")
    first = F.when(same, F.least("part", "with")).otherwise(F.when(below, F.col("part")).otherwise(F.col("with")))
    second = F.when(same, F.greatest("part", "with")).otherwise(F.when(below, F.col("with")).otherwise(F.col("part")))
    cells = met.select(
        "band", low.alias("low"), high.alias("high"), first.alias("i"), second.alias("j"), "node", "fp", "prefix", "part"
    )
    return cells.groupBy("band", "low", "high", "i", "j").applyInArrow(
        _walk_cells(bands, bits, budget, halves), "a bigint, b bigint"
    )


class SetJoin:
    """Unites sets whose Jaccard similarity is ``least`` or more.

    Set ``i`` holds ``values[ends[i] - sizes[i] : ends[i]]``. Pairs that differ by more than
    ``budget`` bits are no candidates, unless both are tiny; pairs already in one tree are not compared.
    """

    def __init__(self, values: np.ndarray, sizes: np.ndarray, full: np.ndarray, least: float, budget: int) -> None:
        vocabulary, self.ids = np.unique(values, return_inverse=True)
        self.sizes, self.ends, self.full = sizes, np.cumsum(sizes), full
        self.least, self.budget = least, budget
        self.marked = np.zeros(len(vocabulary), bool)
        self.root = np.arange(len(sizes))

    def _of(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] - self.sizes[i] : self.ends[i]]

    def _candidates(self, i: int, others: np.ndarray) -> np.ndarray:
        others = others[self.root[others] != self.root[i]]
        low, high = np.minimum(self.sizes[i], self.sizes[others]), np.maximum(self.sizes[i], self.sizes[others])
        others = others[low >= self.least * high * (1 - 1e-9)]
        differing = np.bitwise_count(self.full[others] ^ self.full[i]).sum(axis=1, dtype=np.int64)
        tiny = np.maximum(self.sizes[others], self.sizes[i]) <= TINY
        return others[(differing <= self.budget) | tiny]

    def join(self, i: int, others: np.ndarray) -> None:
        others = self._candidates(i, others)
        if not len(others):
            return
        self.marked[self._of(i)] = True
        at, to = 0, 1
        while at < len(others):  # a few sets first: one of them may stand for the rest
            some = others[at:to]
            some = some[self.root[some] != self.root[i]]
            if len(some):
                starts = np.cumsum(self.sizes[some]) - self.sizes[some]
                shared = np.add.reduceat(self.marked[np.concatenate([self._of(k) for k in some])].astype(np.int64), starts)
                near = some[shared / (self.sizes[i] + self.sizes[some] - shared) >= self.least]
                if len(near):
                    trees = np.unique(self.root[np.append(near, i)])
                    self.root[np.isin(self.root, trees)] = trees[0]
            at, to = to, to + min(2 * (to - at), 256)
        self.marked[self._of(i)] = False


def _check_cells(least: float, budget: int):
    def check(key: tuple, table: pa.Table) -> pa.Table:
        _, first, second = (k.as_py() for k in key)
        table = table.combine_chunks().sort_by([("root", "ascending"), ("node", "ascending")])
        roots, parts = table.column("root").to_numpy(), table.column("part").to_numpy()
        nodes, lists = table.column("node").to_numpy(), table.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        values, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
        full = table.column("fp").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
        full = np.ascontiguousarray(full, "<i8").view("<u8")
        cuts = np.flatnonzero(np.diff(roots, prepend=roots[0] - 1 if len(roots) else 0))
        a, b = [], []
        for low, high in zip(cuts, [*cuts[1:], len(nodes)], strict=True):
            joined = SetJoin(
                values[ends[low] - sizes[low] : ends[high - 1]], sizes[low:high], full[low:high], least, budget
            )
            own, left = np.arange(high - low), np.flatnonzero(parts[low:high] == first)
            right = np.flatnonzero(parts[low:high] == second)
            for nth, i in enumerate(left):
                joined.join(i, left[nth + 1 :] if first == second else right)
            linked = np.flatnonzero(joined.root != own)
            a.append(nodes[low:high][linked])
            b.append(nodes[low:high][joined.root[linked]])
        none = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return check


def similar_sets(
    members: DataFrame, *, least: float, budget: int, cell: int = SETS_CELL, buckets: int | None = None
) -> DataFrame:
    """Edges (a, b) that connect all pairs of one candidate class whose sets have a Jaccard
    similarity of ``least`` or more and fingerprints within ``budget`` bits.

    ``members`` holds (node, root, fp, n, shingles): ``root`` names the candidate class. A
    cell has many small classes, or two parts of a class of more than ``cell`` shingles.
    """
    spark = members.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(buckets, -(-total // cell))
    parts = (
        members.groupBy("root").agg(F.sum("n").alias("total")).filter(F.col("total") > cell)
        .select("root", F.ceil(F.col("total") / cell).cast("int").alias("parts"))
    )
    met = members.join(parts, "root", "left")
    count = F.coalesce("parts", F.lit(1))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), count).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), count - 1)))
    bucket = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.col("root"))
    cells = met.select(
        bucket.alias("bucket"), F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"),
        "root", "node", "fp", "part", "shingles",
    )
    return cells.groupBy("bucket", "i", "j").applyInArrow(_check_cells(least, budget), "a bigint, b bigint")


def similar_documents(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = LONG_SHINGLE,
    words: int = LONG_WORDS,
    least: float = LONG_LEAST,
    bands: tuple = LONG_BANDS,
    budget: int = LONG_BUDGET,
    **links,
) -> DataFrame:
    """(doc_id, component_id, key, class, n) per row: classes of texts connected by pairs whose
    sets of shingles have a Jaccard similarity of ``least`` or more. ``key`` is the text's hash,
    ``class`` names the class whatever its ids, ``n`` is the size of the set.

    SimHash links only name candidates: they connect candidate classes, within which the
    sets of distinct texts are compared before two of them are united.
    """
    key = F.xxhash64(F.col(text).cast("string"))
    marked = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), sketch(F.col(text), size, words).alias("s"))
    marked = written(marked.select("doc_id", "key", "s.*"), "fingerprints")
    groups = written(
        marked.groupBy("node").agg(
            F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("parts").alias("parts"), F.min("doc_id").alias("least"), F.min("key").alias("key")
        ),
        "fingerprints",
    )
    links = {"halves": all(b == HALVED for _, _, b in bands), **links}
    edges = link_fingerprints(groups.select("node", "fp"), bands=bands, budget=budget, **links)
    tiny = groups.select(F.col("node").alias("a"), F.explode("parts").alias("b"))
    # the same part of two sets links them, a set that is the part of another as well
    least_of = tiny.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("sets"))
    least_of = least_of.join(groups.select(F.col("node").alias("b"), F.col("node").alias("whole")), "b", "left")
    least_of = least_of.filter((F.col("sets") > 1) | F.col("whole").isNotNull())
    tiny = tiny.join(least_of.select("b", F.coalesce("whole", "m").alias("m")), "b").select("a", F.col("m").alias("b"))
    edges = edges.unionByName(tiny)
    members = written(groups.join(components(edges), "node").select("node", "root", "fp", "n", "key"), "candidates")
    texts = docs.select(key.alias("key"), F.col(text).cast("string").alias("text"))
    texts = texts.join(members.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = texts.select("key", shingle_set(F.col("text"), size).alias("shingles"))
    members = written(members.join(sets, "key").drop("key"), "shingles")
    classes = components(similar_sets(members, least=least, budget=budget))
    named = groups.select("node", "least").join(classes, "node", "left")
    names = named.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root", "left").select(
        "node",
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("root", "node").alias("class"),
    )
    rows = marked.select("doc_id", "key", "node", "n")
    return rows.join(named, "node").select("doc_id", "component_id", "key", "class", "n")


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    words: int = 1,
    repeats: bool = True,
    **links,
) -> DataFrame:
    """(doc_id, fp, component_id, copies) per row of ``docs``.

    ``component_id`` is the smallest id reachable over links; ``copies`` is the number
    of rows with the same fingerprint. ``links`` are options of ``link_fingerprints``.
    """
    mark = fingerprint(F.col(text), size, words, repeats)
    marked = docs.select(F.col(doc_id).alias("doc_id"), mark.alias("fp"))
    # a node is the fingerprint itself, or a 64-bit hash of a longer one
    marked = written(marked.withColumn("node", F.col("fp")[0] if words == 1 else F.xxhash64("fp")), "fingerprints")
    groups = marked.groupBy("node").agg(
        F.first("fp").alias("fp"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    groups = written(groups, "fingerprints")
    edges = link_fingerprints(groups.select("node", "fp"), **links)
    classes = components(edges)
    named = groups.drop("fp").join(classes, "node", "left")
    linked = named.filter(F.col("root").isNotNull())
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root", "left").select(
        "node",
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        "copies",
    )
    return marked.join(named, "node").select("doc_id", "fp", "component_id", "copies")


def drop_near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """Keep one row per class of ``near_duplicates``: the one whose id, which must be unique,
    names it. Rows without id all stay."""
    classes = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    keep = classes.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    nth = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_first()))
    one = docs.join(keep, doc_id, "left_semi").select("*", nth.alias("_nth")).filter("_nth = 1").drop("_nth")
    return one.select(*docs.columns).unionByName(docs.filter(F.col(doc_id).isNull()))


def drop_similar(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Keep one row per class of ``similar_documents``: the one with the smallest id (rows without
    id last), then the smallest hash of the text. Rows without a word all stay.

    Rows are told apart by id and text, so equal ids with unrelated texts both stay; of rows that
    are equal in both one stays.
    """
    found = similar_documents(docs, doc_id=doc_id, text=text, **options)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    best = found.filter("n > 0").groupBy("class").agg(F.min_by(F.struct("doc_id", "key"), rank).alias("best"))
    keep = best.select(F.col("best.doc_id").alias("id"), F.col("best.key").alias("key"))
    keep = keep.select(F.xxhash64(F.col("id").cast("string")).alias("named"), "id", "key")
    whole = F.col(text).cast("string")
    rows = docs.select(
        F.struct(*docs.columns).alias("all"),
        F.xxhash64(F.col(doc_id).cast("string")).alias("named"),
        F.xxhash64(whole).alias("key"),
        F.coalesce(F.length(F.translate(whole, WHITE, "")) == 0, F.lit(True)).alias("blank"),
    )
    met = rows.filter("not blank").join(keep, ["named", "key"])
    met = met.filter(F.col("all")[doc_id].eqNullSafe(F.col("id")))
    nth = F.row_number().over(Window.partitionBy("named", "key").orderBy(F.hash("all")))
    one = met.withColumn("nth", nth).filter("nth = 1")
    kept = one.select("all").unionByName(rows.filter("blank").select("all"))
    return kept.select(*[F.col("all")[c].alias(c) for c in docs.columns])
