"""Benchmark decontamination with a generalised suffix automaton of words.

The normalised test items become one automaton over words. Each document streams its
words through it; the state carries the longest suffix that occurs in some item. Where
that length reaches the window, the window is hit, and the state tells which items hold
it. No shuffle takes place: documents pass through once, whatever their size.

Normalisation: A-Z to lower case; words are runs of ASCII letters, ASCII digits and
non-ASCII characters. A window is ``window`` consecutive words of an item; an item with
fewer words (but at least one) is a window of its own.

Defined results: null or wordless texts have 0 words and no hits; null items and items
without words are ignored; repeated items count once by id; an item without id hits
but is not listed; repeated documents are treated alike; no documents give no rows, an
empty benchmark gives no hits. Columns are addressed by the given names only, results
get the name given in ``into``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import per_text
from gridload.session import written

WINDOW = 10
MAX_COVERAGE = 0.5
#: words of items in one automaton; larger benchmarks are searched in several passes
BLOCK_WORDS = 200_000

_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
#: first and last are word numbers, start and end code points; last and end are exclusive
RESULT = (
    "struct<n_words:bigint,items:array<string>,"
    "spans:array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>>"
)


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class ItemAutomaton:
    """Suffix automaton of all items, with the items behind each state."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        known = [(name, [self.words.setdefault(w, len(self.words)) for w in ws]) for name, ws in items if ws]
        for _, ws in known:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.shortest = min((min(len(ws), window) for _, ws in known), default=window)
        self._own_items(known)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            old = nxt[last][word]
            return old if length[old] == length[last] + 1 else self._clone(last, word, old)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            old = nxt[at][word]
            link[new] = old if length[old] == length[at] + 1 else self._clone(at, word, old)
        return new

    def _clone(self, at: int, word: int, old: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[old]))
        link.append(link[old])
        length.append(length[at] + 1)
        link[old] = new
        while at >= 0 and nxt[at].get(word) == old:
            nxt[at][word] = new
            at = link[at]
        return new

    def _own_items(self, known: list[tuple[str | None, list[int]]]) -> None:
        """Items holding a state's words (states of a window or more), and short items."""
        window, link, length = self.window, self.link, self.length
        self.items: dict[int, set] = {}
        short: dict[int, set] = {}
        for name, ws in known:
            at = 0
            for w in ws:
                at = self.next[at][w]
                up = at
                while up > 0 and length[up] >= window:
                    mine = self.items.setdefault(up, set())
                    if name in mine:
                        break
                    mine.add(name)
                    up = link[up]
            if len(ws) < window:
                short.setdefault(at, set()).add((len(ws), name))
        #: state whose longest words are cut to one window
        self.top = [0] * len(link)
        self.short: list[tuple] = [()] * len(link)
        for state in sorted(range(1, len(link)), key=length.__getitem__):
            up = link[state]
            if length[state] >= window:
                self.top[state] = self.top[up] if length[up] >= window else state
            self.short[state] = (*self.short[up], *short.get(state, ()))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Hit flag per word, and the items with occurring windows."""
        n = len(words)
        hit = np.zeros(n, bool)
        found: set = set()
        if n < self.shortest or not self.words:
            return hit, found
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, n)
        # an unknown word resets the automaton: only runs of known words can match
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= self.shortest:
                self._stream(ids[start:end].tolist(), start, hit, found)
        return hit, found

    def _stream(self, ids: list[int], start: int, hit: np.ndarray, found: set) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for at, word in enumerate(ids, start + 1):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            if matched >= window:
                hit[at - window : at] = True
                found |= self.items[self.top[state]]
            for size, name in self.short[state]:
                if size <= matched:
                    hit[at - size : at] = True
                    found.add(name)


def _scanner(automaton: ItemAutomaton):
    def scan(texts: list[str]) -> list[dict]:
        out = []
        for text in texts:
            words = split_words(text)
            hit, found = automaton.scan(words)
            spans = []
            if found:
                at = [m.span() for m in _WORD.finditer(text)]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                spans = [
                    {"first": a, "last": b, "start": at[a][0], "end": at[b - 1][1]}
                    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
                ]
            items = sorted(x for x in found if x is not None)
            out.append({"n_words": len(words), "items": items, "spans": spans})
        return out

    return scan


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    into: str = "leaks",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Add ``into``: a struct of n_words, n_hit, items (ids as text, sorted) and spans.

    The benchmark's size is measured first and cut into blocks of about ``block_words``
    words, so each broadcast automaton is bounded. One block is one pass without any
    shuffle; further blocks are further passes over a written table.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    items = items.filter(F.col("t").isNotNull())
    size = items.agg(F.sum(F.size(F.split("t", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    blocks = 1 + size // block_words
    parts = [f"_{into}_{block}" for block in range(blocks)]
    for block, part in enumerate(parts):
        rows = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        pairs = [(r.i, split_words(r.t)) for r in rows.toLocalIterator()]
        shared = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(pairs, window))
        scan = per_text(lambda shared=shared: _scanner(shared.value), RESULT)
        docs = docs.withColumn(part, scan(F.col(text)))
        if blocks > 1:
            docs = written(docs)
    every = F.array(*parts)
    spans = F.flatten(F.transform(every, lambda p: p["spans"]))
    united = F.struct(
        F.col(parts[0])["n_words"].alias("n_words"),
        F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"] - 1)))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(every, lambda p: p["items"])))).alias("items"),
        F.array_sort(spans).alias("spans"),
    )
    docs = docs.withColumn(into, united).drop(*parts)
    return docs.withColumn(
        into, F.col(into).withField("n_hit", F.size(F.col(into)["hit"]).cast("bigint")).dropFields("hit")
    )


def without(text: Column, spans: Column) -> Column:
    """The text without the sorted spans, which may overlap; each leaves one blank."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("kept"))

    def cut(state: Column, span: Column) -> Column:
        gap = F.greatest(span["start"] - state["at"], F.lit(0)).cast("int")
        kept = F.concat(state["kept"], F.substring(text, (state["at"] + 1).cast("int"), gap))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), kept.alias("kept"))

    def end(state: Column) -> Column:
        return F.concat(state["kept"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, cut, end))


def remove_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    max_coverage: float = MAX_COVERAGE,
    **options,
) -> DataFrame:
    """Cut hit spans out of ``text``; drop rows with more than ``max_coverage`` words hit.

    Rows without hits come back unchanged, with the same columns.
    """
    mark = "_leaks"
    while any(c.lower().startswith((mark, f"_{mark}_")) for c in docs.columns):
        mark += "_"
    found = find_leaks(docs, benchmark, text=text, into=mark, **options)
    kept = found.filter(F.col(mark)["n_hit"] <= F.lit(max_coverage) * F.col(mark)["n_words"])
    return kept.withColumn(text, without(F.col(text), F.col(mark)["spans"])).drop(mark)
