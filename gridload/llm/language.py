"""Language identification by cross-parsing against suffix automata.

Every language has a suffix automaton of labelled text. A text is cut greedily into
phrases, each the longest piece from here on that occurs somewhere in the language's
text; a language that knows the text needs few phrases. Phrases times the bits needed
to point into the automaton, per character, is the cross-parsing entropy; the lowest
wins, and a tie goes to the language with more labelled rows.

The whole of every text is parsed: lower case, letters only, everything else one blank.
It is laid out in lanes of ``LANE`` characters (each lane starts a phrase, in every
language alike), and all lanes of a batch step through all automata together.

The automata are learned from a bounded sample: per language one row for each of
``per_language`` hash buckets, the one with the smallest hash, in whole texts up to
``model_chars`` characters over all languages. Their alphabet is the sample's
``LETTERS`` most frequent letters; other letters are phrases of their own.

Defined results: ``und`` with score 0 for null texts and texts without letters; if there
is nothing to learn from, every text is ``und``. Ids without value learn nothing.
Repeated rows get equal results; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import for_learning, per_text

PER_LANGUAGE = 64
MODEL_CHARS = 160_000
LETTERS = 120
LANE = 1024
BATCH_CHARS = 2_000_000
UNKNOWN = "und"
RESULT = "struct<lang:string,score:double>"
_BLANK = 1


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def _letters_and_blanks(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of characters kept, and mask of letters; runs of others shrink to one."""
    letter = _is_letter()[points]
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[starts[starts < len(before)]] = False
    return letter | before, letter


def _automaton(codes: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Suffix automaton of one sequence: transitions per state; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and c not in nxt[at]:
            nxt[at][c] = new
            at = link[at]
        if at >= 0:
            old = nxt[at][c]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[old]))
                link.append(link[old])
                length.append(length[at] + 1)
                link[old] = link[new] = copy
                while at >= 0 and nxt[at].get(c) == old:
                    nxt[at][c] = copy
                    at = link[at]
        last = new
    return nxt, length


class CrossParser:
    """Automata of all languages in one flat transition table."""

    def __init__(self, samples: list[tuple[str, list[str]]]) -> None:
        """``samples``: language and its texts, the most frequent language first."""
        self.langs = [lang for lang, _ in samples]
        seen = Counter(c for _, texts in samples for t in texts for c in t.lower() if c.isalpha())
        self.code = np.zeros(0x110000, np.int16)
        self.code[~_is_letter()] = _BLANK
        for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]):
            self.code[ord(c)] = i + 2
        self.width = int(self.code.max(initial=1)) + 1
        tables, firsts, self.bits = [], [], []
        offset = 0
        for _, texts in samples:
            codes = self._encode(texts)
            nxt, _ = _automaton(codes)
            table = np.full((len(nxt), self.width), -1, np.int32)
            for state, moves in enumerate(nxt):
                for c, to in moves.items():
                    table[state, c] = to + offset
            table[:, 0] = -1
            first = np.where(table[0] < 0, offset, table[0]).astype(np.int32)
            table[0] = -1  # the start state always begins a phrase, see ``first``
            tables.append(table)
            firsts.append(first)
            self.bits.append(np.log2(len(codes) + 2))
            offset += len(nxt)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.first = np.stack(firsts) if firsts else np.zeros((0, self.width), np.int32)

    def _encode(self, texts: list[str]) -> list[int]:
        points = _points("\n".join(texts))
        kept, _ = _letters_and_blanks(points, np.zeros(1, np.int64))
        return self.code[points[kept]].tolist()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases per text and language, characters parsed, and letters per text."""
        parts = [_points(t) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        points = np.concatenate(parts)
        kept, letter = _letters_and_blanks(points, np.cumsum(sizes) - sizes)
        of = np.repeat(np.arange(len(texts)), sizes)
        letters = np.bincount(of[letter], minlength=len(texts))
        chars = np.bincount(of[kept], minlength=len(texts))
        codes = self.code[points[kept]].astype(np.int32)
        lanes = -(-chars // LANE)
        lane_of = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(lane_of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(np.cumsum(chars) - chars, lanes) + nth * LANE
        length = np.minimum(LANE, np.repeat(chars, lanes) - nth * LANE)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        n = len(self.langs)
        state = np.repeat(self.first[:, :1], len(order), axis=1)
        state[:] = (self.first[:, 0])[:, None]
        count = np.zeros((n, len(order)), np.int32)
        active = len(order)
        for step in range(int(length[0]) if len(length) else 0):
            while length[active - 1] <= step:
                active -= 1
            c = codes[begin[:active] + step]
            to = self.table.take(state[:, :active] * self.width + c)
            dead = to < 0
            count[:, :active] += dead
            state[:, :active] = np.where(dead, self.first.take(c, axis=1), to)
        total = np.stack([np.bincount(lane_of[order], weights=k, minlength=len(texts)) for k in count])
        return total.T, chars, letters

    def predict(self, texts: list[str]) -> list[dict]:
        out, at = [], 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_CHARS):
                size += len(texts[to])
                to += 1
            out += self._predict(texts[at:to])
            at = to
        return out

    def _predict(self, texts: list[str]) -> list[dict]:
        nothing = {"lang": UNKNOWN, "score": 0.0}
        if not self.langs:
            return [nothing] * len(texts)
        total, chars, letters = self.phrases(texts)
        entropy = total * np.array(self.bits) / np.maximum(chars, 1)[:, None]
        best = entropy.argmin(axis=1)
        two = np.sort(entropy, axis=1)[:, :2]
        sure = 1 - two[:, 0] / two[:, 1].clip(1e-12) if two.shape[1] > 1 else np.ones(len(texts))
        return [
            {"lang": self.langs[b], "score": float(min(max(s, 0.0), 1.0))} if n else nothing
            for b, s, n in zip(best.tolist(), sure, letters.tolist(), strict=True)
        ]


def learn(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    model_chars: int = MODEL_CHARS,
) -> list[tuple[str, list[str]]]:
    """Sample texts per language, the language with most labelled rows first."""
    hashed = F.xxhash64(F.col(doc_id).cast("string"))
    rows = docs.filter(for_learning(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    chosen = (
        rows.select(F.col(lang).alias("l"), hashed.alias("h"))
        .groupBy("l", F.pmod("h", F.lit(per_language)).alias("bucket"))
        .agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n"))
    )
    counts: Counter = Counter()
    hashes = []
    for r in chosen.toLocalIterator():
        counts[r.l] += r.n
        hashes.append(r.h)
    if not hashes:
        return []
    # at most per_language hashes for each language
    found = rows.select(F.col(lang).alias("l"), hashed.alias("h"), F.col(text).alias("t")).filter(F.col("h").isin(hashes))
    texts: dict[str, set] = {lang: set() for lang in counts}
    for r in found.toLocalIterator():
        texts[r.l].add((len(r.t), r.t))
    share, samples = model_chars // len(counts), []
    for name, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        taken, size = [], 0
        for n, t in sorted(texts[name], reverse=True):
            if size + n <= share:
                taken.append(t)
                size += n
        if not taken and texts[name]:
            taken = [min(texts[name])[1]]
        samples.append((name, taken))
    return samples


@lru_cache(maxsize=2)
def _parser(samples: tuple) -> CrossParser:
    return CrossParser([(lang, list(texts)) for lang, texts in samples])


def predict(docs: DataFrame, samples: list[tuple[str, list[str]]], *, text: str = "text", into: str = "language") -> DataFrame:
    """Add ``into``: struct of lang and score. The samples travel as one broadcast of at
    most ``model_chars`` characters; each worker builds the automata once."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple((lang, tuple(texts)) for lang, texts in samples))
    return docs.withColumn(into, per_text(lambda: _parser(shared.value).predict, RESULT)(F.col(text)))
