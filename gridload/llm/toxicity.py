"""Toxic spans and document scores from a linear-chain conditional random field.

Two labels, toxic and not. Only documents carry labels, so token labels are derived
from them first: features of words (the word, its beginnings and its ending) that are
far more frequent in toxic than in other labelled documents mark the toxic tokens of
toxic documents; every token of another document is not toxic. On these labelled tokens
the field is fitted by gradient ascent: one weight per feature, a bias, a start and a
transition table. Forward-backward gives each token's marginal; runs of likely tokens
are the offending offsets, and a logistic of the largest and the summed marginal, fitted
to the document labels with their true frequencies, is the score.

Scoring is one pass without a shuffle. The chains of a batch are one long sequence in
which document starts cut the dependence; it is folded into columns that step together
(products of 2 x 2 tables), so long texts cost no more per word than short ones.

The fit uses a bounded sample: the ``per_class`` toxic rows (twice as many of the others)
with the smallest hash of the id, among texts of 1 to ``sample_chars`` characters, from
rows that may be learned from; near copies count once. Label frequencies are counted over all
such rows.

Defined results: null and wordless texts get the score of no evidence; without rows of
both labels every score is the share of toxic labels (0 if there are none); ids labelled
twice count as toxic if any label is; rows without id are scored, not learned from. No
rows give no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridload.llm.common import for_learning, per_text

PER_CLASS = 2_000
CLEAN_PER_TOXIC = 2
SAMPLE_CHARS = 20_000
MIN_DOCUMENTS = 4
#: least log odds, two standard errors below the estimate, of marks and of features
MARK_ODDS, FEATURE_ODDS = 1.5, 0.5
COPY_HASHES = 4
ROUNDS = 25
THRESHOLD = 0.7
SPAN_THRESHOLD = 0.5
BATCH_WORDS = 400_000
RESULT = "struct<score:double,spans:array<struct<start:bigint,end:bigint,marginal:double>>>"

_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 6 characters, and its last 4."""
    out = [word]
    out += [f"^{word[:k]}" for k in range(3, 7) if len(word) > k]
    if len(word) > 4:
        out.append(f"${word[-4:]}")
    return out


@dataclass
class Field:
    """A fitted field and the document logistic on top of it."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    start: tuple[float, float] = (0.0, 0.0)
    moves: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    document: tuple[float, float, float] | None = None
    share: float = 0.0


def _messages(tables: np.ndarray) -> np.ndarray:
    """Normalised row vectors ``v_t = v_(t-1) @ tables[t]``, from ones.

    The steps are folded into columns; all columns multiply up their tables together,
    then each column's incoming vector is carried over and applied.
    """
    n = len(tables)
    height = max(1, int(math.sqrt(n)))
    width = -(-n // height)
    padded = np.empty((height * width, 2, 2))
    padded[:n] = tables
    padded[n:] = np.eye(2)
    grid = padded.reshape(width, height, 2, 2).transpose(1, 2, 3, 0)  # step, from, to, column
    a, b, c, d = (np.ascontiguousarray(grid[:, i, j]) for i in (0, 1) for j in (0, 1))
    product = np.empty((height, 4, width))
    p = np.stack((a[0], b[0], c[0], d[0]))
    product[0] = p / p.max(axis=0)
    for t in range(1, height):
        p = product[t - 1]
        out = product[t]
        out[0] = p[0] * a[t] + p[1] * c[t]
        out[1] = p[0] * b[t] + p[1] * d[t]
        out[2] = p[2] * a[t] + p[3] * c[t]
        out[3] = p[2] * b[t] + p[3] * d[t]
        out /= out.max(axis=0)
    entering = np.empty((2, width))
    x, y = 0.5, 0.5
    for k, (p0, p1, p2, p3) in enumerate(product[-1].T.tolist()):
        entering[0, k], entering[1, k] = x, y
        x, y = x * p0 + y * p2, x * p1 + y * p3
        x, y = x / (x + y), y / (x + y)
    first = entering[0] * product[:, 0] + entering[1] * product[:, 2]
    second = entering[0] * product[:, 1] + entering[1] * product[:, 3]
    total = first + second
    return np.stack((first / total, second / total), axis=-1).transpose(1, 0, 2).reshape(-1, 2)[:n]


def marginals(emit: np.ndarray, starts: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """Marginals of the toxic label, the step tables, and both messages.

    ``emit`` is the log potential of the toxic label per token, ``starts`` marks the
    first token of each document.
    """
    node = np.stack((np.ones_like(emit), np.exp(np.clip(emit, -30, 30))), axis=-1)
    tables = np.where(starts[:, None, None], np.exp(start)[None, None, :], np.exp(moves)[None]) * node[:, None, :]
    ahead = _messages(tables)
    turned = np.empty_like(tables)
    turned[0] = np.eye(2)
    turned[1:] = tables[:0:-1].transpose(0, 2, 1)
    behind = _messages(turned)[::-1]
    joint = ahead * behind
    return joint[:, 1] / joint.sum(axis=1), tables, ahead, behind


def _summaries(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Largest marginal and log of one plus their sum, per document."""
    out = np.zeros((len(sizes), 2))
    full = sizes > 0
    if full.any():
        begin = (np.cumsum(sizes) - sizes)[full]
        out[full, 0] = np.maximum.reduceat(p, begin)
        out[full, 1] = np.log1p(np.add.reduceat(p, begin))
    return out


def _doc_features(words: set[str], wanted: dict | None) -> set[str]:
    return {f for w in words for f in features(w) if wanted is None or f in wanted}


def _sure_odds(k1: int, n1: int, k0: int, n0: int) -> float:
    """Log odds of a feature in toxic documents, less two standard errors."""
    odds = math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))
    return odds - 2 * math.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5))


def fit(texts: list[str], toxic: list[int], frequency: tuple[int, int], rounds: int = ROUNDS) -> Field:
    """Fit on labelled documents; ``frequency`` counts all rows without and with the label."""
    share = frequency[1] / max(1, sum(frequency))
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    if not n1 or not n0:
        return Field(share=share)
    vocabulary: dict[str, int] = {}
    docs = [
        np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(t.lower())], np.int32) for t in texts
    ]
    names = list(vocabulary)
    bad, good = Counter(), Counter()
    for d, label in zip(docs, toxic, strict=True):
        if label:
            bad.update(_doc_features({names[i] for i in d.tolist()}, None))
    bad = Counter({f: k for f, k in bad.items() if k >= MIN_DOCUMENTS})
    for d, label in zip(docs, toxic, strict=True):
        if not label:
            good.update(_doc_features({names[i] for i in d.tolist()}, bad))
    odds = {f: _sure_odds(k, n1, good[f], n0) for f, k in bad.items()}
    number = {f: i for i, f in enumerate(sorted(f for f, o in odds.items() if o >= FEATURE_ODDS))}
    of_word = [[number[f] for f in features(w) if f in number] for w in names]
    marked = np.array([max(odds.get(f, -9.0) for f in features(w)) >= MARK_ODDS for w in names] + [False])
    ends = np.cumsum([0, *map(len, of_word)])
    flat = np.array([i for own in of_word for i in own], np.int64)
    batches = _training_batches(docs, toxic, marked)
    weights, bias = np.zeros(len(number)), -4.0
    begin, moves = np.zeros(2), np.zeros((2, 2))
    memory = [np.zeros_like(x) for x in (weights, np.zeros(1), begin, moves)]
    words = len(names)

    def potentials() -> np.ndarray:
        of = np.repeat(np.arange(words), np.diff(ends))
        return np.bincount(of, weights[flat], minlength=words) + bias

    for _ in range(rounds):
        emit = potentials()
        error = np.zeros(words)
        to_begin, to_moves = np.zeros(2), np.zeros((2, 2))
        for tokens, truth, starts in batches:
            p, tables, ahead, behind = marginals(emit[tokens], starts, begin, moves)
            error += np.bincount(tokens, truth - p, minlength=words)
            inner = np.flatnonzero(~starts)
            pair = ahead[inner - 1][:, :, None] * tables[inner] * behind[inner][:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            seen = np.bincount(2 * truth[inner - 1] + truth[inner], minlength=4).reshape(2, 2)
            to_moves += seen - pair.sum(axis=0)
            first = truth[starts] - p[starts]
            to_begin += np.array([-first.sum(), first.sum()])
        gradients = (
            np.bincount(flat, np.repeat(error, np.diff(ends)), minlength=len(number)) - 0.01 * weights,
            np.array([error.sum()]),
            to_begin,
            to_moves,
        )
        steps = []
        for g, m in zip(gradients, memory, strict=True):  # adaptive step sizes
            m += g * g
            steps.append(g / np.sqrt(m + 1e-8))
        weights += steps[0]
        bias += float(steps[1][0])
        begin += 0.5 * steps[2]
        moves += 0.5 * steps[3]
    emit = potentials()
    p = [marginals(emit[tokens], starts, begin, moves)[0] for tokens, _, starts in batches]
    summary = _summaries(np.concatenate([*p, np.zeros(0)]), np.array(list(map(len, docs))))
    y = np.array(toxic)
    cost = np.where(y == 1, frequency[1] / n1, frequency[0] / n0)
    document = _logistic(summary, y, cost / cost.mean())
    kept = {f: float(weights[i]) for f, i in number.items() if abs(weights[i]) > 1e-3}
    table = tuple(tuple(map(float, row)) for row in moves)
    return Field(kept, bias, tuple(map(float, begin)), table, tuple(map(float, document)), share)


def _training_batches(docs: list[np.ndarray], toxic: list[int], marked: np.ndarray) -> list[tuple]:
    """(words, token labels, document starts) of runs of whole documents."""
    runs: list[list[int]] = [[]]
    size = 0
    for k, d in enumerate(docs):
        if size + len(d) > BATCH_WORDS // 2 and runs[-1]:
            runs.append([])
            size = 0
        runs[-1].append(k)
        size += len(d)
    out = []
    for run in runs:
        tokens = np.concatenate([docs[k] for k in run])
        labels = np.repeat([toxic[k] for k in run], [len(docs[k]) for k in run])
        starts = np.zeros(len(tokens) + 1, bool)
        starts[np.cumsum([0] + [len(docs[k]) for k in run])[:-1]] = True
        if len(tokens):
            out.append((tokens, (labels * marked[tokens]).astype(np.int64), starts[:-1]))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps, slightly ridged."""
    design = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(3)
    ridge = np.diag([1e-2, 1e-2, 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (cost * (y - p)) - ridge @ w
        hessian = (design * (cost * p * (1 - p))[:, None]).T @ design + ridge
        w += np.linalg.solve(hessian, gradient)
    return tuple(w)


class Tagger:
    """Scores texts with a fitted field."""

    MOST_WORDS = 300_000

    def __init__(self, model: Field) -> None:
        self.model = model
        self.start, self.moves = np.array(model.start), np.array(model.moves)
        self.known: dict[str, float] = {}

    def _emit(self, word: str) -> float:
        if len(self.known) > self.MOST_WORDS:
            self.known.clear()
        weights = self.model.weights
        value = self.known[word] = self.model.bias + sum(weights.get(f, 0.0) for f in features(word))
        return value

    def score(self, texts: list[str]) -> list[dict]:
        if self.model.document is None:
            return [{"score": self.model.share, "spans": []} for _ in texts]
        out: list[dict] = []
        held: list[tuple[str, np.ndarray]] = []
        size = 0
        for text in texts:
            words = _WORD.findall(text.lower())
            known, emit = self.known, self._emit
            values = np.array([known[w] if w in known else emit(w) for w in words], np.float64)
            if held and size + len(values) > BATCH_WORDS:
                out += self._finish(held)
                held, size = [], 0
            held.append((text, values))
            size += len(values)
        return out + (self._finish(held) if held else [])

    def _finish(self, held: list[tuple[str, np.ndarray]]) -> list[dict]:
        sizes = np.array([len(v) for _, v in held])
        emit = np.concatenate([v for _, v in held])
        begin = np.cumsum(sizes) - sizes
        p = np.zeros(0)
        if len(emit):
            starts = np.zeros(len(emit), bool)
            starts[begin[sizes > 0]] = True
            p = marginals(emit, starts, self.start, self.moves)[0]
        a, b, c = self.model.document
        summary = _summaries(p, sizes)
        scores = 1 / (1 + np.exp(-np.clip(summary @ np.array([a, b]) + c, -30, 30)))
        return [
            {
                "score": float(s),
                "spans": self._spans(text, p[at : at + n]) if top >= SPAN_THRESHOLD else [],
            }
            for (text, _), s, at, n, top in zip(held, scores, begin.tolist(), sizes.tolist(), summary[:, 0], strict=True)
        ]

    @staticmethod
    def _spans(text: str, p: np.ndarray) -> list[dict]:
        """Runs of tokens that are likely toxic, in code points of the original text."""
        low = text.lower()
        places = [m.span() for m in _WORD.finditer(text if len(low) == len(text) else low)]
        if len(places) != len(p):
            places = [m.span() for m in _WORD.finditer(low)]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], p >= SPAN_THRESHOLD, [0]))))
        return [
            {"start": places[i][0], "end": places[j - 1][1], "marginal": float(p[i:j].max())}
            for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
        ]


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    per_class: int = PER_CLASS,
    sample_chars: int = SAMPLE_CHARS,
) -> Field:
    """Fit a field, in one task on a bounded number of texts of bounded length."""
    marks = labels.filter(for_learning(F.col(doc_id)) & F.col(toxic).isin(0, 1))
    marks = marks.groupBy(F.col(doc_id).alias("_id")).agg(F.max(toxic).cast("int").alias("_toxic"))
    frequency = Counter({r._toxic: r.n for r in marks.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()})
    rows = docs.filter(F.length(text).between(1, sample_chars))
    sized = rows.select(F.col(doc_id).alias("_id")).join(marks, "_id").distinct()
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    chosen = None
    for label in (0, 1):
        size = per_class if label else per_class * CLEAN_PER_TOXIC
        some = sized.filter(F.col("_toxic") == label).orderBy(*by_hash).limit(size)
        chosen = some if chosen is None else chosen.union(some)
    texts = rows.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    sample = texts.join(F.broadcast(chosen), "_id").withColumn("_one", F.lit(1))  # a bounded number of ids
    fitted = sample.groupBy("_one").applyInArrow(_fit_sample((frequency[0], frequency[1])), "model string").first()
    return Field(**json.loads(fitted.model)) if fitted else fit([], [], (frequency[0], frequency[1]))


def _without_copies(texts: list[str]) -> list[str]:
    """One text of each group of near copies: none shares a least shingle hash with one before."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = _WORD.findall(text.lower())
        shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        least = sorted(xxhash.xxh64_intdigest(x) for x in shingles)[:COPY_HASHES]
        if seen.isdisjoint(least):
            out.append(text)
        seen.update(least)
    return out


def _fit_sample(frequency: tuple[int, int]):
    """Fit in one task: the sample's size is bounded by ``learn``'s parameters."""

    def run(table: pa.Table) -> pa.Table:
        found: dict = {}
        for t, y in zip(*(table.column(c).to_pylist() for c in ("_text", "_toxic")), strict=True):
            found[t] = max(found.get(t, 0), y)
        order = _without_copies(sorted(found, key=lambda t: (-found[t], t)))
        model = fit(order, [found[t] for t in order], frequency)
        return pa.table({"model": pa.array([json.dumps(asdict(model))])})

    return run


def score(docs: DataFrame, model: Field, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Add ``into``: struct of score (0 to 1) and offending spans (code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(into, per_text(lambda: Tagger(shared.value).score, RESULT)(F.col(text)))
