"""Isolation forest (Liu, Ting and Zhou, 2008) for outlier removal.

Training sees a bounded hash sample, one tree per task; scoring is one pass over the
table with Arrow batches; the cut is an exact distributed quantile of the scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridload.prep.base import NOT_OUTLIER_FEATURES, Fitted, Step, chosen, column_quantiles
from gridload.session import durable

_EULER = 0.5772156649015329
_NODES = "tree int, node int, feature int, cut double, low int, high int, length double"


def average_path(n: int) -> float:
    """Mean search length among ``n`` rows, the normaliser of path lengths."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + _EULER) - 2.0 * (n - 1) / n


def grow_tree(rows: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """Nodes ``(node, feature, cut, low, high, length)``; feature -1 marks a leaf."""
    nodes: list[list] = []
    waiting = [(rows, 0, None, 0)]
    while waiting:
        part, level, parent, side = waiting.pop()
        index = len(nodes)
        if parent is not None:
            nodes[parent][3 + side] = index
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 else []
        if level >= depth or len(part) <= 1 or not len(spread):
            nodes.append([index, -1, 0.0, -1, -1, level + average_path(len(part))])
            continue
        feature = int(rng.choice(spread))
        low, high = part[:, feature].min(), part[:, feature].max()
        cut = float(rng.uniform(low, high))
        nodes.append([index, feature, cut, -1, -1, 0.0])
        below = part[:, feature] <= cut
        waiting.append((part[~below], level + 1, index, 1))
        waiting.append((part[below], level + 1, index, 0))
    return [tuple(n) for n in nodes]


class IsolationForest(Step):
    """Fit on a table; the model scores rows and drops the most isolated share."""

    def __init__(
        self,
        columns: Sequence[str] | None = None,
        row_key: Sequence[str] = ("series", "ts"),
        contamination: float = 0.1,
        trees: int = 100,
        sample_rows: int = 256,
        seed: int = 42,
    ):
        super().__init__()
        self.columns, self.row_key, self.contamination = columns, tuple(row_key), contamination
        self.trees, self.sample_rows, self.seed = trees, sample_rows, seed

    def _pool(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """At most trees * sample_rows rows, in the order of a seeded hash."""
        values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
        mixed = F.xxhash64(F.lit(self.seed), *self.row_key)
        return (
            df.select(mixed.alias("_h"), *self.row_key, *[v.alias(f"_x{i}") for i, v in enumerate(values)])
            .orderBy("_h", *self.row_key)
            .limit(self.trees * self.sample_rows)
            .withColumn(
                "_p", F.row_number().over(Window.partitionBy().orderBy("_h", *self.row_key)) - 1
            )
        )

    def _fit(self, df: DataFrame) -> IsolationModel:
        columns = chosen(df, self.columns, NOT_OUTLIER_FEATURES)
        pool = durable(self._pool(df, columns))
        size = pool.agg(F.count(F.lit(1)).alias("n")).scalar()
        take = self.sample_rows
        member = F.filter(
            F.sequence(F.lit(0), F.lit(self.trees - 1)),
            lambda t: F.pmod(F.col("_p") - t * take, F.col("_size")) < take,
        )
        features = [f"_x{i}" for i in range(len(columns))]
        assigned = pool.withColumn("_size", size).select(
            F.explode(member).alias("tree"), "_p", *features
        )
        seed, depth = self.seed, max(1, math.ceil(math.log2(take)))

        def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            tree = int(key[0])
            rows = part.sort_values("_p")[features].to_numpy(dtype="float64")
            rng = np.random.default_rng([seed, tree])
            grown = grow_tree(rows, rng, depth)
            return pd.DataFrame(
                [(tree, *node) for node in grown],
                columns=["tree", "node", "feature", "cut", "low", "high", "length"],
            )

        # trees x (2 * sample_rows - 1) nodes at most come to the driver
        nodes = assigned.groupBy("tree").applyInPandas(build, _NODES).orderBy("tree", "node")
        used = min(take, pool.count())
        table = nodes.toPandas()
        state = {
            "columns": columns,
            "norm": average_path(used),
            "contamination": self.contamination,
            "nodes": {c: table[c].tolist() for c in table.columns},
            "cut": None,
        }
        model = IsolationModel(state)
        scored = durable(model.add_score(df).select("anomaly_score"))
        limits = column_quantiles(scored, ["anomaly_score"], [1.0 - self.contamination])
        state["cut"] = limits["anomaly_score"].get(1.0 - self.contamination)
        return IsolationModel(state)


class IsolationModel(Fitted):
    def _trees(self) -> list[dict[str, np.ndarray]]:
        nodes = pd.DataFrame(self.state["nodes"])
        return [
            {c: part[c].to_numpy() for c in ("feature", "cut", "low", "high", "length")}
            for _, part in nodes.groupby("tree", sort=True)
        ]

    def score_column(self, df: DataFrame) -> Column:
        """Anomaly score in (0, 1]; higher is more isolated. Missing cells count as 0."""
        trees = df.sparkSession.sparkContext.broadcast(self._trees())
        norm = self.state["norm"] or 1.0

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            forest = trees.value
            for batch in batches:
                x = batch.to_numpy(dtype="float64")
                lengths = np.zeros(len(x))
                lines = np.arange(len(x))
                for tree in forest:
                    at = np.zeros(len(x), dtype="int64")
                    moving = lines[tree["feature"][at] >= 0]
                    while len(moving):
                        node = at[moving]
                        below = x[moving, tree["feature"][node]] <= tree["cut"][node]
                        at[moving] = np.where(below, tree["low"][node], tree["high"][node])
                        moving = moving[tree["feature"][at[moving]] >= 0]
                    lengths += tree["length"][at]
                yield pd.Series(np.exp2(-lengths / (len(forest) * norm)))

        cells = [
            F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}")
            for i, c in enumerate(self.state["columns"])
        ]
        return score(F.struct(*cells))

    def add_score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("anomaly_score", self.score_column(df))

    def flag(self, df: DataFrame) -> DataFrame:
        """Adds anomaly_score and is_outlier (0/1)."""
        cut = self.state["cut"]
        hit = F.col("anomaly_score") > F.lit(cut) if cut is not None else F.lit(False)
        return self.add_score(df).withColumn("is_outlier", hit.cast("int"))

    def _transform(self, df: DataFrame) -> DataFrame:
        """Rows that are not outliers, with the original columns."""
        return self.flag(df).filter("is_outlier = 0").select(*df.columns)
