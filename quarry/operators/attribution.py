"""Exact attributions of tree ensembles: path-dependent Shapley values over root-to-leaf paths (XAI-2).

A tree's value for a set of known features is the mean over its leaves, where a split on an unknown feature sends a row
both ways by the shares of training rows. A leaf then counts a product over the features on its path: 1 or 0 for a
known one (the row meets all the path's splits on it, or not), the product of shares for an unknown one. The Shapley
value of such a product needs the subsets of a path by size alone, which are the coefficients of a polynomial in the
path's features, so nothing grows with the number of features or of their subsets.

An ensemble is a small table of paths (leaves times depth). It goes to the tasks as arrays, and a batch of rows is
valued for all paths of a length at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import require

#: Rows times paths that are valued at once.
AT_ONCE = 1 << 19


@dataclass(frozen=True)
class Leaf:
    """A leaf and the share of all training rows that reach it."""

    value: float
    count: float


@dataclass(frozen=True)
class Split:
    """Rows whose feature is at most the threshold go left; others, missing values too, go right."""

    feature: int
    threshold: float
    left: Split | Leaf
    right: Split | Leaf

    @property
    def count(self) -> float:
        return self.left.count + self.right.count


@dataclass(frozen=True)
class Path:
    """A leaf's value and, per feature on its path, the interval (low, high] that leads there and the share that goes that way."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def paths(node: Split | Leaf, weight: float = 1.0) -> Iterator[Path]:
    """The paths of a tree, each feature once; of missing values only intervals open above hold."""

    def walk(at: Split | Leaf, held: dict[int, tuple[float, float, float]]) -> Iterator[Path]:
        if isinstance(at, Leaf):
            names = tuple(held)
            yield Path(weight * at.value, names, *(tuple(held[f][i] for f in names) for i in range(3)))
            return
        low, high, share = held.get(at.feature, (-inf, inf, 1.0))
        total = at.count
        yield from walk(at.left, {**held, at.feature: (low, min(high, at.threshold), share * at.left.count / total)})
        yield from walk(at.right, {**held, at.feature: (max(low, at.threshold), high, share * at.right.count / total)})

    yield from walk(node, {})


def mean(node: Split | Leaf) -> float:
    """The mean of a tree over its training rows."""
    if isinstance(node, Leaf):
        return node.value
    return (node.left.count * mean(node.left) + node.right.count * mean(node.right)) / node.count


@dataclass(frozen=True)
class Ensemble:
    """Trees with weights; output is what their weighted sum means (a probability, or a margin as log odds)."""

    trees: tuple[tuple[float, Split | Leaf], ...]
    output: str = "value"

    @property
    def base(self) -> float:
        return sum(w * mean(t) for w, t in self.trees)

    def paths(self) -> list[Path]:
        return [p for w, t in self.trees for p in paths(t, w) if p.features]

    @property
    def fixed(self) -> float:
        """The sum of trees that are a leaf alone."""
        return sum(w * t.value for w, t in self.trees if isinstance(t, Leaf))


def of_model(model) -> Ensemble:
    """The trees of a pyspark.ml decision tree, forest or boosted model of two classes, or regression; splits on numbers only."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    forest = list(getattr(last, "trees", [last]))
    boosted = "GBT" in type(last).__name__
    classes = boosted or hasattr(last, "numClasses")
    require(not classes or last.numClasses == 2, "ml_error", "attributions need two classes")

    def read(node):
        if node.subtreeDepth() == 0:
            stats = node.impurityStats()
            if classes and not boosted:
                counts = list(stats.stats())
                return Leaf(counts[1] / (sum(counts) or 1.0), float(stats.count()))
            return Leaf(float(node.prediction()), float(stats.count()))
        split = node.split()
        require(hasattr(split, "threshold") and "Continuous" in split.getClass().getSimpleName(), "ml_error", "splits on categories have no intervals")
        return Split(split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild()))

    weights = list(last.treeWeights) if hasattr(last, "treeWeights") else [1.0]
    if boosted and classes:
        weights = [2 * w for w in weights]  # the margin as log odds
    elif not boosted:
        weights = [w / sum(weights) for w in weights]
    return Ensemble(tuple((w, read(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"))) for w, t in zip(weights, forest, strict=True)), "log_odds" if boosted and classes else "probability" if classes else "value")


def _weights(d: int) -> np.ndarray:
    """Weights of subsets by size among the d - 1 other features of a path."""
    return np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])


def values(x: np.ndarray, every: list[Path], n_features: int) -> np.ndarray:
    """Contributions (rows, features) of paths to rows (rows, features)."""
    out = np.zeros((len(x), n_features))
    for d in sorted({len(p.features) for p in every}):
        mine = [p for p in every if len(p.features) == d]
        step = max(1, AT_ONCE // max(1, len(x)) // d)
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            feature, low, high, share = (np.array([getattr(p, k) for p in some], int if k == "features" else float) for k in ("features", "low", "high", "share"))
            v = x[:, feature]
            met = np.where(np.isnan(v), high == inf, (v > low) & (v <= high)).astype(float)
            weights, value = _weights(d), np.array([p.value for p in some])
            for i in range(d):
                # coefficients of the product over the other features of (share + met * t)
                poly = np.zeros((d, *met.shape[:2]))
                poly[0] = 1.0
                for n, j in enumerate(k for k in range(d) if k != i):
                    for k in range(n + 1, 0, -1):
                        poly[k] = poly[k] * share[:, j] + poly[k - 1] * met[:, :, j]
                    poly[0] = poly[0] * share[:, j]
                part = (met[:, :, i] - share[:, i]) * np.tensordot(weights, poly, 1) * value
                np.add.at(out.T, feature[:, i], part.T)
    return out


def contributions(x: Column, ensemble: Ensemble, n_features: int) -> Column:
    """An array column of features to the array of their contributions; nulls are missing values."""
    every = ensemble.paths()

    @F.pandas_udf("array<double>")
    def valued(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            table = np.vstack(rows.to_list()).astype(float) if len(rows) else np.zeros((0, n_features))
            step = max(1, AT_ONCE // max(1, len(every)) * 8)
            parts = [values(table[i : i + step], every, n_features) for i in range(0, len(table), step)]
            yield pd.Series(list(np.concatenate(parts)) if parts else [], dtype=object)

    return valued(F.transform(x, lambda v: v.cast("double")))


def explained(rows: DataFrame, x: Column, ensemble: Ensemble, n_features: int) -> DataFrame:
    """rows with contributions, base and output of an ensemble; output is base plus the sum of contributions."""
    out = rows.withColumn("contributions", contributions(x, ensemble, n_features)).withColumn("base", F.lit(ensemble.base))
    return out.withColumn("output", F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v))


def outputs(node: Split | Leaf, x: np.ndarray) -> np.ndarray:
    """A tree's values of rows, each split deciding for the rows that reach it."""
    out = np.empty(len(x))

    def walk(at: Split | Leaf, rows: np.ndarray) -> None:
        if isinstance(at, Leaf):
            out[rows] = at.value
        elif len(rows):
            left = x[rows, at.feature] <= at.threshold
            walk(at.left, rows[left])
            walk(at.right, rows[~left])

    walk(node, np.arange(len(x)))
    return out


@dataclass(frozen=True)
class Scorer:
    """A fitted model of two classes as numbers: a scaled linear one, or trees; features are places in a shared array."""

    features: tuple[int, ...]
    linear: tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...], float] | None = None
    trees: Ensemble | None = None

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = x[:, list(self.features)]
        if self.trees is not None:
            margin = sum(w * outputs(t, x) for w, t in self.trees.trees)
            return margin if self.trees.output == "probability" else 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
        mean_, sd, coef, intercept = (np.array(v) for v in self.linear)
        z = np.divide(x - mean_, sd, out=np.zeros_like(x), where=sd != 0)
        return 1 / (1 + np.exp(-np.clip(z @ coef + intercept, -700, 700)))


def scorer(model, features: list[int]) -> Scorer:
    """The numbers of a pipeline with a scaler and a linear model, or of trees."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    if not hasattr(last, "coefficients"):
        return Scorer(tuple(features), trees=of_model(model))
    scaler = next(s for s in model.stages if hasattr(s, "mean"))
    return Scorer(tuple(features), linear=(tuple(scaler.mean.toArray()), tuple(scaler.std.toArray()), tuple(last.coefficients.toArray()), float(last.intercept)))


def scores(kind: Column, x: Column, kinds: list[str], scorers: list[Scorer], n_features: int) -> Column:
    """The probabilities (model, p) of a row by all scorers of its kind."""

    @F.pandas_udf("array<struct<model:int,p:double>>")
    def run(kind: pd.Series, x: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[] for _ in range(len(x))]
        table = np.vstack(x.to_list()).astype(float) if len(x) else np.zeros((0, n_features))
        for k, (of, one) in enumerate(zip(kinds, scorers, strict=True)):
            at = np.flatnonzero((kind == of).to_numpy())
            for i, p in zip(at.tolist(), one.probability(table[at]).tolist() if len(at) else (), strict=True):
                out[i].append({"model": k, "p": p})
        return pd.Series(out, dtype=object)

    return run(kind, x)
