"""Many logistic regressions at once: every fold, held-out project and setting in one job for each Newton step (ML-4, ML-7).

A model is what it leaves out (projects), its C, and the smell whose rows and features it reads. Means, deviations and
class weights of a training set are those of all projects less the ones left out, from one table of sums by project. A
step's gradients and Hessians are summed by the tasks for all models in one pass over the rows, and added up by model
and place, so what reaches the driver is the size of the models and not of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 60
TOLERANCE = 1e-10
#: Models that take their steps together.
AT_ONCE = 1024


def group_folds(sizes: dict[str, int], k: int) -> dict[str, int]:
    """Fold of each group: the largest group first, each into the lightest fold; of groups of one size the last name first."""
    load, out = [0] * k, {}
    for name in sorted(sorted(sizes), key=lambda g: sizes[g])[::-1]:
        fold = load.index(min(load))
        out[name], load[fold] = fold, load[fold] + sizes[name]
    return out


@dataclass
class Model:
    """One regression; coefficients are those of standardised features, and intercept and weights follow from fit_many."""

    smell: str
    c: float
    without: frozenset[str]
    tested: frozenset[str]
    features: np.ndarray | None = None
    mean: np.ndarray | None = None
    sd: np.ndarray | None = None
    weights: tuple[float, float] = (1.0, 1.0)
    n: int = 0
    beta: np.ndarray | None = field(default=None, repr=False)

    @property
    def usable(self) -> bool:
        """Both classes are present in training."""
        return min(self.weights) > 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Standardised features after a column of ones; what the smell does not use, or what never changes, is 0."""
        z = np.divide(x - self.mean, self.sd, out=np.zeros_like(x), where=self.sd > 0)
        return np.hstack([np.ones((len(x), 1)), z])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scaled(x) @ self.beta, -700, 700)))


def project_sums(rows: DataFrame, features: list[str]) -> dict[str, dict[str, np.ndarray]]:
    """Per smell and project: rows, positives, and sums and squares of each feature; as many rows as there are projects."""
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    got = rows.groupBy("smell_type", "project_fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("double")).alias("pos"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(values)], *[F.sum(v * v).alias(f"q{i}") for i, v in enumerate(values)]
    )
    out: dict[str, dict[str, np.ndarray]] = {}
    for r in got.collect():
        out.setdefault(r["smell_type"], {})[r["project_fingerprint"]] = np.array(r[2:], float)
    return out


def prepare(models: list[Model], sums: dict[str, dict[str, np.ndarray]], used: dict[str, np.ndarray]) -> None:
    """Means, deviations and class weights of each model's training rows; used: which features a smell has."""
    for m in models:
        mine = sums[m.smell]
        total = sum((v for p, v in mine.items() if p not in m.without), np.zeros(len(next(iter(mine.values())))))
        d = (len(total) - 2) // 2
        n, pos = total[0], total[1]
        m.n, m.mean = int(n), total[2 : 2 + d] / max(n, 1)
        spread = np.maximum(total[2 + d :] - n * m.mean**2, 0)
        m.sd = np.sqrt(spread / max(n - 1, 1))
        m.sd[(spread <= 1e-12 * np.maximum(total[2 + d :], 1e-300)) | ~used[m.smell]] = 0
        m.weights = (n / (2 * (n - pos)), n / (2 * pos)) if 0 < pos < n else (0.0, 0.0)
        m.beta = np.zeros(d + 1)


def _arrays(batch: pa.RecordBatch, d: int):
    """Rows of a batch by smell: (smell, projects, labels, features)."""
    smell, project = (np.array(batch.column(c).to_pylist(), object) for c in ("smell_type", "project_fingerprint"))
    y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    for s in sorted(set(smell.tolist())):
        at = np.flatnonzero(smell == s)
        yield s, project[at], y[at], x[at]


def _summed(models: list[Model], d: int):
    """(model, place, value): loss, gradient and upper half of the Hessian of each model over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(d + 1)
        sums = np.zeros((len(models), 1 + d + 1 + len(upper[0])))
        for batch in batches:
            for smell, project, y, x in _arrays(batch, d):
                names = {p: i for i, p in enumerate(sorted(set(project.tolist())))}
                code = np.array([names[p] for p in project.tolist()])
                for k, m in enumerate(models):
                    if m.smell != smell:
                        continue
                    inside = np.array([p not in m.without for p in names])[code]
                    z, t = m.scaled(x[inside]), y[inside]
                    w = np.where(t == 1, m.weights[1], m.weights[0])
                    eta = z @ m.beta
                    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    sums[k, 0] += (w * (np.logaddexp(0, eta) - t * eta)).sum()
                    sums[k, 1 : d + 2] += z.T @ (w * (p - t))
                    sums[k, d + 2 :] += ((z * (w * p * (1 - p))[:, None]).T @ z)[upper]
        model, place = (i.ravel() for i in np.indices(sums.shape))
        yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums.ravel())], ["model", "place", "value"])

    return run


def fit_many(rows: DataFrame, models: list[Model], d: int) -> int:
    """Fits the models in place by Newton steps with halving; rows: smell_type, project_fingerprint, label, x. Returns the steps."""
    steps = 0
    for at in range(0, len(models), AT_ONCE):
        some = [m for m in models[at : at + AT_ONCE] if m.usable]
        steps += _newton(rows, some, d)
    return steps


def _newton(rows: DataFrame, models: list[Model], d: int) -> int:
    upper = np.triu_indices(d + 1)
    ridge = np.diag([0.0] + [1.0] * d)
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    open_, step = list(range(len(models))), 0
    while open_ and step < STEPS:
        step += 1
        some = [models[i] for i in open_]
        got = rows.mapInArrow(_summed(some, d), "model int, place int, value double").groupBy("model", "place").agg(F.sum("value").alias("value")).toPandas()
        sums = np.zeros((len(some), 1 + d + 1 + len(upper[0])))
        sums[got.model, got.place] = got.value
        still = []
        for k, i in enumerate(open_):
            m = models[i]
            lam = 1 / (m.c * max(1, m.n))
            loss = sums[k, 0] / m.n + lam / 2 * (m.beta[1:] ** 2).sum()
            if i in best and loss > best[i][0] + 1e-15:  # too far: half of the step
                before, move = best[i][1], best[i][2] / 2
                best[i] = (best[i][0], before, move)
                m.beta = before + move
                if np.abs(move).max() > TOLERANCE:
                    still.append(i)
                continue
            h = np.zeros((d + 1, d + 1))
            h[upper] = sums[k, d + 2 :] / m.n
            h = h + np.triu(h, 1).T + lam * ridge
            g = sums[k, 1 : d + 2] / m.n + lam * np.r_[0.0, m.beta[1:]]
            move = -np.linalg.solve(h + 1e-14 * np.eye(d + 1), g)
            best[i] = (loss, m.beta, move)
            m.beta = m.beta + move
            if np.abs(move).max() > TOLERANCE:
                still.append(i)
        open_ = still
    return step


def tested(models: list[Model], d: int) -> Column:
    """Of a row (smell_type, project_fingerprint, x): the probabilities (model, p) by all models that are tested on its project."""
    by: dict[tuple[str, str], list[int]] = {}
    for k, m in enumerate(models):
        if m.usable:
            for p in m.tested:
                by.setdefault((m.smell, p), []).append(k)

    @F.pandas_udf("array<struct<model:int,p:double>>")
    def run(smell: pd.Series, project: pd.Series, x: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[] for _ in range(len(x))]
        groups = pd.DataFrame({"s": smell, "p": project}).groupby(["s", "p"], sort=False).indices
        for key, at in groups.items():
            table = np.array([np.asarray(v, float) for v in x.iloc[at]]).reshape(len(at), d)
            for k in by.get(key, ()):
                for i, p in zip(at.tolist(), models[k].probability(table).tolist(), strict=True):
                    out[i].append({"model": k, "p": p})
        return pd.Series(out)

    return run("smell_type", "project_fingerprint", "x")


def with_x(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with their features as one array, 0 where a row has none."""
    return rows.withColumn("x", F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]))
