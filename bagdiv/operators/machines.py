"""Kernel machines on a Gram matrix of bags, with the grid and the folds of the search spread over tasks."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .kernel import repair

#: The grids that are searched by default.
SIGMAS = tuple(2.0**e for e in range(-4, 11, 2))
CS = tuple(2.0**e for e in range(-9, 19, 3))
NUS = (0.1, 0.2, 0.3, 0.5, 0.7)
EPSILONS = tuple(10.0**e for e in range(-3, 5))


def smo(q: np.ndarray, p: np.ndarray, y: np.ndarray, c: np.ndarray, a: np.ndarray, by_sign: bool = False, tol: float = 1e-3, rounds: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Minimise a'Qa/2 + p'a with y'a fixed and 0 <= a <= c by maximal violating pairs; by_sign: sums of either sign fixed. Returns (a, gradient)."""
    a = a.astype(float)
    g = q @ a + p
    groups = [y > 0, y < 0] if by_sign else [np.ones(len(y), bool)]
    for _ in range(rounds):
        best = (tol, -1, -1)
        up, down = ((y > 0) & (a < c)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        f = -y * g
        for inside in groups:
            hi, lo = np.where(up & inside, f, -np.inf), np.where(down & inside, f, np.inf)
            i, j = int(hi.argmax()), int(lo.argmin())
            if hi[i] - lo[j] > best[0]:
                best = (hi[i] - lo[j], i, j)
        gap, i, j = best
        if i < 0:
            break
        curve = max(q[i, i] + q[j, j] - 2 * y[i] * y[j] * q[i, j], 1e-12)
        step = min(gap / curve, c[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += step * (y[i] * q[:, i] - y[j] * q[:, j])
    return a, g


def _offset(y: np.ndarray, g: np.ndarray, a: np.ndarray, c: np.ndarray) -> float:
    f = y * g
    free = (a > 1e-12 * c) & (a < c * (1 - 1e-12))
    if free.any():
        return float(f[free].mean())
    up, down = ((y > 0) & (a <= 0)) | ((y < 0) & (a >= c)), ((y > 0) & (a >= c)) | ((y < 0) & (a <= 0))
    return float((f[up].min(initial=np.inf) if up.any() else f[down].max()) / 2 + (f[down].max(initial=-np.inf) if down.any() else f[up].min()) / 2)


@dataclass
class Machine:
    """kind: SVC, NuSVC, SVR, NuSVR or OneClassSVM, on precomputed kernels; several classes by one against one."""

    kind: str = "SVC"
    c: float = 1.0
    nu: float = 0.5
    epsilon: float = 0.1
    class_weight: dict | None = None
    rounds: int = 1_000_000
    parts: list = field(default_factory=list)

    def fit(self, k: np.ndarray, y: np.ndarray | None = None, weight: np.ndarray | None = None) -> "Machine":
        n = len(k)
        w = np.ones(n) if weight is None else np.asarray(weight, float)
        if self.kind in ("SVC", "NuSVC"):
            self.classes = np.unique(y)
            if len(self.classes) < 2:
                raise ValueError("one class only")
            if self.class_weight:
                w = w * np.array([self.class_weight.get(v, 1.0) for v in y])
            self.parts = [self._pair(k, y, w, *ab) for ab in itertools.combinations(self.classes, 2)]
        elif self.kind == "OneClassSVM":
            c, start, left = w, np.zeros(n), self.nu * n
            for i in range(n):
                start[i] = min(c[i], left)
                left -= start[i]
            a, g = smo(k, np.zeros(n), np.ones(n), c, start, rounds=self.rounds)
            self.parts = [(np.arange(n), a, _offset(np.ones(n), g, a, c))]
        else:
            s = np.concatenate([np.ones(n), -np.ones(n)])
            q = np.outer(s, s) * np.tile(k, (2, 2))
            c = self.c * np.tile(w, 2)
            if self.kind == "SVR":
                a, g = smo(q, np.concatenate([self.epsilon - y, self.epsilon + y]), s, c, np.zeros(2 * n), rounds=self.rounds)
                b = _offset(s, g, a, c)
            else:
                start, left = np.zeros(n), self.c * self.nu * n / 2
                for i in range(n):
                    start[i] = min(c[i], left)
                    left -= start[i]
                a, g = smo(q, np.concatenate([-y, y]), s, c, np.tile(start, 2), True, rounds=self.rounds)
                one, two = (_offset(np.ones(m.sum()), g[m], a[m], c[m]) for m in (s > 0, s < 0))
                b = (one - two) / 2
            self.parts = [(np.arange(n), a[:n] - a[n:], b)]
        return self

    def _pair(self, k, y, w, lo, hi):
        rows = np.flatnonzero((y == lo) | (y == hi))
        s = np.where(y[rows] == lo, 1.0, -1.0)
        q = np.outer(s, s) * k[np.ix_(rows, rows)]
        if self.kind == "SVC":
            c = self.c * w[rows]
            a, g = smo(q, -np.ones(len(rows)), s, c, np.zeros(len(rows)), rounds=self.rounds)
            return rows, a * s, _offset(s, g, a, c)
        c, start = w[rows], np.zeros(len(rows))
        if self.nu * len(rows) / 2 > min(c[s > 0].sum(), c[s < 0].sum()):
            raise ValueError("nu is too large for these classes")
        for sign in (1.0, -1.0):
            left = self.nu * len(rows) / 2
            for i in np.flatnonzero(s == sign):
                start[i] = min(c[i], left)
                left -= start[i]
        a, g = smo(q, np.zeros(len(rows)), s, c, start, True, rounds=self.rounds)
        one, two = (_offset(np.ones(m.sum()), g[m], a[m], c[m]) for m in (s > 0, s < 0))
        scale = max((one + two) / 2, 1e-12)
        return rows, a * s / scale, (one - two) / 2 / scale

    def calibrate(self, k: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, n_folds: int = 5, seed: int = 0) -> "Machine":
        """Sigmoids for probabilities(), from decisions about bags that were left out of the training; classifiers only."""
        w = np.ones(len(k)) if weight is None else np.asarray(weight, float)
        self.sigmoids = []
        for lo, hi in itertools.combinations(self.classes, 2):
            rows = np.flatnonzero((y == lo) | (y == hi))
            fold, f = folds(len(rows), n_folds, seed), np.zeros(len(rows))
            for i in range(n_folds):
                train, test = rows[fold != i], rows[fold == i]
                if len(np.unique(y[train])) < 2:
                    f[fold == i] = 1.0 if (y[train] == lo).any() else -1.0
                    continue
                at, coef, b = self._pair(k[np.ix_(train, train)], y[train], w[train], lo, hi)
                f[fold == i] = k[np.ix_(test, train[at])] @ coef - b
            self.sigmoids.append(sigmoid(f, y[rows] == lo))
        return self

    def probabilities(self, k: np.ndarray) -> np.ndarray:
        """A row for each test bag, a column for each class; needs calibrate()."""
        n = len(self.classes)
        r = np.full((len(k), n, n), 0.5)
        for (i, j), d, (a, b) in zip(itertools.combinations(range(n), 2), self.decision(k).T, self.sigmoids):
            r[:, i, j] = np.clip(1 / (1 + np.exp(np.clip(a * d + b, -500, 500))), 1e-7, 1 - 1e-7)
            r[:, j, i] = 1 - r[:, i, j]
        return np.array([coupled(x) for x in r]).reshape(-1, n)

    def log_probabilities(self, k: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.probabilities(k))

    def decision(self, k: np.ndarray) -> np.ndarray:
        return np.column_stack([k[:, rows] @ coef - b for rows, coef, b in self.parts])

    def predict(self, k: np.ndarray) -> np.ndarray:
        d = self.decision(k)
        if self.kind in ("SVR", "NuSVR"):
            return d[:, 0]
        if self.kind == "OneClassSVM":
            return np.where(d[:, 0] >= 0, 1, -1)
        votes = np.zeros((len(k), len(self.classes)))
        for (i, j), x in zip(itertools.combinations(range(len(self.classes)), 2), d.T):
            votes[:, i] += x > 0
            votes[:, j] += x <= 0
        return self.classes[votes.argmax(1)]


def sigmoid(f: np.ndarray, positive: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a f + b)), the likeliest for smoothed targets, by Newton steps that are halved until they help."""
    more, less = int(positive.sum()), int((~positive).sum())
    t = np.where(positive, (more + 1) / (more + 2), 1 / (less + 2))
    x = np.column_stack([f, np.ones(len(f))])

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float((t * np.logaddexp(0, z) + (1 - t) * np.logaddexp(0, -z)).sum())

    w = np.array([0.0, math.log((less + 1) / (more + 1))])
    now = cost(w)
    for _ in range(rounds):
        p = np.exp(-np.logaddexp(0, x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-10 * np.eye(2), x.T @ (t - p))
        while np.abs(step).max() > 1e-10 and cost(w - step) > now:
            step = step / 2
        if np.abs(step).max() <= 1e-10:
            break
        w = w - step
        now = cost(w)
    return float(w[0]), float(w[1])


def coupled(r: np.ndarray) -> np.ndarray:
    """Class probabilities whose ratios fit those of all pairs best in squares; r[i, j] is that of i against j."""
    n = len(r)
    off = r * (1 - np.eye(n))
    q = np.diag((off**2).sum(0)) - off * off.T
    system = np.block([[q, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    p = np.maximum(np.linalg.lstsq(system, np.append(np.zeros(n), 1.0), rcond=None)[0][:n], 0)
    return p / p.sum()


def folds(n: int, k: int, seed: int = 0, classes: np.ndarray | None = None) -> np.ndarray:
    """A fold for each of n, of sizes that differ by one at most; with classes, so within each class."""
    rng = np.random.default_rng(seed)
    if classes is None:
        return rng.permutation(n) % k
    order = np.argsort(rng.permutation(n))
    order = order[np.argsort(np.asarray(classes)[order], kind="stable")]
    out = np.empty(n, int)
    out[order] = np.arange(n) % k
    return out


def grid(kind: str) -> list[dict]:
    axes = {"SVC": {"c": CS}, "NuSVC": {"nu": NUS}, "SVR": {"c": CS, "epsilon": EPSILONS}, "NuSVR": {"c": CS, "nu": NUS[1:]}, "OneClassSVM": {}}[kind]
    return [dict(zip(axes, v)) for v in itertools.product(*axes.values())]


def loss(kind: str, y: np.ndarray, pred: np.ndarray, weight: np.ndarray | None = None) -> float:
    return float(np.average(y != pred if kind in ("SVC", "NuSVC") else (y - pred) ** 2, weights=weight))


def sigma_scale(divs: np.ndarray) -> float:
    """The median of the positive divergences; 1 where all are 0, as the kernel of bags that are all alike is 1 with any sigma."""
    positive = divs[divs > 0]
    if len(positive):
        return float(np.median(positive))
    if not (divs == 0).all():
        raise ValueError("no divergence is positive")
    return 1.0


def gram(divs: np.ndarray, sigma: float, how: str = "clip") -> np.ndarray:
    return repair(np.exp(-(divs**2) / (2 * sigma**2)), how)[0]


def tune(spark: SparkSession, divs: np.ndarray, y: np.ndarray, kind: str = "SVC", sigmas=SIGMAS, params: list[dict] | None = None, n_folds: int = 3, how: str = "clip", seed: int = 0, rounds: int = 1000, weight: np.ndarray | None = None) -> dict:
    """The best of sigma (times `sigma_scale`) and parameters, by mean loss over folds; the first of equals."""
    return tune_each(spark, divs, y, [np.arange(len(divs))], kind, sigmas, params, n_folds, how, seed, rounds, weight)[0]


def tune_each(spark: SparkSession, divs: np.ndarray, y: np.ndarray, trains: list[np.ndarray], kind: str = "SVC", sigmas=SIGMAS, params: list[dict] | None = None, n_folds: int = 3, how: str = "clip", seed: int = 0, rounds: int = 1000, weight: np.ndarray | None = None) -> list[dict]:
    """As tune, for each of some sets of bags (their rows), in one Spark job: a row for every set, try and fold."""
    params = params or grid(kind)
    insides = [divs[np.ix_(at, at)] for at in trains]
    scales = [sigma_scale(d) for d in insides]
    tries = [*itertools.product(sigmas, params)]
    if len(tries) == 1:
        return [{"sigma": tries[0][0] * scale, **tries[0][1]} for scale in scales]
    shared = spark.sparkContext.broadcast((divs, y, np.ones(len(y)) if weight is None else np.asarray(weight, float), trains))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, labels, weights, sets = shared.value
        for pdf in batches:
            out = []
            for (of, sigma), rows in pdf.groupby(["of", "sigma"]):
                at = sets[of]
                k, own, w, fold = gram(every[np.ix_(at, at)], sigma, how), labels[at], weights[at], folds(len(at), n_folds, seed)
                for r in rows.itertuples():
                    train, test = np.flatnonzero(fold != r.fold), np.flatnonzero(fold == r.fold)
                    try:
                        m = Machine(kind, rounds=rounds, **tries[r.i][1]).fit(k[np.ix_(train, train)], own[train], w[train])
                        out.append((r.of, r.i, loss(kind, own[test], m.predict(k[np.ix_(test, train)]), w[test])))
                    except ValueError:
                        out.append((r.of, r.i, 1e50))
            yield pd.DataFrame(out, columns=["of", "i", "loss"])

    todo = [(of, i, float(s * scale), f) for of, scale in enumerate(scales) for i, (s, _) in enumerate(tries) for f in range(n_folds)]
    rows = spark.createDataFrame(todo, "of int, i int, sigma double, fold int")
    tasks = min(len(tries) * len(trains), spark.sparkContext.defaultParallelism)
    found = rows.repartition(tasks, "of", "sigma", "i").mapInPandas(run, "of int, i int, loss double").groupBy("of", "i").agg(F.avg("loss").alias("loss"))
    best = {r.of: r.i for r in found.groupBy("of").agg(F.min(F.struct("loss", "i"))["i"].alias("i")).collect()}
    return [{"sigma": tries[best[of]][0] * scale, **tries[best[of]][1]} for of, scale in enumerate(scales)]


def _fold_task(kind: str, how: str, project_all: bool):
    """Rows (fold, sigma, params) -> the predictions for the fold's bags, each fit in the task that its row is in."""

    def run(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
        d, y, w, fold = shared.value
        for pdf in batches:
            for r in pdf.itertuples():
                train, test = np.flatnonzero(fold != r.fold), np.flatnonzero(fold == r.fold)
                m = Machine(kind, **json.loads(r.params))
                if project_all:
                    k = gram(d, r.sigma, how)
                    pred = m.fit(k[np.ix_(train, train)], y[train], w[train]).predict(k[np.ix_(test, train)])
                else:
                    raw = np.exp(-(d**2) / (2 * r.sigma**2))
                    k, change = repair(raw[np.ix_(train, train)], how)
                    pred = m.fit(k, y[train], w[train]).predict(raw[np.ix_(test, train)] @ change)
                codes = np.searchsorted(np.unique(y), pred) if kind in ("SVC", "NuSVC") else pred
                yield pd.DataFrame({"at": test, "pred": np.asarray(codes, float)})

    return run


def crossvalidate(spark: SparkSession, divs: np.ndarray, y: np.ndarray, kind: str = "SVC", n_folds: int = 10, how: str = "clip", seed: int = 0, weight: np.ndarray | None = None, stratified: bool = False, fold: np.ndarray | None = None, project_all: bool = True, **search) -> tuple[float, np.ndarray]:
    """(score, predictions) of `crossvalidated`."""
    out = crossvalidated(spark, divs, y, kind, n_folds, how, seed, weight, stratified, fold, project_all, **search)
    return out["score"], out["preds"]


def crossvalidated(spark: SparkSession, divs: np.ndarray, y: np.ndarray, kind: str = "SVC", n_folds: int = 10, how: str = "clip", seed: int = 0, weight: np.ndarray | None = None, stratified: bool = False, fold: np.ndarray | None = None, project_all: bool = True, **search) -> dict:
    """score, preds, the fold of each bag and params, those of each fold: every fold tunes on its training bags, and its
    machine is fitted in a task of its own.

    weight: of the bags, in fits and in the score. fold: the fold of each bag, in place of random (or stratified) ones.
    project_all: test bags join the Gram matrix without labels; otherwise it is repaired for the training bags alone
    and the test rows are mapped to it.
    """
    y, divs, w = np.asarray(y), (divs + divs.T) / 2, np.ones(len(y)) if weight is None else np.asarray(weight, float)
    if fold is None:
        fold = folds(len(y), n_folds, seed, y if stratified else None)
    fold = np.asarray(fold)
    names = np.unique(fold)
    bests = tune_each(spark, divs, y, [np.flatnonzero(fold != f) for f in names], kind, how=how, seed=seed, weight=w, **search)
    params = {int(f): best for f, best in zip(names, bests)}
    todo = [(f, float(best["sigma"]), json.dumps({k: v for k, v in best.items() if k != "sigma"})) for f, best in params.items()]
    shared, task = spark.sparkContext.broadcast((divs, y, w, fold)), _fold_task(kind, how, project_all)
    rows = spark.createDataFrame(todo, "fold int, sigma double, params string").repartition(len(todo), "fold")
    found = rows.mapInPandas(lambda b: task(b, shared), "at long, pred double").collect()
    classifies = kind in ("SVC", "NuSVC")
    preds = np.empty(len(y), y.dtype if classifies else float)
    for r in found:
        preds[r.at] = np.unique(y)[int(r.pred)] if classifies else r.pred
    bad = loss(kind, y, preds, w)
    return {"score": 1 - bad if classifies else bad**0.5, "preds": preds, "fold": fold, "params": params}


def transduct(divs: np.ndarray, y: np.ndarray, n_train: int, kind: str = "SVC", sigma: float = 1.0, how: str = "clip", mode: str = "predict", **params) -> np.ndarray:
    """For the bags after the first n_train, which are projected together with them. mode: predict, decision, probabilities or log_probabilities."""
    k = gram((divs + divs.T) / 2, sigma, how)
    m = Machine(kind, **params).fit(k[:n_train, :n_train], y)
    if mode.endswith("probabilities"):
        m.calibrate(k[:n_train, :n_train], np.asarray(y))
    return getattr(m, mode)(k[n_train:, :n_train])
