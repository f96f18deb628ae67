"""Machines over bags: fit on some, predict others.

Divergences come from Spark; the Gram matrix of the training bags, a row for each, is on the driver. Between
the bags to predict and those of the training, divergences are computed in both directions and not within either side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel, machines
from .divergence import estimate_divs


def accuracy(label: Column, pred: Column) -> Column:
    return F.avg((pred == label).cast("double"))


def rmse(label: Column, pred: Column) -> Column:
    return F.sqrt(F.avg(F.pow(pred - label, 2)))


@dataclass
class BagMachine:
    """kind as of Machine; div and k name the divergence; sigmas count in `machines.sigma_scale` of the divergences.

    Several sigmas or params are searched by folds of the training bags. probability: fit sigmoids too.
    """

    kind: str = "SVC"
    div: str = "kl"
    k: int = 3
    how: str = "clip"
    sigmas: tuple[float, ...] | None = None
    params: list[dict] | None = None
    n_folds: int = 3
    seed: int = 0
    probability: bool = False

    def fit(self, pts: DataFrame, labels: DataFrame | None = None) -> "BagMachine":
        """points, and labels (bag_id, label) of their bags; bags without a label only take part in the projection. OneClassSVM needs no labels."""
        divs = kernel.symmetrize(estimate_divs(pts, [self.div], [self.k]).select("p", "q", "value"))
        self.pts = pts.select("bag_id", "point_id", "features")
        self.ids = [r[0] for r in pts.select("bag_id").distinct().orderBy("bag_id").collect()]
        d = kernel.matrix(divs, self.ids)
        one_class = self.kind == "OneClassSVM"
        said = {} if labels is None else {r.bag_id: r.label for r in labels.where("label is not null").select("bag_id", "label").collect()}
        self.rows = np.array([i for i, b in enumerate(self.ids) if one_class or b in said], int)
        y = None if one_class else np.array([said[self.ids[i]] for i in self.rows])
        if len(self.rows) < 2:
            raise ValueError("two bags at least must have labels")
        sigmas = self.sigmas or ((1.0,) if one_class else machines.SIGMAS)
        inside = d[np.ix_(self.rows, self.rows)]
        best = machines.tune(pts.sparkSession, inside, y, self.kind, sigmas, self.params or ([{}] if one_class else None), self.n_folds, self.how, self.seed)
        self.sigma, self.best = best.pop("sigma"), best
        gram, self.change = kernel.repair(np.exp(-(d**2) / (2 * self.sigma**2)), self.how)
        gram = gram[np.ix_(self.rows, self.rows)]
        self.machine = machines.Machine(self.kind, **best).fit(gram, y)
        if self.probability:
            self.machine.calibrate(gram, y, seed=self.seed)
        return self

    def _kernel(self, pts: DataFrame) -> tuple[list, np.ndarray]:
        def named(df: DataFrame, side: str) -> DataFrame:
            return df.select(F.concat(F.lit(side), F.col("bag_id").cast("string")).alias("bag_id"), "point_id", "features", F.lit(side).alias("split"))

        ids = [r[0] for r in pts.select("bag_id").distinct().orderBy("bag_id").collect()]
        divs = kernel.symmetrize(estimate_divs(named(pts, "new:").unionByName(named(self.pts, "old:")), [self.div], [self.k]).select("p", "q", "value"))
        divs = divs.where(F.col("p").startswith("new:") & F.col("q").startswith("old:"))
        d = np.full((len(ids), len(self.ids)), np.nan)
        at, to = ({f"{side}{b}": i for i, b in enumerate(names)} for side, names in (("new:", ids), ("old:", self.ids)))
        for r in divs.collect():
            d[at[r.p], to[r.q]] = np.nan if r.value is None else r.value
        return ids, (np.exp(-(d**2) / (2 * self.sigma**2)) @ self.change)[:, self.rows]

    def _rows(self, pts: DataFrame, ids: list, values: np.ndarray, name: str) -> DataFrame:
        kind = "array<double>" if values.ndim > 1 else {"i": "long", "f": "double", "b": "boolean"}.get(values.dtype.kind, "string")
        return pts.sparkSession.createDataFrame([*zip(ids, values.tolist())], f"bag_id {pts.schema['bag_id'].dataType.simpleString()}, {name} {kind}")

    def predict(self, pts: DataFrame) -> DataFrame:
        """(bag_id, pred) of other bags, whose ids may be the same as those of the training."""
        ids, k = self._kernel(pts)
        return self._rows(pts, ids, self.machine.predict(k), "pred")

    def decision(self, pts: DataFrame) -> DataFrame:
        """(bag_id, decision): a value for each pair of classes, or the one value of other kinds."""
        ids, k = self._kernel(pts)
        return self._rows(pts, ids, self.machine.decision(k), "decision")

    def probabilities(self, pts: DataFrame) -> DataFrame:
        """(bag_id, probability): in the order of the classes."""
        ids, k = self._kernel(pts)
        return self._rows(pts, ids, self.machine.probabilities(k), "probability")

    def score(self, pts: DataFrame, labels: DataFrame) -> float:
        """Accuracy of classifiers, root of the mean squared error of the others."""
        met = self.predict(pts).join(labels, "bag_id")
        if self.kind in ("SVC", "NuSVC", "OneClassSVM"):
            return met.agg(accuracy(F.col("label"), F.col("pred"))).first()[0]
        return met.agg(rmse(F.col("label"), F.col("pred"))).first()[0]
