"""Command line over Parquet: python -m bagdiv divs | cv | predict."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import SparkSession

from .operators import divergence, estimators, kernel, machines
from .sources.files import DivergenceCache, write_attrs
from .sources.growing import counted
from .tables import scratch

#: The divergences that are estimated by default.
DIVS = ["hellinger", "bc", "linear", "l2", "kl", "renyi:.5", "renyi:.7", "renyi:.9", "renyi:.99"]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("bagdiv", description="points: Parquet (bag_id, point_id, features); labels: Parquet (bag_id, label)")
    todo = out.add_subparsers(dest="todo", required=True)
    one = todo.add_parser("divs", help="divergences between all bags, written by spec and K")
    one.add_argument("points"), one.add_argument("out")
    one.add_argument("--strict", action="store_true", help="values that aren't finite are an error")
    one.add_argument("--div", nargs="+", default=DIVS), one.add_argument("-K", nargs="+", type=int, default=[1, 3, 5, 10])
    for name, more in (("cv", ("points", "labels", "out")), ("predict", ("points", "labels", "test", "out"))):
        one = todo.add_parser(name)
        for a in more:
            one.add_argument(a)
        one.add_argument("--div", default="kl"), one.add_argument("-K", type=int, default=3), one.add_argument("--folds", type=int, default=10)
        one.add_argument("--kind", default="SVC", choices=["SVC", "NuSVC", "SVR", "NuSVR", "OneClassSVM"])
        one.add_argument("--psd", default="clip", choices=["clip", "project", "shift", "flip", "square", "identity"])
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("bagdiv").getOrCreate()
    pts = spark.read.parquet(a.points)
    if a.todo == "divs":
        with scratch(spark):
            counted(divergence.estimate_divs(pts, a.div, a.K), a.div, a.K, DivergenceCache(spark, a.out).write, a.strict)
        return
    labels = spark.read.parquet(a.labels)
    if a.todo == "predict":
        m = estimators.BagMachine(a.kind, a.div, a.K, a.psd).fit(pts, labels)
        m.predict(spark.read.parquet(a.test)).write.parquet(a.out)
        write_attrs(spark, a.out, {"div": a.div, "K": a.K, "kind": a.kind, "psd": a.psd, "params": {"sigma": float(m.sigma), **m.best}})
        return
    said = {r.bag_id: r.label for r in labels.where("label is not null").collect()}
    ids = sorted(said)
    with scratch(spark):
        d = kernel.matrix(divergence.estimate_divs(pts, [a.div], [a.K]), ids)
    y = np.array([said[b] for b in ids])
    found = machines.crossvalidated(spark, d, y, a.kind, a.folds, a.psd)
    print(f"score {found['score']:.6f}")
    rows = [*zip(ids, y.tolist(), found["preds"].tolist(), found["fold"].tolist())]
    spark.createDataFrame(rows, ["bag_id", "label", "pred", "fold"]).write.parquet(a.out)
    write_attrs(spark, a.out, {"score": float(found["score"]), "div": a.div, "K": a.K, "kind": a.kind, "psd": a.psd, "params": found["params"]})


if __name__ == "__main__":
    main()
