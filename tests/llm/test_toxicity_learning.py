"""The lexicon that Spark's counts give, against one counted plainly in Python."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from bagdiv.llm import toxicity


def plain(texts: list[str | None], toxic: list[int], least: int, most: int) -> tuple[dict, dict]:
    """(weights, exceptions) by the definition."""
    folded = [toxicity.fold(t) for t in texts]
    docs, around = {0: Counter(), 1: Counter()}, defaultdict(set)
    for f, t in zip(folded, toxic):
        words = f.split()
        docs[t].update({k for w in words for k in toxicity.entries(w)})
        for i, w in enumerate(words if t else []):
            for k in toxicity.entries(w):
                around[k].add((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    weight = {k: math.log((n + 0.5) / (n1 + 1)) - math.log((docs[0][k] + 0.5) / (n0 + 1)) for k, n in docs[1].items() if len(around[k]) >= least}
    sure = {k: w for k, w in weight.items() if w > 3 and (not docs[0][k] or w > 3 * math.sqrt(1 / (docs[1][k] + 0.5) + 1 / (docs[0][k] + 0.5)))}
    best = {k: sure[k] for k in sorted(sure, key=lambda k: (-sure[k] * math.log1p(docs[1][k]), k))[:most]}
    shorter = lambda k: [k[: n + 1] for n in toxicity.PREFIXES if k[: n + 1] != k]
    weights = {k: w for k, w in best.items() if not any(s in best and best[s] >= w - 0.7 for s in shorter(k))}
    held = {0: Counter(), 1: Counter()}
    for f, t in zip(folded, toxic):
        words, found = f.split(), set()
        for i, w in enumerate(words):
            for k in {*toxicity.entries(w)} & {*weights}:
                found |= {(f" {words[i - 1]} {w} ", weights[k])} if i else set()
                found |= {(f" {w} {words[i + 1]} ", weights[k])} if i + 1 < len(words) else set()
        held[t].update(found)
    exceptions: dict[str, float] = {}
    for (phrase, w), n in held[0].items():
        if n >= 2 and not held[1][phrase, w]:
            exceptions[phrase] = min(-w, exceptions.get(phrase, 0.0))
    return weights, exceptions


def test_lexicon_of_the_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.fit(docs, labels, F.lit(False))
    told = {r.doc_id: int(r.toxic != 0) for r in labels.where("toxic is not null").collect()}
    rows = [(r.text, told[r.doc_id]) for r in docs.collect() if r.doc_id in told]
    weights, exceptions = plain(*zip(*rows), 5, 5000)
    assert weights and got.weights == weights and got.exceptions == exceptions


@pytest.mark.parametrize("most", [3, 5000])
def test_lexicon_with_exceptions_copies_and_ties(spark, most):
    """Copies of one text count once for the words around an entry; null and empty texts, tied entries, phrases of clean texts alone."""
    texts = [(f"you vile{i % 7} wretched{'ly' * (i % 2)} thing{i}", 1) for i in range(30)] + [("the same scoundrel words", 1)] * 20
    texts += [(f"sunny day number{i} walk {i}", 0) for i in range(400)] + [(f"the wretched weather again{i}", 0) for i in range(2)] + [(None, 0), ("", 1), (" \n ", 0)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    got = toxicity.fit(docs, labels, F.lit(False)) if most == 5000 else toxicity.learn(docs.join(labels, "doc_id").mapInArrow(_folded, "doc_id long, toxic boolean, folded string"), 51, len(texts) - 51, most=most)
    weights, exceptions = plain(*zip(*texts), 5, most)
    assert got.weights == weights and got.exceptions == exceptions
    assert weights and " scoundrel " not in weights and len(weights) <= most
    assert most < 5000 or " wretched weather " in exceptions or " the wretched " in exceptions


def _folded(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "toxic": b.column(2).cast(pa.bool_()), "folded": pa.array([toxicity.fold(t) for t in b.column(1).to_pylist()], pa.string())})
