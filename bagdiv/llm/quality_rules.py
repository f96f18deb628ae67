"""Quality rules: an ordered decision list, learned by sequential covering from labelled statistics.

Statistics of whole texts come from one vectorised pass. Rules that reject are grown one condition at a time
(threshold on a statistic, by information gain) on two thirds of the labelled rows, pruned on the last
third, and kept while they hold there; the rows that a rule covers are then taken out. The list becomes
one conditional Spark expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_words, text_chunks, windows

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = ["n_upper", "n_letters", "n_digits", "n_points", "n_bangs", "n_bars", "n_capitals", "n_lines", "n_distinct", "n_bare"]
#: What rules are made of: ratios, so that they mean the same for texts of any length.
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "n_letters"),
    "digits": ("n_digits", "word_chars"), "points": ("n_points", "word_chars"), "bangs": ("n_bangs", "n_words"), "bars": ("n_bars", "n_words"), "capitals": ("n_capitals", "n_words"), "distinct": ("n_distinct", "n_words"),
    "bare": ("n_bare", "n_words"), "per_line": ("n_words", "n_lines"), "length": ("n_words", None),
}


def _marked(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOL, UPPER, DIGIT, POINT, BANG, BAR = map(_marked, ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"-()", "!", "|"))
LETTER = _marked("abcdefghijklmnopqrstuvwxyz") | UPPER
#: Bytes that begin a code point.
FIRST = np.ones(256, bool)
FIRST[0x80:0xC0] = False


def _repeat_words(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> np.ndarray:
    """Words that lie in runs of k words which their text has twice or more."""
    grams, edges = windows(h, bounds, k, short=False)
    out = np.zeros(len(bounds) - 1, np.int64)
    for d in range(len(out)):
        own = grams[edges[d] : edges[d + 1]]
        if len(own) > 1:
            _, which, n = np.unique(own, return_inverse=True, return_counts=True)
            at = np.flatnonzero(n[which] > 1)
            if len(at):
                step = np.zeros(len(own) + k, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + k, -1)
                out[d] = np.count_nonzero(np.cumsum(step))
    return out


def _dup_lines(text: bytes) -> tuple[int, int]:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0, len(lines)
    full = [x for x in lines if x.split()]
    return len(full) - len(set(full)), len(lines)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts under the name text; all other columns are passed on."""
    for batch in batches:
        others = [c for c in batch.schema.names if c != "text"]
        for i, j, data, offsets in text_chunks(batch.column("text")):
            starts, lengths, h, bounds = split_words(data, offsets, lower=False)
            summed = lambda mark: np.diff(np.append(0, np.cumsum(mark))[offsets])
            by_word = lambda mark: np.diff(np.append(0, np.cumsum(mark))[bounds])
            solid = np.zeros(len(data) + 1, np.int64)
            np.add.at(solid, starts, 1)
            np.add.at(solid, starts + lengths, -1)
            solid = np.cumsum(solid)[:-1] > 0
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets, offsets[1:])]
            dup = np.array([_dup_lines(t) for t in texts], np.int64).reshape(-1, 2)
            alnum = np.append(0, np.cumsum(LETTER[data] | DIGIT[data] | (data >= 0x80)))
            got = {
                "n_words": np.diff(bounds), "word_chars": summed(solid & FIRST[data]), "n_symbols": summed(SYMBOL[data]), "n_dup_lines": dup[:, 0], "n_repeat_words": _repeat_words(h, bounds),
                "n_upper": summed(UPPER[data]), "n_letters": summed(LETTER[data]), "n_digits": summed(DIGIT[data]), "n_points": summed(POINT[data]), "n_bangs": summed(BANG[data]), "n_bars": summed(BAR[data]),
                "n_capitals": by_word(UPPER[data[starts]]), "n_lines": dup[:, 1], "n_distinct": np.array([len(np.unique(h[a:b])) for a, b in zip(bounds, bounds[1:])], np.int64), "n_bare": by_word(alnum[starts + lengths] == alnum[starts]),
            }
            yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(i, j - i) for c in others} | {k: pa.array(v.astype(np.int64)) for k, v in got.items()})


def statistics(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, counts…) over whole texts; null text counts as empty."""
    return documents.select("doc_id", "text").mapInArrow(_stats, "doc_id long, " + ", ".join(f"{c} long" for c in BASE + COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def ratio(name: str) -> Column:
    over, under = RATIOS[name]
    return F.col(over).cast("double") if under is None else F.col(over) / F.greatest(F.col(under), F.lit(1))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    at: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(RATIOS).index(self.name)]
        return column >= self.at if self.above else column < self.at

    def column(self) -> Column:
        return ratio(self.name) >= self.at if self.above else ratio(self.name) < self.at

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.at:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, longest: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest and bad[inside].any() and not bad[inside].all():
        here, b = x[inside], bad[inside]
        p0, n0 = b.sum(), (~b).sum()
        best, gain = None, 1e-9
        for k, name in enumerate(RATIOS):
            order = np.argsort(here[:, k], kind="stable")
            v, p = here[order, k], np.append(0, np.cumsum(b[order]))
            n = np.arange(len(v) + 1) - p
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            for above, ps, ns in ((False, p[cut], n[cut]), (True, p0 - p[cut], n0 - n[cut])):
                g = ps * (np.log2(np.maximum(ps, 1e-9) / np.maximum(ps + ns, 1)) - math.log2(p0 / (p0 + n0)))
                if len(g) and g.max() > gain:
                    i = cut[int(g.argmax())]
                    best, gain = Condition(name, above, float((v[i - 1] + v[i]) / 2)), g.max()
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    inside = covered(rule, x)
    p, n = int(bad[inside].sum()), int((~bad)[inside].sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, most: int = 24, longest: int = 4) -> list[Rule]:
    """Rules that reject, in order. A rule must reach `precision` on rows that it was pruned on, and cover three bad ones."""
    rules: list[Rule] = []
    third = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < most:
        grow, prune = left & ~third, left & third
        rule = _grow(x[grow], bad[grow], longest)
        if not rule:
            break
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, x[prune], bad[prune]), -len(r)))
        inside, checked = left & covered(rule, x), prune & covered(rule, x)
        if bad[inside].sum() < 3 or bad[inside].mean() < precision or (checked.any() and bad[checked].mean() < precision):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for texts that no rule rejects: CASE WHEN rule 1 THEN false … ELSE true."""
    out = None
    for rule in rules:
        every = rule[0].column()
        for c in rule[1:]:
            every = every & c.column()
        out = F.when(every, F.lit(False)) if out is None else out.when(every, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[Rule]:
    """Rules from at most `sample` labelled documents, those of the smallest hash of doc_id. labels (doc_id, quality: 0 is bad, null is none).

    Only the texts of these are read for it. Of rows with one doc_id the one with the least statistics counts.
    """
    own = labels.select("doc_id", "quality").where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = statistics(documents.select("doc_id", "text").join(F.broadcast(own.select("doc_id")), "doc_id", "left_semi"))
    stats = met.groupBy("doc_id").agg(F.min(F.struct(*BASE, *COUNTS)).alias("stats")).select("doc_id", "stats.*")
    rows = stats.join(F.broadcast(own), "doc_id").select(F.xxhash64("doc_id").alias("at"), "doc_id", "quality", *(ratio(k).alias(k) for k in RATIOS)).toArrow()
    column = lambda name: rows.column(name).to_numpy()
    order = np.lexsort((column("doc_id"), column("at")))
    if not len(order):
        return []
    return learn(np.column_stack([column(k) for k in RATIOS])[order], (column("quality") == 0)[order])


def quality(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """documents (doc_id, text; more are ignored), labels (doc_id, quality) ->
    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each document.

    Null and empty texts have no words and fail the base rule. Without labels only the base rule holds. A document
    with two labels counts by the lower one. Every row is judged by its own text, so repeated doc_ids and null ones
    are as any other. Equal statistics get equal verdicts. An empty table gives no rows.
    """
    stats = statistics(documents)
    rules = fit(documents, labels, **how)
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def filtered(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """documents without those that are rejected, their columns as they were.

    The columns pass through the task that makes the statistics, so no text is shuffled or joined. Nulls, repeated
    rows and empty tables as in `quality`; columns of any names pass.
    """
    rules = fit(documents, labels, **how)
    names = documents.columns
    own = documents.select("text", *(F.col(c).alias(f"own{i}") for i, c in enumerate(names)))
    kinds = [f"own{i} {f.dataType.simpleString()}" for i, f in enumerate(documents.schema)]
    rows = own.mapInArrow(_stats, ", ".join([*kinds, *(f"{c} long" for c in BASE + COUNTS)]))
    return rows.where(~base_failed() & verdict(rules)).select(*(F.col(f"own{i}").alias(c) for i, c in enumerate(names)))
