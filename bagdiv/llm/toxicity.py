"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding maps homoglyphs to Latin letters, takes accents and invisible characters away and reads digits and
signs inside words as the letters that they stand for. Lexicon entries are whole words and word beginnings whose
weights are learned from labels; longer exception phrases take back the weight of the entry that they hold.
The sum of the weights is normalised by length and put on a scale from 0 to 1.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dropped

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = dict(zip("абвгдеёзіїјкмнорстухцѕԁһԛԝАВЕЗІЈКМНОРСТУХЅαβγεηικμνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧøØıłŁđĐ", "abbrdeeziijkmhopctyxusdhqwabeзijkmhopctyxsabyenikuvoptuxwabezhikmnoptyxoOilLdD".replace("з", "z")))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i", "+": "t"}
INVISIBLE = "­​‌‍⁠﻿"
_LETTERS = {ord(k): v for k, v in HOMOGLYPHS.items()} | dict.fromkeys(map(ord, INVISIBLE))
_MARKS = re.compile(r"[̀-ͯ]+")
_MIXED = re.compile(r"[^\W\d_]*(?:[0134578](?=[^\W_]*[^\W\d_])|(?<=[^\W\d_])[0134578]|[@$€](?=[^\W\d_])|(?<=[^\W\d_])[@!|+](?=[^\W\d_]))[\w@$!€|+]*")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([.\-_*·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_OTHER = re.compile(r"[\W_]+")
_AS_LETTER = {ord(k): v for k, v in LEET.items()}
PREFIXES = (4, 5, 6)


def fold_word(word: str) -> str:
    """The folded words that stand in a word between white space, single spaces between them."""
    if not word.isascii():
        word = _MARKS.sub("", unicodedata.normalize("NFKD", word)).translate(_LETTERS)
    word = word.lower()
    if not word.isalpha():
        word = _MIXED.sub(lambda m: re.sub(r"[!$@|+€]+$", "", m[0]).translate(_AS_LETTER), word)
        word = _SPACED.sub(lambda m: _OTHER.sub("", m[0]), word)
        word = _OTHER.sub(" ", word).strip()
    return _RUN.sub(r"\1", word)


class _Folded(dict):
    """Folded words that a process has met; emptied when it is large, which costs time only."""

    def __missing__(self, word: str) -> str:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = fold_word(word) if len(word) <= 256 else " ".join(fold_word(word[i : i + 256]) for i in range(0, len(word), 256))
        return out


_folded = _Folded()


def fold(text: str | None) -> str:
    """The text as words between single spaces, a space at either end; empty if it has none."""
    text = " ".join([w for w in map(_folded.__getitem__, (text or "").split()) if w])
    return f" {text} " if text else ""


def entries(word: str) -> list[str]:
    """The whole word, as " word ", and beginnings of it, as " begin"."""
    return ([f" {word} "] if len(word) > 2 else []) + [f" {word[:k]}" for k in PREFIXES if len(word) > k]


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: dict[str, float]
    power: float
    scale: float
    shift: float

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for phrase, weight in (self.weights | self.exceptions).items():
            out.add_word(phrase, weight)
        if len(out):
            out.make_automaton()
        return out

    def raw(self, automaton, folded: str) -> float:
        return sum(w for _, w in automaton.iter(folded)) if len(automaton) and folded else 0.0

    def density(self, raw: float, folded: str) -> float:
        return raw / max(1, folded.count(" ") - 1) ** self.power

    def score(self, automaton, text: str | None) -> float:
        folded = fold(text)
        z = self.scale * self.density(self.raw(automaton, folded), folded) + self.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(scale, shift, loss) of a logistic curve by Newton steps with a small ridge."""
    spread = float(x.std()) or 1.0
    a = np.column_stack([x / spread, np.ones(len(x))])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ b, -30, 30))), 1e-12, 1 - 1e-12)
    return float(b[0] / spread), float(b[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _folded_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            own = batch.slice(i, 1000)
            yield pa.RecordBatch.from_pydict({"doc_id": own.column(0), "toxic": own.column(1), "folded": pa.array([fold(t) for t in own.column(2).to_pylist()], pa.string())})


def _entry_counts(least: int):
    """Rows (toxic, folded) -> (entry, bad, good, beside): texts of either kind that hold an entry, and up to `least` different
    pairs of words around it in toxic ones, which are enough to tell over all tasks whether there are so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good, beside, known = Counter(), Counter(), {}, {}
        for batch in batches:
            for toxic, folded in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = folded.split()
                found: set[str] = set()
                for w in set(words):
                    if w not in known:
                        known[w] = entries(w)
                    found.update(known[w])
                (bad if toxic else good).update(found)
                if toxic:
                    for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                        for k in known[w]:
                            if len(seen := beside.setdefault(k, set())) < least:
                                seen.add(f"{before} {after}")
        every = [*(bad | good)]
        for i in range(0, len(every), 10_000):
            own = every[i : i + 10_000]
            yield pa.RecordBatch.from_pydict({"entry": pa.array(own, pa.string()), "bad": pa.array([bad[k] for k in own], pa.int64()), "good": pa.array([good[k] for k in own], pa.int64()), "beside": pa.array([[*beside.get(k, ())] for k in own], pa.list_(pa.string()))})

    return run


def _phrases(lexicon):
    """Rows (toxic, folded) -> (phrase, weight, held, seen): clean and toxic texts that hold an entry with the word before or after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held, seen = lexicon.value.automaton(), Counter(), Counter()
        for batch in batches:
            for toxic, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set()
                for end, w in automaton.iter(f) if len(automaton) and f else ():
                    first = f.rfind(" ", 0, end)
                    stop = f.find(" ", first + 1)
                    before, after = f.rfind(" ", 0, first), f.find(" ", stop + 1)
                    found |= {(f[before : stop + 1], w)} if before >= 0 else set()
                    found |= {(f[first : after + 1], w)} if after > 0 else set()
                (seen if toxic else held).update(found)
        every = [*(held | seen)]
        for i in range(0, len(every), 10_000):
            own = every[i : i + 10_000]
            yield pa.RecordBatch.from_pydict({"phrase": pa.array([p for p, _ in own], pa.string()), "weight": pa.array([w for _, w in own], pa.float64()), "held": pa.array([held[k] for k in own], pa.int64()), "seen": pa.array([seen[k] for k in own], pa.int64())})

    return run


def _sums(lexicon):
    """Rows (doc_id, toxic, folded) -> (doc_id, toxic, raw, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Lexicon = lexicon.value
        automaton = own.automaton()
        for batch in batches:
            folded = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "toxic": batch.column(1), "raw": pa.array([float(own.raw(automaton, f)) for f in folded], pa.float64()), "words": pa.array([max(1, f.count(" ") - 1) for f in folded], pa.int64())})

    return run


def learn(texts: DataFrame, n_toxic: int, n_clean: int, least: int = 5, most: int = 5000) -> Lexicon:
    """texts (doc_id, toxic, folded), read three times -> a lexicon of at most `most` entries: each between `least` different pairs of
    words in toxic texts (so that copies of one text count once) and at least twenty times as frequent there. Counts are
    Spark's; the driver gets the entries, the exceptions, and for each text the sum of its weights and its number of words."""
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Lexicon({}, {}, 0.0, 1.0, math.log(share / (1 - share)))
    context = texts.sparkSession.sparkContext
    two = texts.select("toxic", "folded")
    counted = two.mapInArrow(_entry_counts(least), "entry string, bad long, good long, beside array<string>").groupBy("entry")
    counted = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.size(F.array_distinct(F.flatten(F.collect_list("beside")))).alias("pairs")).where(F.col("pairs") >= least)
    weight = F.log((F.col("bad") + 0.5) / (n_toxic + 1)) - F.log((F.col("good") + 0.5) / (n_clean + 1))
    # Beyond the odds, the difference must exceed three standard errors, so that chance doesn't make entries.
    chance = F.when(F.col("good") > 0, 3 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))).otherwise(0.0)
    sure = counted.withColumn("weight", weight).where((F.col("weight") > 3) & (F.col("weight") > chance))
    rows = sure.orderBy((F.col("weight") * F.log1p("bad")).desc(), "entry").limit(most).collect()
    best = {r.entry: math.log((r.bad + 0.5) / (n_toxic + 1)) - math.log((r.good + 0.5) / (n_clean + 1)) for r in rows}
    # Of a beginning and what it is a beginning of, only the beginning counts if it says as much.
    weights = {k: w for k, w in best.items() if not any(k[: n + 1] != k and best.get(k[: n + 1], -1) >= w - 0.7 for n in PREFIXES)}
    lexicon = Lexicon(weights, {}, 0.0, 1.0, 0.0)
    # Exceptions: an entry with the word before or after it, if that phrase is found in clean texts alone. Of two entries in
    # one phrase it takes back the larger weight.
    shared = context.broadcast(lexicon)
    phrases = two.mapInArrow(_phrases(shared), "phrase string, weight double, held long, seen long").groupBy("phrase", "weight").agg(F.sum("held").alias("held"), F.sum("seen").alias("seen"))
    kept = phrases.where("held >= 2 and seen = 0").groupBy("phrase").agg(F.max("weight").alias("weight")).collect()
    shared.unpersist()
    lexicon = Lexicon(weights, {r.phrase: -r.weight for r in sorted(kept)}, 0.0, 1.0, 0.0)
    shared = context.broadcast(lexicon)
    facts = texts.mapInArrow(_sums(shared), "doc_id long, toxic boolean, raw double, words long").toArrow().sort_by("doc_id")
    shared.unpersist()
    y, raw, words = (facts.column(c).to_numpy().astype(float) for c in ("toxic", "raw", "words"))
    tried = [(*_logistic(raw / words**power, y), power) for power in (0.25, 0.5, 0.75, 1.0)]
    lexicon.scale, lexicon.shift, _, lexicon.power = min(tried, key=lambda t: (t[2], t[3]))
    return lexicon


def _scored(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Lexicon = lexicon.value
        automaton = own.automaton()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                score = [own.score(automaton, t) for t in batch.column(1).slice(i, 1000).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, 1000), "score": pa.array(score, pa.float64())})

    return run


def fit(documents: DataFrame, labels: DataFrame, held_out: Column, sample: int = 12_000, text_bytes: int = 64 << 20) -> Lexicon:
    """From at most `sample` labelled documents that aren't held out and at most `text_bytes` of their texts, those of the
    smallest hash of doc_id. A text that alone is larger than what is left is passed over. Of rows with one doc_id
    the first text counts. Their folded texts are a written table, from which Spark makes the counts."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out)
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = documents.select("doc_id", "text").join(F.broadcast(own), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= text_bytes)
    rows = checkpointed(met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    sizes = rows.select("doc_id", (F.col("toxic") != 0).alias("toxic"), F.xxhash64("doc_id").alias("at"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()
    room, chosen = text_bytes, []
    for r in sorted(sizes, key=lambda r: (r["at"], r["doc_id"])):
        if r["n"] <= room:
            room -= r["n"]
            chosen.append((r["doc_id"], r["toxic"]))
    n_toxic = sum(toxic for _, toxic in chosen)
    ids = documents.sparkSession.createDataFrame([(doc_id,) for doc_id, _ in chosen], "doc_id long")
    # Slices of about a megabyte.
    own = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", (F.col("toxic") != 0).alias("toxic"), "text")
    texts = checkpointed(own.repartition(((text_bytes - room) >> 20) + 1, "doc_id").mapInArrow(_folded_texts, "doc_id long, toxic boolean, folded string"))
    dropped(rows)
    lexicon = learn(texts, n_toxic, len(chosen) - n_toxic)
    dropped(texts)
    return lexicon


def toxicity(documents: DataFrame, labels: DataFrame, held_out: Column, **how) -> DataFrame:
    """documents (doc_id, text; more are ignored), labels (doc_id, toxic) -> (doc_id, held_out, score, predicted), a row for each document.

    Only the text enters a score. Null and empty texts score as texts without any entry. Of two labels of one document
    the higher counts; with no labels, or of one kind only, every score is the share of toxic ones. A row for each row,
    so repeated and null doc_ids are as any other; equal texts get equal scores; an empty table gives no rows.
    """
    lexicon = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, held_out, **how))
    found = documents.select("doc_id", "text").mapInArrow(_scored(lexicon), "doc_id long, score double")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
