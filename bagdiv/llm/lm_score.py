"""Language-model scores by a weighted backoff automaton.

The states are the empty history and every word and every pair of words of the training documents as a history. An
arc carries the log-probability of a word after a history (absolute discounting), a failure arc the weight of
backing off to the history without its first word; the empty history reads any word. No pair or triple is dropped,
so the model grows with the corpus. It is never in one place: documents are dealt to groups of bounded size, a
group asks the owners of states for the counts of the arcs that its texts can take, first of words, then of those
pairs whose arcs it can't know itself, and compiles from their answers the part of the automaton that it needs,
which reads its texts from left to right in one pass. Words, pairs and triples are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpointed, dropped, long_array, mix64, split_words, text_chunks
from .frequent import above_cutoff

#: The end of a text, counted as a token; no word holds white space.
END = b" "
DISCOUNT = 0.75
END_HASH = U64(0x5D1F0C2A9B7E4361)
_FIRST, _SLICE = U64(0x9E6C63D0876A9A47), U64(0xC2B2AE3D27D4EB4F)
#: Bytes of text in a group of documents; and at most so many words whose arcs are dealt to several owners.
GROUP_BYTES, HOT_WORDS = 6 << 20, 1 << 12
#: At most so many of the most frequent words (12 bytes each in a broadcast) are named by their places in questions, all others by
#: their hashes; and bytes of text that a task holds while it deals them to groups.
RANKED, DEALT_BYTES = 1 << 20, 32 << 20
_ZSTD = pa.Codec("zstd", compression_level=3)


def folded(doc_id: str, mod: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod))


def held_out_fold(mod: int, remainder: int) -> Column:
    return F.coalesce(folded("doc_id", mod) == remainder, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then the end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def hashed(found: list[bytes]) -> np.ndarray:
    """Hashes of words as `split_words` makes them; END has one of its own."""
    out = np.full(len(found), END_HASH, U64)
    own = [i for i, w in enumerate(found) if w != END]
    if own:
        data = b" ".join(found[i] for i in own)
        out[own] = split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[2]
    return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * _FIRST + mix64(b) + _FIRST)


def sequences(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes with the ends, bounds of each text) of runs of texts."""
    for i, _, data, offsets in text_chunks(texts):
        _, _, h, bounds = split_words(data, offsets)
        yield i, np.insert(h, bounds[1:], END_HASH), bounds + np.arange(len(bounds))


@dataclass
class Unigrams:
    """Probabilities of single words: absolute discounting, what it takes away going to all unseen words as one.

    ends: how often a training text ended. hot: words whose arcs have several owners, with the number of those; most: what
    one owner of a state is to have of its arcs. frequent, places: hashes of the most frequent words, in order, and their
    places by frequency.
    """

    total: int
    distinct: int
    discount: float
    ends: int = 0
    hot: dict[int, int] = field(default_factory=dict)
    most: int = 1 << 16
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def rank(self, words: np.ndarray) -> np.ndarray:
        """Places of words among the frequent ones, RANKED for all others."""
        if not len(self.frequent):
            return np.full(len(words), RANKED, np.int64)
        at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
        return np.where(self.frequent[at] == words, self.places[at], RANKED).astype(np.int64)

    def log10(self, n: np.ndarray) -> np.ndarray:
        n = np.asarray(n, float)
        if not self.total:
            return np.zeros(n.shape)
        return np.log10(np.where(n > 0, n - self.discount, self.discount * self.distinct) / self.total)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((np.asarray(n, float) + 1) / (self.total + 1 * (self.distinct + 1)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, learned) -> (word, n) of training texts as far as the task saw them, and rows without a word with the bytes of all texts."""
    held: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        for lo in range(0, len(word), 100_000):
            part = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([long_array(word[part]), pa.array(n[part].astype(np.int64))], ["word", "n"])

    size = 0
    for batch in batches:
        learned = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        size += batch.column(0).nbytes
        for i, h, bounds in sequences(batch.column(0)):
            n = np.diff(bounds)
            held.append(h[np.repeat(learned[i : i + len(n)], n)])
        if sum(map(len, held)) > 1 << 22:
            yield from out()
    if held:
        yield from out()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([size], pa.int64())], ["word", "n"])


def count_words(texts: DataFrame, hot: int = HOT_WORDS) -> tuple[Unigrams, int]:
    """texts (text, held_out) -> (counts of single words in those that aren't held out, bytes of all texts)."""
    rows = texts.select("text", F.coalesce(~F.col("held_out"), F.lit(False))).mapInArrow(_word_counts, "word long, n long")
    counts = checkpointed(rows.groupBy("word").agg(F.sum("n").alias("n")))
    known = counts.where("word is not null")
    total, distinct, once, twice = known.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
    total, once, twice = total or 0, once or 0, twice or 0
    size = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    ends = known.where(F.col("word") == int(END_HASH.astype(np.int64))).agg(F.sum("n")).first()[0] or 0
    # Fewer than `hot` words can exceed this share of all tokens; how their arcs are dealt changes no score.
    most = max(1 << 16, -(-total // hot))
    many = {r.word % 2**64: -(-r.n // most) for r in known.where(F.col("n") > most).collect()}
    many.pop(int(END_HASH), None)
    top = above_cutoff(known, RANKED).select("word", "n").toArrow()
    frequent, n = top.column("word").to_numpy().view(U64), top.column("n").to_numpy()
    order = np.argsort(frequent)
    places = np.empty(len(order), np.int32)
    places[np.lexsort([frequent[order], -n[order]])] = np.arange(len(order), dtype=np.int32)
    dropped(counts)
    return Unigrams(total, distinct, min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.05)), ends, many, most, frequent[order], places), size


def squeezed(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + _ZSTD.compress(b, asbytes=True) if b else b""


def restored(b: bytes) -> bytes:
    return _ZSTD.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True) if b else b""


def planes(x: np.ndarray, width: int = 8) -> bytes:
    """Whole numbers of so many bytes, all lowest bytes first, compressed: small ones compress well."""
    return squeezed(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def from_planes(b: bytes, width: int = 8) -> np.ndarray:
    b = restored(b)
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1).astype(np.int64)


class Questions:
    """Arcs that leave some states, in the order in which their owners are asked for them.

    names, parts: of each state its hash, and how many owners deal its arcs among them. asked: the states asked for.
    before, after: of each arc its state, which is one of asked, and the word that it reads.
    """

    def __init__(self, names: np.ndarray, parts: np.ndarray, asked: np.ndarray, before: np.ndarray, after: np.ndarray):
        first = np.cumsum(parts[asked]) - parts[asked]
        owner = np.repeat(asked, parts[asked])
        keys = self._key(names, parts, owner, np.arange(len(owner)) - np.repeat(first, parts[asked]))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        own = self._key(names, parts, before, (mix64(after) % parts[before].astype(U64)).astype(np.int64))
        self.order = np.argsort(own, kind="stable")
        self.edges = np.append(np.searchsorted(own[self.order], self.keys), len(own))

    @staticmethod
    def _key(names: np.ndarray, parts: np.ndarray, state: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The name of a state; that of a part of it where its arcs have several owners."""
        with np.errstate(over="ignore"):
            return np.where(parts[state] > 1, mix64(names[state] + (part.astype(U64) + U64(1)) * _SLICE), names[state])

    def asked(self, buckets: int, rank: np.ndarray, after: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
        """(bucket, states, number of arcs of each, ranks of these, words without a rank, times in training texts), by bucket.
        States are in order, so each is sent as its distance from the one before."""
        bounds = np.searchsorted(((self.keys >> U64(32)) * U64(buckets)) >> U64(32), np.arange(buckets + 1))
        rank, after, times = rank[self.order], after[self.order], times[self.order]
        for b, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if lo < hi:
                of = slice(self.edges[lo], self.edges[hi])
                keys = np.diff(self.keys[lo:hi], prepend=U64(0))
                yield b, planes(keys), planes(np.diff(self.edges[lo : hi + 1])), planes(rank[of], 3), after[of][rank[of] == RANKED].astype("<u8").tobytes(), planes(times[of])

    def answered(self, answers: pa.Table, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(how often each state is in training texts before a word, its distinct arcs there, how often each arc is there, and
        whether more groups than this ask for the arc)."""
        answers = answers.sort_by("bucket")
        totals, kinds, times = (np.concatenate([from_planes(b) for b in answers.column(c).to_pylist()] or [np.zeros(0, np.int64)]) for c in ("totals", "kinds", "times"))
        mine = np.zeros(len(times), np.int64)
        mine[self.order] = times
        return np.bincount(self.owner, totals, states).astype(np.int64), np.bincount(self.owner, kinds, states).astype(np.int64), mine >> 1, (mine & 1).astype(bool)


class Reading:
    """The tokens of a group of texts, and its distinct words, word pairs and triples.

    words: hashes in order; rank: their places among the frequent words. token, arc, begins: of each token its word, its
    pair with the token before it (-1 if it begins a text), and whether it does. before, after, times: of each pair its
    words, and how often it is in training texts. deepen() adds triples.
    """

    def __init__(self, texts: pa.Array, learned: np.ndarray, u: Unigrams):
        found = [*sequences(texts)]
        h = np.concatenate([x for _, x, _ in found] or [np.zeros(0, U64)])
        self.size = np.concatenate([np.diff(b) for _, _, b in found] or [np.zeros(0, np.int64)])
        del found
        self.text = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.u, self.learned = u, learned
        self.words, token = np.unique(h, return_inverse=True)
        del h
        self.token = token.astype(np.int32)
        self.rank = u.rank(self.words)
        self.begins = np.ones(len(token), bool)
        self.begins[1:] = self.text[1:] != self.text[:-1]
        inside, n = np.flatnonzero(~self.begins), max(1, len(self.words))
        pairs, at = np.unique(token[inside - 1] * n + token[inside], return_inverse=True)
        self.before, self.after = pairs // n, pairs % n
        self.arc = np.full(len(token), -1, np.int32)
        self.arc[inside] = at
        self.times = np.bincount(at, learned[self.text[inside]], len(pairs)).astype(np.int64)

    def pairs(self) -> Questions:
        """All words as states, whose arcs are the pairs."""
        parts = np.ones(len(self.words), np.int64)
        if self.u.hot and len(self.words):
            names = np.array([*self.u.hot], U64)
            at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
            ok = self.words[at] == names
            parts[at[ok]] = np.array([*self.u.hot.values()])[ok]
        return Questions(self.words, parts, np.flatnonzero(self.words != END_HASH), self.before, self.words[self.after])

    def deepen(self) -> None:
        """Triples: of each token its triple with the two before it (-1 if the text has no two), of each triple its first pair, its last
        pair, its last word, and how often it is in training texts."""
        n = max(1, len(self.words))
        at = np.flatnonzero(~self.begins[1:] & (self.arc[:-1] >= 0)) + 1
        whole, first, which = np.unique(self.arc[at - 1].astype(np.int64) * n + self.token[at], return_index=True, return_inverse=True)
        self.history, self.last = whole // n, whole % n
        self.lower = self.arc[at[first]]
        self.triple = np.full(len(self.token), -1, np.int32)
        self.triple[at] = which
        self.three = np.bincount(which, self.learned[self.text[at]], len(whole)).astype(np.int64)

    def foreign(self, seen: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return shared & (seen > 0) & (self.words[self.after] != END_HASH)

    def triples(self, seen: np.ndarray, shared: np.ndarray) -> tuple[Questions, np.ndarray]:
        """Pairs as states, whose arcs are the triples, as far as others must be asked; and which triples those are.

        seen: how often each pair is in all training texts; shared: whether it is in the texts of another group. A pair that is in no
        training text has no arcs, and all arcs of one that no other group has are known here. Every text has an end, which is no
        history, so a pair without it goes on as often as it is seen.
        """
        want = self.foreign(seen, shared)
        mine = np.flatnonzero(want[self.history])
        names = pair(self.words[self.before], self.words[self.after])
        parts = np.maximum(1, -(-seen // self.u.most))
        return Questions(names, parts, np.flatnonzero(want), self.history[mine], self.words[self.last[mine]]), mine


@dataclass
class Automaton:
    """States are the empty history, words and pairs of words. single: log10 probabilities read at the empty history. backoff, arcs:
    weights of the failure arcs of words to it, and of the arcs that leave words. deep_backoff, deep: weights of the failure arcs of
    pairs to their last words, and of the arcs that leave pairs. A failure arc weighs 0 where no arc leaves; arcs that aren't there are no numbers."""

    single: np.ndarray
    backoff: np.ndarray
    arcs: np.ndarray
    deep_backoff: np.ndarray
    deep: np.ndarray

    @staticmethod
    def of(r: Reading, total: np.ndarray, kinds: np.ndarray, times: np.ndarray, deep_kinds: np.ndarray, deep_times: np.ndarray) -> "Automaton":
        """From how often words (total), pairs (times) and triples (deep_times) are in training texts, and in how many pairs words
        (kinds) and in how many triples pairs (deep_kinds) are first there."""
        single = r.u.log10(total)
        with np.errstate(all="ignore"):
            left = np.where(kinds > 0, DISCOUNT * kinds / total, 1.0)
            lower = left[r.before] * 10.0 ** single[r.after]
            arcs = np.where(times > 0, np.log10((times - DISCOUNT) / total[r.before] + lower), math.nan)
            lower = np.where(times > 0, 10.0**arcs, lower)
            deep_left = np.where(deep_kinds > 0, DISCOUNT * deep_kinds / times, 1.0)
            deep = np.log10((deep_times - DISCOUNT) / times[r.history] + deep_left[r.history] * lower[r.lower])
            return Automaton(single, np.log10(left), arcs, np.log10(deep_left), np.where(deep_times > 0, deep, math.nan))

    def read(self, r: Reading) -> np.ndarray:
        """log10 probability of each token. The state behind a token is its pair with the token before, else its word: one pass from left
        to right is one over the array of tokens. Each takes the arc of its state, or the failure arc to the state of the word before
        and the arc of that, or a second failure arc and reads at the empty history."""
        value = self.single[r.token]
        inside = np.flatnonzero(r.arc >= 0)
        arc = self.arcs[r.arc[inside]]
        value[inside] = np.where(np.isnan(arc), value[inside] + self.backoff[r.token[inside - 1]], arc)
        inside = np.flatnonzero(r.triple >= 0)
        arc = self.deep[r.triple[inside]]
        value[inside] = np.where(np.isnan(arc), value[inside] + self.deep_backoff[r.arc[inside - 1]], arc)
        return value


ASKED = "bucket int, group int, states binary, lengths binary, ranks binary, words binary, times binary"
ANSWERED = "bucket int, group int, level int, totals binary, kinds binary, times binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, doc_id, text, held_out) -> (group, docs): rows of one group as far as a task has met them, compressed."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        group = rows.column("group").to_numpy()
        order = np.argsort(group, kind="stable")
        edges = [*np.flatnonzero(np.diff(group[order], prepend=-1)), len(order)]
        for lo, hi in zip(edges, edges[1:]):
            sink = pa.BufferOutputStream()
            part = rows.take(pa.array(order[lo:hi])).drop_columns(["group"])
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array([group[order[lo]]], pa.int32()), pa.array([squeezed(sink.getvalue().to_pybytes())], pa.binary())], ["group", "docs"])

    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > DEALT_BYTES:
            yield from out()
            size = 0
    if held:
        yield from out()


def _docs(table: pa.Table) -> pa.Table:
    """The rows of one group (doc_id, text, held_out)."""
    return pa.concat_tables([pa.ipc.open_stream(restored(b.as_py())).read_all() for b in table.column("docs")]).combine_chunks()


def _reading(docs: pa.Table, u: Unigrams) -> Reading:
    texts = docs.column("text")
    return Reading(pa.concat_arrays(texts.chunks), ~docs.column("held_out").to_numpy().astype(bool), u)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    columns = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(columns)], [n for n, _ in columns])


def _asked_pairs(buckets: int, u):
    def run(table: pa.Table) -> pa.Table:
        r = _reading(_docs(table), u.value)
        group = table.column("group")[0].as_py()
        return _table([(b, group, *x) for b, *x in r.pairs().asked(buckets, r.rank[r.after], r.words[r.after], r.times)], ASKED)

    return run


def _asked_triples(buckets: int, u):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        r = _reading(_docs(docs), u.value)
        group = docs.column("group")[0].as_py()
        _, _, seen, shared = r.pairs().answered(answers, len(r.words))
        r.deepen()
        questions, mine = r.triples(seen, shared)
        last = r.last[mine]
        return _table([(b, group, *x) for b, *x in questions.asked(buckets, r.rank[last], r.words[last], r.three[mine])], ASKED)

    return run


def _answered(level: int):
    """What all groups ask of one bucket of states -> for each of them how often its states (of words alone; pairs are known by then) and arcs
    are in training texts, and the states' distinct arcs there. A group asks for an arc once, so an arc asked for twice is in two groups; that is
    the lowest bit of what is told of it."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_pylist()
        states = [np.cumsum(from_planes(b).view(U64), dtype=U64) for b in column("states")]
        lengths = [from_planes(b) for b in column("lengths")]
        rank = np.concatenate([from_planes(b, 3) for b in column("ranks")])
        times = [from_planes(b) for b in column("times")]
        sizes = [len(x) for x in times]
        times = np.concatenate(times)
        keys, at = np.unique(np.concatenate(states), return_inverse=True)
        of = np.repeat(at, np.concatenate(lengths))
        name = rank.astype(U64)
        name[rank == RANKED] = np.concatenate([np.frombuffer(b, "<u8") for b in column("words")])
        del rank
        _, first, arc = np.unique(pair(keys[of], name), return_index=True, return_inverse=True)
        del name
        sums = np.bincount(arc, times, len(first)).astype(np.int64)
        told = 2 * sums + (np.bincount(arc, minlength=len(first)) > 1)
        totals = np.bincount(of, times, len(keys)).astype(np.int64) if level == 2 else np.zeros(len(keys), np.int64)
        kinds = np.bincount(of[first], sums > 0, len(keys)).astype(np.int64)
        out, s, a = [], 0, 0
        for bucket, group, x, n in zip(column("bucket"), column("group"), states, sizes):
            here = at[s : s + len(x)]
            out.append((bucket, group, level, planes(totals[here]), planes(kinds[here]), planes(told[arc[a : a + n]])))
            s, a = s + len(x), a + n
        return _table(out, ANSWERED)

    return run


def _scored(held):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _docs(docs)
        r, u = _reading(docs, held.value), held.value
        level = answers.column("level").to_numpy()
        total, kinds, times, shared = r.pairs().answered(answers.filter(pa.array(level == 2)), len(r.words))
        total[r.words == END_HASH] = u.ends
        r.deepen()
        questions, mine = r.triples(times, shared)
        _, deep_kinds, deep, _ = questions.answered(answers.filter(pa.array(level == 3)), len(times))
        deep_times = r.three.copy()
        deep_times[mine] = deep
        # Of pairs that no other group has, the arcs are those of this group.
        own = np.bincount(r.history, r.three > 0, len(times)).astype(np.int64)
        deep_kinds = np.where(r.foreign(times, shared), deep_kinds, own)
        value = Automaton.of(r, total, kinds, times, deep_kinds, deep_times).read(r)
        by_text = lambda x: np.bincount(r.text, x, len(r.size))
        known = total > 0
        sums = [pa.array(r.size), pa.array(by_text(known[r.token]).astype(np.int64)), pa.array(np.full(len(r.size), u.total)), pa.array(by_text(u.base(total)[r.token])), pa.array(by_text(value))]
        return pa.table([docs.column("doc_id"), docs.column("held_out"), *sums], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(documents: DataFrame, held_out: Column, group_bytes: int = GROUP_BYTES, hot: int = HOT_WORDS) -> DataFrame:
    """documents (doc_id, text; more are ignored) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    The model learns from rows where held_out is false. Null text counts as empty: one token, the end.
    base_score is the sum of log10((c + 1) / (N + V + 1)); score is the model's log10 probability, over the
    same events (each known word, and any unknown one). With nothing to learn from both are 0.
    A row for each row: a doc_id that is repeated, or null, is scored as often as it comes, and each of its rows is
    learned from. An empty table gives no rows. A text is read whole, at some 30 bytes of memory for each of its own;
    one that is larger than a group makes its group larger.
    """
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    u, size = count_words(own, hot)
    groups = max(1, -(-size // group_bytes))
    # The one exchange of the texts serves all three plans below.
    rows = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("group"), "*")
    dealt = rows.mapInArrow(_bundles, "group int, docs binary").repartition(groups, "group")
    u = documents.sparkSession.sparkContext.broadcast(u)
    pairs = dealt.groupBy("group").applyInArrow(_asked_pairs(groups, u), ASKED).groupBy("bucket").applyInArrow(_answered(2), ANSWERED)
    asked = dealt.groupBy("group").cogroup(pairs.groupBy("group")).applyInArrow(_asked_triples(groups, u), ASKED)
    answers = pairs.unionByName(asked.groupBy("bucket").applyInArrow(_answered(3), ANSWERED))
    return dealt.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(_scored(u), SCORED)
