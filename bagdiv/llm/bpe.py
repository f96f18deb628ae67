"""BPE encoding and decoding with a transducer of frequent words.

Frequent words are compiled, with their ids as output, into a minimal acyclic automaton: equal suffixes are
shared, each arc knows how many words come before it, and so a path sums to the number of its word,
under which its ids lie. Workers map the compiled file into memory. A word that it doesn't hold is merged
exactly by the ranks of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .frequent import above_cutoff

END = "</w>"
#: Fixed value: the split pattern of the vocabulary, for printable ASCII in lower case.
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
PRINTABLE = re.compile(r"[!-~]+").fullmatch
#: The rank of neighbours that no merge joins.
NONE = (1 << 40, -1)
#: Words that a worker keeps in each of two generations; beyond that the older one goes, which costs time only.
CACHE = 500_000


class Vocabulary:
    """Ids, merge ranks and special strings of a tokenizer file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda s: [s]
        library = Tokenizer.from_file(path)
        self.normal, self.pre = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def split(self, word: str) -> list[str]:
        """Pre-tokens of a word without white space, in the vocabulary's letters for bytes."""
        if PRINTABLE(word):
            return ASCII_SPLIT.findall(word.lower())
        return [s for s, _ in self.pre(self.normal(word))]

    def merge(self, pre: str) -> list[int]:
        """Ids of a pre-token: of all neighbours that have a rank, the lowest merge first, from the left."""
        now = [*map(self.ids.__getitem__, pre[:-1]), self.ids[pre[-1] + END]]
        rank = [*map(self.ranked, zip(now, now[1:]))]
        while rank and (best := min(rank)) is not NONE:
            i = rank.index(best)
            now[i : i + 2] = [best[1]]
            del rank[i]
            if i:
                rank[i - 1] = self.ranked((now[i - 1], now[i]))
            if i < len(rank):
                rank[i] = self.ranked((now[i], now[i + 1]))
        return now

    def ranked(self, pair: tuple[int, int]) -> tuple[int, int]:
        return self.merges.get(pair, NONE)


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The minimal acyclic transducer of the entries, as the bytes of a file."""
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, list[tuple[int, int]]]] = []
    count: list[int] = []

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(nodes)
            nodes.append((final, arcs))
            count.append(final + sum(count[t] for _, t in arcs))
        return register[key]

    open_: list[list] = [[False, [], None]]  # final, arcs that are settled, label of the arc that leads on
    was = b""

    def close(depth: int) -> None:
        while len(open_) > depth + 1:
            final, arcs, _ = open_.pop()
            open_[-1][1].append((open_[-1][2], settle(final, arcs)))

    for word, _ in words:
        common = len(os.path.commonprefix([was, word]))
        close(common)
        for byte in word[common:]:
            open_[-1][2] = byte
            open_.append([False, [], None])
        open_[-1][0] = True
        was = word
    close(0)
    root = settle(open_[0][0], open_[0][1])
    first, labels, target, skip = [0], bytearray(), [], []
    for final, arcs in nodes:
        before = int(final)
        for label, t in arcs:
            labels.append(label), target.append(t), skip.append(before)
            before += count[t]
        first.append(len(labels))
    final = bytes(n[0] for n in nodes)
    outs = np.cumsum([0, *(len(ids) for _, ids in words)])
    parts = [np.array(first, "<u4"), np.array(target, "<u4"), np.array(skip, "<u4"), outs.astype("<u4"), np.array([i for _, ids in words for i in ids], "<u4")]
    head = np.array([root, *(len(p) for p in parts), len(labels), len(final)], "<u4")
    return head.tobytes() + b"".join(p.tobytes() for p in parts) + bytes(labels) + final


class Lexicon:
    """A compiled transducer, mapped from a file that vanishes with this process."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        head = view[:32].cast("I")
        self.root, at, parts = head[0], 32, []
        for n in head[1:6]:
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.target, self.skip, self.outs, self.ids = parts
        self.labels, self.final = at, at + head[6]

    def get(self, word: str) -> list[int] | None:
        node, number, find, first, labels = self.root, 0, self.map.find, self.first, self.labels
        text = word.encode()
        for i in range(len(text)):
            arc = find(text[i : i + 1], labels + first[node], labels + first[node + 1]) - labels
            if arc < 0:
                return None
            number += self.skip[arc]
            node = self.target[arc]
        if not self.map[self.final + node]:
            return None
        return list(self.ids[self.outs[number] : self.outs[number + 1]])


class Met(dict):
    """Results by word: those met since the last turn, and the generation before it."""

    def __init__(self, make, most: int = CACHE):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        if out is None:
            out = self.make(word)
        self[word] = out
        return out


class Encoder:
    """Encodes texts word by word; the ids of words and pre-tokens that it met are kept."""

    def __init__(self, path: str, compiled: bytes):
        self.vocabulary, self.lexicon = Vocabulary(path), Lexicon(compiled)
        self.words = Met(self.word)
        self.pre = Met(lambda pre: array("I", self.lexicon.get(pre) or self.vocabulary.merge(pre)).tobytes(), CACHE // 2)
        self.names = [self.vocabulary.names.get(i, "") for i in range(max(self.vocabulary.names) + 1)]

    def word(self, word: bytes) -> bytes:
        """Ids of a word without ASCII white space, as little-endian 32-bit integers."""
        v, pre = self.vocabulary, self.pre
        text = word.decode("utf-8", "replace")
        if "<|" not in text:
            return b"".join([pre[p] for p in v.split(text)])
        return b"".join([array("I", [v.special[part]]).tobytes() if part in v.special else b"".join([pre[p] for p in v.split(part)]) for part in v.cut(text) if part])

    def text(self, raw: bytes) -> tuple[bytes, bytes]:
        """Ids and the decoded text. No token spans ASCII white space, so words are encoded one by one."""
        ids = b"".join(map(self.words.__getitem__, raw.split()))
        return ids, " ".join(map(self.names.__getitem__, memoryview(ids).cast("I"))).encode()


def _words(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text := text.as_py():
                    found.update(text.lower().split())
            if len(found) > 2_000_000:
                found = Counter({w: n for w, n in found.items() if n > 1})
        kept = [(w, n) for w, n in found.items() if n >= least and len(w) <= 64]
        for i in range(0, len(kept), 100_000):
            part = kept[i : i + 100_000]
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in part], pa.string()), "n": pa.array([n for _, n in part], pa.int64())})

    return run


def frequent_lexicon(documents: DataFrame, path: str, size: int, least: int = 4) -> bytes:
    """The compiled lexicon of at most `size` words that some task met `least` times, of all documents."""
    counts = checkpointed(documents.select("text").mapInArrow(_words(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    v, entries = Vocabulary(path), {}
    for row in above_cutoff(counts, size).select("word").collect():
        for part in v.cut(row.word):
            if part and part not in v.special:
                for pre in v.split(part):
                    entries.setdefault(pre, v.merge(pre))
    return compile_lexicon(entries)


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoded(path: str, compiled, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, hashlib.sha256(compiled.value).hexdigest())
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(path, compiled.value)
        encoder = _encoders[key]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                ids, n, a, b, tokens, decoded = batch.column(0).slice(i, 500), [], [], [], [], []
                for text in batch.column(1).slice(i, 500).to_pylist():
                    x, y = encoder.text((text or "").encode("utf-8", "replace"))
                    n.append(len(x) // 4), a.append(hashlib.sha256(x).hexdigest()), b.append(hashlib.sha256(y).hexdigest())
                    if keep:
                        tokens.append(np.frombuffer(x, "<u4").astype(np.int64)), decoded.append(y.decode())
                out = {"doc_id": ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
                if keep:
                    out |= {"ids": pa.array(tokens, pa.list_(pa.int64())), "decoded": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    return run


def encode(documents: DataFrame, path: str, lexicon: int = 100_000, keep: bool = True) -> DataFrame:
    """documents (doc_id, text; more are ignored) -> (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]).

    Ids equal the tokenizers library's with the file at path (a BPE with word ends, lower case), no
    tokens added; decoded is its decode of them, special tokens included. Null text counts as empty:
    no ids, empty text. Every row is encoded by itself, so repeated and null doc_ids are as any other; an empty table
    gives no rows. lexicon bounds the words in the broadcast transducer; any other word is merged.
    keep: give the ids and the decoded text too, not their digests alone.
    """
    own = documents.select("doc_id", "text")
    compiled = documents.sparkSession.sparkContext.broadcast(frequent_lexicon(own, path, lexicon))
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep
    return own.mapInArrow(_encoded(path, compiled, keep), kind)
