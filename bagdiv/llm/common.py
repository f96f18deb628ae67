"""Helpers shared by the text operators: table access, vectorised word splitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..tables import checkpoint_folder, checkpointed, dropped  # noqa: F401, for the operators

U64 = np.uint64
#: Bytes of text that are split into words at once; bounds the memory of a task.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, longer by underscores where a table has them already, whatever their case."""
    held = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = stream64(256, 1)
_STEP = 0xD6E8FEB86659FD93


class _Powers:
    """Powers of an odd constant, as far as the longest word so far needs them."""

    table = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if n > len(cls.table):
            m = 1 << max(10, int(n - 1).bit_length())
            with np.errstate(over="ignore"):
                cls.table = np.cumprod(np.concatenate([np.ones(1, U64), np.full(m - 1, _STEP, U64)]), dtype=U64)
        return cls.table


def text_chunks(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; null counts as empty."""
    text = pc.fill_null(text, "") if text.null_count else text
    if pa.types.is_large_string(text.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + n + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts: (start, length, 64-bit hash, bounds); text i has words bounds[i]:bounds[i+1]."""
    if lower:
        data = LOWER[data]
    solid = ~SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = solid[first]
    at = np.flatnonzero(start)
    if not len(at):
        return at, at, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inner = np.cumsum(solid)[at] - 1
    letters = data[solid]
    length = np.diff(np.append(inner, len(letters)))
    place = np.arange(len(letters)) - np.repeat(inner, length)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[letters] * _Powers.upto(int(length.max()))[place], inner)
        h = mix64(h + length.astype(U64) * U64(0x9E3779B97F4A7C15))
    return at, length, h, np.searchsorted(at, offsets)


_SPOT = stream64(64, 7) | U64(1)


def windows(h: np.ndarray, bounds: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and their bounds by text. short: a text of 1 to k-1 words gives its whole sequence."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            m = len(h) - k + 1
            mixed = np.zeros(m, U64)
            for i in range(k):
                mixed += h[i : i + m] * _SPOT[i]
            whole = owner[:m] == owner[k - 1 :]
            mixed, of = mix64(mixed[whole] ^ U64(k)), owner[:m][whole]
        else:
            mixed, of = np.zeros(0, U64), np.zeros(0, np.int64)
        if short and len(few := np.flatnonzero((n > 0) & (n < k))):
            more = np.array([int(np.sum(h[bounds[d] : bounds[d + 1]] * _SPOT[: n[d]], dtype=U64)) for d in few], U64)
            mixed, of = np.concatenate([mixed, mix64(more ^ n[few].astype(U64))]), np.concatenate([of, few])
            order = np.argsort(of, kind="stable")
            mixed, of = mixed[order], of[order]
    return mixed, np.searchsorted(of, np.arange(len(n) + 1))


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U64 else x.astype(np.int64, copy=False))
