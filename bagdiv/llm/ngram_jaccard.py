"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

Texts with equal sets are one class. A class is looked up under its prefix alone: of |x| n-grams in one global
order, the first |x| - ceil(t|x|) + 1; two sets with Jaccard similarity t or more share one of their prefixes.
The order puts n-grams that are frequent, or of frequent words, last, which keeps the columns of the product short; any order gives
the same links. For the smaller of the two a still shorter prefix does. Classes that meet in a column form clusters, clusters are cut into tiles of bounded
size, and for every two tiles that some column brings together a task multiplies their full rows:
overlap counts accumulate over blocks of columns, and pairs whose sizes or counts are out of bounds are
discarded. A task returns the edges of a forest, never the list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, long_array, mix64, split_words, text_chunks, windows
from .components import connected_components
from .frequent import above_cutoff

#: Rows and n-grams of a tile, columns of a dense block, and the column length from which it is used.
TILE_ROWS, TILE_GRAMS, BLOCK, DENSE = 512, 1 << 21, 4096, 12
#: Rows (class, block) up to which that table is broadcast, some tens of MB; beyond, texts are shuffled to meet it.
BROADCAST_ROWS = 1 << 20


class Rarity:
    """How common n-grams are, as far as a bounded table tells: by their own counts, and by those of their words."""

    def __init__(self, grams: pa.Table, words: pa.Table):
        self.grams, self.times = self._table(grams)
        self.words, n = self._table(words)
        self.levels = (8 * np.log2(n + 1)).astype(np.int64)

    @staticmethod
    def _table(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(hashes in order, counts) of a table of both."""
        key, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
        order = np.argsort(key)
        return key[order], n[order]

    @staticmethod
    def _of(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, values[at], 0)

    def of_words(self, h: np.ndarray) -> np.ndarray:
        return self._of(h, self.words, self.levels)

    def of_grams(self, grams: np.ndarray, of_words: np.ndarray) -> np.ndarray:
        """Places in the order: n-grams of known counts by them after all others, those by the frequencies of their words."""
        return self._of(grams, self.grams, self.times) * (1 << 16) + of_words


def _sets(batch: pa.RecordBatch, k: int, see=None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text that has a word. see: gets the hashes of all words."""
    for i, _, data, offsets in text_chunks(batch.column("text")):
        _, _, h, bounds = split_words(data, offsets)
        grams, edges = windows(h, bounds, k)
        if see:
            see(h)
        for d in range(len(edges) - 1):
            if edges[d] < edges[d + 1]:
                yield i + d, np.unique(grams[edges[d] : edges[d + 1]])


def _placed(batch: pa.RecordBatch, k: int, rarity: Rarity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct n-gram hashes, their places in the order) of each text that has a word."""
    for _, _, data, offsets in text_chunks(batch.column("text")):
        _, _, h, bounds = split_words(data, offsets)
        grams, edges = windows(h, bounds, k)
        level, n = rarity.of_words(h), np.diff(bounds)
        # A text of fewer than k words has one n-gram, of all its words.
        sums = np.append(0, np.cumsum(level))
        ends = np.minimum(k, np.repeat(n, np.diff(edges)))
        first = np.repeat(bounds[:-1] - edges[:-1], np.diff(edges)) + np.arange(len(grams))
        of_words = sums[first + ends] - sums[first]
        for d in range(len(edges) - 1):
            if edges[d] < edges[d + 1]:
                own, at = np.unique(grams[edges[d] : edges[d + 1]], return_index=True)
                yield own, rarity.of_grams(own, of_words[edges[d] : edges[d + 1]][at])


def signature(grams: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([np.sum(mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]))[0].astype(np.int64))


def _profiles(k: int, least: int):
    """Rows (doc_id, size, sig), and in between (gram, n) and (word, n) of what the task saw in `least` documents or places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {"gram": [], "word": []}

        def common(kind: str) -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held[kind]), return_counts=True)
            held[kind] = []
            key, n = key[n >= least], n[n >= least]
            none = pa.nulls(len(key), pa.int64())
            return pa.RecordBatch.from_pydict({"doc_id": none, "size": none, "sig": none, "gram": none, "word": none} | {kind: long_array(key), "n": pa.array(n.astype(np.int64))})

        for batch in batches:
            sizes, sigs = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, grams in _sets(batch, k, held["word"].append):
                sizes[row], sigs[row] = len(grams), signature(grams)
                held["gram"].append(grams)
                if row % 64 == 0:
                    for kind in ("gram", "word"):
                        if sum(map(len, held[kind])) > 1 << 22:
                            yield common(kind)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "size": pa.array(sizes), "sig": pa.array(sigs), "gram": none, "word": none, "n": none})
        for kind in ("gram", "word"):
            if held[kind]:
                yield common(kind)

    return run


def prefix(grams: np.ndarray, places: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first n-grams of a set in the order (place, hash), and how many of them do for the smaller of two sets."""
    n = len(grams)
    keep, enough = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
    return grams[np.argsort(places, kind="stable")][:keep], enough


def _prefixes(k: int, percent: int, late):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = late.value
        for batch in batches:
            out: list[tuple[np.ndarray, int, int, int]] = []
            done: set[tuple[int, int]] = set()
            count = 0
            for grams, places in _placed(batch, k, rarity):
                key = (len(grams), signature(grams))
                if key not in done:
                    done.add(key)
                    out.append((*prefix(grams, places, percent), *key))
                    count += len(out[-1][0])
                if count > 200_000:
                    yield rows(out)
                    out, count = [], 0
            if out:
                yield rows(out)

    def rows(out: list[tuple[np.ndarray, int, int, int]]) -> pa.RecordBatch:
        n = [len(g) for g, _, _, _ in out]
        early = np.concatenate([np.arange(len(g)) < e for g, e, _, _ in out])
        return pa.RecordBatch.from_pydict({"gram": long_array(np.concatenate([g for g, _, _, _ in out])), "size": pa.array(np.repeat([s for _, _, s, _ in out], n).astype(np.int64)), "sig": pa.array(np.repeat(np.array([c for _, _, _, c in out], np.int64), n)), "early": pa.array(early)})

    return run


def _met(percent: int):
    """Rows (gram, size, sig, early) in order -> each class with the last early one before it in the column, if their sizes are within bounds.

    The smaller of two sets that link has a common n-gram among its early ones, so these pairs connect all
    classes of a column that can link through it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 4), np.int64)
        for batch in batches:
            now = np.column_stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("gram", "size", "sig", "early")])
            now = np.concatenate([rest, now])
            yield from out(now, len(rest))
            early = now[now[:, 3] == 1]
            rest = early[-1:]

    def out(x: np.ndarray, old: int) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(x))
        last = np.maximum.accumulate(np.where(x[:, 3] == 1, at, -1))
        before = np.append(-1, last[:-1])
        i = np.flatnonzero((before >= 0) & (at >= old))
        a, b = x[before[i]], x[i]
        same = (a[:, 0] == b[:, 0]) & (100 * a[:, 1] >= percent * b[:, 1]) & (a[:, 1:3] != b[:, 1:3]).any(1)
        if same.any():
            a, b = a[same], b[same]
            columns = (a[:, 0], a[:, 1], a[:, 2], b[:, 1], b[:, 2])
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(b[:, 3] == 1)], ["gram", "size", "sig", "size2", "sig2", "early"])

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The product of the incidence matrices of two lists of sets: sizes of all their intersections."""
    n, m = len(a), len(b)
    grams = np.concatenate([*a, *b])
    row = np.repeat(np.arange(n + m), [len(x) for x in (*a, *b)])
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(grams)))
    out = np.zeros((n, m), np.int64)
    for d in np.unique(length[(length > 1) & (length < DENSE)]):
        columns = row[start[length == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                x, y = columns[:, i], columns[:, j]
                across = (x < n) & (y >= n)
                if across.any():
                    out += np.bincount(x[across] * m + y[across] - n, minlength=n * m).reshape(n, m)
    wide = np.flatnonzero(length >= DENSE)
    for lo in range(0, len(wide), BLOCK):
        part = wide[lo : lo + BLOCK]
        size = length[part]
        at = np.repeat(start[part] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        dense = np.zeros((n + m, len(part)), np.float32)
        dense[row[at], np.repeat(np.arange(len(part)), size)] = 1
        out += np.rint(dense[:n] @ dense[n:].T).astype(np.int64)
    return out


def forest(a: list[np.ndarray], ids_a: list[int], b: list[np.ndarray], ids_b: list[int], percent: int) -> list[tuple[int, int]]:
    """Edges (id, smallest id that links of these two lists reach) for ids that have a link."""
    both = overlaps(a, b)
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    union = size_a[:, None] + size_b[None] - both
    i, j = np.nonzero(100 * both >= percent * union)
    ids = np.array([*ids_a, *ids_b])
    i, j = ids[i], ids[len(a) + j]
    i, j = i[i != j], j[i != j]
    if not len(i):
        return []
    names, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    root = np.arange(len(names))
    while True:
        was = root.copy()
        np.minimum.at(root, where[: len(i)], was[where[len(i) :]])
        np.minimum.at(root, where[len(i) :], was[where[: len(i)]])
        root = root[root]
        if np.array_equal(root, was):
            break
    return [(int(x), int(y)) for x, y in zip(names, names[root]) if x != y]


def _products(percent: int, k: int):
    """Rows (cluster, one, two, tile, doc_id, text) sorted by the first three -> forest edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tiles = None, {}
        for batch in batches:
            keys = [*zip(*(batch.column(c).to_pylist() for c in ("cluster", "one", "two", "tile", "doc_id")))]
            for row, grams in _sets(batch, k):
                *key, tile, doc_id = keys[row]
                if key != now:
                    yield from out(now, tiles)
                    now, tiles = key, {}
                sets, ids = tiles.setdefault(tile, ([], []))
                sets.append(grams), ids.append(doc_id)
        yield from out(now, tiles)

    def out(key, tiles) -> Iterator[pa.RecordBatch]:
        if key and key[1] in tiles and key[2] in tiles and (found := forest(*tiles[key[1]], *tiles[key[2]], percent)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["doc_id", "root"])

    return run


def in_tiles(placed: DataFrame) -> DataFrame:
    """placed (cluster, size, rep, …) with a tile: 0 in clusters that fit one. Others are cut by bands of size, and a band
    by a hash of rep into as many parts as its rows or n-grams need; so no cluster is numbered in one task."""
    parts = F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("size") / TILE_GRAMS)).cast("int").alias("parts")
    large = placed.groupBy("cluster").agg(parts).where("parts > 1").select("cluster", F.lit(True).alias("cut"))
    few = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = placed.join(F.broadcast(large) if few else large, "cluster", "left")
    # Bands of a quarter of an octave; a part of a band is named after both.
    marked = marked.withColumn("band", F.when(F.col("cut"), F.floor(4 * F.log2("size")).cast("int")).otherwise(F.lit(-1)))
    bands = marked.where("cut").groupBy("cluster", "band").agg(parts)
    few = bands.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    cut = marked.join(F.broadcast(bands) if few else bands, ["cluster", "band"], "left")
    tile = F.when(F.col("band") < 0, F.lit(0).cast("long")).otherwise((F.col("band") + 1).cast("long") * (1 << 40) + F.pmod(F.xxhash64("rep"), F.col("parts")))
    return cut.select(*placed.columns, tile.alias("tile"))


def links(documents: DataFrame, percent: int = 85, k: int = 4, late: int = 1 << 18, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(profiles (doc_id, size, sig, rep), forest edges (doc_id, root) between the representatives).

    late: n-grams, and words, of which the order knows how common they are, at most so many of either, by the counts
    that tasks made of all documents (of those that a task saw `least` times); broadcast. They change no link.
    """
    spark = documents.sparkSession
    own = documents.select("doc_id", "text")
    seen = checkpointed(own.mapInArrow(_profiles(k, least), "doc_id long, size long, sig long, gram long, word long, n long"))
    profiles = seen.where("gram is null and word is null").select("doc_id", "size", "sig")
    # Written, so that a class of very many documents can be split when it meets its representative.
    reps = checkpointed(profiles.where("size > 0 and doc_id is not null").groupBy("size", "sig").agg(F.min("doc_id").alias("rep")))
    # As Arrow, a few MB each on the driver; rows would take a hundred.
    common = {kind: above_cutoff(seen.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.sum("n").alias("n")), late).toArrow() for kind in ("gram", "word")}
    rarity = spark.sparkContext.broadcast(Rarity(common["gram"], common["word"]))
    rows = own.mapInArrow(_prefixes(k, percent, rarity), "gram long, size long, sig long, early boolean")
    # Equal n-grams meet in one partition; sorted by size, neighbours within bounds connect all that can link there.
    met = checkpointed(rows.repartition("gram").sortWithinPartitions("gram", "size", "sig").mapInArrow(_met(percent), "gram long, size long, sig long, size2 long, sig2 long, early boolean"))
    pairs = met.select("size", "sig", "size2", "sig2").distinct()
    named = pairs.join(reps, ["size", "sig"]).select("rep", F.col("size2").alias("size"), F.col("sig2").alias("sig")).join(reps.withColumnRenamed("rep", "rep2"), ["size", "sig"])
    clusters = connected_components(named, "rep", "rep2")
    placed = checkpointed(in_tiles(checkpointed(reps.join(clusters, F.col("rep") == F.col("id")).select("rep", "size", "sig", F.col("component").alias("cluster")))))
    # A class goes to the blocks in which it meets another of a size within bounds in some column.
    members = met.select("gram", "size", "sig", F.lit(True).alias("early")).union(met.select("gram", "size2", "sig2", "early")).distinct().join(placed, ["size", "sig"])
    early = F.when(F.col("early"), F.col("size"))
    columns = members.groupBy("gram", "cluster", F.col("tile").alias("other")).agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.min(early).alias("low1"), F.max(early).alias("high1"))
    larger = F.col("early") & (F.col("high") >= F.col("size")) & (F.lit(percent) * F.col("low") <= F.lit(100) * F.col("size"))
    smaller = (F.col("low1") <= F.col("size")) & (F.lit(100) * F.col("high1") >= F.lit(percent) * F.col("size"))
    fits = (larger | smaller) & ((F.col("tile") != F.col("other")) | (F.col("n") > 1))
    sides = members.join(columns, ["gram", "cluster"]).where(fits).select("rep", "cluster", "tile", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two")).distinct()
    sides = checkpointed(sides)
    few = sides.count() <= BROADCAST_ROWS
    blocks = sides.groupBy(F.col("rep").alias("doc_id"), "cluster", "tile").agg(F.collect_list(F.struct("one", "two")).alias("blocks"))
    # The texts go to the tasks that multiply their rows; they are smaller than their rows of hashes.
    sent = own.join(F.broadcast(blocks) if few else blocks, "doc_id").select("doc_id", "text", "cluster", "tile", F.explode("blocks").alias("block"))
    sent = sent.select("cluster", "block.one", "block.two", "tile", "doc_id", "text")
    edges = sent.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two", "tile").mapInArrow(_products(percent, k), "doc_id long, root long")
    named = profiles.withColumn("size0", F.when(F.col("doc_id").isNotNull(), F.col("size"))).join(reps.withColumnRenamed("size", "size0"), ["size0", "sig"], "left")
    return named.select("doc_id", "size", "sig", "rep"), edges


def jaccard_components(documents: DataFrame, percent: int = 85, k: int = 4, **how) -> DataFrame:
    """documents (doc_id, text; more are ignored) -> (doc_id, n_shingles, component_id), a row for each document.

    Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a text of fewer than k words has its whole sequence as the one
    n-gram. Linked: 100 * intersection >= percent * union. Null texts and texts without words link with
    nothing. component_id is the smallest doc_id that links reach; equal sets are one node, whose name is its smallest.
    Rows of one doc_id are parts of one document, linked by any of them. Rows without a doc_id link with nothing, and
    their component is null. An empty table gives no rows. Sets are told apart by their size and a hash of 64 bits,
    words and n-grams by hashes of 64 bits, which are not compared with the texts.
    """
    profiles, edges = links(documents, percent, k, **how)
    again = profiles.where("rep is not null and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    edges = edges.union(again.select("doc_id", "low")).union(again.select("doc_id", "high")) if not again.isEmpty() else edges
    found = connected_components(edges, "doc_id", "root").select(F.col("id").alias("rep"), "component")
    return profiles.join(found, "rep", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def without_near_copies(documents: DataFrame, percent: int = 80, k: int = 5, **how) -> DataFrame:
    """documents without those of which a smaller doc_id is in the same component; their columns as they were. Rows of one
    doc_id stay or go together, rows without one stay."""
    kept = jaccard_components(documents, percent, k, **how).where("doc_id = component_id").select("doc_id")
    return documents.join(kept, "doc_id", "left_semi").select(*documents.columns).unionByName(documents.where("doc_id is null"))
