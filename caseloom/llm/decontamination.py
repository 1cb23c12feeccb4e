"""Benchmark decontamination by SimHash of item-sized windows.

For each length that a benchmark item has, windows of that many words are
fingerprinted: 64 bits, each the sign of a sum over the window's words. Items of
that length lie in a multi-index: the fingerprint falls into ``BLOCK_COUNT`` blocks, and
of two fingerprints within ``RADIUS`` bits at least one block differs in at most
RADIUS // BLOCK_COUNT bits, so that looking up each block with those bits flipped finds all
of them. What is found is verified by the exact weighted similarity of the
shingles (sum of the lesser over sum of the greater number of occurrences).

A window only reaches a similarity above 0 if it holds a shingle of the
benchmark; windows around those shingles are the ones that are fingerprinted, and no
other can pass the verification.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, materialize, small_side, table, unused
from .text_arrays import Runs, Words, finish, text_slices

SHINGLE, SIMILARITY = 5, 0.8
BLOCK_COUNT, RADIUS = 4, 15
#: Items, and bytes of their texts, that one pass over the documents carries; a larger benchmark takes more passes.
PASS_ITEMS, PASS_BYTES = 4_000, 16 << 20
#: Windows fingerprinted at once.
_SPAN = 1 << 15

#: Bytes of ASCII punctuation: words are compared without it.
_MARKS = np.zeros(256, bool)
_MARKS[np.frombuffer(string.punctuation.encode(), np.uint8)] = True


def plain_words(buf: np.ndarray, offs: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of a slice without ASCII punctuation (a word of nothing else is none)
    and their hashes, A-Z read as a-z."""
    keep = ~_MARKS[buf]
    kept = np.concatenate([[0], np.cumsum(keep)])
    words = Words(buf[keep], kept[offs])
    return words, words.hashes(0, lower=True)


def _bits_of(hashes: np.ndarray) -> np.ndarray:
    """Each word's vector: +1 or -1 for each of 64 bits, as int16."""
    return (np.unpackbits(finish(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) << 1) - 1


def fingerprints(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """64-bit SimHash of the ``n`` words from each of the ascending ``starts`` on."""
    out = np.empty(len(starts), np.uint64)
    gap = np.diff(starts, prepend=starts[0] - n if len(starts) else 0)
    held = np.cumsum(np.minimum(gap, n))  # words that the windows up to each cover together
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(held, held[lo] + _SPAN)))
        own, new = starts[lo:hi], np.minimum(gap[lo:hi], n)
        new[0] = n
        last = np.cumsum(new)
        covered = np.repeat(own + n - last, new) + np.arange(last[-1])  # each covered word once, in order
        total = np.zeros((len(covered) + 1, 64), np.int32)
        np.cumsum(_bits_of(hashes[covered]), axis=0, out=total[1:])
        out[lo:hi] = np.packbits(total[last] - total[last - n] > 0, axis=1).view(np.uint64).ravel()
        lo = hi
    return out


@dataclass
class MultiIndex:
    """All fingerprints within RADIUS of a query, by exact lookups of blocks.

    Only the fingerprints travel; a worker builds the lookup when it first needs it.
    """

    prints: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)
    owners: list[np.ndarray] = field(default_factory=list)

    def _build(self) -> None:
        width = 64 // BLOCK_COUNT
        flips = [0] + [sum(1 << b for b in c) for k in range(1, RADIUS // BLOCK_COUNT + 1) for c in combinations(range(width), k)]
        flips = np.array(flips, np.uint64)
        for b in range(BLOCK_COUNT):
            near = (self._block(self.prints, b)[:, None] ^ flips).ravel()
            order = np.argsort(near, kind="stable")
            self.keys.append(near[order].astype(np.uint16))
            self.owners.append((order // len(flips)).astype(np.int32))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        width = 64 // BLOCK_COUNT
        return (prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, fingerprint) within RADIUS, each once."""
        if not self.keys:
            self._build()
        found = []
        for b in range(BLOCK_COUNT):
            keys = self._block(queries, b).astype(np.uint16)
            lo, hi = np.searchsorted(self.keys[b], keys, "left"), np.searchsorted(self.keys[b], keys, "right")
            n = hi - lo
            q = np.repeat(np.arange(len(queries)), n)
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            i = self.owners[b][at]
            close = np.bitwise_count(queries[q] ^ self.prints[i]) <= RADIUS
            found.append(q[close].astype(np.int64) * len(self.prints) + i[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


@dataclass
class Benchmark:
    """The items of one pass, by number of words."""

    ids: list[int]
    shingles: dict[int, np.ndarray]  # by shingle length: sorted hashes
    filters: dict[int, np.ndarray]  # by shingle length: which low 16 bits occur
    lengths: dict[int, tuple[np.ndarray, MultiIndex]]  # by item length: item numbers, index
    weights: list[tuple[np.ndarray, np.ndarray]]  # each item's shingles and their counts
    shingle: int

    def gram(self, n: int) -> int:
        return min(self.shingle, n)


def index_items(items: list[tuple[int, str]], shingle: int = SHINGLE) -> Benchmark:
    """Items without a word have no shingle and match nothing."""
    texts = pa.array([t or "" for _, t in items], pa.large_string())
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    for lo, hi, buf, offs in text_slices(texts):
        words, hashes = plain_words(buf, offs)
        for k in range(hi - lo):
            own = hashes[words.first[k] : words.first[k + 1]]
            if len(own):
                by_length.setdefault(len(own), []).append((lo + k, own))
    shingles, lengths, weights = {}, {}, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * len(items)
    for n, members in by_length.items():
        g = min(shingle, n)
        prints = []
        for k, own in members:
            grams, counts = np.unique(Runs(own).all(g), return_counts=True)
            weights[k] = (grams, counts)
            shingles.setdefault(g, []).append(grams)
            prints.append(fingerprints(own, np.zeros(1, np.int64), n))
        lengths[n] = (np.array([k for k, _ in members]), MultiIndex(np.concatenate(prints)))
    shingles = {g: np.unique(np.concatenate(s)) for g, s in shingles.items()}
    filters = {}
    for g, s in shingles.items():
        filters[g] = np.zeros(1 << 16, bool)
        filters[g][(s & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Benchmark([i for i, _ in items], shingles, filters, lengths, weights, shingle)


def _members(values: np.ndarray, known: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Places of the values that are among the sorted ``known``."""
    at = np.flatnonzero(maybe[(values & np.uint64(0xFFFF)).astype(np.int64)])
    some = values[at]
    found = np.searchsorted(known, some)
    return at[known[np.minimum(found, len(known) - 1)] == some]


def matches(words: Words, hashes: np.ndarray, bench: Benchmark, least: float) -> list[tuple[int, int, int, int, float]]:
    """(row, item number, first word, words, similarity): the best window for each row and item."""
    runs = Runs(hashes)
    hits = {g: _members(runs.all(g), known, bench.filters[g]) for g, known in bench.shingles.items()}
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for n, (items, index) in bench.lengths.items():
        g = bench.gram(n)
        if not len(hits[g]) or len(words) < n:
            continue
        # Starts of windows that hold a hit: from n - g words before it to the hit itself.
        new = np.minimum(np.diff(hits[g], prepend=hits[g][0] - n), n - g + 1)
        last = np.cumsum(new)
        starts = np.repeat(hits[g] + 1 - last, new) + np.arange(last[-1])
        starts = starts[starts >= 0]
        row = np.searchsorted(words.first, starts, "right") - 1
        starts = starts[starts + n <= words.first[row + 1]]
        if not len(starts):
            continue
        q, i = index.near(fingerprints(hashes, starts, n))
        for s, k in zip(starts[q].tolist(), items[i].tolist()):
            grams, counts = np.unique(runs.between(np.arange(s, s + n - g + 1), np.arange(s + g, s + n + 1)), return_counts=True)
            own, weight = bench.weights[k]
            at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
            both = own[at] == grams
            same = int(np.minimum(counts[both], weight[at[both]]).sum())
            similarity = same / (2 * (n - g + 1) - same)
            if similarity >= least:
                r = int(np.searchsorted(words.first, s, "right")) - 1
                if similarity > best.get((r, k), (0.0,))[0]:
                    best[r, k] = (similarity, s - int(words.first[r]), n)
    return [(r, k, s, n, x) for (r, k), (x, s, n) in sorted(best.items())]


FOUND = "doc_id bigint, row_key bigint, item_id bigint, start int, n_words int, similarity double"


def _scan(shared, least: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            for lo, _, buf, offs in text_slices(batch.column("text")):
                words, hashes = plain_words(buf, offs)
                found = matches(words, hashes, bench, least)
                if found:
                    r, k, s, n, x = zip(*found)
                    take = pa.array([lo + v for v in r])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(take), batch.column("row_key").take(take), pa.array([bench.ids[v] for v in k], pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(x, pa.float64())],
                        names=["doc_id", "row_key", "item_id", "start", "n_words", "similarity"],
                    )

    return rows


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row_key (hash of the text), item_id, start, n_words, similarity of each
    (document, item) pair of which some item-sized window is as similar as ``least``;
    the best window, the first of equal ones. Words count without ASCII punctuation and with A-Z as
    a-z; ``start`` is a number among those words. Documents without a word, and
    shorter than an item, don't match it; repeated rows match alike; items without a
    word match nothing; an item of fewer words than a shingle is one shingle.

    The documents are read in one pass without a shuffle for each PASS_ITEMS items (one
    for benchmarks up to that size); only that many items are sent to the executors.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null").distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-size["n"] // PASS_ITEMS), -(-size["bytes"] // PASS_BYTES))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), F.col("text").cast("string").alias("text"))
    found = None
    for k in range(passes):
        chosen = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        bench = index_items([(r["item_id"], r["text"]) for r in chosen.orderBy("item_id", "text").collect()], shingle)  # about PASS_ITEMS items
        part = keyed.mapInArrow(lean(_scan(spark.sparkContext.broadcast(bench), least)), FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item was found.

    The found rows' keys are written once and counted: a short list is broadcast, so
    that no text is shuffled; a long one is joined by a shuffle.
    """
    leaked, key = unused(docs, "doc"), unused(docs, "key")
    keys = leaks(docs, benchmark, least).select(F.col("doc_id").alias(leaked), F.col("row_key").alias(key)).distinct()
    keys = materialize(keys, "leak-keys")
    joined = docs.join(small_side(keys, keys.count(), 40), docs["doc_id"].cast("long").eqNullSafe(keys[leaked]) & (F.xxhash64(docs["text"]) == keys[key]), "left_anti")
    return joined.select(*docs.columns)


def op9_decontamination(spark, sf_dir):
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    # Items that share an id, and rows that share a doc_id, keep their best window.
    line = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "start", "n_words")
    best = found.withColumn("k", F.row_number().over(line)).where("k = 1")
    return best.select("doc_id", "item_id", "start", "n_words", "similarity")
