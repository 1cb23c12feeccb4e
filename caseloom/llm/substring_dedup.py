"""Substring dedup by a de Bruijn graph in minimizer space.

A window of W consecutive words is an edge of the de Bruijn graph of (W-1)-word
nodes. Each window belongs to its minimizer, the k-word mer with the least hash
in it, and neighbouring windows with one minimizer form a nonbranching run of
edges: equal windows have equal minimizers, so two documents can only share a
window inside runs of the same mer. The graph is kept as one row a run (mer,
digest of the run's words, document, coordinates), about W/2 times smaller than
the edges. Spark joins compact it: runs with equal digests are one path whose
source is the least document that holds it. Only where different runs meet at a
mer (a branch: texts that diverge within W words) are single windows looked at,
and only those of a run's source. What continues in a document and in its source is
one span. Runs and windows are compared by a cryptographic digest (BLAKE2b, 128 bits) of the words that
stand at their coordinates, not by the hashes that choose minimizers: a span is its source's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, drop_shuffles, lean, materialize, table
from .text_arrays import Runs, Words, text_slices

#: Words of a mer, the content-defined anchor of a window.
MER = 10


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and text: rows that share a doc_id are told apart by their text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), F.col("text").cast("string").alias("text"))


def _anchors(words: Words, mers: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each run, and the word at which its mer starts."""
    n = len(words)
    width = window - MER + 1  # mers in a window
    if n < window:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(max(20, int(n).bit_length()))
    packed = ((mers >> bits) << bits) | np.arange(len(mers), dtype=np.uint64)
    least, span = packed, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    starts = np.flatnonzero(words.holds(window))
    anchor = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(anchor) != 0)
    new[1:] |= np.diff(np.searchsorted(words.first, starts, "right")) != 0
    at = np.flatnonzero(new)
    return starts[at], starts[np.append(at[1:], len(starts)) - 1], anchor[at]


RUNS = "mer bigint, run1 bigint, run2 bigint, doc_id bigint, row_key bigint, s int, e int"


def _digests(words: Words, lo: np.ndarray, hi: np.ndarray) -> list[pa.Array]:
    """The halves of the digests of the words from each ``lo`` up to ``hi``, one space after each."""
    if not len(lo):
        return [pa.array([], pa.int64())] * 2
    # The slice's words with one space after each: a run of words is then a run of bytes.
    size = words.end - words.start + 1
    stop = np.cumsum(size)
    at = np.repeat(words.start - (stop - size), size) + np.arange(stop[-1])
    at[stop - 1] = 0
    spaced = words.buf[at]
    spaced[stop - 1] = 32
    view = memoryview(spaced)
    digest = hashlib.blake2b
    found = b"".join([digest(view[i:j], digest_size=16).digest() for i, j in zip((stop - size)[lo].tolist(), stop[hi - 1].tolist())])
    halves = np.frombuffer(found, "<i8").reshape(-1, 2)
    return [pa.array(halves[:, k].copy()) for k in range(2)]


def _runs(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("row_key")
            for lo, _, buf, offs in text_slices(batch.column("text")):
                words = Words(buf, offs)
                s, e, a = _anchors(words, mers := Runs(words.hashes(0)).all(MER), window)
                if not len(s):
                    continue
                row = np.searchsorted(words.first, s, "right") - 1
                base = words.first[row]
                take = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mers[a].view(np.int64)), *_digests(words, s, e + window), ids.take(take), keys.take(take), pa.array((s - base).astype(np.int32)), pa.array((e - base).astype(np.int32))],
                    names=["mer", "run1", "run2", "doc_id", "row_key", "s", "e"],
                )

    return rows


WINDOWS = "w1 bigint, w2 bigint, doc_id bigint, row_key bigint, s int"


def _windows(window: int):
    """Digests of the windows that start in the given runs of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, runs = batch.column("doc_id"), batch.column("row_key"), batch.column("runs")
            for lo, hi, buf, offs in text_slices(batch.column("text")):
                words = Words(buf, offs)
                part = runs.slice(lo, hi - lo)
                flat = part.flatten()
                n = np.asarray(part.value_lengths())
                row = np.repeat(np.arange(hi - lo), n)
                s, e = (np.asarray(flat.field(k)).astype(np.int64) for k in ("s", "e"))
                size = e - s + 1
                at = np.repeat(s + words.first[row], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                take = np.repeat(row, size)
                yield pa.RecordBatch.from_arrays(
                    [*_digests(words, at, at + window), ids.take(pa.array(lo + take)), keys.take(pa.array(lo + take)), pa.array((at - words.first[take]).astype(np.int32))],
                    names=["w1", "w2", "doc_id", "row_key", "s"],
                )

    return rows


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """Ranges of window starts whose words also start in a document with a smaller
    doc_id: doc_id, row_key, s, e, source (doc_id, s: where the range's first
    window starts in the source). Null doc_ids take no part.

    Each step's rows are a table before the next step starts, and tables and shuffle files
    that no later step reads go: the disk holds one step at a time. Joins but that of paths with
    their mers are merge joins at every size.
    """
    keyed = _keyed(docs)
    runs = materialize(keyed.where("doc_id is not null").mapInArrow(lean(_runs(window)), RUNS), "dedup-runs")
    key = ["mer", "run1", "run2"]
    place = F.struct("doc_id", "s")
    paths = runs.groupBy(*key).agg(F.min(place).alias("source"), F.max("doc_id").alias("last"))
    mers = paths.groupBy("mer").agg(F.count(F.lit(1)).alias("n_runs"), F.min("source.doc_id").alias("least"), F.max("last").alias("most"))
    mers = mers.where("least < most").select("mer", "n_runs")
    shared = materialize(paths.join(mers, "mer").select(*key, "source", "n_runs"), "dedup-shared")
    drop_shuffles(docs.sparkSession)
    hits = runs.join(shared.hint("merge"), key).where("source.doc_id < doc_id or n_runs > 1")
    hits = materialize(hits.select("doc_id", "row_key", "s", "e", F.when(F.col("source.doc_id") < F.col("doc_id"), F.col("source")).alias("source")), "dedup-paths")
    discard(runs, shared)
    drop_shuffles(docs.sparkSession)
    branches = hits.where("source is null").groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    windows = keyed.join(branches.hint("merge"), ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "runs").mapInArrow(lean(_windows(window)), WINDOWS)
    windows = materialize(windows, "dedup-windows")
    drop_shuffles(docs.sparkSession)
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("source"), F.max("doc_id").alias("last")).where("source.doc_id < last").drop("last")
    single = windows.join(first.hint("merge"), ["w1", "w2"]).where("source.doc_id < doc_id")
    single = materialize(single.select("doc_id", "row_key", "s", F.col("s").alias("e"), "source"), "dedup-single")
    discard(windows)
    drop_shuffles(docs.sparkSession)
    return hits.where("source is not null").unionByName(single)


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """Maximal spans of repeated windows with source coordinates: doc_id, row_key,
    start, n_words, source_doc, source_start. Ranges that continue each
    other in the document and in the same source are one span."""
    found = repeated_windows(docs, window).select("doc_id", "row_key", "s", "e", F.col("source.doc_id").alias("source_doc"), (F.col("source.s") - F.col("s")).alias("shift")).distinct()
    key = ["doc_id", "row_key", "source_doc", "shift"]
    line = Window.partitionBy(*key).orderBy("s")
    found = found.withColumn("new", (F.col("s") > F.coalesce(F.lag("e").over(line) + 1, F.lit(-1))).cast("int"))
    found = found.withColumn("island", F.sum("new").over(line))
    spans = found.groupBy(*key, "island").agg(F.min("s").alias("start"), F.max("e").alias("e"))
    return spans.select("doc_id", "row_key", "start", (F.col("e") + window - F.col("start")).alias("n_words"), "source_doc", (F.col("start") + F.col("shift")).alias("source_start"))


def _removed(window: int, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges")):
                words = (text.as_py() or "").encode().split()
                keep = words
                if (ranges := ranges.values) is not None and len(ranges):
                    edge = np.zeros(len(words) + window + 1, np.int32)
                    np.add.at(edge, np.asarray(ranges.field("s")), 1)
                    np.add.at(edge, np.asarray(ranges.field("e")) + window, -1)
                    keep = [words[i] for i in np.flatnonzero(np.cumsum(edge)[: len(words)] == 0)]
                kept = b" ".join(keep)
                n_words.append(len(words))
                n_removed.append(len(words) - len(keep))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if with_text else None)
            out = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                out, names = [*out, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return rows


def remove_repeats(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """Every document with each word removed that lies in a window of ``window`` words
    which also starts in a document with a smaller doc_id.

    One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (and
    kept_text). Windows are judged on the input. Null, empty and shorter texts
    lose nothing; exact copies lose everything but in the least doc_id; rows with
    one doc_id never remove from each other; repeated rows are treated alike; an empty
    table gives an empty result; other columns are ignored. A text of any length is one row of one task.
    """
    found = repeated_windows(docs, window).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    joined = _keyed(docs).join(found.hint("merge"), ["doc_id", "row_key"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(lean(_removed(window, with_text)), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else ""))


def op8_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, s, hash(array_to_string(w[s:s+49], ' ')) AS h
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
hit AS (SELECT rid, s FROM (SELECT rid, s, doc_id, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT rid, p FROM (
  SELECT rid, p.i AS p FROM (SELECT rid, s, unnest(range(s, s + 50)) AS i FROM hit) AS p)),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT words.rid, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
         FROM words LEFT JOIN gone ON words.rid = gone.rid AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
