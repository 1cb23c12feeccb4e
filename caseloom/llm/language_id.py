"""Language identification with a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: how many
character n-grams (of every length up to ``MAX_N``) both hold, whatever their
counts, divided by the root of the product of either's own number (Lodhi et al.
2002; Ionescu et al. 2014). Landmark texts give its Nystroem approximation, one-versus-
rest kernel ridge regression its weights. A text is scored by one product of its
presence row with a matrix of n-grams by languages, for batches of rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget_others, lean, materialize, small_batches, table

#: Longest n-gram; all shorter ones count as well.
MAX_N = 4
#: n-grams are told apart by this many bits of hash.
BITS = 20
#: Bounds of the fit: landmark texts and training texts for each language.
LANDMARKS, TRAIN_ROWS = 48, 1500
#: Most languages that are learned: beyond it the fit is refused.
MAX_LANGUAGES = 500
#: An n-gram is a feature when this many landmarks hold it.
MIN_LANDMARKS = 2
RIDGE = 1e-2
UNKNOWN = "und"
#: Cells of a batch's presence matrix.
_CELLS = 1 << 22

_codes: np.ndarray | None = None


def _letter_codes() -> np.ndarray:
    """For each code point: 0 if no letter, else a scrambled code of its own."""
    global _codes
    if _codes is None:
        letters = np.array([chr(i).isalpha() for i in range(0x110000)])
        x = (np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        _codes = np.where(letters, ((x ^ (x >> np.uint64(29))) >> np.uint64(8)).astype(np.uint32) | np.uint32(1), np.uint32(0))
    return _codes


def gram_batches(texts: list[str], limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, rows, n-gram hashes, whether each text has a letter) for slices of texts.

    Texts are lower-cased, all that is no letter reads as one mark between words;
    n-grams that begin with that mark are left out, so that each word's grams
    start at its letters and end at most one mark behind it.
    """
    codes = _letter_codes()
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= limit):
            size += len(texts[hi]) + 1
            hi += 1
        lowered = [t.lower() for t in texts[lo:hi]]
        points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.repeat(np.arange(hi - lo, dtype=np.int32), [len(t) + 1 for t in lowered])
        c = codes[points]
        del points
        keep = c != 0
        has_letter = np.zeros(hi - lo, bool)
        has_letter[rows[keep]] = True
        keep[1:] |= keep[:-1]  # one mark behind each word; the rest of a gap goes
        c, rows = c[keep], rows[keep]
        first = c != 0
        h = c.copy()
        every, owners = [h[first]], [rows[first]]
        for n in range(2, MAX_N + 1):
            h = h[:-1] * np.uint32(0x01000193 + 2 * n) + c[n - 1 :]
            inside = first[: len(h)] & (rows[: len(h)] == rows[n - 1 :])
            every.append((h[inside] ^ (h[inside] >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n))
            owners.append(rows[: len(h)][inside])
        grams = np.concatenate(every)
        yield lo, np.concatenate(owners), ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), has_letter
        lo = hi


@dataclass
class Features:
    """Which n-gram is which column; -1: none of the landmarks' grams."""

    column: np.ndarray
    width: int

    def presence(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, 0/1 matrix of texts by n-grams, whether they have a letter)."""
        step = max(1, _CELLS // max(1, self.width))
        for lo in range(0, len(texts), step):
            for at, rows, grams, letters in gram_batches(texts[lo : lo + step]):
                found = np.zeros((len(letters), self.width), np.float32)
                column = self.column[grams]
                known = column >= 0
                found[rows[known], column[known]] = 1
                yield lo + at, found, letters


@dataclass
class Classifier:
    languages: list[str]
    features: Features
    weights: np.ndarray  # n-grams by languages

    def scores(self, present: np.ndarray) -> np.ndarray:
        return present @ self.weights / np.sqrt(np.maximum(present.sum(1), 1))[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.languages:
            for lo, present, letters in self.features.presence(texts):
                s = self.scores(present)
                top = s.argmax(1)
                for k in np.flatnonzero(letters):
                    names[lo + k] = self.languages[top[k]]
                    best[lo + k] = min(1.0, max(0.0, float(s[k, top[k]])))
        return names, best


GRAMS = "lang string, grams array<int>"


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for lo, rows, grams, letters in gram_batches(texts):
            sets = [np.unique(grams[rows == k]).astype(np.int32) for k in range(len(letters))]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, len(sets)), pa.array(sets, pa.list_(pa.int32()))], names=["lang", "grams"])


PARTIAL = "kk binary, ky binary"


def _normal_equations(features: Features, marks: np.ndarray, names: list[str]):
    """Sums of k'k and k'y over a partition, k a text's kernel with the landmarks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = np.sqrt(np.maximum(marks.sum(1), 1))
        kk, ky = np.zeros((len(marks), len(marks))), np.zeros((len(marks), len(names)))
        for batch in batches:
            texts, langs = [t or "" for t in batch.column("text").to_pylist()], batch.column("lang").to_pylist()
            for lo, present, letters in features.presence(texts):
                k = (present @ marks.T / norm / np.sqrt(np.maximum(present.sum(1), 1))[:, None]).astype(np.float64)
                y = np.array([[x == name for name in names] for x in langs[lo : lo + len(k)]], np.float64)
                k, y = k[letters], y[letters]
                kk += k.T @ k
                ky += k.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([kk.tobytes()]), pa.array([ky.tobytes()])], names=["kk", "ky"])

    return rows


def fit(labelled: DataFrame, landmarks: int = LANDMARKS, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Learn from rows (doc_id, text, lang), none of them null.

    The fit reads a sample bounded by ``landmarks`` and ``train_rows`` for each
    language: documents whose doc_id's hash falls below a share that is set from
    the language's exact count, so that a rerun draws the same ones. Landmarks'
    n-gram sets (at most 2^BITS numbers each) and one partial sum for each of at
    most 8 partitions come to the driver; texts never do.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Classifier([], Features(np.full(1 << BITS, -1, np.int32), 0), np.zeros((0, 0), np.float32))
    names = sorted(r["lang"] for r in counts)
    shares = spark.createDataFrame([(r["lang"], min(1.0, landmarks / r["n"]), min(1.0, (landmarks + train_rows) / r["n"])) for r in counts], "lang string, mark double, train double")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id"), 11) / F.lit(float(1 << 53))
    drawn = labelled.join(F.broadcast(shares), "lang").withColumn("unit", unit)  # at most MAX_LANGUAGES rows
    # The sample is written first, by as many tasks as the table has parts; what follows reads it alone.
    drawn = materialize(drawn.where("unit < train").select("lang", "text", (F.col("unit") < F.col("mark")).alias("mark")), "language-sample")
    sets = drawn.where("mark").select("lang", "text").repartition(8).mapInArrow(lean(_gram_sets), GRAMS).toPandas()
    sets = [np.asarray(g) for g in sets["grams"] if len(g)]
    held = np.zeros(1 << BITS, np.int64)
    for grams in sets:
        held[grams] += 1
    chosen = np.flatnonzero(held >= min(MIN_LANDMARKS, max(1, len(sets))))
    column = np.full(1 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen), dtype=np.int32)
    features = Features(column, len(chosen))
    marks = np.zeros((len(sets), len(chosen)), np.float32)
    for k, grams in enumerate(sets):
        own = column[grams]
        marks[k, own[own >= 0]] = 1
    if not len(sets) or not len(chosen):
        return Classifier([], features, np.zeros((0, 0), np.float32))
    sums = drawn.select("lang", "text").repartition(8).mapInArrow(lean(_normal_equations(features, marks, names)), PARTIAL).collect()  # 8 rows at most
    m = len(marks)
    kk = sum(np.frombuffer(r["kk"]).reshape(m, m) for r in sums)
    ky = sum(np.frombuffer(r["ky"]).reshape(m, len(names)) for r in sums)
    norm = np.sqrt(np.maximum(marks.sum(1), 1)).astype(np.float64)
    kmm = (marks @ marks.T).astype(np.float64) / norm[:, None] / norm
    alpha = np.linalg.solve(kk + RIDGE * kmm + 1e-6 * np.trace(kk) / m * np.eye(m), ky)
    # A text's kernel with the landmarks is linear in its presence row: fold it into the weights.
    return Classifier(names, features, (marks.T @ (alpha / norm[:, None])).astype(np.float32))


PREDICTED = "lang_pred string, score double"


def identify(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, lang_pred and score (0 to 1, the regression's value).

    Null texts and texts without a letter are ``und`` with score 0, as is everything
    if nothing was learned. The whole text counts; rows stay as they are. Columns of
    docs that bear the new names can't be among ``keep``.
    """
    if clash := {"lang_pred", "score"} & set(keep):
        raise ValueError(f"kept columns would be doubled: {sorted(clash)}")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded: 2^BITS columns, landmarks' grams by languages

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                names, best = shared.value.predict([t or "" for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in range(len(keep))] + [pa.array(names), pa.array(best)], names=[*keep, "lang_pred", "score"])

    chosen = docs.select(*keep, F.col("text").cast("string").alias("text to identify"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(lean(rows), f"{fields}, {PREDICTED}")


def accepted(docs: DataFrame, model: Classifier, least: float) -> DataFrame:
    """The rows of docs, with all their columns, in a learned language that scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("language_id")
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                names, best = shared.value.predict([t or "" for t in part.column(text).to_pylist()])
                yield part.filter(pa.array([name != UNKNOWN and score >= least for name, score in zip(names, best)]))

    return docs.mapInArrow(lean(rows), docs.schema)


def held_out(doc_id, modulus: int = 3, remainder: int = 1):
    """crc32 of the doc_id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learn(docs: DataFrame) -> Classifier:
    """Fit on the rows with text and lang whose doc_id isn't held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return fit(known.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.withColumn("held_out", held_out("doc_id")), learn(docs), ["doc_id", "held_out"])
