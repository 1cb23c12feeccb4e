"""Quality classifier: random Fourier features of document statistics.

Statistics of a whole text are standardized and mapped to random Fourier
features (Rahimi and Recht 2007), whose inner products approximate a Gaussian
kernel. Ridge regression on them has normal equations that are sums over rows, so each
partition sums its own. Isotonic regression then turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .shared import lean, materialize, table
from .text_arrays import Runs, Words, text_slices

#: Random Fourier features, the kernel's width (in standard deviations), and ridge.
FEATURES, WIDTH, RIDGE = 192, 3.0, 1e-3
#: Bound of the labelled rows that the fit reads; one in CALIBRATE of them is kept for calibration.
FIT_ROWS, CALIBRATE = 200_000, 4
#: Scores are calibrated in this many steps.
STEPS = 2048
_SEED = 23

NAMES = (
    "log_words", "log_bytes", "word_length", "word_length_sd", "upper", "digits", "symbols", "marks", "bars", "letters", "high_bytes",
    "ends_in_symbol", "distinct_words", "distinct_pairs", "distinct_fives", "repeated_next", "lines_per_word", "commonest", "long_words", "log_longest",
)

_UPPER, _DIGIT, _SYMBOL, _MARK, _BAR, _LETTER, _HIGH, _LINE = range(8)
_KINDS = np.zeros((8, 256), bool)
_KINDS[_UPPER, 65:91] = _KINDS[_DIGIT, 48:58] = _KINDS[_LETTER, 65:91] = _KINDS[_LETTER, 97:123] = _KINDS[_HIGH, 128:] = True
for _k, _chars in ((_SYMBOL, "#*$%&<>@^~_=+\\"), (_MARK, "!?"), (_BAR, "|"), (_LINE, "\n")):
    _KINDS[_k, [ord(c) for c in _chars]] = True


def _distinct(keys: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and the number of the commonest one."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, o[at], np.diff(np.append(at, len(k))))
    return np.bincount(o[at], minlength=rows), most


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text of a slice; an empty text's are all 0."""
    words = Words(buf, offs)
    rows, n = len(offs) - 1, words.count
    size = np.diff(offs)
    share = lambda k: np.diff(np.concatenate([[0], np.cumsum(_KINDS[k][buf])])[offs]) / np.maximum(size, 1)
    owner = words.row()
    length = (words.end - words.start).astype(np.float64)
    per = np.maximum(n, 1)
    total = lambda v: np.bincount(owner, v, minlength=rows)
    mean = total(length) / per
    hashes = words.hashes(0, lower=True)
    runs = Runs(hashes)

    def variety(k: int) -> tuple[np.ndarray, np.ndarray]:
        inside = np.flatnonzero(words.holds(k)[: max(0, len(words) - k + 1)])
        own, most = _distinct(hashes if k == 1 else runs.all(k)[inside], owner if k == 1 else owner[inside], rows)
        return own / np.maximum(n - k + 1, 1), most

    next_same = np.zeros(len(words), bool)
    next_same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    longest = np.zeros(rows)
    np.maximum.at(longest, owner, length)
    ends = _KINDS[_SYMBOL][buf[words.end - 1]] | _KINDS[_MARK][buf[words.end - 1]]
    single, most = variety(1)
    columns = [
        np.log1p(n), np.log1p(size), mean, np.sqrt(np.maximum(total(length * length) / per - mean * mean, 0)), share(_UPPER), share(_DIGIT), share(_SYMBOL),
        share(_MARK), share(_BAR), share(_LETTER), share(_HIGH), total(ends) / per, single, variety(2)[0], variety(5)[0], total(next_same) / per,
        share(_LINE) * size / per, most / per, total(length > 20) / per, np.log1p(longest),
    ]
    out = np.stack([np.asarray(c, np.float64) for c in columns], axis=1)
    out[size == 0] = 0
    return out


STATISTICS = "doc_id bigint, stats array<double>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in text_slices(batch.column("text")):
            rows = statistics(buf, offs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], names=["doc_id", "stats"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every row; null texts measure as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_measure), STATISTICS)


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None  # None: nothing was learned
    steps: np.ndarray | None = None  # raw scores and the calibrated values there
    values: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        r = np.random.default_rng(_SEED)
        k = stats.shape[1]
        w, b = r.normal(0, 1 / WIDTH, (k, FEATURES)), r.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.center) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        if self.steps is None or not len(self.steps):
            return np.clip(raw, 0, 1)
        return np.clip(np.interp(raw, self.steps, self.values), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, len(NAMES)))


PARTIAL = "zz binary, zy binary"


def _normal_equations(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zz, zy = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z, y = model.features(_matrix(batch.column("stats"))), np.asarray(batch.column("label"), np.float64)
            zz += z.T @ z
            zy += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()]), pa.array([zy.tobytes()])], names=["zz", "zy"])

    return rows


def _raw_steps(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.clip(np.floor((model.raw(_matrix(batch.column("stats"))) + 0.5) * STEPS / 2), 0, STEPS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(step.astype(np.int32)), batch.column("label")], names=["step", "label"])

    return rows


def isotonic(x: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over ascending x: each block's mean x and its share of positives.

    Shares lean by one virtual half-and-half row on the whole, so that the ends are not
    certain and blocks stay in order.
    """
    blocks: list[list[float]] = []
    for at, p, n in zip(x, positives, totals):
        blocks.append([float(at * n), float(p), float(n)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            b = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], b)]
    n = np.array([b[2] for b in blocks])
    value = np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
    return np.array([b[0] for b in blocks]) / n, np.maximum.accumulate(value)


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from (doc_id, stats, label), label 0 or 1, of at most about ``rows`` rows.

    A larger table is thinned by a hash of the doc_id. The moments, the eight
    partitions' sums and at most STEPS histogram rows come to the driver.
    """
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 11) / F.lit(float(1 << 53))
    n = labelled.count()
    drawn = materialize(labelled.where(unit < min(1.0, rows / max(n, 1))).repartition(8, "doc_id"), "quality-labelled")
    parts = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(CALIBRATE)) == 0
    moments = drawn.agg(*[f(F.get("stats", F.lit(k))).alias(f"{name}{k}") for k in range(len(NAMES)) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if moments["m0"] is None:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    pick = lambda name: np.array([moments[f"{name}{k}"] for k in range(len(NAMES))])
    model = Model(pick("m"), np.maximum(pick("s"), 1e-3))
    part = drawn.where(~parts)
    if part.isEmpty():
        part = drawn
    sums = part.coalesce(8).mapInArrow(lean(_normal_equations(model)), PARTIAL).collect()
    zz, zy = sum(np.frombuffer(r["zz"]).reshape(FEATURES + 1, -1) for r in sums), sum(np.frombuffer(r["zy"]) for r in sums)
    ridge = RIDGE * np.trace(zz) / len(zz)
    model.weights = np.linalg.solve(zz + ridge * np.eye(len(zz)), zy)
    steps = drawn.where(parts).mapInArrow(lean(_raw_steps(model)), "step int, label int").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).orderBy("step").collect()  # STEPS rows at most
    if steps:
        x = (np.array([r["step"] for r in steps]) + 0.5) * 2 / STEPS - 0.5
        model.steps, model.values = isotonic(x, np.array([r["p"] for r in steps]), np.array([r["n"] for r in steps]))
    return model


SCORED = "doc_id bigint, score double"


def _score(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("stats"))))], names=["doc_id", "score"])

    return rows


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (how likely quality is 1) for every row of docs.

    Labels count when their doc_id isn't held out (crc32 mod 5 is 0) and quality is 0
    or 1; of several rows of one doc_id the lowest. Without any, every score is
    0.5. Null and empty texts are scored as texts without a word; repeated rows alike.
    """
    stats = materialize(measured(docs), "quality-statistics")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id", 5, 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    model = fit(stats.join(known, "doc_id").select("doc_id", "stats", "label"))
    return stats.mapInArrow(lean(_score(model)), SCORED)


def op5_quality_classifier(spark, sf_dir):
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
