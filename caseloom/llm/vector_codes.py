"""Vector code compression: product quantization in whole numbers.

Components become the integers floor(256 x). Vectors are cut into 16 equal parts and
each part position has a codebook of up to 64 entries, refined by a fixed number of
rounds. A part finds its nearest entry coarse to fine: by Cauchy and Schwarz, parts
cut into the same blocks are at least as far apart as

    sum over blocks of  size * (difference of means)^2 + (difference of residual norms)^2

where a block's residual is what its mean leaves. One block a part is the coarsest
bound, and blocks are halved until they would be single components. Entries whose bound
lies above a distance already known are out; the others get exact integer distances.
Bounds are floating point and are rounded down, so that no entry is lost to them.

Each round is one pass: tasks sum the parts that chose an entry, and Spark adds up one
row for each task, part and entry. Only codebooks (bounded by their definition) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, materialize, small_side, table, unused

#: Steps a unit, parts of a vector, entries of a codebook, refining rounds.
STEPS, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows held against a codebook at once.
BLOCK = 512


def largest(dim: int) -> int:
    """The magnitude up to which components may go so that every sum over a vector stays within 64 bits."""
    return isqrt((1 << 61) // max(dim, PARTS)) // 2


class Blocks:
    """What the bounds of one level read of parts (rows of integers): for each block of a part its sum, and the norm
    of its residual times the root of its size."""

    def __init__(self, parts: np.ndarray, cuts: list[int]):
        self.size = np.diff([*cuts, parts.shape[1]]).astype(np.float64)
        self.total = np.add.reduceat(parts, cuts, axis=1)
        self.spread = np.sqrt((np.add.reduceat(parts * parts, cuts, axis=1) * self.size.astype(np.int64) - self.total * self.total).astype(np.float64))


def lower_bound(own: Blocks, book: Blocks, row, entry) -> np.ndarray:
    """Numbers that the squared distances between the parts ``row`` and the entries ``entry`` (which broadcast) aren't below."""
    bound = 0.0
    for k, size in enumerate(own.size):
        apart = (own.total[row, k] - book.total[entry, k]).astype(np.float64)
        mine, other = own.spread[row, k], book.spread[entry, k]
        ring = np.abs(mine - other)
        ring -= 1e-15 * (mine + other)  # more than the roots can be off
        np.maximum(ring, 0, out=ring)
        ring *= ring
        apart *= apart
        apart += ring
        apart *= (1 - 1e-12) / size
        bound = bound + apart
    return bound


class Codebook:
    """The entries of one part position, with their blocks from coarse to fine."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width, self.cuts = entries.shape[1], []
        n = 1
        while n == 1 or 2 * n <= width:
            self.cuts.append([width * k // n for k in range(n)])
            n *= 2

    @cached_property
    def levels(self) -> list[Blocks]:
        return [Blocks(self.entries, cuts) for cuts in self.cuts]

    def _exact(self, parts: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = parts[row] - self.entries[entry]
        return (gap * gap).sum(axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each part (of equal ones the first), its squared distance, and how many
        distances were taken exactly."""
        n = len(parts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        own, book = Blocks(parts, self.cuts[0]), self.levels[0]
        bound = lower_bound(own, book, np.arange(n)[:, None], np.arange(len(self.entries)))
        first = bound.argmin(axis=1)
        known = self._exact(parts, np.arange(n), first)  # no entry beyond this can be nearest
        row, entry = np.nonzero(bound <= known[:, None])
        for cuts, book in zip(self.cuts[1:], self.levels[1:]):
            own = Blocks(parts, cuts)
            close = lower_bound(own, book, row, entry) <= known[row]
            row, entry = row[close], entry[close]
        far = self._exact(parts, row, entry)
        head = np.flatnonzero(np.diff(row, prepend=-1))  # the first choice's bound is no bar to itself: every row is there
        least = np.minimum.reduceat(far, head)
        tied = np.where(far == least[row], entry, len(self.entries))
        return np.minimum.reduceat(tied, head), least, len(row) + n


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as whole numbers."""
    values = np.asarray(column.flatten()).astype(np.float64)
    return np.floor(values.reshape(len(column), -1) * STEPS).astype(np.int64)


def _assigned(batch: pa.RecordBatch, books: list[Codebook]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, whole numbers, codes, squared distances) of the rows of a batch, BLOCK at a time."""
    column = batch.column("__vector")
    for lo in range(0, len(batch), BLOCK):
        x = _matrix(column.slice(lo, BLOCK))
        found = [book.nearest(part) for book, part in zip(books, np.split(x, PARTS, axis=1))]
        yield lo, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


SUMS = "part int, entry int, sums array<bigint>"


def _sum_parts(books: np.ndarray):
    """Rows (part, entry, [count, sums of components]) of a task's vectors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        parts, entries, width = books.shape
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for _, x, codes, _ in _assigned(batch, own):
                for p in range(parts):
                    chosen = [np.bincount(codes[:, p], minlength=entries)]
                    # Sums of BLOCK components are below 2^53, where floating point is exact.
                    chosen += [np.bincount(codes[:, p], x[:, p * width + k], entries).astype(np.int64) for k in range(width)]
                    total[p] += np.stack(chosen, axis=1)
        part, entry = np.nonzero(total[:, :, 0])
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "sums"])

    return rows


def _encode(books: np.ndarray):
    """(code, error) beside the columns of each row but its vector."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        for batch in batches:
            codes, errors = [], []
            for _, _, code, far in _assigned(batch, own):
                codes += [c.tobytes().hex() for c in code.astype(np.uint8)]
                errors.append(far.sum(axis=1))
            kept = [k for k, name in enumerate(batch.schema.names) if name != "__vector"]
            columns = [batch.column(k) for k in kept] + [pa.array(codes, pa.string()), pa.array(np.concatenate(errors) if errors else [], pa.int64())]
            yield pa.record_batch(columns, [*(batch.schema.names[k] for k in kept), "__code", "__error"])

    return rows


def _whole(vector: str):
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def learn(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks, an array of (part, entry, place); None if no vector can be learnt from.

    Entries begin as the parts of the vectors with the least keys (null ones last, equal keys by vector)."""
    fine = vectors.where(_whole(vector)).select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__vector"))
    fits = fine.where((F.size("__vector") > 0) & (F.size("__vector") % PARTS == 0))
    order = [F.asc_nulls_last("__key"), "__vector"]
    first = fits.orderBy(*order).first()
    if first is None:
        return None
    dim = len(first["__vector"])
    usable = _usable(fine, dim)
    seeds = [r["__vector"] for r in usable.orderBy(*order).limit(entries).collect()]  # ``entries`` rows at most
    if not seeds:
        return None
    x = np.floor(np.array(seeds, np.float64) * STEPS).astype(np.int64)
    books = np.stack(np.split(x, PARTS, axis=1))
    for _ in range(rounds):
        sums = usable.select("__vector").mapInArrow(lean(_sum_parts(books)), SUMS)
        added = sums.select("part", "entry", F.posexplode("sums").alias("place", "s")).groupBy("part", "entry", "place").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), object)
        for r in added.collect():  # one row a number of the codebooks
            total[r["part"], r["entry"], r["place"]] = int(r["s"])
        for part, entry in zip(*np.nonzero(total[:, :, 0])):
            count, *s = total[part, entry]
            books[part, entry] = [v // count for v in s]
    return books


def _usable(rows: DataFrame, dim: int) -> DataFrame:
    return rows.where(_comparable(dim))


def _comparable(dim: int):
    most = largest(dim) / STEPS
    return (F.size("__vector") == dim) & F.forall("__vector", lambda x: F.abs(x) < most)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, books: np.ndarray | None, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is whole, their columns without the vector, with ``code`` (two hex digits a part) and ``error``
    (squared distances to the entries, summed over parts).

    Rows whose vector is null or holds a null or a number that isn't finite go. A vector of another length than the
    codebooks', or with a component too large for 64-bit sums (``largest``), can't be compared: it stays, with null code and error.
    Repeated rows and keys stay rows of their own; an empty table stays empty. A column named code or error is replaced.
    """
    others = [c for c in vectors.columns if c.lower() not in ("code", "error", vector.lower())]
    row = unused(vectors, "row")
    kept = vectors.where(_whole(vector)).select(F.struct(*others).alias(row), F.col(vector).cast("array<double>").alias("__vector"))
    none = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")]
    if books is None:
        return kept.select(f"{row}.*", *none)
    dim = books.shape[0] * books.shape[2]
    able = kept.where(_comparable(dim))
    schema = able.select(row, F.lit(None).cast("string").alias("__code"), F.lit(None).cast("bigint").alias("__error")).schema
    coded = able.mapInArrow(lean(_encode(books)), schema)
    rest = kept.where(~F.coalesce(_comparable(dim), F.lit(False)))
    return coded.select(f"{row}.*", F.col("__code").alias("code"), F.col("__error").alias("error")).unionByName(rest.select(f"{row}.*", *none))


def op13_vector_codes(spark, sf_dir):
    """vec_id, code, error, the error summed over rows of one label (nulls together), and the codebooks' digest."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = learn(vectors)
    coded = materialize(compress(vectors, books), "vector-codes")
    by_label = materialize(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("bigint").alias("label_error")), "vector-labels")
    labels = by_label.select(F.col("label").alias("own"), "label_error")
    joined = coded.join(small_side(labels, labels.count(), 24), F.col("label").eqNullSafe(F.col("own")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books) if books is not None else None).alias("codebooks_sha256"))


#: Parts and entries are numbered from 0; lists are subscripted from 1.
def _rounds_sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS (SELECT vec_id, label, p, v, e, d FROM (
  SELECT x.vec_id, x.label, x.p, x.v, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
    row_number() OVER (PARTITION BY x.vec_id, x.p ORDER BY list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e) AS r
  FROM parts x JOIN book{k} b USING (p)) WHERE r = 1)""")
        if k < ROUNDS:
            steps.append(f"""mean{k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (
  SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (p, e))""")
    return ",\n".join(steps)


OP13_SQL = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {STEPS}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS v FROM (SELECT *, unnest(range({PARTS})) AS p FROM kept)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
book0 AS (SELECT p, e, v FROM parts JOIN seeds USING (vec_id)),
{_rounds_sql()},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(v, ',') AS x FROM book{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""
