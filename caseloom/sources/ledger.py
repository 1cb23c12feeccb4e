"""The hash ledger: an append-only record of manifests' digests.

A manifest that is new, or whose digest differs from its last line, gets a line; earlier lines stay, so that a rewritten manifest
shows. Each append is one batch with a seal, a sum over its lines' digests and the seal before: a line changed, added or taken away later is found, and so is a batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line: the batch that appended it, the manifest's key, digest and size, and when.
LINE = "batch bigint, key string, sha256 string, size bigint, appended_at string"
SEAL = "batch bigint, lines bigint, mix bigint, before string, seal string"


def _number(digest: Column) -> Column:
    """60 bits of a digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _own() -> Column:
    """The digest of a line."""
    return F.sha2(F.concat_ws("\n", F.col("batch").cast("string"), "key", "sha256", F.col("size").cast("string"), "appended_at"), 256)


def _seal(batch: Column, lines: Column, mix: Column, before: Column) -> Column:
    return F.sha2(F.concat_ws("\n", batch.cast("string"), lines.cast("string"), mix.cast("string"), before), 256)


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).json(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def seals(self) -> DataFrame:
        return self._read("seals", SEAL)

    def lines(self) -> DataFrame:
        """The lines of sealed batches; what an append left that broke off isn't among them."""
        return self._read("lines", LINE).join(F.broadcast(self.seals().select("batch")), "batch", "left_semi").select(*(c.split()[0] for c in LINE.split(", ")))

    def latest(self) -> DataFrame:
        """The last line of each key."""
        return self.lines().groupBy("key").agg(F.max_by(F.struct("batch", "key", "sha256", "size", "appended_at"), "batch").alias("line")).select("line.*")

    def new_lines(self, manifests: DataFrame, at: str) -> DataFrame:
        """Lines of the manifests (key, body) that aren't in the ledger or differ from their last line."""
        now = manifests.select("key", F.sha2("body", 256).alias("sha256"), F.octet_length("body").cast("bigint").alias("size"))
        last = self.latest().select("key", F.col("sha256").alias("known"))
        return now.join(last, "key", "left").where(~F.col("sha256").eqNullSafe(F.col("known"))).select("key", "sha256", "size", F.lit(at).alias("appended_at"))

    def append(self, manifests: DataFrame, at: str) -> int:
        """Append new_lines as one batch and return how many there were. One writer at a time.

        Lines are written first, into the batch's own folder, and count once the seal is there: an append that broke off is written over."""
        last = self.seals().orderBy(F.desc("batch")).first()
        batch, before = (last["batch"] + 1, last["seal"]) if last else (1, "")
        place = f"{self.folder}/lines/part={batch}"
        self.new_lines(manifests, at).withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").json(place)
        sums = self._sums(self.spark.read.schema(LINE).json(place)).first()
        if sums is None:
            return 0
        row = self.spark.createDataFrame([(batch, sums["lines"], sums["mix"], before)], "batch bigint, lines bigint, mix bigint, before string")
        sealed = row.withColumn("seal", _seal(F.col("batch"), F.col("lines"), F.col("mix"), F.col("before")))
        sealed.coalesce(1).write.mode("append").json(f"{self.folder}/seals")
        return sums["lines"]

    @staticmethod
    def _sums(lines: DataFrame) -> DataFrame:
        return lines.groupBy("batch").agg(F.count(F.lit(1)).alias("lines"), F.bit_xor(_number(_own())).alias("mix"))

    def problems(self, manifests: DataFrame) -> DataFrame:
        """(batch, key, problem), by batch and key: the first row is the first bad line. Batches whose lines or seal aren't those that were
        written come under a null key; manifests (key, body) that are missing or differ from their last line under their own."""
        sums = self._sums(self._read("lines", LINE)).withColumnRenamed("lines", "n").withColumnRenamed("mix", "own")
        seals = self.seals()
        before = seals.select((F.col("batch") + 1).alias("batch"), F.col("seal").alias("last"))
        held = seals.join(sums, "batch", "left").join(before, "batch", "left")
        broken = (
            F.when(F.col("n").isNull() | (F.col("n") != F.col("lines")) | (F.col("own") != F.col("mix")), "its lines aren't those that were sealed")
            .when(_seal(F.col("batch"), F.col("lines"), F.col("mix"), F.col("before")) != F.col("seal"), "its seal was changed")
            .when(F.col("before") != F.coalesce("last", F.lit("")), "the batch before it isn't the one that was sealed")
        )
        chain = held.select("batch", F.lit(None).cast("string").alias("key"), broken.alias("problem"))
        now = manifests.select("key", F.sha2("body", 256).alias("now"))
        state = F.when(F.col("now").isNull(), "manifest is missing").when(F.col("now") != F.col("sha256"), "manifest differs from the ledger")
        files = self.latest().join(now, "key", "left").select("batch", "key", state.alias("problem"))
        return chain.unionByName(files).where(F.col("problem").isNotNull()).orderBy("batch", F.asc_nulls_first("key"))
