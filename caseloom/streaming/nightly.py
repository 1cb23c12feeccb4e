"""The nightly run as a micro-batch stream with exactly-once state.

New files are taken with the AvailableNow trigger. Each batch is folded to the latest row of a
key and overwrites one partition (stream, batch) of a Parquet table, so that a batch which Spark
replays after a lost driver writes the same partition again; reading folds the batches to
the latest row of a key. A stream is known by the identifier that Spark keeps in its checkpoint: another one, or a checkpoint made anew at the
same path, has partitions of its own.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.sources.places import stream_id

SCHEMA = "user_id bigint, event_id bigint, ts timestamp_ntz, status string, value double, n bigint"


def latest(events: DataFrame) -> DataFrame:
    """The latest event of each key, by event_id, and how many there were."""
    pick = lambda c: F.max_by(c, "event_id")
    return events.groupBy("user_id").agg(F.max("event_id").alias("event_id"), pick("ts").alias("ts"), pick("event_type").alias("status"), pick("value").alias("value"), F.count(F.lit(1)).alias("n"))


class Store:
    """A table of the latest row of each key, held as one partition a batch."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def batches(self, spark: SparkSession) -> DataFrame:
        """All batches' rows, with their stream and batch."""
        try:
            return spark.read.schema(f"{SCHEMA}, stream string, batch bigint").parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"{SCHEMA}, stream string, batch bigint")

    def read(self, spark: SparkSession) -> DataFrame:
        pick = lambda c: F.max_by(c, "event_id").alias(c)
        folded = self.batches(spark).groupBy("user_id").agg(F.max("event_id").alias("__e"), pick("ts"), pick("status"), pick("value"), F.sum("n").alias("n"))
        return folded.withColumnRenamed("__e", "event_id").select(*(c.split()[0] for c in SCHEMA.split(", ")))

    def upsert(self, batch: DataFrame, batch_id: int, stream: str) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/stream={stream}/batch={batch_id}")


def run(spark: SparkSession, source: str, schema: T.StructType, store: Store, checkpoint: str, files_per_batch: int = 100) -> None:
    """Fold everything that is new under ``source`` into the store and return."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: store.upsert(latest(df), k, stream_id(spark, checkpoint))).start()
    query.awaitTermination()


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each key with their event counts; works on a stream and on a table.

    State of a session is dropped once the watermark has passed it."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
