"""Where driver and executors may both write."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder under spark.checkpoint.dir; only a local session without that setting (a test) gets one of its own machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-caseloom-", dir="/tmp")
        top = _own[app]
    return f"{top.rstrip('/')}/{name}"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identifier that Spark gave the stream of a checkpoint; a checkpoint made anew at the same path has another one."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def written(df, name: str):
    """``df`` as a Parquet table in the shared folder: later steps read files that outlive any executor, and no lineage grows."""
    path = shared_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
