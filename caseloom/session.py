"""SparkSession settings that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "caseloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A UTC, adaptive session.

    ``master`` is only set where the caller runs locally (tests, bench); on a
    cluster the submit command decides it, and the shuffle width with it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("CASELOOM_DRIVER_MEMORY", "8g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
