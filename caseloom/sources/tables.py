"""Reading tables: Parquet folders, guarded JSON lines, code dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters of a query reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class DamagedInput(ValueError):
    """An input that must not be read in part."""


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed schema. A line that isn't such a record fails the read,
    and the message names it: damaged input is refused, never filtered."""
    rows = spark.read.schema(f"{schema}, _damaged string").option("columnNameOfCorruptRecord", "_damaged").json(path)
    # A corrupt-record column alone can't be asked for: the whole row is parsed once.
    bad = rows.where(F.col("_damaged").isNotNull()).select("_damaged", *rows.columns[:-1]).limit(3).collect()
    if bad:
        raise DamagedInput("; ".join(r["_damaged"][:120] for r in bad))
    return rows.drop("_damaged")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overlay(base: DataFrame, supplement: DataFrame, key: str = "code", value: str = "label") -> DataFrame:
    """A dimension with a supplement laid over it: the supplement's value wins."""
    s = supplement.select(key, F.col(value).alias("__over"))
    return base.select(key, value).join(s, key, "full_outer").select(key, F.coalesce("__over", value).alias(value))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("code string, label string").option("header", "true").csv(path)


def newest_lines(manifest: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The newest line of each key of an append-only manifest; of equal times the first line."""
    rank = F.struct(F.col(order), -F.col(tie))
    picked = manifest.groupBy(key).agg(F.max_by(F.struct(*manifest.columns), rank).alias("row"))
    return picked.select("row.*")
