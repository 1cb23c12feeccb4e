"""Which paths dynamic records have, however deep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.sources.places import written

_BOX = "^(OBJECT|ARRAY)"


def _opened(rows: DataFrame) -> DataFrame:
    """(path, value) with each object and array replaced by what it holds; other values stay. Empty ones hold nothing."""
    # What holds nothing is a plain value or an empty box: only there is the kind asked for, which elsewhere reads the whole value.
    return rows.sparkSession.sql(
        f"""SELECT CASE WHEN e.value IS NULL THEN path WHEN e.key IS NULL THEN path || '[]' WHEN path = '' THEN e.key ELSE path || '.' || e.key END AS path,
          coalesce(e.value, f.value) AS value
        FROM {{rows}} AS f, LATERAL variant_explode_outer(f.value) AS e WHERE e.value IS NOT NULL OR NOT schema_of_variant(f.value) RLIKE '{_BOX}'""",
        rows=rows,
    )


def leaf_paths(records: DataFrame, column: str, levels: int = 8) -> DataFrame:
    """(path, n, kinds) of the leaves of a VARIANT column: how often each path ends in a value that is no object or array, and the kinds of
    these values in order. Steps into arrays are written ``[]``; a JSON null is a leaf of kind VOID; a record that is no object has the empty path.

    All levels are opened in one pass over the records, whose counts, a row a path, are written. If a box was left unopened
    after ``levels`` levels, twice as many are opened, and so on, so that any depth costs a few passes and most cost one."""
    records = records.select(F.lit("").alias("path"), F.col(column).alias("value")).where(F.col("value").isNotNull())
    kind = F.regexp_extract("schema", "^[A-Z]+", 0)
    while True:
        rows = records
        for _ in range(levels):
            rows = _opened(rows)
        rows = rows.select("path", F.schema_of_variant("value").alias("schema"))
        found = written(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(kind)).alias("kinds"), F.count_if(F.col("schema").rlike(_BOX)).alias("boxes")), "census")
        if found.where("boxes > 0").isEmpty():
            return found.drop("boxes")
        levels *= 2
