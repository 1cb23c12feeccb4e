"""The raw store (a folder of JSON pages a month) and the processed table built from it.

A month is fetched as a whole under a folder of its own name and becomes visible with one line of the manifest, written last: the
commit point. Readers take each month's newest line and nothing else, so that a fetch which broke off is never seen, and one that is repeated
replaces the month. The line holds every page's digest; a page that is missing, changed or no such JSON stops the job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import newest_lines

#: One line a fetch. ``fetch`` names the folder, ``place`` is the line's position in the manifest.
MANIFEST = "month string, fetched_at string, fetch string, records bigint, pages array<struct<file string, sha256 string, records bigint>>"


class Refused(ValueError):
    """Cases that may not be read by this job."""


def _file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def _else_stop(fine: Column, value: Column, *why: Column | str) -> Column:
    """``value``, or an error that says why: rows aren't left out."""
    said = F.concat(*(w if isinstance(w, Column) else F.lit(w) for w in why))
    return F.when(fine, value).otherwise(F.raise_error(said))


def raw_records(spark: SparkSession, folder: str, record: str, months: Iterable[str] | None = None) -> DataFrame:
    """The records of the pages under ``folder/month=YYYY-MM``: month, page (file name), place and the fields of
    ``record`` (a struct schema). Months left out are pruned by their folder's name: none of their files is opened. A page
    that isn't whole JSON, or whose records aren't such structs, fails the job by its name; a page without data has no records, and what isn't a record
    in a page's data is skipped."""
    pages = spark.read.schema(f"data array<struct<{record}>>, _damaged string, month string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_damaged").json(folder)
    if months is not None:
        pages = pages.where(F.col("month").isin(list(months)))
    return _records(pages.select("month", _file_name().alias("page"), _else_stop(F.col("_damaged").isNull(), F.col("data"), "damaged page ", F.col("month"), "/", _file_name()).alias("data")))


def _records(pages: DataFrame) -> DataFrame:
    each = pages.select("month", "page", F.posexplode("data").alias("place", "record"))
    return each.where("record is not null").select("month", "page", "place", "record.*")


class RawStore:
    """Months of pages with a manifest, all in one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> DataFrame:
        """All lines, as they were appended: every one is a small file of its own that Spark commits whole."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def latest(self) -> DataFrame:
        """The newest line of each month; of equal times the one whose folder's name is least."""
        return newest_lines(self.manifest().withColumn("tie", F.xxhash64("fetch")), "month", "fetched_at", "tie").drop("tie")

    def missing(self, months: DataFrame) -> DataFrame:
        """Those of ``months`` (month) that no fetch committed."""
        return months.join(self.manifest().select("month"), "month", "left_anti")

    def add(self, pages: DataFrame, fetched_at: str, refresh: bool = False) -> int:
        """Take up ``pages`` (month, page, content: a page's JSON text): months that the manifest doesn't have, or all with ``refresh``. Returns
        how many were committed. Pages are written first, under a new name; then one append of the manifest makes all their
        months visible together. A job that dies in between leaves nothing that is read."""
        wanted = pages if refresh else pages.join(self.manifest().select("month").distinct(), "month", "left_anti")
        fetch = uuid.uuid4().hex
        place = f"{self.folder}/pages/fetch={fetch}"
        wanted.select("month", "page", "content").write.partitionBy("month").parquet(place)
        try:
            written = self.spark.read.schema("page string, content string, month string").parquet(place)
            page = F.struct(F.col("page").alias("file"), F.sha2("content", 256).alias("sha256"), F.coalesce(F.expr("json_array_length(get_json_object(content, '$.data'))"), F.lit(0)).cast("bigint").alias("records"))
            lines = written.groupBy("month").agg(F.sort_array(F.collect_list(page)).alias("pages"))
            lines = lines.select("month", F.lit(fetched_at).alias("fetched_at"), F.lit(fetch).alias("fetch"), F.aggregate("pages", F.lit(0).cast("bigint"), lambda n, p: n + p["records"]).alias("records"), "pages")
            lines.write.mode("append").json(f"{self.folder}/manifest")
            return lines.count()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return 0  # nothing was wanted

    def records(self, record: str, months: Iterable[str] | None = None, verify: bool = True) -> DataFrame:
        """The records of the latest fetch of each month: month, page, place and the fields of ``record``.

        Folders of fetches and months that aren't wanted are pruned before a file is opened. With ``verify`` a page whose digest isn't the manifest's, which
        the manifest doesn't know or which is missing, fails the job; a page that isn't JSON does in any case."""
        own = self.latest().select("month", "fetch", "pages")
        if months is not None:
            own = own.where(F.col("month").isin(list(months)))
        listed = own.select("month", "fetch", F.explode_outer("pages").alias("p")).select("month", "fetch", F.col("p.file").alias("page"), F.col("p.sha256").alias("sha256")).where("page is not null")
        fetches = [r[0] for r in own.select("fetch").distinct().collect()]  # the committed fetches that are newest for a month
        schema = "page string, content string, fetch string, month string"
        held = self.spark.read.schema(schema).option("basePath", f"{self.folder}/pages").parquet(*[f"{self.folder}/pages/fetch={f}" for f in fetches]) if fetches else self.spark.createDataFrame([], schema)
        if months is not None:
            held = held.where(F.col("month").isin(list(months)))
        # A month may have been fetched again later: only its newest fetch counts.
        held = held.join(own.select("month", "fetch"), ["month", "fetch"], "left_semi")
        both = held.withColumn("there", F.lit(True)).join(listed.withColumn("known", F.lit(True)), ["month", "fetch", "page"], "full_outer" if verify else "left")
        fine = F.col("there") & (F.col("known") & (F.sha2("content", 256) == F.col("sha256"))) if verify else F.col("there")
        why = F.when(F.col("there").isNull(), "missing").when(F.col("known").isNull(), "not in the manifest").otherwise("changed")
        name = F.concat("month", F.lit("/"), "page")
        content = _else_stop(F.coalesce(fine, F.lit(False)), F.col("content"), "page ", name, ": ", why)
        parsed = F.from_json("content", f"data array<struct<{record}>>, _damaged string", {"columnNameOfCorruptRecord": "_damaged"})
        pages = both.select("month", "page", content.alias("content")).withColumn("parsed", parsed)
        whole = F.col("parsed").isNotNull() & F.col("parsed._damaged").isNull()
        return _records(pages.select("month", "page", _else_stop(whole, F.col("parsed.data"), "damaged page ", name).alias("data")))


def newest(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest copy of each key: the greatest of ``order``, by one aggregate combined before the shuffle. Null keys go."""
    rows = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*records.columns), F.struct(*order)).alias("row"))
    return rows.select("row.*")


def build(records: DataFrame, key: str, order: list[str], reasons: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """The processed rows and the counts (reason, n) of what isn't among them.

    Of each key the newest copy counts. ``reasons`` is a ladder of (reason, condition): the first that holds excludes a row. Older copies are counted as
    duplicates, rows without a key as such."""
    ladder = F.lit(None).cast("string")
    for reason, holds in reversed(reasons):
        ladder = F.when(holds, reason).otherwise(ladder)
    judged = newest(records, key, order).withColumn("__reason", ladder)
    total = records.agg(F.count(F.lit(1)).alias("all"), F.count(key).alias("keyed"), F.countDistinct(key).alias("keys"))
    others = total.select(F.explode(F.array(F.struct(F.lit("no key").alias("reason"), (F.col("all") - F.col("keyed")).alias("n")), F.struct(F.lit("older copy").alias("reason"), (F.col("keyed") - F.col("keys")).alias("n")))).alias("x")).select("x.*")
    counted = judged.where(F.col("__reason").isNotNull()).groupBy(F.col("__reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return judged.where(F.col("__reason").isNull()).drop("__reason"), counted.unionByName(others.where("n > 0"))


def write_processed(kept: DataFrame, excluded: DataFrame, path: str, by: str = "split") -> dict:
    """Write the kept rows as zstd Parquet with their counts as JSON beside them: rows, rows by split, and the
    (reason, n) rows of ``excluded``. Keys of the counts are strings; a null split or reason is counted as "null"."""
    spark = kept.sparkSession
    kept.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/cases.parquet")
    name = lambda v: "null" if v is None else str(v)
    counts = {name(r[by]): r["count"] for r in spark.read.parquet(f"{path}/cases.parquet").groupBy(F.col(by).cast("string").alias(by)).count().collect()}  # one row a split
    reasons: dict[str, int] = {}
    for r in excluded.collect():  # one row a reason
        reasons[name(r["reason"])] = reasons.get(name(r["reason"]), 0) + r["n"]
    meta = {"rows": sum(counts.values()), "counts_by_split": counts, "excluded": reasons}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/cases.meta.json")
    return meta


def fence(wanted: DataFrame, withheld: DataFrame, key: str, why: str) -> DataFrame:
    """``wanted`` if none of its keys is withheld (sealed, held out or live); else Refused, before a case is read."""
    found = [r[0] for r in wanted.select(key).join(withheld.select(key), key, "left_semi").limit(3).collect()]
    if found:
        raise Refused(f"{why}: {', '.join(map(str, found))}")
    return wanted


def load_cases(wanted: DataFrame, cases: DataFrame, key: str, place: str) -> DataFrame:
    """The rows of ``cases`` for the keys of ``wanted`` (key, place), with their places; a wanted key that no case has is refused before a case is read."""
    lost = [r[0] for r in wanted.join(cases.select(key), key, "left_anti").orderBy(place).select(key).limit(3).collect()]
    if lost:
        raise Refused(f"no such case: {', '.join(map(str, lost))}")
    return wanted.select(key, place).join(cases, key)


def refuse_dangling(rows: DataFrame, known: DataFrame, key: str, what: str) -> DataFrame:
    """``rows``, if each has its key in ``known``; else Refused: rows that point nowhere aren't dropped by a join."""
    lost = [r[0] for r in rows.join(known.select(key), key, "left_anti").select(key).limit(3).collect()]
    if lost:
        raise Refused(f"{what} without a case: {', '.join(map(str, lost))}")
    return rows
