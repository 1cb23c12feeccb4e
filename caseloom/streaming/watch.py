"""Keyed state of the nightly run: each key's status, night by night, with the tail in which it is still watched.

A key that leaves the open status is watched for some more days; returning clears the tail, and nothing else moves
it. State is held by key: the latest night as a value, all nights as a map, and a timer that ends
the tail. Nights may come in any order and in any number of pieces: an observation of an earlier night than the latest (a
month whose fetch had failed) is put in its place, and the key's rows from there on are given again. Nothing is dropped for
being late; there is no watermark. Rows given again replace the earlier ones when the table is read, as they are of a later batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caseloom.sources.places import stream_id

#: Columns of an observation; ``at`` and ``event_id`` tell which of a night's observations is the last.
OBSERVED = "key bigint, run date, at timestamp_ntz, event_id bigint, status string"
#: ``kind`` is seen, or released for the row with which a tail ends; absent_run is the night before on which the key was seen.
ROWS = "key bigint, kind string, run date, status string, old string, absent_run date, watch_until date"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_of_each_night(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last observation of each key and night within a task, so that a key with very many goes to its task as few rows."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) > 200_000:
            yield _last(held)
            held = []
    if held:
        yield _last(held)


def _last(held: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(held).sort_values(["at", "event_id"], kind="stable").drop_duplicates(["key", "run"], keep="last")


def nights(seen: list[tuple[date, str]], before: tuple[date, str, date | None] | None, open_status: str, days: int) -> list[tuple]:
    """(run, status, old, absent_run, watch_until) of each night in order, after the night ``before`` with its tail."""
    absent, old, until = before or (None, None, None)
    out = []
    for run, status in seen:
        if status == open_status:
            until = None
        elif old == open_status:
            until = run + timedelta(days=days)
        out.append((run, status, old, absent, until))
        absent, old = run, status
    return out


def _day(value: Any) -> date | None:
    return None if value is None or pd.isna(value) else pd.Timestamp(value).date()


class Watch(StatefulProcessor):
    def __init__(self, open_status: str, days: int):
        self.open_status, self.days = open_status, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "run date, status string, watch_until date")
        self.seen = handle.getMapState("seen", "run date", "at timestamp_ntz, event_id bigint, status string")

    def _timer(self, was: date | None, until: date | None) -> None:
        for t in list(self.handle.listTimers()) if was is not None else ():  # without a tail there is none
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if until is not None:
            self.handle.registerTimer(int(datetime(until.year, until.month, until.day, tzinfo=UTC).timestamp() * 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new: dict[date, tuple] = {}
        for pdf in rows:
            for run, at, event, status in zip(pdf["run"], pdf["at"], pdf["event_id"], pdf["status"]):
                day, own = _day(run), (pd.Timestamp(at), int(event), status)
                if day not in new or own[:2] > new[day][:2]:
                    new[day] = own
        changed = []
        last = self.latest.get() if self.latest.exists() else None
        before = None if last is None else (_day(last[0]), last[1], _day(last[2]))
        for day, own in new.items():
            if before is not None and day <= before[0] and self.seen.containsKey((day,)):  # each call to the state is a round trip; no night after the latest is known
                at, event, _ = self.seen.getValue((day,))
                if (pd.Timestamp(at), int(event)) >= own[:2]:
                    continue  # seen already, as after a replay
            self.seen.updateValue((day,), (own[0].to_pydatetime(), own[1], own[2]))
            changed.append((day, own[2]))
        if not changed:
            return
        changed.sort()
        if before is None or changed[0][0] > before[0]:
            out = nights(changed, before, self.open_status, self.days)
        else:  # a late night, or a later observation of a known one: the rows from there on are told again
            known = sorted((_day(k[0]), v[2]) for k, v in self.seen.iterator())
            out = [r for r in nights(known, None, self.open_status, self.days) if r[0] >= changed[0][0]]
        end = out[-1]
        self.latest.update((end[0], end[1], end[4]))
        was = before[2] if before else None
        if was != end[4]:
            self._timer(was, end[4])
        yield pd.DataFrame([(key[0], "seen", *r) for r in out], columns=["key", "kind", "run", "status", "old", "absent_run", "watch_until"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        run, status, until = self.latest.get()
        ended = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).date()
        if _day(until) == ended:  # else the tail was cleared or moved meanwhile
            yield pd.DataFrame([(key[0], "released", ended, status, status, _day(run), ended)], columns=["key", "kind", "run", "status", "old", "absent_run", "watch_until"])

    def close(self) -> None:
        pass


class WatchTable:
    """What the stream gave, one Parquet partition a stream and batch: a batch that Spark replays overwrites its own."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, batch: DataFrame, batch_id: int, stream: str) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/stream={stream}/batch={batch_id}")

    def read(self, spark: SparkSession, kind: str = "seen") -> DataFrame:
        """The rows as told last. The table is empty before the first batch."""
        schema = f"{ROWS}, stream string, batch bigint"
        try:
            rows = spark.read.schema(schema).parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], schema)
        names = [c.split()[0] for c in ROWS.split(", ")]
        last = rows.where(F.col("kind") == kind).groupBy("key", "run").agg(F.max_by(F.struct(*names), "batch").alias("row"))
        return last.select("row.*")


def run(spark: SparkSession, observed: DataFrame, table: WatchTable, checkpoint: str, open_status: str, days: int = 30) -> None:
    """Take what is new in the stream ``observed`` (columns OBSERVED) into state and table, and return.

    A checkpoint in a shared folder makes state outlive any machine."""
    # With timers of the clock a stream would run empty batches for ever and AvailableNow never end; tails end with the next night's batch.
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        few = observed.mapInPandas(last_of_each_night, OBSERVED)
        rows = few.groupBy("key").transformWithStateInPandas(Watch(open_status, days), ROWS, "append", "ProcessingTime")
        stream = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        query = stream.foreachBatch(lambda df, k: table.write(df, k, stream_id(spark, checkpoint))).start()
        query.awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
