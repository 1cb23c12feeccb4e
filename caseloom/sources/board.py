"""The board: an index and one JSON file a case, which appear together or not at all.

A data source that Spark writes to. Tasks write files of a new version, each under a name of its own and then renamed; the driver's commit
writes the version's index and last the pointer ``current``, one small file, by which readers find the version. A job that fails, or a driver that is lost, leaves the
pointer where it was: the old board stays readable as a whole. No row passes through the driver: the index is a list of part files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .places import written

FORMAT = 1


def _fs(path: str):
    """File system and path of any URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(files, path: str, text: str) -> None:
    """Write a whole file: under another name first, so that nobody sees a part of it."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        out.write(text.encode())
    files.move(part, path)


def _get(files, path: str) -> str:
    with files.open_input_stream(path) as f:
        return f.read().decode()


def _current(files, top: str) -> str | None:
    from pyarrow.fs import FileType

    return _get(files, f"{top}/current") if files.get_file_info(f"{top}/current").type == FileType.File else None


@dataclass
class _Written(WriterCommitMessage):
    part: str | None
    cases: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, stamp: str):
        self.path, self.stamp, self.version = path.rstrip("/"), stamp, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, top = _fs(self.path)
        top = f"{top}/versions/{self.version}"
        files.create_dir(f"{top}/cases", recursive=True)
        files.create_dir(f"{top}/index", recursive=True)
        lines = []
        for row in iterator:
            if not row["case_number"] or "/" in row["case_number"]:
                raise ValueError(f"not a case number: {row['case_number']!r}")
            _put(files, f"{top}/cases/{row['case_number']}.json", row["body"])
            lines.append(row["entry"])
        if not lines:
            return _Written(None, 0)
        part = f"{uuid.uuid4().hex}.jsonl"
        _put(files, f"{top}/index/{part}", "".join(f"{x}\n" for x in lines))
        return _Written(part, len(lines))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, top = _fs(self.path)
        done = [m for m in messages if m is not None]
        index = {"format": FORMAT, "stamp": json.loads(self.stamp), "cases": sum(m.cases for m in done), "parts": sorted(m.part for m in done if m.part)}
        files.create_dir(f"{top}/versions/{self.version}", recursive=True)
        _put(files, f"{top}/versions/{self.version}/index.json", json.dumps(index, sort_keys=True))
        before = _current(files, top)
        _put(files, f"{top}/current", self.version)  # the commit point
        # The version before stays for those who are reading it; older ones, and what failed jobs left, go. One writer at a time.
        from pyarrow.fs import FileSelector

        for old in files.get_file_info(FileSelector(f"{top}/versions")):
            if old.base_name not in (self.version, before):
                files.delete_dir(old.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, top = _fs(self.path)
        from pyarrow.fs import FileType

        place = f"{top}/versions/{self.version}"
        if files.get_file_info(place).type == FileType.Directory:
            files.delete_dir(place)


class Board(DataSource):
    """Rows of (case_number, entry, body), the last two JSON texts; options: path, stamp (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "caseloom_board"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("stamp", "{}"))


def export(board: DataFrame, path: str, stamp: dict | None = None) -> None:
    """Write ``board`` (case_number, entry, body) as the new version of the board at ``path``. A case number twice is an error."""
    board.sparkSession.dataSource.register(Board)
    board = written(board.select("case_number", "entry", "body"), "board-rows")  # read twice, made once
    twice = board.groupBy("case_number").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two rows of case {twice[0][0]}")
    board.write.format("caseloom_board").option("path", path).option("stamp", json.dumps(stamp or {})).mode("append").save()


def index(path: str) -> dict | None:
    """The index of the current version, None before the first."""
    files, top = _fs(path.rstrip("/"))
    version = _current(files, top)
    if version is None:
        return None
    return json.loads(_get(files, f"{top}/versions/{version}/index.json")) | {"version": version}


def entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The index's entries, by the part files that the current version names."""
    own = index(path)
    if own is None or not own["parts"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path.rstrip('/')}/versions/{own['version']}/index/{p}" for p in own["parts"]])


def bodies(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The files of the current version's cases."""
    own = index(path)
    if own is None or not own["cases"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path.rstrip('/')}/versions/{own['version']}/cases")
