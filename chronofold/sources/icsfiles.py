"""A data source that writes one calendar file for each row.

Tasks write below a folder of the write's own beside the target; the commit moves that folder to the target in one step, so readers see all
files or none. A failed or repeated task leaves nothing and overwrites nothing: a file gets its name only when it is complete, and equal rows give equal files. Paths are
those of pyarrow's file systems (a plain path, ``hdfs://``, ``s3://``, ...).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NO_EVENTS, ICS_FAILED = "NO_EVENTS", "ICS_FAILED"


class ExportError(ValueError):
    """Nothing was exported; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Written(WriterCommitMessage):
    files: int


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class CalendarWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.stage = path.rstrip("/"), f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        system, stage = _file_system(self.stage)
        system.create_dir(stage)

    def write(self, iterator: Iterator) -> Written:
        system, stage = _file_system(self.stage)  # made by the driver only: a task that outlives an abort finds no folder and makes none
        n = 0
        for name, text in iterator:
            target = f"{stage}/{quote(str(name), safe='')}.ics"
            part = f"{target}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write((text or "").encode())
            system.move(part, target)
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        system, stage = _file_system(self.stage)
        target = _file_system(self.path)[1]
        system.create_dir(stage)
        system.move(stage, target)

    def abort(self, messages: list[Written | None]) -> None:
        system, stage = _file_system(self.stage)
        if system.get_file_info(stage).type.name == "Directory":
            system.move(stage, f"{stage}.aborted")  # tasks that still run can add nothing to it
            system.delete_dir(f"{stage}.aborted")


class CalendarFiles(DataSource):
    """``df.write.format("calendars").mode("append").save(path)`` for (name, text) rows."""

    @classmethod
    def name(cls) -> str:
        return "calendars"

    def writer(self, schema: StructType, overwrite: bool) -> CalendarWriter:
        return CalendarWriter(self.options["path"])


def export_calendars(calendars: DataFrame, path: str, name: str = "calendar", text: str = "ics") -> None:
    """A file ``<name>.ics`` (the name percent-encoded) for each row in a new folder ``path``.

    ExportError: ``NO_EVENTS`` for no rows; ``ICS_FAILED`` where two rows share a name, a name is null, the folder exists, or a task fails for good. Then nothing is left.
    """
    spark = calendars.sparkSession
    rows = calendars.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    if rows.isEmpty():
        raise ExportError(NO_EVENTS, "no events to export")
    if not rows.groupBy("name").count().where("name is null or count > 1").isEmpty():
        raise ExportError(ICS_FAILED, "names must be there and differ")
    system, target = _file_system(path)
    if system.get_file_info(target.rstrip("/")).type.name != "NotFound":
        raise ExportError(ICS_FAILED, f"{path} exists")
    spark.dataSource.register(CalendarFiles)
    try:
        rows.write.format("calendars").mode("append").save(path)
    except PySparkException as e:
        raise ExportError(ICS_FAILED, str(e)) from e
