"""Transactional sink of training files: parts are staged by tasks and become an upload in the commit."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from rolloom.functions.variant import is_blank, strip
from rolloom.operators.validation import record_format
from rolloom.sources.jsonl import file_catalog

METADATA = "metadata.json"
_WRITE_BYTES = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its place in the order, the staged file (none without lines) and the format of its first recognisable line."""

    number: int
    staged: str | None
    lines: int
    format: str | None


class TrainingFileWriter(DataSourceWriter):
    """Tasks write below a staging folder of this job; only the commit makes an upload of it.

    The commit moves the files of its messages into place, in the order of the tasks, and writes the metadata file last: a
    catalog never sees an upload without all of its data. Files of lost or repeated attempts are in no message and go with the
    staging folder. An abort removes that folder and leaves nothing.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        self.metadata = json.loads(options.get("metadata", "{}"))

    def write(self, iterator: Iterator[Row]) -> Part:
        system, staging = pyarrow.fs.FileSystem.from_uri(self.staging)
        number, lines, found, out, held, size = TaskContext.get().partitionId(), 0, None, None, [], 0
        path = f"{staging}/{number:08d}-{uuid.uuid4().hex}"
        for value, kind in iterator:
            if value is not None and "\n" in value:
                raise ValueError("a record holds a line end")
            if out is None:
                system.create_dir(staging, recursive=True)
                out = system.open_output_stream(path)
            line = (value or "").encode() + b"\n"
            held.append(line)
            size += len(line)
            lines += 1
            found = found or kind
            if size >= _WRITE_BYTES:
                out.write(b"".join(held))
                held, size = [], 0
        if out is not None:
            out.write(b"".join(held))
            out.close()
        return Part(number, path if out is not None else None, lines, found)

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{folder}/{METADATA}").type != pyarrow.fs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{self.path} is an upload already")
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        staged = [p.staged for p in parts if p.staged]
        system.create_dir(folder, recursive=True)
        names = [f"data-{at:05d}.jsonl" for at in range(max(len(staged), 1))]
        for source, name in zip(staged, names):
            system.move(source, f"{folder}/{name}")
        if not staged:
            system.open_output_stream(f"{folder}/{names[0]}").close()
        kinds = [p.format for p in parts if p.format]
        made = {"purpose": "training", "created_at": int(time.time()), "format": kinds[0] if kinds else "unknown"}
        made |= self.metadata | {"parts": len(names), "lines": sum(p.lines for p in parts)}
        temporary = f"{folder}/_{METADATA}-{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            out.write(json.dumps(made).encode())
        system.move(temporary, f"{folder}/{METADATA}")
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, staging = pyarrow.fs.FileSystem.from_uri(self.staging)
        if system.get_file_info(staging).type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(staging)


class TrainingFiles(DataSource):
    """``df.write.format("training_file")`` of (value, format) rows."""

    @classmethod
    def name(cls) -> str:
        return "training_file"

    def schema(self) -> str:
        return "value string, format string"

    def writer(self, schema, overwrite: bool) -> TrainingFileWriter:
        return TrainingFileWriter(dict(self.options))


def write_training_file(
    records: DataFrame,
    uploads_dir: str,
    filename: str | None = None,
    created_at: int | None = None,
    record: Column | str = "record",
    order_by: list[str] | None = None,
    upload: str | None = None,
) -> DataFrame:
    """Write ``record`` (JSON text) as the upload ``uploads_dir/<upload>``; returns its catalog row.

    One data file per partition, sorted by range when ``order_by`` is given, and ``metadata.json``: purpose, time (now unless
    given), name, and the format of the first recognisable line, which the tasks noticed while they wrote. The data
    is written once and not read again. A null record is a blank line. Nothing remains of a write that failed.
    """
    spark: SparkSession = records.sparkSession
    upload = upload or f"file-{uuid.uuid4()}"
    value = F.col(record) if isinstance(record, str) else record
    if order_by:
        records = records.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    parsed = F.when(~is_blank(value), F.try_parse_json(strip(value)))
    rows = records.select(value.alias("value"), F.nullif(record_format(parsed), F.lit("unknown")).alias("format"))
    given = {k: v for k, v in (("filename", filename), ("created_at", created_at)) if v is not None}
    spark.dataSource.register(TrainingFiles)
    path = f"{uploads_dir.rstrip('/')}/{upload}"
    rows.write.format("training_file").option("metadata", json.dumps(given)).mode("append").save(path)
    return file_catalog(spark, uploads_dir, upload=upload)
