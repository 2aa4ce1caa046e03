"""Text tables as single named files: tasks write parts, the commit joins them in order, an abort leaves nothing."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .ranged import system_of

COPY_BYTES = 1 << 22


@dataclass
class _Written(WriterCommitMessage):
    number: int
    path: str
    rows: int


class OneFileWriter(DataSourceArrowWriter):
    """Lines of one column into one file. The head comes first, then the lines of the partitions by their numbers.

    With gzip each part is a member of its own, which together are one file. digest names a JSON file for rows, bytes and
    SHA-256 of the whole.
    """

    def __init__(self, options: dict):
        self.path, self.head = options["path"], options.get("head", "")
        self.gzip = options.get("compression", "none") == "gzip"
        self.digest = options.get("digest")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex[:12]}"
        system, folder = system_of(self.parts)
        system.create_dir(folder, recursive=True)  # here and not by tasks, of which one may outlive an abort

    def _bytes(self, text: str) -> bytes:
        data = text.encode("utf-8", "surrogatepass")
        return gzip.compress(data, mtime=0) if self.gzip and data else data

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        context = TaskContext.get()
        number, rows = context.partitionId(), 0
        system, folder = system_of(self.parts)
        place = f"{folder}/{number:07d}-{context.taskAttemptId()}"  # a task that runs again writes another part
        with system.open_output_stream(place) as out:
            for batch in iterator:
                lines = batch.column(0).to_pylist()
                rows += len(lines)
                out.write(self._bytes("".join(f"{line}\n" for line in lines)))
        return _Written(number, place, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = system_of(self.path)
        _, folder = system_of(self.parts)
        hashed, size, whole = hashlib.sha256(), 0, f"{folder}/whole"
        with system.open_output_stream(whole) as out:

            def put(data: bytes) -> None:
                nonlocal size
                hashed.update(data)
                size += len(data)
                out.write(data)

            put(self._bytes(self.head))
            for part in sorted((m for m in messages if m), key=lambda m: m.number):
                with system.open_input_stream(part.path) as source:
                    while data := source.read(COPY_BYTES):
                        put(data)
        system.move(whole, path)
        if self.digest:
            place, name = system_of(self.digest)
            with place.open_output_stream(name) as out:
                out.write(json.dumps({"rows": sum(m.rows for m in messages if m), "bytes": size, "sha256": hashed.hexdigest()}).encode())
        system.delete_dir(folder)

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = system_of(self.parts)
        if system.get_file_info(folder).type.name == "Directory":
            system.delete_dir(folder)


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "onefile"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> OneFileWriter:
        return OneFileWriter(self.options)


def cell(value: Column, kind: str, nan_text: str | None = None) -> Column:
    """A value as a cell of a text table: lists and structs as JSON, what holds a comma, quote or line break in quotes
    (quotes doubled), nulls empty, or as nan_text in columns of numbers."""
    text = (F.to_json(value) if kind in ("array", "struct", "map") else value).cast("string")
    text = F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.coalesce(text, F.lit(nan_text if nan_text is not None and kind in ("double", "float") else ""))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str | Column] | None = None, compression: str = "none", nan_text: str | None = None, mark: bool = False, digest: str | None = None) -> None:
    """One CSV file with a header, its rows in the given order (of all rows, by range partitions); an existing file is
    replaced when the new one is whole. mark: whether a byte order mark comes first, for readers of spreadsheets.
    Driver and executors must share the file's folder."""
    columns = columns or df.columns
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    rows = df.orderBy(*order) if order else df
    line = F.concat_ws(",", *[cell(F.col(f"`{c}`"), kinds[c], nan_text) for c in columns])
    head = ("\ufeff" if mark else "") + ",".join(columns) + "\n"
    df.sparkSession.dataSource.register(OneFile)
    out = rows.select(line.alias("value")).write.format("onefile").mode("append").options(path=str(path), head=head, compression=compression)
    (out.option("digest", digest) if digest else out).save()


def write_text(path: str, text: str) -> None:
    """A small text file, written on the driver."""
    system, place = system_of(str(path))
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        out.write(text.encode())
