"""A log of text lines as a data source: every batch of a stream is there once, whatever reruns.

    spark.dataSource.register(LineLog)
    lines.write.format("line_log").mode("append").save(path)            # one column: value
    stream.writeStream.format("line_log").option("path", path)...       # once a micro-batch
    spark.readStream.format("line_log").option("path", path).load()     # by committed batches

Tasks write files of their own name into a staging folder and tell the driver which; only the
driver's commit makes them part of the log, by one rename of the batch's list of files.  The
path is any that pyarrow's file systems reach from driver and executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    """The file a task wrote and its number of lines."""

    file: str
    lines: int


class _Place:
    """The folders of a log: lines/ has the tasks' files, batches/ a list of files a batch."""

    def __init__(self, path: str):
        self.path = path

    def open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def stage(self, lines: list[str]) -> Written:
        store, base = self.open()
        name = f"{uuid.uuid4().hex}.txt"
        store.create_dir(f"{base}/lines", recursive=True)
        with store.open_output_stream(f"{base}/lines/{name}") as out:
            out.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode())
        return Written(name, len(lines))

    def committed(self) -> list[str]:
        store, base = self.open()
        found = store.get_file_info(fs.FileSelector(f"{base}/batches", allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def commit(self, batch: str, messages: list[Written | None]) -> None:
        """List the files of a batch, unless it is listed already; then they are dropped."""
        store, base = self.open()
        files = [m.file for m in messages if m is not None and m.lines]
        if f"{batch}.json" in self.committed():
            self.drop(messages)
            return
        store.create_dir(f"{base}/batches", recursive=True)
        with store.open_output_stream(f"{base}/batches/{batch}.tmp") as out:
            out.write(json.dumps(files).encode())
        store.move(f"{base}/batches/{batch}.tmp", f"{base}/batches/{batch}.json")

    def drop(self, messages: list[Written | None]) -> None:
        store, base = self.open()
        for m in messages:
            if m is not None and store.get_file_info(f"{base}/lines/{m.file}").type != fs.FileType.NotFound:
                store.delete_file(f"{base}/lines/{m.file}")

    def files(self, batch: str) -> list[str]:
        store, base = self.open()
        with store.open_input_stream(f"{base}/batches/{batch}") as f:
            return json.loads(f.read())

    def lines(self, file: str) -> Iterator[str]:
        store, base = self.open()
        with store.open_input_stream(f"{base}/lines/{file}") as f:
            for line in f.read().decode().splitlines():
                yield json.loads(line)


@dataclass
class _File(InputPartition):
    batch: str
    file: str


class _Writer(DataSourceWriter):
    def __init__(self, place: _Place):
        self.place, self.batch = place, f"b{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        return self.place.stage([r[0] for r in iterator if r[0] is not None])

    def commit(self, messages) -> None:
        self.place.commit(self.batch, messages)

    def abort(self, messages) -> None:
        self.place.drop(messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, place: _Place, stream: str):
        self.place, self.stream = place, stream

    def write(self, iterator) -> Written:
        return self.place.stage([r[0] for r in iterator if r[0] is not None])

    def commit(self, messages, batchId: int) -> None:
        self.place.commit(f"s{self.stream}-{batchId:012d}", messages)

    def abort(self, messages, batchId: int) -> None:
        self.place.drop(messages)


class _Reader(DataSourceReader):
    def __init__(self, place: _Place):
        self.place = place

    def partitions(self) -> list[_File]:
        return [_File(b, f) for b in self.place.committed() for f in self.place.files(b)] or [_File("", "")]

    def read(self, partition: _File) -> Iterator[tuple[str, str]]:
        return ((line, partition.batch.removesuffix(".json")) for line in (self.place.lines(partition.file) if partition.file else ()))


class _StreamReader(DataSourceStreamReader):
    """Offsets are the batches read so far, by name: names of later batches may sort anywhere."""

    def __init__(self, place: _Place):
        self.place = place

    def initialOffset(self) -> dict:
        return {"read": "[]"}

    def latestOffset(self) -> dict:
        return {"read": json.dumps(self.place.committed())}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        new = sorted(set(json.loads(end["read"])) - set(json.loads(start["read"])))
        return [_File(b, f) for b in new for f in self.place.files(b)] or [_File("", "")]

    def read(self, partition: _File) -> Iterator[tuple[str, str]]:
        return _Reader(self.place).read(partition)

    def commit(self, end: dict) -> None:
        pass


class LineLog(DataSource):
    """See the module.  Option `stream` names the writing stream, if several write to one log."""

    @classmethod
    def name(cls) -> str:
        return "line_log"

    def schema(self) -> str:
        return "value string, batch string"

    def _place(self) -> _Place:
        return _Place(self.options["path"])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._place())

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self._place())

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self._place())

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self._place(), self.options.get("stream", ""))
