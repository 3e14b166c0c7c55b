"""A queue on shared storage, read and written as streams by format name ``rillmark_queue``.

A queue is a folder.  What one micro-batch (or one batch write) puts in is a segment: Parquet
files under ``data/`` and a manifest under ``log/`` that names them with their numbers of rows.
A segment exists once its manifest does, so readers see all of it or nothing, and offsets are
numbers of segments.  A manifest remembers which micro-batch of which ``writer`` it came from: one
that is written again after a restart is left alone, which with the reader's offsets in the
query's checkpoint makes every row pass exactly once.  A queue has one writer at a time.

Options: ``path`` (any address that Arrow's file systems know, the same for all executors);
for reading ``capacity`` (a bounded queue: of the rows that came since the last read only the
newest so many are delivered, as older ones were dropped to make room; rows are in order of the
partitions that wrote them); for stream writing ``writer`` (a name that the query keeps over
restarts), for a batch write in ``foreachBatch`` also ``batch``, its number.

``close`` ends a queue: it takes no more segments.  ``statistics`` counts what went through."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "rillmark_queue"


class Folder:
    """The files of a queue."""

    def __init__(self, path: str):
        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:"))

    def numbers(self) -> list[int]:
        """Of all segments, ascending."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def manifest(self, number: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/log/{number:012d}.json") as f:
            return json.loads(f.read())

    def publish(self, name: str, what: dict) -> None:
        """Put a file in place whole: readers never see half of one."""
        self.fs.create_dir(f"{self.root}/log")
        held = f"{self.root}/log/.{uuid.uuid4()}"
        with self.fs.open_output_stream(held) as f:
            f.write(json.dumps(what).encode())
        self.fs.move(held, f"{self.root}/log/{name}.json")

    def closed(self) -> bool:
        return self.fs.get_file_info(f"{self.root}/log/closed.json").type != fs.FileType.NotFound

    def append(self, files: list[tuple[str, int]], writer: str, batch: int, schema: str) -> None:
        """A segment of files and their rows; nothing, if the writer's batch is there already."""
        numbers = self.numbers()
        for number in reversed(numbers):
            told = self.manifest(number)
            if told["writer"] == writer and told["batch"] <= batch:
                if told["batch"] == batch:
                    return self.delete([name for name, _ in files])
                break
        if self.closed():
            raise ValueError(f"the queue {self.root} is closed")
        return self.publish(f"{numbers[-1] + 1 if numbers else 0:012d}", {"writer": writer, "batch": batch, "files": sorted(files), "rows": sum(n for _, n in files), "schema": schema})

    def delete(self, names: list[str]) -> None:
        for name in names:
            self.fs.delete_file(f"{self.root}/data/{name}")


@dataclass
class Files(WriterCommitMessage):
    """What one task has written."""

    names: list[tuple[str, int]]


class _Writer:
    def __init__(self, options: dict, schema: StructType):
        self.path, self.writer, self.batch, self.schema = options["path"], options.get("writer", ""), int(options.get("batch", 0)), schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        held, name, rows, out = Folder(self.path), f"{TaskContext.get().partitionId():06d}-{uuid.uuid4()}.parquet", 0, None
        for batch in iterator:
            if batch.num_rows:
                if out is None:
                    held.fs.create_dir(f"{held.root}/data")
                    out = pq.ParquetWriter(f"{held.root}/data/{name}", batch.schema, filesystem=held.fs)
                out.write_batch(batch)
                rows += batch.num_rows
        if out is not None:
            out.close()
        return Files([(name, rows)] if rows else [])

    def _files(self, messages: list) -> list[tuple[str, int]]:
        return [x for m in messages if m is not None for x in m.names]


class QueueWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        Folder(self.path).append(self._files(messages), self.writer or str(uuid.uuid4()), self.batch, self.schema.json())

    def abort(self, messages: list) -> None:
        Folder(self.path).delete([n for n, _ in self._files(messages)])


class QueueStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        if not self.writer:
            raise ValueError("a stream names its writer")
        Folder(self.path).append(self._files(messages), self.writer, batchId, self.schema.json())

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        Folder(self.path).delete([n for n, _ in self._files(messages)])


@dataclass
class Part(InputPartition):
    """A file, and the rows of it that a bounded queue has dropped."""

    name: str
    skip: int


def parts(folder: Folder, start: int, end: int, capacity: int | None) -> list[Part]:
    """The files of segments [start, end), without the oldest rows beyond ``capacity``."""
    files = [tuple(x) for k in range(start, end) for x in folder.manifest(k)["files"]]
    drop = max(0, sum(n for _, n in files) - capacity) if capacity is not None else 0
    out = []
    for name, n in files:
        if drop < n:
            out.append(Part(name, drop))
        drop = max(0, drop - n)
    return out


class _Reader:
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.names
        self.capacity = int(options["capacity"]) if "capacity" in options else None

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        held, skip = Folder(self.path), partition.skip
        with held.fs.open_input_file(f"{held.root}/data/{partition.name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=self.columns):
                if skip < batch.num_rows:
                    yield batch.select(self.columns).slice(skip)
                skip = max(0, skip - batch.num_rows)


class QueueReader(_Reader, DataSourceReader):
    """A batch read has what is in the queue now."""

    def partitions(self) -> list[Part]:
        folder = Folder(self.path)
        return parts(folder, 0, len(folder.numbers()), self.capacity) or [Part("", -1)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.skip >= 0:
            yield from super().read(partition)


class QueueStreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"segment": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"segment": len(Folder(self.path).numbers())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts(Folder(self.path), start["segment"], end["segment"], self.capacity)

    def commit(self, end: dict) -> None:
        """Segments stay, as other readers have offsets of their own."""


class Queue(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        folder = Folder(self.options["path"])
        numbers = folder.numbers()
        if not numbers:
            raise ValueError(f"the queue {folder.root} has no segment to tell its columns: name them")
        return StructType.fromJson(json.loads(folder.manifest(numbers[0])["schema"]))

    def reader(self, schema: StructType) -> QueueReader:
        return QueueReader(self.options, schema)

    def streamReader(self, schema: StructType) -> QueueStreamReader:  # noqa: N802
        return QueueStreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> QueueWriter:
        if overwrite:
            raise ValueError("a queue is only appended to")
        return QueueWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> QueueStreamWriter:  # noqa: N802
        return QueueStreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Queue)


def close(path: str) -> None:
    """No more segments; a reader that has read all there are has read everything."""
    Folder(path).publish("closed", {})


def statistics(path: str, reads: list[tuple[int, int]], capacity: int | None = None) -> dict[str, int]:
    """produced, consumed, dropped and size of a queue of which the segments [start, end) of
    ``reads`` were read one after the other, each read finding what its capacity had kept."""
    folder = Folder(path)
    rows = [folder.manifest(k)["rows"] for k in folder.numbers()]
    least = lambda n: n if capacity is None else min(n, capacity)
    end = max((e for _, e in reads), default=0)
    consumed = sum(least(sum(rows[s:e])) for s, e in reads)
    size = least(sum(rows[end:]))
    return {"produced": sum(rows), "consumed": consumed, "dropped": sum(rows) - consumed - size, "size": size}
