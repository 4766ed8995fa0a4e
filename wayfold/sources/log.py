"""A log of messages with offsets, as a Spark data source: what a broker's topic is, in files of any shared file system.

    spark.dataSource.register(LogSource)
    df.write.format("wayfold-log").mode("append").save(path)
    spark.readStream.format("wayfold-log").load(path)

Messages (key, value) go to a partition by their key, as Parquet files that
nothing refers to yet; a commit then names them all in one small file with the
next number.  A reader's offset is a number of commits, so Spark's checkpoint
has it, a restart goes on where the last batch ended, and nothing is listed.
A streaming writer's commits carry the batch's number: one that is repeated
after a failure is not added again.  A log has one writer at a time.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "key string, value string, partition int, offset long"
#: Messages that a task holds before it writes a file of each partition.
HELD = 100_000


class Log:
    """The commits of a log."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.path = self.path.rstrip("/")

    def commit_path(self, n: int) -> str:
        return f"{self.path}/commits/{n:020d}.json"

    def has(self, n: int) -> bool:
        return self.fs.get_file_info(self.commit_path(n)).type == pafs.FileType.File

    def commit(self, n: int) -> dict:
        """The n-th commit, from 1; before the first there is nothing."""
        if n == 0:
            return {"files": [], "ends": {}, "batches": {}}
        with self.fs.open_input_stream(self.commit_path(n)) as f:
            return json.loads(f.read())

    def head(self, known: int = 0) -> int:
        """The number of commits, if there were `known` of them before: strides that double, then halve."""
        step = 1
        while self.has(known + step):
            known += step
            step *= 2
        while step > 1:
            step //= 2
            if self.has(known + step):
                known += step
        return known

    def add(self, files: list[tuple[int, str, int]], producer: str | None = None, batch: int | None = None) -> int:
        """Commits files (partition, name, rows); the log's commits then.  A producer's batch that is in already isn't added."""
        n = self.head()
        last = self.commit(n)
        if producer is not None and batch is not None and last["batches"].get(producer, -1) >= batch:
            self.drop([name for _, name, _ in files])
            return n
        ends, named = dict(last["ends"]), []
        for partition, name, rows in files:
            first = ends.get(str(partition), 0)
            named.append([partition, name, first, rows])
            ends[str(partition)] = first + rows
        said = {"files": named, "ends": ends, "batches": last["batches"] | ({producer: batch} if producer is not None else {})}
        self.write(self.commit_path(n + 1), said)
        return n + 1

    def write(self, path: str, said: dict) -> None:
        """A file that is there whole or not at all."""
        new = f"{path}-{uuid.uuid4().hex}"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(new) as f:
            f.write(json.dumps(said, separators=(",", ":")).encode())
        self.fs.move(new, path)

    def drop(self, names: list[str]) -> None:
        for name in names:
            if self.fs.get_file_info(f"{self.path}/{name}").type == pafs.FileType.File:
                self.fs.delete_file(f"{self.path}/{name}")

    def position(self, group: str) -> int:
        """The commits that a group of readers is through with."""
        path = f"{self.path}/groups/{group}.json"
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return 0
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())["commit"]


@dataclass
class Piece(InputPartition):
    """A file, its partition and its first offset."""

    name: str
    partition: int
    first: int


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, int]] = field(default_factory=list)


def pieces(log: Log, start: int, end: int) -> list[Piece]:
    return [Piece(name, partition, first) for n in range(start + 1, end + 1) for partition, name, first, _ in log.commit(n)["files"]]


def batches_of(path: str, piece: Piece) -> Iterator[pa.RecordBatch]:
    log, at = Log(path), piece.first
    with log.fs.open_input_file(f"{log.path}/{piece.name}") as f:
        for batch in pq.ParquetFile(f).iter_batches(10_000):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([piece.partition] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=["key", "value", "partition", "offset"])
            at += n


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Piece]:
        log = Log(self.path)
        return pieces(log, 0, log.head())

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return batches_of(self.path, partition)


class StreamReader(DataSourceStreamReader):
    """Reads at most `perTrigger` commits at once, if that is set; `group` is then the name under which it remembers its place for that."""

    def __init__(self, path: str, options: dict[str, str]) -> None:
        self.path, self.log = path, Log(path)
        self.latest, self.most = options.get("startingOffsets", "earliest") == "latest", int(options.get("perTrigger", 0))
        self.group = options.get("group")
        self.done = self.log.position(self.group) if self.group else 0
        self.known = self.done

    def initialOffset(self) -> dict:
        self.done = self.log.head() if self.latest else 0
        return {"commit": self.done}

    def latestOffset(self) -> dict:
        self.known = self.log.head(self.known)
        return {"commit": min(self.known, self.done + self.most) if self.most else self.known}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.done = max(self.done, start["commit"])
        return pieces(self.log, start["commit"], end["commit"])

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return batches_of(self.path, partition)

    def commit(self, end: dict) -> None:
        self.done = max(self.done, end["commit"])
        if self.group:
            self.log.write(f"{self.log.path}/groups/{self.group}.json", end)


class Writing:
    """What writers of batches and of streams share."""

    def __init__(self, path: str, options: dict[str, str]) -> None:
        self.path, self.parts, self.producer = path, int(options.get("partitions", 4)), options.get("producer", "stream")

    def write(self, iterator: Iterator) -> Written:
        log, held, out, n = Log(self.path), {}, Written(), 0

        def flush() -> None:
            for partition, rows in sorted(held.items()):
                name = f"data/{uuid.uuid4().hex}.parquet"
                log.fs.create_dir(f"{log.path}/data", recursive=True)
                with log.fs.open_output_stream(f"{log.path}/{name}") as f:
                    pq.write_table(pa.table({"key": pa.array([r[0] for r in rows], pa.string()), "value": pa.array([r[1] for r in rows], pa.string())}), f)
                out.files.append((partition, name, len(rows)))
            held.clear()

        for row in iterator:
            key, value = row["key"], row["value"]
            held.setdefault(zlib.crc32((key or "").encode()) % self.parts, []).append((key, value))
            n += 1
            if n % HELD == 0:
                flush()
        flush()
        return out

    def files(self, messages: list[Written | None]) -> list[tuple[int, str, int]]:
        return [x for m in messages if m for x in m.files]

    def abort(self, messages: list[Written | None], batchId: int | None = None) -> None:  # noqa: N803
        Log(self.path).drop([name for _, name, _ in self.files(messages)])


class Writer(Writing, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        if files := self.files(messages):
            Log(self.path).add(files)


class StreamWriter(Writing, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        if files := self.files(messages):
            Log(self.path).add(files, self.producer, batchId)


class LogSource(DataSource):
    """Options: path; partitions (4) and producer for writers; perTrigger, group and startingOffsets (earliest) for streams."""

    @classmethod
    def name(cls) -> str:
        return "wayfold-log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a log is only appended to")
        return Writer(self.options["path"], self.options)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(self.options["path"], self.options)
