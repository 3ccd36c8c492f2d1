"""A replayable log of device messages: segments in one folder, addressed by byte, and a stream source that reads it.

A segment is named by the position in the log at which it starts, twenty digits, and holds one JSON message a line. A message's
position is its segment's plus the bytes before it, so positions grow with arrival, never change, and are found without
counting messages. A stream's offset is such a position: planning lists the folder and reads the end of the newest
segment only, and a range of the log is cut into tasks by bytes. A line that isn't finished yet isn't read.

    message_log.register(spark)
    spark.readStream.format("message_log").load(folder)     # options: taskBytes, keepSegments

The log is read with Arrow's file systems by whichever task holds the range, so its folder has to be a path that all executors
reach. Writers append whole segments (``append``); one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from heliogrid.session import ship_package

NAME = "message_log"
SCHEMA = "position long, topic string, payload string, ingestion_time timestamp_ntz"
TASK_BYTES = 64 << 20
TASKS = 512
TAIL = 1 << 20
SUFFIX = ".jsonl"
ROWS = 4096


@dataclass
class Segment:
    path: str
    start: int
    size: int


@dataclass
class Range(InputPartition):
    """Messages that start in [start, end) of one segment, which begins at ``base``."""

    path: str
    base: int
    start: int
    end: int


class Log:
    """The segments of a folder."""

    def __init__(self, folder: str):
        self.files, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)

    def segments(self) -> list[Segment]:
        found = self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted((Segment(f.path, int(f.base_name[: -len(SUFFIX)]), f.size) for f in found if f.base_name.endswith(SUFFIX)), key=lambda s: s.start)

    def end(self) -> int:
        """Position after the last finished line."""
        held = self.segments()
        if not held:
            return 0
        last, upto = held[-1], held[-1].size
        with self.files.open_input_file(last.path) as f:
            while upto:
                at = max(0, upto - TAIL)
                f.seek(at)
                if (newline := f.read(upto - at).rfind(b"\n")) >= 0:
                    return last.start + at + newline + 1
                upto = at
        return last.start

    def begin(self) -> int:
        return next((s.start for s in self.segments()), 0)

    def ranges(self, start: int, end: int, task_bytes: int) -> list[Range]:
        """Tasks that together hold each message of [start, end) once.

        They have ``task_bytes`` each. Where that makes more than TASKS, they are as large as it takes, up to TASK_BYTES: each task starts
        a reader and opens files of its own in a sink, which costs more than a small range does.
        """
        task_bytes = max(task_bytes, min(TASK_BYTES, -(-(end - start) // TASKS)))
        out = []
        for s in self.segments():
            at, upto = max(start, s.start), min(end, s.start + s.size)
            while at < upto:
                out.append(Range(s.path, s.start, at, min(upto, at + task_bytes)))
                at += task_bytes
        return out

    def lines(self, r: Range) -> Iterator[tuple[int, bytes]]:
        """(position, line) of the lines that start in the range."""
        with self.files.open_input_stream(r.path) if r.start == r.base else self.files.open_input_file(r.path) as f:
            at = r.start
            if at > r.base:  # the line that holds the byte before belongs to the range before
                f.seek(at - 1 - r.base)
                at -= 1
            held, skip = b"", at < r.start
            while at < r.end:
                if (cut := held.find(b"\n")) < 0:
                    more = f.read(TAIL)
                    if not more:
                        return
                    held += more
                    continue
                parts = held.split(b"\n")
                held = parts.pop()
                for line in parts:
                    if not skip and at < r.end:
                        yield at, line
                    skip = False
                    at += len(line) + 1


def _batches(log: Log, r: Range) -> Iterator[pa.RecordBatch]:
    names, rows = ["position", "topic", "payload", "ingestion_time"], []
    kinds = [pa.int64(), pa.string(), pa.string(), pa.timestamp("us")]

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows.clear()
        return out

    for at, line in log.lines(r):
        try:
            m = json.loads(line)
            time = m.get("ingestion_time")
            rows.append((at, m.get("topic"), m.get("payload"), datetime.fromisoformat(time).replace(tzinfo=None) if time else None))
        except (ValueError, AttributeError, TypeError):  # whatever is no message is kept as the payload of one without a topic
            rows.append((at, None, line.decode(errors="replace"), None))
        if len(rows) == ROWS:
            yield batch()
    if rows:
        yield batch()


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, task_bytes: int, keep_segments: bool):
        self.folder, self.task_bytes, self.keep_segments = folder, task_bytes, keep_segments

    def initialOffset(self) -> dict:
        return {"position": Log(self.folder).begin()}

    def latestOffset(self) -> dict:
        return {"position": Log(self.folder).end()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return Log(self.folder).ranges(start["position"], end["position"], self.task_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(Log(self.folder), partition)

    def commit(self, end: dict) -> None:
        """With ``keepSegments`` false, segments that are read and closed go; the newest stays."""
        if not self.keep_segments:
            log = Log(self.folder)
            for s in log.segments()[:-1]:
                if s.start + s.size <= end["position"]:
                    log.files.delete_file(s.path)


class _Whole(DataSourceReader):
    def __init__(self, folder: str, task_bytes: int):
        self.folder, self.task_bytes = folder, task_bytes

    def partitions(self) -> list[Range]:
        log = Log(self.folder)
        return log.ranges(0, log.end(), self.task_bytes)

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        return _batches(Log(self.folder), partition) if partition else iter(())  # none: the log is empty


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("taskBytes", TASK_BYTES))

    def streamReader(self, schema) -> _Stream:
        return _Stream(*self._options(), self.options.get("keepSegments", "true").lower() == "true")

    def reader(self, schema) -> _Whole:
        return _Whole(*self._options())


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(MessageLog)


def stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The log as a stream of SCHEMA rows."""
    register(spark)
    return spark.readStream.format(NAME).options(**options).load(folder)


def append(messages: DataFrame, folder: str) -> int:
    """Append (topic, payload, ingestion_time) rows to the log, in order of their partitions; the log's new end.

    The lines are written beside the log first; the driver only lists the files and renames them to the positions that their sizes give.
    """
    spark, folder = messages.sparkSession, folder.rstrip("/")
    line = F.to_json(F.struct("topic", "payload", F.date_format("ingestion_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ingestion_time")))
    messages.select(line.alias("value")).write.mode("overwrite").text(f"{folder}/_incoming")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    end = Log(folder).end()
    for f in sorted(store.listStatus(path(f"{folder}/_incoming")), key=lambda f: f.getPath().getName()):
        if f.getLen() and f.getPath().getName().startswith("part-"):
            if not store.rename(f.getPath(), path(f"{folder}/{end:020d}{SUFFIX}")):
                raise OSError(f"position {end} of the log is taken")
            end += f.getLen()
    store.delete(path(f"{folder}/_incoming"), True)
    return end
