"""SubRip files as a data source: spark.read.format("srt"), spark.readStream.format("srt")."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, cue int, start_ms long, end_ms long, text string"
TIMES = re.compile(r"^(?:\s*(\d+)\s*\n)?\s*(\d+):(\d\d):(\d\d)[,.](\d{3}) --> (\d+):(\d\d):(\d\d)[,.](\d{3})[^\n]*(?:\n(.*))?$", re.S)
#: Bytes of files that one task reads, about.
TASK_BYTES = 8 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time, path, bytes) of the .srt files under a folder, or of one file, in order of time."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    found = system.get_file_info(place)
    infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    root = path.split("://", 1)[0] + "://" if "://" in path else ""
    return sorted((x.mtime_ns or 0, root + x.path, x.size) for x in infos if x.type == fs.FileType.File and x.path.lower().endswith(".srt"))


def planned(files: list[tuple[int, str, int]], task_bytes: int) -> list[Files]:
    """Files dealt out to tasks by size: small ones share a task."""
    out: list[list[str]] = []
    size = 0
    for _, path, n in files:
        if not out or size + n > task_bytes:
            out.append([])
            size = 0
        out[-1].append(path)
        size += n + 4_096
    return [Files(paths) for paths in out]


def cues(path: str, columns: list[str]) -> Iterator[tuple]:
    """The wanted columns of a file's cues; blocks without times are skipped."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(place) as file:
        blocks = re.split(r"\n\s*\n", file.read().decode("utf-8-sig", "replace").replace("\r", ""))
    for block in blocks:
        m = TIMES.match(block.strip("\n"))
        if m:
            h = [int(x) for x in m.groups()[1:9]]
            start, end = (((a * 60 + b) * 60 + c) * 1_000 + d for a, b, c, d in (h[:4], h[4:]))
            row = {"file": path, "cue": int(m[1]) if m[1] else None, "start_ms": start, "end_ms": end, "text": m[10] or ""}
            yield tuple(row[c] for c in columns)


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.path, self.task_bytes = schema.names, options["path"], int(options.get("taskBytes", TASK_BYTES))

    def partitions(self) -> list[Files]:
        return planned(listed(self.path), self.task_bytes)

    def read(self, partition: Files | None) -> Iterator[tuple]:
        for path in partition.paths if partition else ():  # none where there is no file
            yield from cues(path, self.columns)


class StreamReader(DataSourceStreamReader):
    """New files by (time, path); a file that is written again is read again."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns, self.path, self.task_bytes = schema.names, options["path"], int(options.get("taskBytes", TASK_BYTES))

    def initialOffset(self) -> dict:
        return {"at": json.dumps([-1, ""])}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"at": json.dumps(list(files[-1][:2]))} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (tuple(json.loads(x["at"])) for x in (start, end))
        return planned([f for f in listed(self.path) if low < f[:2] <= high], self.task_bytes)

    def read(self, partition: Files | None) -> Iterator[tuple]:
        for path in partition.paths if partition else ():  # none where there is no file
            yield from cues(path, self.columns)


class Subtitles(DataSource):
    """Options: path (a folder or file), taskBytes. A schema with fewer of the columns of SCHEMA reads only these."""

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Subtitles)
