"""Chunks as image files, one ``frame_%04d.pgm`` each, with a commit of their own.

A task writes its files below a part of its own attempt. Only when all tasks have ended does the driver write a commit file that names the parts; readers take parts from
commit files, so a failed job or a repeated task shows nothing. The format is the plain binary gray map: a line ``P5``, a line with width and height, ``255``, then the bytes.
Register with ``spark.dataSource.register(ChunkFiles)``; the option ``path`` names a folder all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from panoloom.settings import CHUNK_NAME

SCHEMA = "video_id bigint, chunk_no bigint, width int, height int, v binary"
FILES_AT_ONCE = 64


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Part:
        store, root = _open(self.path)
        name = f"run-{self.run}/part-{TaskContext.get().taskAttemptId()}"
        files = []
        for r in rows:
            if r["width"] * r["height"] != len(r["v"]):
                raise ValueError(f"chunk {r['chunk_no']} of video {r['video_id']} has {len(r['v'])} pixels")
            file = f"{r['video_id']}/{(CHUNK_NAME % r['chunk_no']).rsplit('.', 1)[0]}.pgm"
            store.create_dir(f"{root}/{name}/{r['video_id']}")
            with store.open_output_stream(f"{root}/{name}/{file}") as out:
                out.write(b"P5\n%d %d\n255\n" % (r["width"], r["height"]) + bytes(r["v"]))
            files.append(file)
        return Part(name, files)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _open(self.path)
        old = _commits(store, root) if self.overwrite else []
        store.create_dir(f"{root}/_commits")
        parts = [{"part": m.name, "files": m.files} for m in messages if m is not None and m.files]
        with store.open_output_stream(f"{root}/_commits/.{self.run}") as out:
            out.write(json.dumps(parts).encode())
        store.move(f"{root}/_commits/.{self.run}", f"{root}/_commits/{self.run}.json")       # visible at once and whole
        for c in old:
            store.delete_file(c)

    def abort(self, messages: list[Part | None]) -> None:
        store, root = _open(self.path)
        if store.get_file_info(f"{root}/run-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/run-{self.run}")


def _commits(store: fs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".json"))


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Files]:
        """Some files each, as the commits name them; the folder itself is never listed."""
        store, root = _open(self.path)
        out = []
        for c in _commits(store, root):
            with store.open_input_stream(c) as f:
                parts = json.loads(f.read())
            files = [(int(x.split("/")[0]), f"{p['part']}/{x}") for p in parts for x in p["files"]]
            out += [_Files(files[i:i + FILES_AT_ONCE]) for i in range(0, len(files), FILES_AT_ONCE)]
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, root = _open(self.path)
        for video, name in partition.files:
            with store.open_input_stream(f"{root}/{name}") as f:
                _, size, _, v = f.read().split(b"\n", 3)
            width, height = map(int, size.split())
            number = int(name.rsplit("_", 1)[1].split(".")[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([video], pa.int64()), pa.array([number], pa.int64()), pa.array([width], pa.int32()), pa.array([height], pa.int32()),
                 pa.array([v], pa.binary())], ["video_id", "chunk_no", "width", "height", "v"])


class ChunkFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunk_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def chunk_rows(pixels: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` from chunk pixels ``(video_id, chunk_no, y, x, v)``; a chunk is bounded by its size."""
    p = F.sort_array(F.collect_list(F.struct("y", "x", "v")))
    rows = pixels.groupBy("video_id", "chunk_no").agg(p.alias("p"), (F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    digits = F.array_join(F.transform("p.v", lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), "")
    return rows.select("video_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "width", "height", F.unhex(digits).alias("v"))


def chunk_pixels(rows: DataFrame) -> DataFrame:
    """Chunk pixels from rows of ``SCHEMA``."""
    digits = rows.select("video_id", "chunk_no", "width", F.hex("v").alias("h"))
    each = digits.select("video_id", "chunk_no", "width", "h", F.explode(F.expr("sequence(0, length(h) div 2 - 1)")).alias("i"))
    return each.select("video_id", "chunk_no", F.expr("cast(i div width as int)").alias("y"), F.expr("cast(i % width as int)").alias("x"),
                       F.conv(F.expr("substr(h, 2 * i + 1, 2)"), 16, 10).cast("int").alias("v"))
