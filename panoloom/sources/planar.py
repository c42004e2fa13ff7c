"""Uncompressed frames as a data source, ``planar_frames``, for batch and stream.

A file holds records of one length: a byte that says whether there is a time, frame number and time as 64-bit integers, then one byte per pixel and plane. All frames of a
file have one video, size and layout and ascend by number. Tasks write files below a part of their own attempt; the driver makes them visible by one commit file, which also names the
first frame of every block of ``BLOCK_BYTES``. A reader makes one partition of each block, leaves out blocks that filters on ``video_id`` and ``frame_idx`` exclude, and seeks to the
rest: neither folders nor whole files are read. A stream's offset is the number of commits it has seen, so a commit is one step whatever it holds.

The schema is that of stored frames (``frames.SCHEMA``). Commits are numbered, so one job appends at a time; frames with a ``frames.fault`` cannot be written and fail the job, which then
shows nothing. ``register`` makes the source known and lets Spark hand filters to it; ``path`` names a folder all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
                                    In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage)

from panoloom.sources.frames import FRAME, SCHEMA
from panoloom.sources.images import _commits, _open

BLOCK_BYTES = 32 << 20          # a partition of a scan
BATCH_BYTES = 8 << 20           # frames handed to Spark together
FILE_BYTES = 512 << 20
PLANES = {"BGR": 3, "RGB": 3, "GRAY": 1}
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def _record(width: int, height: int, layout: str) -> np.dtype:
    return np.dtype([("timed", "u1"), ("frame", "<i8"), ("ts", "<i8"), ("v", "u1", (PLANES[layout], width * height))])


@dataclass
class Segment:
    """One file: ``firsts`` has the first frame of each block of ``step`` records."""

    file: str
    video: int
    width: int
    height: int
    layout: str
    step: int
    n: int
    firsts: list[int]
    last: int


@dataclass
class Written(WriterCommitMessage):
    segments: list[Segment]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        part = f"run-{self.run}/part-{TaskContext.get().taskAttemptId()}"
        segments, out = [], None
        for batch in batches:
            head = [batch.column(n).to_pylist() for n in NAMES[:6]]
            planes = [batch.column(n) for n in NAMES[6:]]
            for i, (video, frame, ts, width, height, layout) in enumerate(zip(*head)):
                if None in (video, frame, width, height) or layout not in PLANES or width <= 0 or height <= 0:
                    raise ValueError(f"frame {frame} of video {video} has no number, size or known layout")
                kind = _record(width, height, layout)
                row = np.zeros(1, kind)
                row["timed"], row["frame"], row["ts"] = ts is not None, frame, ts or 0
                for k in range(PLANES[layout]):
                    v = planes[k][i].values
                    if v is None or v.null_count or len(v) != width * height:
                        raise ValueError(f"frame {frame} of video {video} has a plane of another size")
                    v = v.to_numpy()
                    if v.min() < 0 or v.max() > 255:
                        raise ValueError(f"frame {frame} of video {video} has levels beyond a byte")
                    row["v"][0, k] = v
                s = segments[-1] if segments else None
                if (s is None or (s.video, s.width, s.height, s.layout) != (video, width, height, layout) or frame < s.last
                        or s.n * kind.itemsize >= FILE_BYTES):
                    if out:
                        out.close()
                    s = Segment(f"{part}/{len(segments):06d}.planes", video, width, height, layout, max(1, BLOCK_BYTES // kind.itemsize), 0, [], frame)
                    segments.append(s)
                    store.create_dir(f"{root}/{part}")
                    out = store.open_output_stream(f"{root}/{s.file}")
                out.write(row.tobytes())
                if s.n % s.step == 0:
                    s.firsts.append(frame)
                s.n, s.last = s.n + 1, frame
        if out:
            out.close()
        return Written(segments)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        store.create_dir(f"{root}/_commits")
        text = "\n".join(json.dumps(asdict(s)) for m in messages if m is not None for s in m.segments)
        with store.open_output_stream(f"{root}/_commits/.{self.run}") as out:
            out.write(text.encode())
        store.move(f"{root}/_commits/.{self.run}", f"{root}/_commits/{len(_commits(store, root)):012d}-{self.run}.json")     # visible at once and whole

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        if store.get_file_info(f"{root}/run-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/run-{self.run}")


class Block(InputPartition):
    """Records ``first`` to ``end`` of a file."""

    def __init__(self, file: str, video: int, width: int, height: int, layout: str, first: int, end: int):
        self.file, self.video, self.width, self.height, self.layout, self.first, self.end = file, video, width, height, layout, first, end


@dataclass
class Wanted:
    """What filters leave: videos (None: all) and frames from ``low`` to ``high``."""

    videos: frozenset | None = None
    low: int = -(1 << 63)
    high: int = (1 << 63) - 1

    def take(self, f: Filter) -> bool:
        """Whether the filter is one of those this source applies in full."""
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if name not in FRAME:
            return False
        if isinstance(f, IsNotNull):
            return True                                     # neither is ever null
        if name == "video_id" and isinstance(f, (EqualTo, In)):
            named = frozenset([f.value] if isinstance(f, EqualTo) else f.value) - {None}
            self.videos = named if self.videos is None else self.videos & named
            return True
        if name == "frame_idx" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            return True
        return False


def _blocks(path: str, wanted: Wanted, start: int = 0, end: int | None = None) -> list[Block]:
    store, root = _open(path)
    out = []
    for c in _commits(store, root)[start:end]:
        with store.open_input_stream(c) as f:
            lines = f.read().decode().splitlines()
        for s in (Segment(**json.loads(x)) for x in lines):
            if wanted.videos is not None and s.video not in wanted.videos:
                continue
            for k, first in enumerate(s.firsts):
                upto = s.firsts[k + 1] if k + 1 < len(s.firsts) else s.last
                if first <= wanted.high and upto >= wanted.low:
                    out.append(Block(s.file, s.video, s.width, s.height, s.layout, k * s.step, min(s.n, (k + 1) * s.step)))
    return out


def _read(path: str, b: Block, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    store, root = _open(path)
    kind = _record(b.width, b.height, b.layout)
    many, area = max(1, BATCH_BYTES // kind.itemsize), b.width * b.height
    with store.open_input_file(f"{root}/{b.file}") as f:
        for at in range(b.first, b.end, many):
            f.seek(at * kind.itemsize)
            rows = np.frombuffer(f.read(min(many, b.end - at) * kind.itemsize), kind)
            rows = rows[(rows["frame"] >= wanted.low) & (rows["frame"] <= wanted.high)]
            n = len(rows)
            if not n:
                continue
            ends = pa.array(np.arange(0, (n + 1) * area, area, dtype=np.int32))
            planes = [pa.ListArray.from_arrays(ends, pa.array(rows["v"][:, k].astype(np.int16).ravel())) if k < PLANES[b.layout]
                      else pa.nulls(n, pa.list_(pa.int16())) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, b.video)), pa.array(rows["frame"]), pa.array(rows["ts"], mask=rows["timed"] == 0), pa.array(np.full(n, b.width, np.int32)),
                 pa.array(np.full(n, b.height, np.int32)), pa.array([b.layout] * n), *planes], NAMES)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        return _blocks(self.path, self.wanted) or [InputPartition(None)]        # Spark asks for one at least

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Block):
            yield from _read(self.path, partition, self.wanted)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(_commits(*_open(self.path)))}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        return _blocks(self.path, Wanted(), start["commits"], end["commits"])

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, partition, Wanted())

    def commit(self, end: dict) -> None:
        """Commits stay for other readers."""


class PlanarFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "planar_frames"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("planar_frames appends only: streams count its commits")
        return _Writer(self.options["path"])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlanarFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_planar(frames: DataFrame, path: str) -> None:
    """Append stored frames in order of video and frame, so that files are few and blocks cover short ranges."""
    register(frames.sparkSession)
    rows = frames.select(*NAMES).repartitionByRange(*FRAME).sortWithinPartitions(*FRAME)
    rows.write.format("planar_frames").option("path", path).mode("append").save()


def read_planar(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("planar_frames").option("path", path).load()


def stream_planar(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("planar_frames").option("path", path).load()
