"""Traces as DataFrames: spark.read.format("trace"), df.write.format("trace"), and read_traces for any store that Spark reads."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship
from . import schema as S
from . import wire

BATCH = 2000


def packet_spans(data: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of each packet's body; other top-level fields are skipped."""
    at = 0
    while at < len(data):
        head, at = wire.read_varint(data, at)
        kind = head & 7
        if kind == 2:
            size, at = wire.read_varint(data, at)
            if head >> 3 == 1:
                yield at, min(at + size, len(data))
            at += size
        else:
            at = wire.read_varint(data, at)[1] if kind == 0 else at + (8 if kind == 1 else 4)


def rows_of(data: bytes, trace: str) -> Iterator[dict]:
    for i, (a, e) in enumerate(packet_spans(data)):
        yield S.to_row(wire.decode("TracePacket", data[a:e]), i, trace)


def _batches(rows: Iterator[dict], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[dict] = []
    for r in rows:
        part.append(r)
        if len(part) == BATCH:
            yield pa.RecordBatch.from_pylist(part, schema=arrow)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=arrow)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all files of a path (glob, folder, remote), read by Spark and decoded a file a row."""
    return decoded(spark.read.format("binaryFile").load(path).select(F.col("path").alias("trace"), "content"))


def decoded(files: DataFrame) -> DataFrame:
    """files: trace, content. Their packets."""
    ship(files.sparkSession)
    schema = T._parse_datatype_string(S.PACKET)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(rows_of(data.as_py(), name), arrow)

    return files.select("trace", "content").mapInArrow(run, schema)


@dataclass
class Range(InputPartition):
    """Packets first..last of a file, whose headers start at a byte."""

    path: str
    start: int
    end: int
    first: int


class TraceReader(DataSourceReader):
    """Hops from packet header to packet header and cuts the file into byte ranges; executors read only theirs."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.size, self.arrow = options["path"], int(options.get("rangebytes", 32 << 20)), to_arrow_schema(schema)

    def files(self) -> list[str]:
        p = self.path.removeprefix("file://")
        return sorted(os.path.join(p, f) for f in os.listdir(p) if not f.startswith(("_", "."))) if os.path.isdir(p) else [p]

    def partitions(self) -> list[Range]:
        out = []
        for path in self.files():
            with open(path, "rb") as f:
                end = os.fstat(f.fileno()).st_size
                at = start = first = n = 0
                while at < end:
                    f.seek(at)
                    head = f.read(20)
                    key, i = wire.read_varint(head, 0)
                    if key & 7 != 2:
                        raise ValueError(f"{path}: no packet at byte {at}")
                    size, i = wire.read_varint(head, i)
                    at, n = at + i + size, n + (key >> 3 == 1)
                    if at - start >= self.size:
                        out.append(Range(path, start, min(at, end), first))
                        start, first = at, n
                if start < end:
                    out.append(Range(path, start, end, first))
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            f.seek(part.start)
            data = f.read(part.end - part.start)
        rows = (S.to_row(wire.decode("TracePacket", data[a:e]), part.first + i, part.path) for i, (a, e) in enumerate(packet_spans(data)))
        yield from _batches(rows, self.arrow)


@dataclass
class Written(WriterCommitMessage):
    tmp: str
    path: str


class TraceWriter(DataSourceWriter):
    """A file for each task, in packet order; files get their names when the job commits."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].removeprefix("file://"), overwrite, uuid.uuid4().hex[:8]

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        c = TaskContext.get()
        name = f"part-{c.partitionId():05d}-{self.job}.trace"
        tmp = os.path.join(self.path, f".{name}.{c.taskAttemptId()}")
        packets = sorted((r.asDict(recursive=True) for r in rows), key=lambda r: (r["trace"] or "", r["packet_idx"]))
        with open(tmp, "wb") as f:
            for frame in wire.framed(S.to_packet(r) for r in packets):
                f.write(frame)
        return Written(tmp, os.path.join(self.path, name))

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for f in os.listdir(self.path):
                if f.endswith(".trace"):
                    os.remove(os.path.join(self.path, f))
        for m in messages:
            if m is not None:
                os.replace(m.tmp, m.path)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.tmp):
                os.remove(m.tmp)


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        return S.PACKET

    def reader(self, schema) -> TraceReader:
        return TraceReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> TraceWriter:
        return TraceWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TraceSource)


def serialized(packets: DataFrame) -> DataFrame:
    """trace, content: each trace's bytes. Packets are encoded where they are; only bytes of one trace come together."""
    ship(packets.sparkSession)
    schema = T._parse_datatype_string("trace string, packet_idx bigint, frame_bytes binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            frames = wire.framed(S.to_packet(r) for r in rows)
            yield pa.RecordBatch.from_pylist([{"trace": r["trace"], "packet_idx": r["packet_idx"], "frame_bytes": f} for r, f in zip(rows, frames, strict=True)], schema=arrow)

    parts = packets.mapInArrow(run, schema).groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("packet_idx", F.hex("frame_bytes").alias("h")))).alias("p"))
    return parts.select("trace", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("content"))
