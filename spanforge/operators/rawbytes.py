"""Forensics on raw bytes: printable runs, patterns in context, numbers, naive fields, hex dumps.

Files come as rows with a binary column. Runs, numbers and dumps are expressions on that value; the search for a pattern and the scan of every varint, which
depends on where the last one ended, are Arrow functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship


def strings(files: DataFrame, content: str = "content", least: int = 4) -> DataFrame:
    """Maximal runs of bytes 32..126 with `least` or more; adds nr (0, 1, ...) and value."""
    text = F.decode(F.col(content), "ISO-8859-1")
    return files.select(*[c for c in files.columns if c != content], F.posexplode(F.regexp_extract_all(text, F.lit(f"([\\x20-\\x7E]{{{least},}})"), F.lit(1))).alias("nr", "value"))


def matches(files: DataFrame, pattern: bytes, content: str = "content", before: int = 0, after: int = 0) -> DataFrame:
    """A row per match, overlapping ones too: the other columns, position, and up to so many bytes before and after. No match carries the content."""
    ship(files.sparkSession)
    others = [c for c in files.columns if c != content]
    schema = T.StructType([files.schema[c] for c in others] + T._parse_datatype_string("position int, before binary, after binary").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, ahead, behind = [], [], [], []
            for i, data in enumerate(batch.column(len(others))):
                data = data.as_py() or b""
                p = data.find(pattern)
                while p >= 0:
                    row.append(i)
                    at.append(p)
                    ahead.append(data[max(0, p - before) : p])
                    behind.append(data[p + len(pattern) : p + len(pattern) + after])
                    p = data.find(pattern, p + 1)
            found = [batch.column(i).take(pa.array(row, pa.int32())) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*found, pa.array(at, pa.int32()), pa.array(ahead, pa.binary()), pa.array(behind, pa.binary())], schema=arrow)

    return files.select(*others, F.col(content).cast("binary").alias(content)).mapInArrow(run, schema)


def occurrences(files: DataFrame, pattern: bytes, content: str = "content", around: int = 20) -> DataFrame:
    """A row per match: position, before and after (up to `around` bytes, as hex)."""
    return matches(files, pattern, content, around, around).withColumns({"before": F.hex("before"), "after": F.hex("after")})


def number_at(content: Column, at: Column, size: int, endian: str = "<") -> Column:
    """An unsigned number of `size` bytes, decimal for eight bytes; null if it passes the end."""
    part = F.substring(content, at + 1, F.lit(size))
    h = F.hex(part)
    if endian == "<":
        h = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])
    value = F.conv(h, 16, 10).cast("decimal(20,0)" if size > 7 else "bigint")
    return F.when(F.octet_length(part) == size, value)


def numbers(files: DataFrame, pattern: bytes, size: int = 2, content: str = "content", endian: str = "<") -> DataFrame:
    """A row per match that a whole number follows: position, number."""
    e = matches(files, pattern, content, 0, size)
    return e.withColumn("number", number_at(F.col("after"), F.lit(0), size, endian)).where("number is not null").drop("before", "after")


def varints(data: bytes) -> tuple[np.ndarray, list[int]]:
    """Ends and values of the base-128 numbers one after another; the last one may be cut off by the end."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if len(b) and (not len(ends) or ends[-1] != len(b) - 1):
        ends = np.append(ends, len(b) - 1)
    values, at = [], 0
    for e in ends.tolist():
        v = 0
        for i in range(e, at - 1, -1):
            v = v << 7 | (data[i] & 127)
        values.append(v)
        at = e + 1
    return ends, values


def fields(files: DataFrame, content: str = "content", most: int = 1000) -> DataFrame:
    """Every varint taken as a header: field and wire type, of those with 0 < field < most, with their counts by file. Adds field, wire, n."""
    ship(files.sparkSession)
    keep = [c for c in files.columns if c != content]
    schema = T.StructType([*[files.schema[c] for c in keep], *T._parse_datatype_string("field int, wire int, n bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data in enumerate(batch.column(len(keep)).to_pylist()):
                counts: dict[tuple[int, int], int] = {}
                for v in varints(data or b"")[1]:
                    if 0 < v >> 3 < most:
                        counts[v >> 3, v & 7] = counts.get((v >> 3, v & 7), 0) + 1
                rows += [(i, f, w, n) for (f, w), n in counts.items()]
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column(j).take(at) for j in range(len(keep))] + [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return files.select(*keep, content).mapInArrow(run, schema)


def hexdump(files: DataFrame, content: str = "content", offset: int = 0, length: int = 256) -> DataFrame:
    """Lines of sixteen bytes: line (its address) and text, `00000010  41 42 ...  AB`."""
    c = F.substring(F.col(content), offset + 1, length)
    n = F.octet_length(c)
    e = files.withColumn("__c", c).withColumn("line", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(16))).otherwise(F.array().cast("array<int>"))))
    part = F.substring(F.col("__c"), F.col("line") + 1, F.lit(16))
    pairs = F.rtrim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "))
    shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".")
    text = F.concat(F.lpad(F.lower(F.hex(F.col("line").cast("bigint") + offset)), 8, "0"), F.lit("  "), F.rpad(pairs, 48, " "), F.lit("  "), shown)
    return e.withColumns({"text": text, "line": F.col("line") + offset}).drop("__c", content)
