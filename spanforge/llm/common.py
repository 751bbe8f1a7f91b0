"""What the corpus operators share: words, batches of whole texts, the shared folder."""

from __future__ import annotations

import ctypes
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder, ship

#: A word is a run of characters other than space and TAB..CR; bytes.split() cuts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A new folder below spark.checkpoint.dir.
shared_dir = shared_folder


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def prepared(spark: SparkSession) -> None:
    """Ships the package. Arrow batches of whole texts are kept to a few MB, unless the session says how large they are."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(4 << 20))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], held: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function. At the end of a task its process, which waits for the next stage, gives back the memory that it does not use; until then what was freed is kept for the next
    array (`held` bytes), as its pages would have to be fetched again."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            if held and (option := getattr(ctypes.CDLL(None), "mallopt", None)):
                option(-1, held)  # M_TRIM_THRESHOLD
                option(-3, 32 << 20)  # M_MMAP_THRESHOLD
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


#: Bytes that go on a character of several bytes.
CONTINUATION = bytes(range(0x80, 0xC0))


def code_points(text: bytes, places: list[int]) -> dict[int, int]:
    """The character at which each of the byte places stands, in one pass over the text."""
    out, last, n = {}, 0, 0
    for a in sorted(set(places)):
        n += len(text[last:a].translate(None, CONTINUATION))
        out[a], last = n, a
    return out


def clear(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of the spans (kind, start, end) that overlap none of the taken ones."""
    by_start = sorted((a, e) for _, a, e in taken)
    starts, ends = [a for a, _ in by_start], list(accumulate((e for _, e in by_start), max))
    return [x for x in spans if not (i := bisect_left(starts, x[2])) or ends[i - 1] <= x[1]]


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts (a binary column) have about `most` bytes; a longer text comes alone."""
    for batch in batches:
        col, at, size = batch.column(text), 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < len(sizes):
            yield batch.slice(at)


def map_texts(
    docs: DataFrame,
    fn: Callable[[list], dict],
    fields: str,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    setup: Callable[[], Callable[[list], dict]] | None = None,
    chunk_bytes: int = 1 << 20,
    held: int = 0,
) -> DataFrame:
    """Rows of `keep` columns and of what fn gives for the whole texts (bytes, or None for null), a list per field.

    setup, if given, runs once a task and returns fn; texts come in runs of about chunk_bytes. Only `keep` and the text are read, so other columns can't clash.
    """
    prepared(docs.sparkSession)
    out = T._parse_datatype_string(fields)
    schema = T.StructType([docs.schema[c] for c in keep] + out.fields)
    names = [f.name for f in out.fields]
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = setup() if setup else fn
        for part in chunks(batches, len(keep), chunk_bytes):
            got = f(part.column(len(keep)).to_pylist())
            cols = [part.column(i) for i in range(len(keep))] + [got[n] for n in names]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("binary").alias("__text")).mapInArrow(tidy(run, held), schema)


def filter_texts(docs: DataFrame, setup: Callable[[], Callable[[list], list]], *, text: str = "text") -> DataFrame:
    """The rows, with all their columns, for whose text the function that setup returns gives True."""
    prepared(docs.sparkSession)
    schema, docs_names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = setup()
        n = len(schema.fields)
        for part in chunks(batches, n):
            kept = part.filter(pa.array(f(part.column(n).to_pylist()), pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:n], names=docs_names)

    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs_names)], F.col(f"`{text}`").cast("binary").alias("__text")).mapInArrow(tidy(run), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
