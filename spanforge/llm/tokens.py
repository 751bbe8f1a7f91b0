"""Token ids of whole documents in a binary format with a shared zstandard dictionary.

A data set is a folder: `dictionary` (trained on serialized id arrays of a bounded sample) and shard files in ascending
doc_id order. A shard holds, after a header with magic, id width and the dictionary's SHA-256, one zstandard frame per document, then an
index row per document (id, offset, length, tokens), then a footer with the index's place. A reader of one document reads footer, index row and
frame; it refuses a shard whose dictionary hash differs.

Encoding: text is cut at ASCII white space, which the tokenizer drops, and every distinct word is encoded once per
worker (a cache of bounded size); this gives the same ids as whole texts do, and tests hold it to that.

Nulls: a null text is the empty document (just the end id); a null doc_id sorts first and is kept as null. Repeated rows are written
as often as they come. An empty table gives a folder without shards and no rows.
"""

from __future__ import annotations

import gc
import hashlib
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, _arrow, chunks, map_texts, prepared, shared_dir, tidy

MAGIC, HEAD, ROW, FOOT = b"IDZ1", struct.Struct("<4sB3x32s"), struct.Struct("<?7xqQQQ"), struct.Struct("<QQQ4s4x")
NO_ID = 0


def opened(uri: str):
    """File system and path; the folder may be in any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Encoder:
    """Ids of whole texts by a tokenizer that drops white space; serialized little-endian, `width` bytes an id.

    Words are known in two generations of about `cache_bytes`: when the young one is full, it becomes the old one, so that frequent words stay.
    """

    #: What a word takes beside its bytes and its ids: two objects and its place in the dictionary.
    ENTRY = 170

    #: ASCII punctuation that, after a letter at a word's end, is a piece of its own; without the apostrophe.
    TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, cache_bytes: int = 32 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 2**16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.most, self.size = cache_bytes, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        """Encodes words joined by spaces and cuts the ids at word ends."""
        for at in range(0, len(words), 2000):
            part = [w.decode() for w in words[at : at + 2000]]
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            enc = self.tok.encode(" ".join(part), add_special_tokens=False)
            first = np.array([o[0] for o in enc.offsets], np.int64)
            cut = np.searchsorted(first, starts) * self.width
            data = np.array(enc.ids, self.kind).tobytes()
            for w, a, b in zip(words[at : at + 2000], cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                self.know(w, data[a:b])

    def know(self, word: bytes, ids: bytes) -> None:
        self.young[word] = ids
        self.size += len(word) + len(ids) + self.ENTRY

    def need(self, words: set[bytes]) -> None:
        young, old, learn, joined = self.young, self.old, set(), []
        for w in words:
            if (x := old.get(w)) is not None:
                self.know(w, x)
                continue
            stem = w.rstrip(self.TAIL)
            if stem and len(stem) < len(w) and b"<|" not in w and (97 <= stem[-1] <= 122 or stem[-1] >= 128 and self.ends_in_letter(stem)):
                joined.append((w, stem, w[len(stem) :]))
                learn.update(x for x in joined[-1][1:] if x not in young)
            else:
                learn.add(w)
        for w in [w for w in learn if w in old]:
            self.know(w, old[w])
            learn.discard(w)
        self.learn(list(learn))
        for w, stem, tail in joined:
            self.know(w, young[stem] + young[tail])

    @staticmethod
    def ends_in_letter(word: bytes) -> bool:
        """As the tokenizer sees it: some characters become a letter and a mark, which joins the punctuation after it."""
        return unicodedata.normalize("NFC", word.decode()).lower()[-1:].isalpha()

    def __call__(self, texts: list) -> list[bytes]:
        """Millions of small objects and no cycles: the collector, which would look through them again and again, stands still meanwhile."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self.encoded(texts)
        finally:
            if on:
                gc.enable()

    def encoded(self, texts: list) -> list[bytes]:
        # A combining mark can join a capital in another way than its small letter: such texts keep their capitals.
        split = [(t if b"\xcc" in t or b"\xcd" in t or b"<|" in t else t.translate(LOWER)).split() if t else [] for t in texts]
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        known = self.young
        if new := set().union(*split).difference(known):
            self.need(new)
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process, so that its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(ids: bytes, width: int, most: int, count: int = 8) -> list[bytes]:
    """All of a document's ids or, of one of over `most` bytes, `count` pieces spread evenly over the whole."""
    if len(ids) <= most:
        return [ids]
    size = max(1, most // count // width) * width
    step = (len(ids) - size) // (count - 1) // width * width
    return [ids[k * step : k * step + size] for k in range(count)]


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary in zstandard's format; with too few samples to train on, their content is the dictionary."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples) or b"\0" * 8)[-size:].ljust(8, b"\0")


class Shard:
    """Writes documents to a file that appears under its name only when complete."""

    def __init__(self, uri: str, width: int, dictionary: bytes, level: int):
        self.fs, self.path = opened(uri)
        self.tmp = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.tmp, buffer_size=1 << 20)
        self.zip = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.at, self.index, self.tokens, self.width = HEAD.size, [], 0, width
        self.out.write(HEAD.pack(MAGIC, width, hashlib.sha256(dictionary).digest()))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zip.compress(ids)
        self.out.write(frame)
        self.index.append(ROW.pack(doc_id is None, doc_id or NO_ID, self.at, len(frame), len(ids) // self.width))
        self.at += len(frame)
        self.tokens += len(ids) // self.width

    def close(self) -> tuple[int, int]:
        self.out.write(b"".join(self.index))
        self.out.write(FOOT.pack(self.at, len(self.index), self.tokens, MAGIC))
        self.out.close()
        self.fs.move(self.tmp, self.path)
        return len(self.index), self.tokens


class Reader:
    def __init__(self, uri: str, dictionary: bytes):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        magic, self.width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        self.index_at, self.n, self.tokens, end = FOOT.unpack(self.file.read_at(FOOT.size, self.file.size() - FOOT.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{uri}: not a token shard, or cut off")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: written with another dictionary")
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.kind = np.dtype(f"<u{self.width}")

    def ids(self, i: int) -> tuple[int | None, np.ndarray]:
        """The i-th document alone: two small reads."""
        null, doc, at, size, n = ROW.unpack(self.file.read_at(ROW.size, self.index_at + i * ROW.size))
        return (None if null else doc), self._ids(self.file.read_at(size, at), n)

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.unzip.decompress(frame, max_output_size=n * self.width), self.kind)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        step, buf, start = 4 << 20, b"", 0
        for k in range(0, self.n, 4096):
            rows = self.file.read_at(ROW.size * min(4096, self.n - k), self.index_at + k * ROW.size)
            for null, doc, at, size, n in ROW.iter_unpack(rows):
                if at < start or at + size > start + len(buf):
                    start, buf = at, self.file.read_at(max(step, size), at)
                yield (None if null else doc), self._ids(buf[at - start : at - start + size], n)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 1, dictionary_bytes: int = 64 << 10, sample_docs: int = 1000, sample_bytes: int = 4 << 20, shard_bytes: int = 256 << 20, level: int = 3, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Writes every document; returns the manifest (part, shard, file, n_docs, n_tokens), itself a table in the folder.

    The dictionary is trained on the ids of at most sample_docs whole documents (those with the smallest hash of their id), of a document of over
    sample_bytes / sample_docs bytes on pieces from all over it; what is written covers every whole text.
    """
    prepared(docs.sparkSession)
    width = encoder(tokenizer).width
    end = np.array([end_id], encoder(tokenizer).kind).tobytes()
    hashed = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(doc)).alias("h"), F.col(text).alias("t"))
    bound = hashed.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    sample = hashed.where(F.lit(False) if bound is None else F.col("h") <= bound).orderBy("h", F.xxhash64("t")).limit(sample_docs)
    cut = lambda texts: {"p": [pieces(x + end, width, sample_bytes // sample_docs) for x in encoder(tokenizer)(texts)]}
    found = map_texts(sample, cut, "p array<binary>", keep=("h",), text="t").collect()
    dictionary = trained([bytes(x) for r in sorted(found, key=lambda r: (r.h, r.p)) for x in r.p], dictionary_bytes)
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary") as f:
        f.write(dictionary)
    schema = T._parse_datatype_string("part int, shard int, file string, n_docs bigint, n_tokens bigint")
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, k, out, size = encoder(tokenizer), TaskContext.get().partitionId(), 0, None, 0
        rows = []
        for batch in chunks(batches, 1):
            for i, ids in zip(batch.column(0).to_pylist(), enc(batch.column(1).to_pylist()), strict=True):
                if out is None:
                    name = f"{folder}/part-{part:06d}-{k:04d}.ids"
                    out, size = Shard(name, enc.width, dictionary, level), 0
                out.add(i, ids + end)
                size += len(ids)
                if size >= shard_bytes:
                    rows.append((part, k, name, *out.close()))
                    out, k = None, k + 1
        if out is not None:
            rows.append((part, k, name, *out.close()))
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=arrow)

    d = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    tie = F.xxhash64("t")
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "t")
    d.mapInArrow(tidy(run), schema).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(schema).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, dictionary: bytes, fn: Callable[[np.ndarray], dict], fields: str) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids before it), n_tokens, and what fn gives for its ids."""
    prepared(manifest.sparkSession)
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    schema = T.StructType(T._parse_datatype_string("doc_id bigint, start bigint, n_tokens bigint").fields + T._parse_datatype_string(fields).fields)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                rows = []
                for i, ids in Reader(file, dictionary):
                    rows.append({"doc_id": i, "start": start, "n_tokens": len(ids)} | fn(ids))
                    start += len(ids)
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("file", "start").repartition(max(1, min(10_000, manifest.count()))).mapInArrow(tidy(run), schema)


def crc(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def token_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the documents below the shared folder and reads all of them back from the files."""
    folder = f"{shared_dir(docs.sparkSession)}/tokens"
    manifest = write_tokens(docs, folder, tokenizer, **options)
    fs, path = opened(folder)
    with fs.open_input_stream(f"{path}/dictionary") as f:
        dictionary = f.read()
    return read_tokens(manifest, dictionary, crc, "ids_crc32 bigint")
