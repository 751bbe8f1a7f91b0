"""Near duplicates: SetSketch registers, banding, joint likelihood, exact confirmation, connected components.

A document is the set of its distinct word shingles, as 64-bit hashes of whole shingles. Documents with equal sets (equal digests) are one
class from the start. Each class has m registers, floor(1 - log_b(least exponential variate of its shingles)) cut off to 0..q + 1. Bands
of `rows` registers give buckets: as many registers as let a pair at the threshold miss all bands with a probability of 1e-6 at most (0.85: 32 bands of 6; 0.8: 38 of 5).

Links are found without emitting the pairs of a bucket. First every member is held against the least id of its
bucket. Components of confirmed links then leave few buckets with several components; there every pair across
components, and none other, is compared by registers, in blocks of bounded size, and those likely enough are confirmed. A pair not tested is either in
one component already, shares no bucket, or has an estimate five standard deviations below the threshold.

Confirmation shuffles the texts of candidates to their partner, salted for partners with many candidates, and compares full
sets. Components by least label with pointer jumping, from table to table in the shared folder; nothing of documents comes to the driver.

Nulls: a null or wordless text has an empty set and is linked with nothing. A row with a null id is its own component. Rows with the same id form
one vertex: of several texts with one id, the one whose set has the least hash is compared, and all the id's rows get its component. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, _arrow, map_texts, prepared, shared_dir, tidy, written

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int, keep: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2^64. Up to `keep` of them are kept for the next call."""
    if len(_powers.get("b", ())) < n:
        found = {}
        for k, f in (("b", BASE), ("i", INVERSE)):
            x = np.full(max(n, 1 << 16), f, U)
            x[0] = 1
            found[k] = np.cumprod(x, dtype=U)
        if n > keep:
            return found["b"], found["i"]
        _powers.update(found)
    return _powers["b"][:n], _powers["i"][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of the (lower-cased) bytes; equal words, wherever they stand, have equal hashes."""
    b = np.frombuffer(data, np.uint8)
    sp = SPACE[b]
    edge = np.diff(np.concatenate([[True], sp, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    p, inv = powers(len(b) + 1)
    prefix = np.concatenate([np.zeros(1, U), np.cumsum((b.astype(U) + U(1)) * p[: len(b)], dtype=U)])
    return mix((prefix[ends] - prefix[starts]) * inv[starts] ^ (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)), starts


def shingle_sets(texts: list, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, a wordless one has none."""
    lows = [(t or b"").translate(LOWER) for t in texts]
    w, starts = word_hashes(b"\n".join(lows) + b"\n") if lows else (np.empty(0, U), np.empty(0, np.int64))
    first = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in lows)]))
    if len(w) >= size:
        h = np.zeros(len(w) - size + 1, U)
        for k in range(size):
            h = h * U(0xFF51AFD7ED558CCD) + w[k : len(w) - size + 1 + k]
        h = mix(h)
    out = []
    for a, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - a >= size:
            out.append(np.unique(h[a : e - size + 1]))
        elif e > a:
            x = np.zeros(1, U)
            for k in range(a, e):
                x = x * U(0xC4CEB9FE1A85EC53) + w[k : k + 1]
            out.append(mix(x + U(e - a)))
        else:
            out.append(np.empty(0, U))
    return out


class Sketch:
    """SetSketch of m registers: base b, rate a, values 0..q + 1."""

    def __init__(self, m: int = 192, b: float = 1.02, a: float = 20.0, q: int = 2**11, seed: int = 1):
        self.m, self.b, self.a, self.q = m, b, a, q
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 2**64, m, dtype=U)
        self.times = rng.integers(0, 2**64, m, dtype=U) | U(1)

    def band_rows(self, share: int, miss: float = 1e-6) -> int:
        """Registers of a band: the most with which a pair at the threshold shares no band with a probability of `miss` at most."""
        return max((r for r in range(1, self.m + 1) if (1 - (share / 100) ** r) ** (self.m // r) <= miss), default=1)

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of uint16 for each set; empty sets have zeros."""
        out = np.zeros((len(sets), self.m), np.uint16)
        full = [i for i, s in enumerate(sets) if len(s)]
        at = 0
        while at < len(full):
            n, end = 0, at
            while end < len(full) and (n == 0 or n + len(sets[full[end]]) <= 40_000):
                n += len(sets[full[end]])
                end += 1
            part = [sets[i] for i in full[at:end]]
            h, starts = np.concatenate(part), np.cumsum([0, *map(len, part)])[:-1]
            least, v = np.empty((self.m, len(part)), U), np.empty_like(h)
            for i in range(self.m):
                np.bitwise_xor(h, self.flip[i], out=v)
                np.multiply(v, self.times[i], out=v)
                least[i] = np.minimum.reduceat(v, starts)
            out[full[at:end]] = self.values(least).T
            at = end
        return out

    def values(self, least: np.ndarray) -> np.ndarray:
        u = (least.astype(np.float64) + 0.5) / 2.0**64
        x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / self.a
        return np.clip(np.floor(1 - np.log(x) / math.log(self.b)), 0, self.q + 1).astype(np.uint16)

    def likely(self, na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
        """Maximum-likelihood Jaccard similarity from set sizes and the numbers of registers where a's is greater or less than b's."""
        u, v = na / (na + nb), nb / (na + nb)
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (self.b - 1) / self.b) / math.log(self.b)
        grid = np.linspace(0, 1, 101)[:, None] * np.minimum(u / v, v / u)[None]
        pa_, pb_ = p(u - v * grid), p(v - u * grid)
        tiny = 1e-12
        ll = more * np.log(np.maximum(pa_, tiny)) + less * np.log(np.maximum(pb_, tiny)) + (self.m - more - less) * np.log(np.maximum(1 - pa_ - pb_, tiny))
        return np.take_along_axis(grid, ll.argmax(0)[None], 0)[0]


def sketched(docs: DataFrame, sketch: Sketch, size: int, *, doc: str, text: str) -> DataFrame:
    """doc, th (a hash of the text), digest (null: empty set), n (set size), regs."""

    def fn(texts: list) -> dict:
        sets = shingle_sets(texts, size)
        regs = sketch.registers(sets)
        return {
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "n": [len(s) for s in sets],
            "regs": [r.tobytes() for r in regs],
        }

    return map_texts(with_text(docs, doc, text), fn, "digest binary, n bigint, regs binary", keep=("doc", "th"))


def with_text(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def banded(classes: DataFrame, rows: int) -> DataFrame:
    """key, doc, n, band: a row for each band."""
    prepared(classes.sparkSession)
    schema = T._parse_datatype_string("key bigint, doc bigint, n bigint, band int")
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.stack([np.frombuffer(r, np.uint16) for r in batch.column(2).to_pylist()]).astype(U)
            bands = regs.shape[1] // rows
            keys = np.zeros((len(regs), bands), U)
            for j in range(rows):
                keys = mix(keys * U(0x9FB21C651E98DF25) + regs[:, j : bands * rows : rows] + U(1))
            keys = mix(keys + np.arange(1, bands + 1, dtype=U) * BASE).astype(np.int64)
            doc, n = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), bands) for i in range(2))
            band = np.tile(np.arange(bands, dtype=np.int32), len(regs))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(doc), pa.array(n), pa.array(band)], schema=arrow)

    return classes.select("doc", "n", "regs").mapInArrow(tidy(run), schema)


def chosen(texts: DataFrame, classes: DataFrame, wanted: DataFrame, small_ids: int = 2_000_000) -> DataFrame:
    """doc, text, n, regs of the wanted documents. Up to small_ids ids (16 MB) go to every task, so that only their texts move; more are joined by a shuffle."""
    wanted = wanted.distinct()
    few = wanted.limit(small_ids + 1).count() <= small_ids
    wanted = wanted.join(classes.select("doc", "th"), "doc")
    texts = texts.join(F.broadcast(wanted) if few else wanted, ["doc", "th"], "left_semi")
    return texts.join(classes.select("doc", "n", "regs"), "doc").drop("th")


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, sketch: Sketch, size: int, share: int, salt_rows: int = 500) -> DataFrame:
    """Those of the pairs (a, b) whose sets have 100 * intersection >= share * union. texts: doc, th, text, a row for each class at least."""
    prepared(pairs.sparkSession)
    schema = T._parse_datatype_string("a bigint, b bigint")
    arrow = _arrow(schema)
    floor = share / 100 - 5 * math.sqrt(share / 100 * (1 - share / 100) / sketch.m)
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / salt_rows).cast("int").alias("s"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("s").cast("bigint")).alias("salt"))
    full = chosen(texts, classes, pairs.select(F.explode(F.array("a", "b")).alias("doc")))
    heads = salts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s").cast("bigint") - 1)).alias("salt")).join(full, F.col("a") == F.col("doc"))
    others = salted.join(full, F.col("b") == F.col("doc"))
    cols = ("a", "salt", "doc", "text", "n", "regs")
    rows = heads.select(*cols, F.lit(0).alias("part")).unionByName(others.select(*cols, F.lit(1).alias("part")))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            found = []
            for r in batch.select(["a", "doc", "text", "n", "regs", "part"]).to_pylist():
                regs = np.frombuffer(r["regs"], np.uint16)
                if r["part"] == 0:
                    head = (r["a"], shingle_sets([r["text"]], size)[0], regs)
                    continue
                a, mine, ra = head
                na, nb = len(mine), r["n"]
                if 100 * min(na, nb) < share * max(na, nb):
                    continue
                if sketch.likely(np.array([na]), np.array([nb]), np.array([(ra > regs).sum()]), np.array([(ra < regs).sum()]))[0] < floor:
                    continue
                other = shingle_sets([r["text"]], size)[0]
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= share * (na + nb - both):
                    found.append({"a": a, "b": r["doc"]})
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(tidy(run), schema)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """v, c: the least vertex that each vertex of the edges (a, b) can reach."""
    both = written(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct(), folder, "both")
    now = both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("c"))
    for i in count():
        now = written(now, folder, f"label{i}")
        near = both.join(now.select(F.col("v").alias("w"), "c"), "w").groupBy("v").agg(F.min("c").alias("near"))
        nxt = now.join(near, "v").select("v", F.least("c", "near").alias("c"), F.col("c").alias("was"))
        up = now.select(F.col("v").alias("c"), F.col("c").alias("up"))
        nxt = written(nxt.join(up, "c", "left").select("v", F.least("c", F.coalesce("up", "c")).alias("c"), "was"), folder, f"next{i}")
        if nxt.where("c <> was").isEmpty():
            return now
        now = nxt.drop("was")


def across(members: DataFrame, classes: DataFrame, texts: DataFrame, sketch: Sketch, size: int, share: int, rows: int, block: int = 1000) -> DataFrame:
    """Confirmed links (a, b) across components inside buckets. members: key, band, doc, n, c. Buckets are cut into blocks, and blocks meet pairwise.

    Inside a task, pairs that a link already joined are passed over, so what comes out grows with the documents, not with their
    pairs; each pair is looked at in its first common band only. Sets are compared in full.
    """
    schema = T._parse_datatype_string("a bigint, b bigint")
    arrow = _arrow(schema)
    floor = share / 100 - 5 * math.sqrt(share / 100 * (1 - share / 100) / sketch.m)
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb"))
    m = members.join(sizes, "key").join(chosen(texts, classes, members.select("doc")).drop("n"), "doc")
    m = m.withColumn("blk", F.pmod(F.xxhash64("doc"), F.col("nb").cast("bigint")).cast("int"))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    m = m.select("key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "band", "blk", "doc", "n", "c", "regs", F.col("text").cast("binary").alias("text"))

    def links(table):
        blk, i, j = (table.column(x).to_numpy() for x in ("blk", "i", "j"))
        doc, n, c = (table.column(x).to_numpy() for x in ("doc", "n", "c"))
        regs = np.stack([np.frombuffer(r, np.uint16) for r in table.column("regs").to_pylist()])
        bands, band = regs.shape[1] // rows, int(table.column("band")[0].as_py())
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        values, counts = np.unique(c, return_counts=True)
        usual, sets, out = values[counts.argmax()], {}, []

        def hashes(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_sets([table.column("text")[k].as_py()], size)[0]
            return sets[k]

        for k in np.flatnonzero(c != usual).tolist():
            ok = (c != c[k]) & ((c == usual) | (doc > doc[k])) & (100 * np.minimum(n, n[k]) >= share * np.maximum(n, n[k]))
            if i[0] != j[0]:
                ok &= blk != blk[k]
            at = np.flatnonzero(ok)
            for s in range(0, len(at), 4096):
                part = at[s : s + 4096]
                equal = regs[part] == regs[k]
                part = part[equal[:, : bands * rows].reshape(-1, bands, rows).all(2).argmax(1) == band]
                more, less = (regs[part] > regs[k]).sum(1), (regs[part] < regs[k]).sum(1)
                likely = sketch.likely(n[part].astype(float), np.full(len(part), float(n[k])), more, less) if len(part) else np.empty(0)
                for x in part[np.argsort(-likely)][: int((likely >= floor).sum())].tolist():
                    a, b = root(int(c[k])), root(int(c[x]))
                    if a == b:
                        continue
                    mine, other = hashes(k), hashes(x)
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * both >= share * (len(mine) + len(other) - both):
                        up[max(a, b)] = min(a, b)
                        out.append({"a": int(min(doc[k], doc[x])), "b": int(max(doc[k], doc[x]))})
        return pa.Table.from_pylist(out, schema=arrow)

    return m.groupBy("key", "i", "j").applyInArrow(links, schema).distinct()


def met(buckets: DataFrame, many: DataFrame, total: int, hot_share: int = 2000) -> DataFrame:
    """The rows of buckets whose key is in many, with its columns (a, na, size).

    Buckets with more than one in hot_share of all rows (there are fewer than hot_share of them) go to every task; their rows stay where they are.
    """
    hot = F.col("size") > total / hot_share
    few = many.where(hot).select("key", F.struct("a", "na", "size").alias("h"))
    rest = many.where(~hot).select(F.col("key").alias("k"), F.struct("a", "na", "size").alias("m"))
    b = buckets.join(F.broadcast(few), "key", "left")
    b = b.withColumn("dealt", F.when(F.col("h").isNull(), F.col("key")).otherwise(F.xxhash64("doc", "band")))
    b = b.join(rest, (F.col("dealt") == F.col("k")) & F.col("h").isNull(), "left").withColumn("m", F.coalesce("h", "m"))
    return b.where("m is not null").select("key", "doc", "n", "band", "m.a", "m.na", "m.size")


def near_duplicates(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", size: int = 5, share: int = 85, sketch: Sketch | None = None) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept, class_id (least id of the documents with the same set)."""
    sketch = sketch or Sketch()
    rows = sketch.band_rows(share)
    folder = shared_dir(docs.sparkSession)
    d = written(sketched(docs, sketch, size, doc=doc, text=text), folder, "sketches")
    able = d.where("doc is not null and digest is not null")
    # Ids with several sets, and the hash of the one that is compared.
    several = written(able.groupBy("doc").agg(F.min(F.xxhash64("digest")).alias("own"), F.max(F.xxhash64("digest")).alias("hi")).where("own <> hi").drop("hi"), folder, "several")
    if twice := not several.isEmpty():
        able = able.join(several, "doc", "left").where("own is null or xxhash64(digest) = own").drop("own")
    first = F.min(F.struct("doc", "th")).alias("least")
    classes = able.groupBy("digest").agg(first, F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = written(classes.select("digest", "least.doc", "least.th", "n", "regs"), folder, "classes")
    ids = classes.select("doc", "digest")
    buckets = banded(classes, rows)
    many = buckets.groupBy("key").agg(F.min("doc").alias("a"), F.min_by("n", "doc").alias("na"), F.count(F.lit(1)).alias("size")).where("size > 1")
    many = written(many, folder, "many")
    buckets = written(met(buckets, many, classes.count() * (sketch.m // rows)), folder, "buckets")  # only rows of buckets with several members
    near = f"100 * least(n, na) >= {share} * greatest(n, na)"
    stars = written(buckets.where(f"doc <> a and {near}").select("a", F.col("doc").alias("b")).distinct(), folder, "stars")
    texts = with_text(docs, doc, text).where("doc is not null and text is not null")
    links = written(confirmed(stars, classes, texts, sketch, size, share), folder, "links1")
    found = components(links, f"{folder}/cc1")
    members = buckets.join(found.select(F.col("v").alias("doc"), "c"), "doc", "left").select("key", "band", "doc", "n", F.coalesce("c", "doc").alias("c"))
    mixed = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    # A bucket of two was settled by the first round; its pair need not be looked at again.
    open_ = written(members.join(mixed, "key", "left_semi").join(many.where("size > 2").select("key"), "key", "left_semi"), folder, "open")
    more = written(across(open_, classes, texts, sketch, size, share, rows), folder, "links2")
    if not more.isEmpty():
        found = components(links.union(more), f"{folder}/cc2")
    groups = ids.join(found.select(F.col("v").alias("doc"), "c"), "doc", "left").select(F.col("digest").alias("dg"), F.col("doc").alias("class_id"), F.coalesce("c", "doc").alias("c"))
    out = d.join(groups, (F.col("digest") == F.col("dg")) & F.col("doc").isNotNull(), "left")
    if twice:
        out = out.join(several, "doc", "left")
        chosen_ = out.where("xxhash64(digest) = own").groupBy("doc").agg(F.first("c").alias("c1"), F.first("class_id").alias("k1"))
        out = out.join(chosen_, "doc", "left").withColumns({"c": F.coalesce("c1", "c"), "class_id": F.coalesce("k1", "class_id")})
    comp = F.coalesce("c", "doc")
    return out.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc").eqNullSafe(comp).alias("kept"), F.coalesce("class_id", "doc").alias("class_id"))


def deduplicated(docs: DataFrame, *, doc: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, without those that another of their component stands for. Of several rows with one id one stays, that with the least hash."""
    gone = near_duplicates(docs, doc=doc, **options).where("not kept").select(F.col(doc).alias("__gone"))
    left = docs.join(gone, F.col(f"`{doc}`") == F.col("__gone"), "left_anti")
    often = docs.groupBy(F.col(f"`{doc}`").alias("__often")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1 and __often is not null").select("__often")
    often = written(often, shared_dir(docs.sparkSession), "often")
    if often.isEmpty():
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = left.join(often, F.col(f"`{doc}`") == F.col("__often"), "left_semi").groupBy(F.col(f"`{doc}`").alias("__id")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row"))
    return left.join(often, F.col(f"`{doc}`") == F.col("__often"), "left_anti").unionByName(one.select("__row.*"))
