"""Repeated byte strings across a corpus, by a collection Burrows-Wheeler transform built column by column.

A string of `length` bytes is a window. Windows are dealt out by content: each goes to the least hash of its `gram`-byte substrings (its
anchor), so equal windows meet and the work is spread over the cluster. Successive windows of a document with the same anchor form a
fragment, shorter than twice the length. Only anchors that occur at least twice are followed up. Of fragments equal in full `copies` go on from a task,
and `copies` of those that meet, the earliest ones; further ones stand after them, so they are removed at once, and a passage that a third of all documents
share is no hot key. A text that equals an earlier one in full is removed before all this. For an anchor with more than `hot` occurrences every window is dealt out by the hash of the whole window.

The fragments that meet are a collection of short strings. In round j the suffixes of length j of all strings are inserted, one symbol per
string: where the new suffix goes follows from the symbol's rank in the transform so far, and its common prefix with both neighbours from
the least of the former common prefixes between. Transform and common prefixes are a tape, read and written from front to end in blocks: what a block needs of those
before it are counts and minima by symbol. A tape of over `memory` bytes goes on in a file of the shared folder. String and start of each
suffix follow at the end by going back through the transform. Runs of common prefixes of at least `length` are then the groups of equal windows; all but the first
occurrence (by doc_id, then start) are removed.

Nulls: a null text is empty; a null doc_id counts as the smallest. Rows with one id and one text are one document and get the same result;
different texts with one id are ordered by their hash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _arrow, chunks, prepared, shared_dir, tidy, written

U = np.uint64
TOP = np.uint8(255)
#: A symbol and, as the upper byte, a common prefix.
PAIR = np.dtype("<u2")


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` (a power of two) bytes from each place; places near the end have none."""
    h, size = b.astype(U), 1
    h += U(1)
    while size < gram:
        longer = h[:-size] * U(pow(0x9E3779B97F4A7C15, size, 2**64))
        longer += h[size:]
        h, size = longer, 2 * size
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def anchors(data: bytes, sizes: list[int], length: int, gram: int, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of the texts in data: text number, first window, number of windows (all from the text's start), anchor hash.

    Anchors are found for `block` windows at a time, so that what is computed on stays in the processor's cache.
    """
    b = np.frombuffer(data, np.uint8)
    windows = len(b) - length + 1
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    some = ends - starts >= length
    if not some.any():
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, U)
    # Runs of windows with one anchor, of the texts put together.
    first, place, hashes = [], [], []
    for lo in range(0, windows, block):
        v = gram_hashes(b[lo : min(lo + block, windows) + length - 1], gram)
        p = least_places(v, length - gram + 1)
        at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        p = p[at]
        first.append(at + lo)
        place.append(p + lo)
        hashes.append(v[p])
    first, place, hashes = np.concatenate(first), np.concatenate(place), np.concatenate(hashes)
    new = np.concatenate([[True], place[1:] != place[:-1]])  # a run goes on over the end of a block
    first, hashes = first[new], hashes[new]
    # Texts begin and end runs; windows over the end of a text are none.
    last = ends[some] - length + 1
    cut = np.unique(np.concatenate([first, starts[some], last]))
    count = np.diff(np.append(cut, windows))
    doc = np.searchsorted(ends, cut, side="right")
    doc[doc == len(ends)] = 0  # only after the last window
    own = cut + length <= ends[doc]
    cut, doc = cut[own], doc[own]
    return doc, cut - starts[doc], count[own], hashes[np.searchsorted(first, cut, side="right") - 1]


def least_places(v: np.ndarray, width: int, bits: int = 24) -> np.ndarray:
    """Of each run of `width` hashes the place of the least, by all but its lowest bits; of equal ones the first.

    Hash and place are one number, so that a pass is one minimum; where the places need more bits, they are compared apart.
    """
    step, n = U(bits), len(v)
    packed = n <= 1 << bits
    least = v >> step << step | np.arange(n, dtype=U) if packed else v >> step
    place = None if packed else np.arange(n)

    def against(by: int) -> None:
        nonlocal least, place
        if packed:
            least = np.minimum(least[:-by], least[by:])
        else:
            less = least[by:] < least[:-by]
            least, place = np.where(less, least[by:], least[:-by]), np.where(less, place[by:], place[:-by])

    size = 1
    while 2 * size <= width:
        against(size)
        size *= 2
    if width > size:
        against(width - size)
    return (least & (U(1 << bits) - U(1))).view(np.int64) if packed else place


class Tape:
    """Symbols, each with a common prefix as its upper byte, written once from front to end, then read from front to end, in blocks of `block` symbols. Over `memory` bytes they go on in a file of the folder."""

    def __init__(self, folder: str, memory: int, block: int):
        self.folder, self.memory, self.block = folder, memory, block
        self.parts: list[np.ndarray] = []
        self.size, self.path, self.out = 0, None, None

    def write(self, x: np.ndarray) -> None:
        self.size += len(x)
        for at in range(0, len(x), self.block):
            self.parts.append(x[at : at + self.block])
        if 2 * self.size > self.memory:
            if self.out is None:
                self.fs, folder = pa_fs.FileSystem.from_uri(self.folder)
                self.fs.create_dir(folder, recursive=True)
                self.path = f"{folder}/{uuid.uuid4().hex}"
                self.out = self.fs.open_output_stream(self.path)
            for part in self.parts:
                self.out.write(part.tobytes())
            self.parts = []

    def close(self) -> None:
        if self.out is not None:
            self.out.close()

    def blocks(self) -> Iterator[np.ndarray]:
        if self.path is None:
            yield from self.parts
            return
        with self.fs.open_input_stream(self.path) as f:
            while data := f.read(2 * self.block):
                yield np.frombuffer(data, PAIR)

    def remove(self) -> None:
        if self.path is not None:
            self.fs.delete_file(self.path)


def least_between(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of x[a..b] for each pair, with a <= b. x ends with one value more. From the back to the front, so that nothing lies between one range and the next."""
    out = np.empty(len(a), x.dtype)
    if len(a):
        order = np.argsort(-a)
        ends = np.stack([a[order], b[order] + 1], 1).ravel()
        out[order] = np.minimum.reduceat(x, ends)[::2]
    return out


class Transform:
    """The transform and common prefixes of strings of up to 254 bytes, none empty."""

    def __init__(self, strings: list[bytes], folder: str, *, memory: int = 32 << 20, block: int = 1 << 20):
        self.n = len(strings)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.width = int(self.sizes.max())
        # Right-aligned; 0 is the end mark, and UTF-8 has no byte above 0xF4, so every symbol moves up by one.
        rows = np.frombuffer(b"".join(s.rjust(self.width, b"\xff") for s in strings), np.uint8).reshape(self.n, self.width)
        self.text = np.ascontiguousarray((rows + np.uint8(1)).T)
        self.new_tape = lambda: Tape(folder, memory, block)
        self.tape = self.new_tape()

    def symbol(self, j: int) -> np.ndarray:
        """What precedes the suffixes of length j; 0 at a string's start."""
        return self.text[self.width - 1 - j] if j < self.width else np.zeros(self.n, np.uint8)

    def build(self) -> tuple[np.ndarray, np.ndarray]:
        """The transform and, for each suffix in order, its common prefix with the one before."""
        self.tape.write(self.symbol(0).astype(PAIR))
        self.tape.close()
        self.count = np.bincount(self.symbol(0), minlength=256)
        place = live = np.arange(self.n)  # of the strings that get a symbol this round, in order of place
        for j in range(1, self.width + 1):
            c = self.symbol(j - 1)[live]
            rank, low, high = self.ranked(place, c)
            order = np.argsort(c, kind="stable")  # by symbol, and in each by place: the order of the new suffixes
            c, live = c[order], live[order]
            to = self.n - self.count[0] + (np.cumsum(self.count) - self.count)[c] + rank[order]
            symbol = self.symbol(j)[live]
            self.insert(to, symbol, (low[order] + 1).astype(np.uint8), (high[order] + 1).astype(np.uint8))
            more = symbol != 0
            place, live = to[more], live[more]
            if not len(live):
                break
        t = np.concatenate(list(self.tape.blocks()))
        self.tape.remove()
        return t.astype(np.uint8), (t >> 8).astype(np.uint8)

    def ranked(self, place: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For places in ascending order and the symbols there: the symbol's occurrences before; the least common prefix after its last occurrence up
        to the place, and after the place up to its next (-1: there is none)."""
        rank = np.empty(len(place), np.int64)
        low, high = np.full(len(place), -1, np.int16), np.full(len(place), -1, np.int16)
        count = np.zeros(256, np.int64)
        since = np.full(256, TOP)  # the least common prefix after a symbol's last occurrence
        waits, least = np.full(256, -1), np.full(256, TOP)  # the place whose symbol has not come again, and the least since
        at = base = 0
        for t in self.tape.blocks():
            b, x = t.astype(np.uint8), np.append((t >> 8).astype(np.uint8), TOP)
            # The transform of repeated text is made of long runs of one symbol; they are put in order, not the symbols.
            run = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1])
            long = np.diff(np.append(run, len(b)))
            own = b[run]
            order = np.argsort(own, kind="stable")
            many = np.bincount(own, minlength=256)
            start = np.cumsum(many) - many
            before = np.concatenate([[0], np.cumsum(long[order])])  # symbols in the runs before, in order
            size = before[start + many] - before[start]
            several = len(b) < self.tape.size
            if several:
                here, gone = np.flatnonzero(size), size == 0
                first, last = run[order[start[here]]], order[start[here] + many[here] - 1]
                last = run[last] + long[last] - 1
                head, tail = np.minimum.accumulate(x[:-1]), np.minimum.accumulate(x[::-1])[::-1]
                came = waits[here] >= 0
                high[waits[here[came]]] = np.minimum(least[here[came]], head[first[came]])
                waits[here] = -1
                least[gone] = np.minimum(least[gone], head[-1])
            end = at + int(np.searchsorted(place[at:], base + len(b)))
            if end > at:
                p, s = place[at:end] - base, c[at:end]
                r = np.searchsorted(run, p, side="right") - 1
                stands = np.empty(len(run), np.int64)
                stands[order] = np.arange(len(run))
                i = stands[r]
                rank[at:end] = count[s] + before[i] - before[start[s]] + p - run[r]
                # Before the place: the symbol itself, else its run before, else one of an earlier block, else none.
                found, own_low = p > run[r], x[p].astype(np.int16)
                far = np.flatnonzero(~found & (i > start[s]))
                prior = order[i[far] - 1]
                own_low[far] = least_between(x, run[prior] + long[prior], p[far])
                none = np.flatnonzero(~found & (i == start[s]))
                own_low[none] = -1
                if several:
                    none = none[count[s[none]] > 0]
                    own_low[none] = np.minimum(since[s[none]], head[p[none]])
                low[at:end] = own_low
                found, own_high = p + 1 < run[r] + long[r], x[p + 1].astype(np.int16)
                far = np.flatnonzero(~found & (i + 1 < start[s] + many[s]))
                own_high[far] = least_between(x, p[far] + 1, run[order[i[far] + 1]])
                none = np.flatnonzero(~found & (i + 1 == start[s] + many[s]))
                own_high[none] = -1
                high[at:end] = own_high
                if several:
                    waits[s[none]], least[s[none]] = at + none, tail[p[none] + 1]
            if several:
                since[gone] = np.minimum(since[gone], head[-1])
                since[here] = tail[last + 1]
            count += size
            at, base = end, base + len(b)
        return rank, low, high

    def insert(self, to: np.ndarray, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Puts suffixes at their places: the symbol before each, its common prefix with the one before, and that of the one after."""
        into = to - np.arange(len(to))  # the old suffix before which it goes
        fresh = symbol | low.astype(PAIR) << 8
        tape, at, base = self.new_tape(), 0, 0
        for t in self.tape.blocks():
            size = len(t)
            end = len(into) if base + size == self.tape.size else at + int(np.searchsorted(into[at:], base + size))
            if end > at:
                i = into[at:end] - base
                final = np.append(i[1:] != i[:-1], True) & (i < size)  # the last one before an old suffix
                t, after = t.copy(), i[final]
                t[after] = t[after] & 255 | high[at:end][final].astype(PAIR) << 8
                new = i + np.arange(len(i))
                old = np.ones(size + len(i), bool)
                old[new] = False
                now = np.empty(len(old), PAIR)
                now[old], now[new] = t, fresh[at:end]
                t = now
            tape.write(t)
            at, base = end, base + size
        tape.close()
        self.tape.remove()
        self.tape = tape
        self.count = self.count + np.bincount(symbol, minlength=256)

    def suffixes(self, bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """String and length of each suffix in order, by going back from every string's end through the transform."""
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sid, size = np.empty(len(bwt), np.int32), np.zeros(len(bwt), np.uint8)
        place, live = np.arange(self.n), np.arange(self.n, dtype=np.int32)
        sid[place] = live
        for j in range(1, self.width + 1):
            live_now = self.sizes[live] >= j
            live, place = live[live_now], rank[place[live_now]]
            sid[place], size[place] = live, j
        return sid, size


def repeats(strings: list[bytes], where: list[tuple], length: int, folder: str) -> list[tuple[int, int, int]]:
    """(string, start, end) of what windows cover that another one equals which stands earlier. where: what orders the strings' places, ending with the start."""
    if len(strings) < 2:
        return []
    t = Transform(strings, folder)
    bwt, lcp = t.build()
    same = lcp >= length
    if not same.any():
        return []
    sid, size = t.suffixes(bwt)
    # Of each group, the window that stands first: places as ranks, in the order of where.
    by = sorted(range(len(strings)), key=lambda i: where[i][:-1])
    doc = np.empty(len(strings), np.int64)
    n = -1
    for k, i in enumerate(by):
        n += k == 0 or where[i][:-1] != where[by[k - 1]][:-1]
        doc[i] = n
    edge = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts) + np.arange((ends - starts).sum())
    group = np.repeat(np.arange(len(starts)), ends - starts)
    s = sid[at].astype(np.int64)
    start = t.sizes[s] - size[at]
    key = doc[s] << 32 | (np.array([w[-1] for w in where], np.int64)[s] + start)
    first = np.full(len(starts), np.iinfo(np.int64).max)
    np.minimum.at(first, group, key)
    later = key > first[group]
    s, start = s[later], start[later]
    order = np.lexsort((start, s))
    s, start = s[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (start[1:] > start[:-1] + length)])) if len(s) else np.empty(0, np.int64)
    end = start[np.append(new[1:], len(s)) - 1] + length if len(s) else new
    return list(zip(s[new].tolist(), start[new].tolist(), end.tolist(), strict=True))


def settled(strings: list[bytes], where: list[tuple], length: int, folder: str) -> list[tuple]:
    """(doc, uid, first byte, end) of windows to remove among fragments that met; where: (doc, uid, start)."""
    return [(*where[s][:2], where[s][2] + a, where[s][2] + e) for s, a, e in repeats(strings, where, length, folder)]


def copies_of_texts(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """doc, uid, size of every text of `length` bytes or more; and uid of those that equal (by 128 bits) an earlier one. No join is on the text, so a text that many have is no hot key."""
    whole = docs.where(F.octet_length("text") >= length).select("doc", "uid", F.octet_length("text").alias("size"), F.md5("text").alias("m"))
    firsts = whole.groupBy("m").agg(F.min(F.struct("doc", "uid")).alias("f")).select("f.uid")
    return whole.drop("m"), whole.select("uid").join(firsts, "uid", "left_anti").distinct()


def removed_spans(docs: DataFrame, *, length: int, gram: int, hot: int, copies: int, bucket_bytes: int, small_hashes: int, small_copies: int = 1_000_000) -> DataFrame:
    """doc, uid, spans (first byte, end, whether the transform found it) to remove. docs: doc (not null), uid, text (binary)."""
    prepared(docs.sparkSession)
    folder = f"{shared_dir(docs.sparkSession)}/tapes"
    # Copies of whole texts are removed at once; up to small_copies of their ids go to every task.
    whole, later = copies_of_texts(docs, length)
    later = written(later, shared_dir(docs.sparkSession), "copies")
    few = F.broadcast(later) if later.limit(small_copies + 1).count() <= small_copies else later
    of_copies = whole.join(few, "uid", "left_semi").select("doc", "uid", F.lit(0).alias("a"), F.col("size").alias("e"), F.lit(False).alias("built")).distinct()
    docs = docs.join(few, "uid", "left_anti").select("doc", "uid", "text")

    count_schema = T._parse_datatype_string("h bigint, n int")
    count_arrow = _arrow(count_schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors of some texts, and how often they come."""
        for batch in chunks(batches, 0):
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            h, n = np.unique(anchors(b"".join(texts), [len(t) for t in texts], length, gram)[3].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int32))], schema=count_arrow)

    each = docs.select("text").mapInArrow(tidy(counted), count_schema)
    many = written(each.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h", (F.col("n") > hot).alias("hot")), shared_dir(docs.sparkSession), "anchors")
    known = None
    if many.limit(small_hashes + 1).count() <= small_hashes:
        # Up to small_hashes repeated anchors (9 bytes each) go to every task; more come to the documents by joins.
        t = many.toArrow()
        h, is_hot = t.column("h").to_numpy(), t.column("hot").to_numpy()
        order = np.argsort(h)
        known = docs.sparkSession.sparkContext.broadcast((h[order], is_hot[order]))
        located = docs
    else:
        own_schema = T._parse_datatype_string("doc bigint, uid bigint, h bigint")
        own_arrow = _arrow(own_schema)

        def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The anchors of each text, once."""
            for batch in chunks(batches, 2):
                texts = [t or b"" for t in batch.column(2).to_pylist()]
                i, _, _, h = anchors(b"".join(texts), [len(t) for t in texts], length, gram)
                order = np.lexsort((h, i))
                i, h = i[order], h[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1])]) if len(i) else np.zeros(0, bool)
                ids = pa.array(i[new])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.array(h[new].view(np.int64))], schema=own_arrow)

        mine = docs.mapInArrow(tidy(owned), own_schema).join(many, "h").groupBy("doc", "uid").agg(F.collect_list("h").alias("hs"), F.collect_list("hot").alias("hots"))
        located = docs.join(mine, ["doc", "uid"])
    schema = T._parse_datatype_string("key bigint, frag binary, doc bigint, uid bigint, first int, size int")
    arrow = _arrow(schema)

    def chosen(batch: pa.RecordBatch, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which anchors are repeated, and which of them hot."""
        if known is not None:
            all_h, all_hot = known.value
            if not len(all_h):
                return np.zeros(len(h), bool), np.zeros(len(h), bool)
            i = np.minimum(np.searchsorted(all_h, h), len(all_h) - 1)
            hit = all_h[i] == h
            return hit, hit & all_hot[i]
        own = [dict(zip(a, b, strict=True)) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        got = [own[d].get(x) for d, x in zip(doc.tolist(), h.tolist(), strict=True)]
        return np.array([x is not None for x in got], bool), np.array([bool(x) for x in got], bool)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragments with a repeated anchor, equal ones a few times; a row without frag is a span that is surely removed."""
        kept: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        held, spans = 0, []

        def flush() -> pa.RecordBatch:
            nonlocal held
            rows = [(k, f, *w, len(f)) for (k, f), places in kept.items() for w in places] + spans
            kept.clear()
            spans.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], t.type) for t in arrow], schema=arrow)

        def add(key: int, frag: bytes, place: tuple[int, int, int]) -> None:
            nonlocal held
            places = kept.setdefault((key, frag), [])
            if place in places:
                return
            if len(places) < copies:
                places.append(place)
                held += len(frag) + 200
                return
            if place < (worst := max(places)):
                places[places.index(worst)] = place
                place = worst
            if spans and spans[-1][3] == place[1] and spans[-1][4] <= place[2] <= spans[-1][4] + spans[-1][5]:
                last = spans[-1]
                spans[-1] = (*last[:5], max(last[5], place[2] + len(frag) - last[4]))
            else:
                spans.append((place[1], None, *place, len(frag)))

        for batch in chunks(batches, 2, 1 << 20):
            docs_, uids, texts = (batch.column(i).to_pylist() for i in range(3))
            texts = [t or b"" for t in texts]
            doc, first, count, h = anchors(b"".join(texts), [len(t) for t in texts], length, gram)
            h = h.astype(np.int64)
            hit, is_hot = chosen(batch, doc, h)
            for d, s, c, x, w in zip(doc[hit].tolist(), first[hit].tolist(), count[hit].tolist(), h[hit].tolist(), is_hot[hit].tolist(), strict=True):
                if w:
                    for i in range(s, s + c):
                        window = texts[d][i : i + length]
                        add(int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), window, (docs_[d], uids[d], i))
                else:
                    add(x, texts[d][s : s + c + length - 1], (docs_[d], uids[d], s))
            if held > 64 << 20 or len(spans) > 200_000:
                yield flush()
        yield flush()

    columns = ["doc", "uid", "text"] + (["hs", "hots"] if known is None else [])
    frags = located.select(*columns).mapInArrow(tidy(cut), schema)
    frags = frags.repartition("key").sortWithinPartitions("key", "frag", "doc", "uid", "first")
    span_schema = T._parse_datatype_string("doc bigint, uid bigint, a int, e int, built boolean")
    span_arrow = _arrow(span_schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Strings, their places and bytes, by the size of the longest of a group: a transform takes as many rounds as its longest string has symbols.
        buckets: list[tuple[list[bytes], list[tuple[int, int, int]]]] = [([], []) for _ in range(4)]
        held = [0] * len(buckets)
        group: list[tuple[bytes, tuple]] = []
        last_key, last, same, spans = None, None, 0, []

        def settle(k: int) -> None:
            spans.extend((*x, True) for x in settled(*buckets[k], length, folder))
            for part in buckets[k]:
                part.clear()
            held[k] = 0

        def close_group() -> None:
            """Fragments of one anchor meet; one alone has no other to meet and holds no window twice."""
            if len(group) > 1:
                k = (max(len(f) for f, _ in group) - length) * len(buckets) // length
                strings, where = buckets[k]
                for f, w in group:
                    strings.append(f)
                    where.append(w)
                    held[k] += len(f)
                if held[k] >= bucket_bytes:
                    settle(k)
            group.clear()

        def out() -> pa.RecordBatch:
            rows = list(zip(*spans, strict=True)) or [()] * len(span_arrow)
            spans.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, span_arrow, strict=True)], schema=span_arrow)

        for batch in batches:
            for key, frag, d, u, first, size in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if frag is None:
                    spans.append((d, u, first, first + size, False))
                    continue
                if key != last_key:
                    close_group()
                    last_key, last = key, None
                if last is not None and frag == last[0]:
                    if (d, u, first) == last[1]:
                        continue
                    same += 1
                else:
                    same = 0
                last = (frag, (d, u, first))
                if same < copies:
                    group.append(last)
                else:
                    spans.append((d, u, first, first + size, False))
            if spans:
                yield out()
        close_group()
        for k in range(len(buckets)):
            settle(k)
            yield out()

    return frags.mapInArrow(tidy(meet), span_schema).unionByName(of_copies).groupBy("doc", "uid").agg(F.collect_list(F.struct("a", "e", "built")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, e in sorted((s["a"], s["e"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [tuple(x) for x in out]


def without_repeats(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", length: int = 100, gram: int = 32, hot: int = 20_000, copies: int = 2, bucket_bytes: int = 1 << 19, small_hashes: int = 8_000_000, small_copies: int = 1_000_000) -> DataFrame:
    """A row for each document: doc_id, n_bytes, removed (spans of bytes), kept (the remaining bytes)."""
    d = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(doc).cast("bigint"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.col(doc), F.col(text)).alias("uid"), F.col(text).cast("binary").alias("text"))
    spans = removed_spans(d.select("doc", "uid", "text"), length=length, gram=gram, hot=hot, copies=copies, bucket_bytes=bucket_bytes, small_hashes=small_hashes, small_copies=small_copies)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc].dataType), *T._parse_datatype_string("n_bytes bigint, removed array<struct<a:int,e:int>>, kept binary").fields])
    arrow = _arrow(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            ids, texts, found = (batch.column(i).to_pylist() for i in range(3))
            sizes, removed, kept = [], [], []
            for t, s in zip(texts, found, strict=True):
                t, spans = t or b"", merged(s or [])
                at = [0, *(x for span in spans for x in span), len(t)]
                sizes.append(len(t))
                removed.append([{"a": a, "e": e} for a, e in spans])
                kept.append(b"".join(t[a:e] for a, e in zip(at[::2], at[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((ids, sizes, removed, kept), arrow, strict=True)], schema=arrow)

    return d.join(spans, ["doc", "uid"], "left").select("doc_id", "text", "spans").mapInArrow(tidy(apply), schema)
