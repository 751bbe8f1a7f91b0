"""Language-model scores: online logistic mixing of hashed-context bit predictors, and a smoothed unigram base.

A text is its lower-cased bytes and an end mark. Each byte is a few binary decisions along a Huffman code, which depends on the byte before and is made from
the pairs of bytes of all training texts. A decision's predictors are counts of zeros and ones in tables keyed by (context, place in the code), for three contexts:
the last three bytes, the last five, the word so far (of a longer one the last eight bytes and the length). The tables have an entry for every context of the training documents,
found by its last byte and 46 bits of hash, so what was not seen is not known: each task counts its own pairs of a context and its next byte, and Spark adds them up.

A pair of counts is a state (both on a logarithmic scale). What a state predicts is learned from the tables themselves: every occurrence is left out once, and counted under
the state that remains. These maps are sums over the whole corpus, of fixed size.

Predictions are mixed in the logistic domain by weights that a gate selects (which contexts are known). Inside each document the weights are scaled by factors that
are refined after 32, 64, 128, ... bytes and from 1024 on after every 1024, a text of up to 32 bytes by none. A document's score depends on its own text and
the tables only. Logarithms of odds are kept within 16, so zero and one always sum to one.

The unigram base needs the corpus count of every word. Words and contexts grow with the corpus: up to a checked size, and where the shared folder is mounted, their sorted files are
mapped by every task, with hash tables that give a pair of a context and its next byte all predictions on its path (only what is not found there is searched for, decision by decision); else documents are dealt to blocks of bounded size, each block asks once for each of its keys, and the values come back to the block.

Nulls: a null text is empty (just the end); a null id counts as training. Repeated rows count as often as they come. Without training
documents N = 0 and the tables are empty: every bit costs one bit.
"""

from __future__ import annotations

import heapq
import itertools
import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, _arrow, chunks, map_texts, prepared, shared_dir, tidy, written
from .neardup import SPACE, word_hashes

U = np.uint64
#: Values of keys; 0 where a key is not known.
Lookup = Callable[[np.ndarray], np.ndarray]
END = 255  # no UTF-8 text has this byte
#: Bytes of the two contexts of fixed length; the third context is the word so far.
BACK = (3, 5)
K = len(BACK) + 1
GATES = 1 << K
#: A key, from the top: 6 bits of hash (its file), next byte or place in the code, byte before, 40 bits of hash, number of the context.
NEXT, BEFORE = 50, 42
BYTE = 255
#: Counts on a logarithmic scale; pairs with a larger one are scaled down together.
LEVELS = np.unique(np.floor(1.4 ** np.arange(42)).astype(np.int64) - 1)
L = len(LEVELS)
CELLS = K * L * L * 2
#: Lengths of the blocks after which a text's factors learn; the last comes again and again.
BLOCKS = (32, 32, 64, 128, 256, 512, 1024)


class Code:
    """A Huffman code of bytes for each byte before: for each pair (before * 256 + byte) its path of (node, bit), as arrays."""

    def __init__(self, counts: np.ndarray):
        paths: list[list[tuple[int, int]]] = []
        for own in counts.reshape(256, 256):
            paths += self.paths(own)
        self.size = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)
        self.node = np.array([n for p in paths for n, _ in p], np.int64)  # 0 to 254

    @staticmethod
    def paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
        order = itertools.count()
        heap = [(int(c) + 1, next(order), b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], next(order), (a[2], b[2])))
        out: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        stack, node = [(heap[0][2], [])], itertools.count()
        while stack:
            tree, path = stack.pop()
            if isinstance(tree, int):
                out[tree] = path
            else:
                n = next(node)
                stack += [(tree[0], [*path, (n, 0)]), (tree[1], [*path, (n, 1)])]
        return out


def contexts(texts: list[bytes], back: tuple[int, ...] = BACK) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each byte of the texts, lower-cased, and their ends: the byte and the one before; ends of the texts; the key of each context, without what is next.

    back: the contexts of fixed length that are wanted; that of the word so far comes last.
    """
    lows = [t.translate(LOWER) for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lows])
    starts = np.concatenate([[0], ends[:-1]])
    buffer = b"\xff" * 8 + b"\xff".join(lows) + b"\xff"
    raw = np.frombuffer(buffer, np.uint8)
    data, before = raw[8:], raw[7:-1]
    n = len(data)
    eight = np.ndarray((n,), "<u8", buffer, 0, (1,)).copy()  # the eight bytes before each place, the nearest as the highest
    near = (starts[:, None] + np.arange(max(back))).ravel()
    at = np.tile(np.arange(max(back)), len(starts))
    inside = near < np.repeat(ends, max(back))
    near, at = near[inside], at[inside].astype(U)
    found = []
    for b in back:
        h = eight >> U(64 - 8 * b)
        h[near] |= (U(1) << (U(8) * (U(b) - np.minimum(at, U(b))))) - U(1)  # nothing of the text before
        found.append(h)
    place = np.arange(n, dtype=np.int32)
    word = np.empty(n, np.int32)
    word[0], word[1:] = 0, np.maximum.accumulate(np.where(SPACE[data] | (data == END), place + np.int32(1), np.int32(0)))[:-1]
    length = (place - word).astype(U)
    found.append(np.where(length > 0, eight >> (U(64) - U(8) * np.clip(length, 1, 8)), U(0)) + (length << U(57)) + length)
    numbers = [*(BACK.index(b) for b in back), K - 1]
    return data, before, ends, [keyed(h, before, k) for h, k in zip(found, numbers, strict=True)]


def keyed(h: np.ndarray, before: np.ndarray, k: int) -> np.ndarray:
    """The keys of context k from numbers that tell its contexts apart, which are overwritten, and the bytes before."""
    h += U(k + 1)
    h *= U(0x9E3779B97F4A7C15)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h &= ~(U(0xFFFF) << U(BEFORE) | U(3))
    h |= before.astype(U) << U(BEFORE)
    h |= U(k)
    return h.view(np.int64)


def shorter(data: np.ndarray, before: np.ndarray, ends: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The keys of fixed context k at some places only."""
    starts = np.concatenate([[0], ends[:-1]])
    at = places - starts[np.searchsorted(starts, places, side="right") - 1]
    h = np.zeros(len(places), U)
    for j in range(1, BACK[k] + 1):
        h |= np.where(at >= j, data[places - np.minimum(at, j)], END).astype(U) << U(8 * (BACK[k] - j))
    return keyed(h, before[places], k)


def pairs(texts: list[bytes]) -> list[np.ndarray]:
    """By context, a key for each byte, with the byte as what is next."""
    data, _, _, ctx = contexts(texts)
    following = data.astype(np.int64) << NEXT
    return [c | following for c in ctx]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, nearly in order, of each key the index of its own, and a place of each distinct one. One sort of numbers that hold a key's upper bits and its place; keys that differ
    below those bits are told apart afterwards, at the price that one may come twice."""
    n = len(keys)
    low = U(max(1, (n - 1).bit_length()))
    packed = keys.view(U) ^ U(1 << 63)
    packed >>= low
    packed <<= low
    packed |= np.arange(n, dtype=U)
    packed.sort()
    packed &= (U(1) << low) - U(1)
    at = packed.view(np.int64)
    k = keys[at]
    new = np.ones(n, bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    index = np.empty(n, np.int64)  # numpy takes by 64-bit indices twice as fast as by shorter ones
    index[at] = np.cumsum(new) - 1
    return k[new], index, at[new]


def decisions(code: Code, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decisions of pairs: key (with the place in the code as what is next) and index of the path; where each pair's begin."""
    both = (pair >> BEFORE & BYTE) << 8 | pair >> NEXT & BYTE
    size = code.size[both]
    start = np.cumsum(size) - size
    path = np.repeat(code.start[both] - start, size) + np.arange(size.sum())
    return np.repeat(pair & ~(BYTE << NEXT), size) | code.node[path] << NEXT, path, start


def state(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """1 and more; 0 for no counts."""
    most = np.maximum(zero, one)
    if len(most) and most.max() > LEVELS[-1]:
        scale = np.minimum(1.0, LEVELS[-1] / np.maximum(most, 1))
        zero, one = zero * scale, one * scale
    a, b = (np.searchsorted(LEVELS, x, side="right") - 1 for x in (zero, one))
    return np.where(most > 0, a * L + b, 0).astype(np.uint16)


def counted_decisions(code: Code, pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of the counted pairs (with all pairs of each of their contexts): sorted keys of decisions, their states, and the counts
    of (context, state, bit) with each occurrence left out once."""
    return counted_paths(code, pair, count)[:3]


def counted_paths(code: Code, pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same; and the cell (context, state, bit) of each decision, pair by pair; where each pair's begin."""
    keys, path, start = decisions(code, pair)
    n, bit = np.repeat(count, np.diff(np.append(start, len(keys)))), code.bit[path].astype(np.int64)
    u, inv = np.unique(keys, return_inverse=True)
    one = np.bincount(inv, n * bit, minlength=len(u)).astype(np.int64)
    zero = np.bincount(inv, n * (1 - bit), minlength=len(u)).astype(np.int64)
    left = state(zero[inv] - (1 - bit), one[inv] - bit).astype(np.int64)
    cell = ((keys & 3) * (L * L) + left) * 2 + bit
    states = state(zero, one)
    return u, states, np.bincount(cell, n, minlength=CELLS).astype(np.int64), (((keys & 3) * (L * L) + states[inv]) * 2 + bit).astype(np.uint16), start


#: For the slots of the two tables of pairs.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def slots_of(keys: np.ndarray, slots: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each key its slot in the level's table, which has `slots` for each value of the highest six bits, and 32 other bits."""
    m = keys.view(U) * U(FACTORS[level])
    m ^= m >> U(29)
    m *= U(0xBF58476D1CE4E5B9)
    check = m.astype(np.uint32)
    m >>= U(32)
    m *= U(slots)
    m >>= U(32)
    at = keys >> 58
    at += PARTS // 2
    at *= slots
    at += m.view(np.int64)
    return at, check


def hashed(keys: np.ndarray, count: np.ndarray, size: np.ndarray, slots: tuple[int, int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Tables of distinct keys of one part, and which of them are in one, the most frequent first. Of those with the same slot the one that came most often has it; the second table is
    for the rest. A slot holds 32 bits of its key and, plus 1, where its values begin in the sequence of what the tables' keys have (size: how many), or 0."""
    kept, taken, rest = [], [], np.lexsort((keys, -count))
    for level in (0, 1):
        at, check = slots_of(keys[rest], slots[level], level)
        at %= slots[level]
        _, first = np.unique(at, return_index=True)
        kept.append(rest[first])
        taken.append((at[first], check[first]))
        rest = np.delete(rest, first)
    both = np.concatenate(kept)
    order = np.lexsort((keys[both], -count[both]))
    begin = np.empty(len(both), np.int64)
    begin[order] = np.cumsum(size[both[order]]) - size[both[order]]
    tables = [np.zeros(n, U) for n in slots]
    for table, (at, check), value in zip(tables, taken, np.split(begin, [len(kept[0])]), strict=True):
        table[at] = check.astype(U) << U(32) | (value + 1).astype(U)
    return tables, both[order]


class Paths:
    """Pairs that training texts have, in hash tables, with the predictions for what came on their paths: where a pair is found, its decisions need no look-up of their own.

    A few seldom pairs are in none, as their slots have gone to others. Tables of the parts lie one after the other.
    """

    def __init__(self, tables: list[np.ndarray], odds: np.ndarray):
        self.tables, self.odds = tables, odds

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where the predictions of each key begin; -1 where it is not found."""
        out, left = self.level(keys, 0)
        out[left] = self.level(keys[left], 1)[0]
        return out

    def level(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one table, and which are not in it."""
        table = self.tables[level]
        at, check = slots_of(keys, len(table) // PARTS, level)
        got = table[at].view(np.uint32)
        low, high = (0, 1) if sys.byteorder == "little" else (1, 0)
        at[:] = got[low::2]
        at -= 1
        left = np.flatnonzero(got[high::2] != check)
        at[left] = -1
        return at, left


def ranges(start: np.ndarray, size: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other; first: where each begins. No range is empty."""
    out = np.ones(total, np.int64)
    out[0] = start[0]
    out[first[1:]] = start[1:] - start[:-1] - size[:-1] + 1
    return np.cumsum(out, out=out)


class Model:
    """The code, what each state of each context predicts (logarithms of odds), and starting weights by gate. The tables of states are looked up."""

    def __init__(self, code: Code, left_out: np.ndarray):
        self.code = code
        n = left_out.reshape(K, L * L, 2).astype(np.float64)
        zero, one = np.divmod(np.arange(L * L), L)
        prior = (LEVELS[one] + 0.4) / (LEVELS[zero] + LEVELS[one] + 0.8)
        p = (n[:, :, 1] + 4 * prior) / (n.sum(2) + 4)
        x = np.log(p / (1 - p)).clip(-12, 12)
        self.predicted = np.where(np.abs(x) < 1e-6, 1e-6, x).astype(np.float32)
        self.predicted[:, 0] = 0  # not known
        self.came = (self.predicted[:, :, None] * np.array([-1, 1], np.float32)).ravel()  # for what came, by (context, state, bit)
        # The weights of what is known sum to a little over one; of the contexts of fixed length the longer counts twice.
        share = (np.arange(GATES)[:, None] >> np.arange(K) & 1) * np.array([1.0, 2.0, 1.0])
        self.weights = (1.05 * share / np.maximum(share.sum(1, keepdims=True), 1)).astype(np.float32)

    def log10(self, texts: list[bytes], lookup: Lookup, run: int = 1 << 18, paths: Paths | None = None) -> np.ndarray:
        """log10 probability of each text, mixed in runs of about `run` bytes. With paths only decisions of pairs that are not there are looked up."""
        if paths:
            return self.found(texts, lookup, run, paths) / math.log(10)
        return self.looked_up(texts, lookup, run) / math.log(10)

    def looked_up(self, texts: list[bytes], lookup: Lookup, run: int) -> np.ndarray:
        """Each distinct context and byte is looked up once, of the contexts of fixed length only the distinct longest ones, which have the shorter ones in them."""
        data, before, ends, ctx = contexts(texts, BACK[-1:])
        following = data.astype(np.int64) << NEXT
        both = before.astype(np.int64) << 8 | data
        tables = []
        for keys in ctx:
            u, index, place = distinct(keys | following)
            own, path, start = decisions(self.code, u)
            lengths = [*(decisions(self.code, shorter(data, before, ends, place, k) | u & BYTE << NEXT)[0] for k in range(K - 2)), own] if keys is ctx[0] else [own]
            tables.append(([self.predictions(k, q, path, lookup) for k, q in enumerate(lengths, 0 if keys is ctx[0] else K - 1)], start[index]))
        size, out, a = self.code.size[both], [], 0
        while a < len(texts):
            lo = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, lo + run, side="right")))
            hi = int(ends[b - 1])

            def fetch(order: np.ndarray, size: np.ndarray, first: np.ndarray, total: int, here: slice = slice(lo, hi)) -> list[np.ndarray]:
                x, place = [], np.arange(total)
                for own, i in tables:
                    at = np.repeat(i[here][order] - first, size) + place
                    x += [t[at] for t in own]
                return x

            out.append(self.mixed(np.diff(ends[a:b], prepend=lo), size[lo:hi], fetch))
            a = b
        return np.concatenate(out)

    def predictions(self, k: int, keys: np.ndarray, path: np.ndarray, lookup: Lookup) -> np.ndarray:
        """Logarithms of odds for what came, of context k's decisions."""
        some, where, _ = distinct(keys)
        p = self.predicted[k][lookup(some).astype(np.int64)][where]
        return np.where(self.code.bit[path], p, -p)

    def found(self, texts: list[bytes], lookup: Lookup, run: int, paths: Paths) -> np.ndarray:
        """The predictions for seen pairs come from their paths; the decisions of all other pairs are looked up together. Texts of like length are mixed together, in few steps."""
        by_length = np.argsort([len(t) for t in texts], kind="stable")
        runs, missing = [], [[] for _ in range(K)]
        for part in sliced([texts[i] for i in by_length], run):
            data, before, ends, ctx = contexts(part)
            following, places = data.astype(np.int64) << NEXT, []
            for k, keys in enumerate(ctx):
                keys |= following
                places.append(paths.places(keys))
                missing[k].append(keys[places[k] < 0])
            runs.append((np.diff(ends, prepend=0), self.code.size[before.astype(np.int64) << 8 | data], places))
        others = []
        for k, parts in enumerate(missing):
            u, index, _ = distinct(np.concatenate(parts))
            own, path, start = decisions(self.code, u)
            others.append(self.predictions(k, own, path, lookup))
            for at, (_, _, places) in zip(np.split(start[index], np.cumsum([len(x) for x in parts])[:-1]), runs, strict=True):
                places[k][places[k] < 0] = -1 - at

        out = []
        for lengths, size, places in runs:

            def fetch(order: np.ndarray, size: np.ndarray, first: np.ndarray, total: int, own: list[np.ndarray] = places) -> list[np.ndarray]:
                x = []
                for k, place in enumerate(own):
                    place = place[order]
                    new = np.flatnonzero(place < 0)
                    there, place[new] = -1 - place[new], 0
                    x.append(paths.odds[ranges(place, size, first, total)])
                    if len(new):
                        many = size[new]
                        begin, n = np.cumsum(many) - many, int(many.sum())
                        x[k][ranges(first[new], many, begin, n)] = others[k][ranges(there, many, begin, n)]
                return x

            out.append(self.mixed(lengths, size, fetch))
        return np.concatenate(out)[np.argsort(by_length)]

    def mixed(self, lengths: np.ndarray, size: np.ndarray, fetch: Callable[[np.ndarray, np.ndarray, np.ndarray, int], list[np.ndarray]], rate: float = 10.0) -> np.ndarray:
        """The logarithm of each text's probability. size: decisions of each byte. fetch: of the bytes in an order, with their sizes and where each one's decisions begin, the logarithms
        of odds for what came, by context."""
        doc = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(doc)) - (np.cumsum(lengths) - lengths)[doc]
        edges = np.cumsum(BLOCKS)
        block = np.where(at < edges[-1], np.searchsorted(edges, at, side="right"), len(edges) + (at - edges[-1]) // BLOCKS[-1])
        order = np.argsort(block.astype(np.uint16) if block.max() < 2**16 else block, kind="stable")  # the first block of each text, then the second, ...
        doc, block, size = doc[order], block[order], size[order]
        first = np.cumsum(size) - size
        total = int(size.sum())
        x = fetch(order, size, first, total)
        gate = np.zeros(total, np.uint8)
        for k in range(K):
            gate |= (x[k] != 0).view(np.uint8) << np.uint8(k)
        # Segments: decisions of one text in one block. Steps: segments of one block.
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])]))
        seg, seg_doc = np.append(first[new], total), doc[new]
        steps = np.concatenate([[0], np.cumsum(np.bincount(block[new]))])
        factor, cost = np.ones((len(lengths), K), np.float32), np.zeros(len(lengths))
        for a, e in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            lo, hi = int(seg[a]), int(seg[e])
            docs, many = seg_doc[a:e], np.diff(seg[a : e + 1])
            own = np.repeat(np.arange(0, len(docs) * GATES, GATES), many) + gate[lo:hi]
            parts = [(self.weights[:, k] * factor[docs, k, None]).ravel()[own] * x[k][lo:hi] for k in range(K)]
            dot = sum(parts[1:], parts[0]).clip(-16, 16)
            p = 1 / (1 + np.exp(-dot))
            cost[docs] += np.add.reduceat(np.log(p), seg[a:e] - lo, dtype=np.float64)
            if e < len(seg_doc):
                error = 1 - p
                for k in range(K):
                    factor[docs, k] += np.float32(rate) * np.add.reduceat(error * parts[k], seg[a:e] - lo) / (many + np.float32(200))
                np.clip(factor, 0, 3, out=factor)
        return cost


def held_out(doc: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def summed(train: DataFrame, size: int, fn: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
    """The sum of fn's `size` counts over all texts; tasks send those that are not 0."""
    prepared(train.sparkSession)
    schema = T._parse_datatype_string("cell int, n bigint")
    arrow = _arrow(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in chunks(batches, 0, 1 << 19):
            total += fn([t or b"" for t in batch.column(0).to_pylist()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=arrow)

    return total_of(train.select("text").mapInArrow(tidy(count), schema), size)


def total_of(cells: DataFrame, size: int) -> np.ndarray:
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out


def byte_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of (byte before, byte); before a text and after it stands the end mark."""
    data = np.frombuffer(b"\xff" + b"".join(t.translate(LOWER) + b"\xff" for t in texts), np.uint8)
    return np.bincount(data[:-1].astype(np.int64) << 8 | data[1:], minlength=1 << 16)


def token_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, each text's words and then its end; tokens of each text."""
    lows = [(t or b"").translate(LOWER) for t in texts]
    data = b"\n".join(x + b" \xff" for x in lows) + b"\n"  # the byte that no text has stands for the end
    h, starts = word_hashes(data)
    n = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(x) + 3 for x in lows)])))
    return h.view(np.int64), n


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts, of several sorted runs of them."""
    if len(runs) < 2:
        return runs[0] if runs else (np.empty(0, np.int64), np.empty(0, np.int64))
    keys, n = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(keys, kind="stable")  # merges runs that are in order
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(n, new)


def word_counts(train: DataFrame) -> DataFrame:
    return key_counts(train, lambda texts: [token_hashes(texts)[0]])


def pair_counts(train: DataFrame) -> DataFrame:
    return key_counts(train, lambda texts: pairs([t or b"" for t in texts]))


def key_counts(train: DataFrame, keys: Callable[[list], list[np.ndarray]], most: int = 3_000_000) -> DataFrame:
    """h, c: each distinct key of the training texts and its count; tasks send a row for each of their distinct keys, of which they hold `most` at a time."""
    schema = T._parse_datatype_string("h bigint, n bigint")
    arrow = _arrow(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        for last, batch in with_last(chunks(batches, 0, 2 << 20)):
            runs += [np.unique(h, return_counts=True) for h in keys(batch.column(0).to_pylist())]
            if last or sum(len(h) for h, _ in runs) > most:
                runs = [merged(runs)]
                if last or len(runs[0][0]) > most // 2:
                    h, n = runs.pop()
                    for at in range(0, len(h), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000]), pa.array(n[at : at + 100_000])], schema=arrow)

    return train.select("text").mapInArrow(tidy(count, 256 << 20), schema).groupBy("h").agg(F.sum("n").alias("c"))


def with_last(items: Iterator) -> Iterator[tuple[bool, object]]:
    """Each item, and whether it is the last."""
    before: list = []
    for x in items:
        if before:
            yield False, before.pop()
        before.append(x)
    if before:
        yield True, before.pop()


PARTS = 64


def values_of(keys: np.ndarray, values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The values of q, 0 where it is not among the sorted keys."""
    if not len(keys):
        return np.zeros(len(q), values.dtype)
    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return np.where(keys[at] == q, values[at], values.dtype.type(0))


class Vocabulary:
    """Values of keys in sorted files of the shared folder, mapped, not loaded; a file for each of the highest six bits."""

    def __init__(self, folder: str, kind: type):
        self.parts = []
        for i in range(PARTS):
            fs, path = pa_fs.FileSystem.from_uri(f"{folder}/{i}")
            n = fs.get_file_info(path).size // (8 + np.dtype(kind).itemsize) if fs.get_file_info(path).type == pa_fs.FileType.File else 0
            self.parts.append((np.memmap(path, np.int64, "r", 0, (n,)), np.memmap(path, kind, "r", 8 * n, (n,))) if n else (np.empty(0, np.int64), np.empty(0, kind)))

    def values(self, q: np.ndarray) -> np.ndarray:
        """q: in the order of its highest six bits."""
        cut = np.searchsorted(q >> 58, np.arange(-PARTS // 2, PARTS // 2 + 1))
        return np.concatenate([values_of(k, v, q[a:e]) for (k, v), a, e in zip(self.parts, cut[:-1].tolist(), cut[1:].tolist(), strict=True)])

    def counts(self, h: np.ndarray) -> np.ndarray:
        u, index, _ = distinct(h)
        return self.values(u)[index]


def mounted(folder: str) -> bool:
    """Whether the shared folder is on a file system that every process can map files of."""
    return isinstance(pa_fs.FileSystem.from_uri(folder)[0], pa_fs.LocalFileSystem)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(folder: str, kind: type) -> Vocabulary:
    if folder not in _vocabularies:
        for old in [x for x in _vocabularies if x.rpartition("/")[0] != folder.rpartition("/")[0]]:
            del _vocabularies[old]
        _vocabularies[folder] = Vocabulary(folder, kind)
    return _vocabularies[folder]


CELL = "cell int, n bigint"


def write_vocabulary(known: DataFrame, folder: str, code: Code | None = None, slots: tuple[int, int] | None = None) -> np.ndarray:
    """Files of the words' counts or, with a code, of the pairs' table of states and, with slots of a part, of the pairs' paths; then returns the counts of states with each occurrence left out."""
    arrow = _arrow(T._parse_datatype_string(CELL))

    def save(group):
        h, c = group.column("h").to_numpy(), group.column("c").to_numpy()
        part, left_out = int(h[0] >> 58) + PARTS // 2, np.zeros(0, np.int64)
        if code:
            order = np.argsort(h)
            pair = h[order]
            n = c[order]
            h, c, left_out, cells, start = counted_paths(code, pair, n)
            if slots:
                size = np.diff(start, append=len(cells))
                tables, kept = hashed(pair, n, size, slots)
                many = size[kept]
                for level, table in enumerate(tables):
                    save_file(f"{folder}/{part}.table{level}", table)
                save_file(f"{folder}/{part}.odds", cells[ranges(start[kept], many, np.cumsum(many) - many, int(many.sum()))])
        order = np.argsort(h)
        save_file(f"{folder}/{part}", h[order], c[order])
        at = np.flatnonzero(left_out)
        return pa.table([pa.array(at.astype(np.int32)), pa.array(left_out[at])], schema=arrow)

    return total_of(known.groupBy(F.expr("shiftright(h, 58)")).applyInArrow(save, CELL), CELLS)


def save_file(uri: str, *arrays: np.ndarray) -> None:
    fs, path = pa_fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
    with fs.open_output_stream(tmp) as f:
        for x in arrays:
            f.write(np.ascontiguousarray(x))
    fs.move(tmp, path)


def join_paths(spark: SparkSession, folder: str, slots: tuple[int, int], came: np.ndarray) -> bool:
    """One file of each table of all parts, with places in another, of their predictions. False if there are more than a slot can tell."""
    fs, path = pa_fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    size = {i.base_name: i.size for i in fs.get_file_info(pa_fs.FileSelector(path))}
    many = [size.get(f"{i}.odds", 0) // 2 for i in range(PARTS)]
    first = [sum(many[:i]) for i in range(PARTS)]
    fits = sum(many) < 2**32 - 1

    def join(kind: tuple[str, int]) -> int:
        name, empty = kind
        fs, path = pa_fs.FileSystem.from_uri(folder)
        tmp = f"{path}/{name}.{TaskContext.get().taskAttemptId()}.tmp"
        with fs.open_output_stream(tmp) as out:
            for i in range(PARTS):
                if f"{i}.{name}" not in size:
                    out.write(bytes(8 * empty))
                    continue
                with fs.open_input_stream(f"{path}/{i}.{name}") as f:
                    while block := f.read(4 << 20):
                        if name == "odds":
                            out.write(came[np.frombuffer(block, np.uint16)])
                        else:
                            own = np.frombuffer(block, U)
                            out.write(own + np.where(own > 0, U(first[i]), U(0)))
            if name == "odds":
                out.write(bytes(4 * BYTE))  # a path that is taken for another's ends in the file
        fs.move(tmp, f"{path}/{name}")
        return 0

    if fits:
        spark.sparkContext.parallelize([("table0", slots[0]), ("table1", slots[1]), ("odds", 0)], 3).map(join).collect()
    for name in size:
        if "." in name:
            fs.delete_file(f"{path}/{name}")
    return fits


_paths: dict[str, Paths] = {}


def paths_of(folder: str) -> Paths:
    if folder not in _paths:
        _paths.clear()
        path = pa_fs.FileSystem.from_uri(folder)[1]
        mapped = [np.memmap(f"{path}/{name}", kind, "r").view(np.ndarray) for name, kind in (("table0", U), ("table1", U), ("odds", np.float32))]
        _paths[folder] = Paths(mapped[:2], mapped[2])
    return _paths[folder]


def tokens_scored(texts: list, counts: np.ndarray, n: np.ndarray) -> dict:
    """part: the sum of log10(c + 1) over a text's tokens; what that is divided by is the same for all texts."""
    starts = np.cumsum(n) - n  # every text has its end, so none is empty
    return {"n_tokens": n.tolist(), "n_known": np.add.reduceat((counts > 0).astype(np.int64), starts).tolist(), "part": np.add.reduceat(np.log10(counts + 1.0), starts).tolist(), "n_bytes": [len(t or b"") for t in texts]}


SCORED = "n_tokens bigint, n_known bigint, part double, n_bytes bigint, score double"


def scored(texts: list, model: Model, counts: Lookup, lookup: Lookup, paths: Paths | None = None) -> dict:
    h, n = token_hashes(texts)
    return tokens_scored(texts, counts(h), n) | {"score": np.concatenate([model.log10(part, lookup, paths=paths) for part in sliced(texts)]).tolist()}


def scored_by_files(d: DataFrame, words: DataFrame, contexts: DataFrame, code: Code, folder: str, n_pairs: int) -> DataFrame:
    """For tables of checked size: their files are read where the documents are."""
    spark = d.sparkSession
    write_vocabulary(words, f"{folder}/w")
    slots = n_pairs // PARTS + 1, n_pairs // PARTS // 2 + 1
    model = Model(code, write_vocabulary(contexts, f"{folder}/c", code, slots))
    joined, held = join_paths(spark, f"{folder}/c", slots, model.came), spark.sparkContext.broadcast(model)

    def fn(texts: list) -> dict:
        return scored(texts, held.value, vocabulary(f"{folder}/w", np.int64).counts, vocabulary(f"{folder}/c", np.uint16).values, paths_of(f"{folder}/c") if joined else None)

    return map_texts(d, fn, SCORED, keep=("doc_id", "held"), chunk_bytes=2 << 20, held=256 << 20)


def sliced(texts: list, most: int = 2 << 20) -> Iterator[list[bytes]]:
    """Texts in runs of about `most` bytes."""
    part, size = [], 0
    for t in texts:
        t = t or b""
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def scored_by_blocks(d: DataFrame, words: DataFrame, contexts: DataFrame, code: Code, folder: str, n_pairs: int, block_bytes: int) -> DataFrame:
    """For tables of any size: documents are dealt to blocks of bounded size, a block asks once for each of its keys, and the values come back to it."""
    n_blocks = max(1, math.ceil((d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    # A row's number in its partition is as good as random, and spreads repeated rows; written, it is the same for a task that comes again.
    d = written(d.withColumn("blk", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n_blocks))), folder, "dealt")
    groups = max(1, n_pairs // 500_000)  # all pairs of a context in one
    dealt = contexts.groupBy(F.pmod(F.xxhash64(F.expr(f"h & {~(BYTE << NEXT)}L")), F.lit(groups)))
    cell_schema = _arrow(T._parse_datatype_string(CELL))

    def leave_out(group):
        n = counted_decisions(code, group.column("h").to_numpy(), group.column("c").to_numpy())[2]
        at = np.flatnonzero(n)
        return pa.table([pa.array(at.astype(np.int32)), pa.array(n[at])], schema=cell_schema)

    def expand(group):
        h, s, _ = counted_decisions(code, group.column("h").to_numpy(), group.column("c").to_numpy())
        return pa.table({"kind": np.ones(len(h), np.int32), "h": h, "v": s.astype(np.int64)})

    model = Model(code, total_of(dealt.applyInArrow(leave_out, CELL), CELLS))
    known = words.select(F.lit(0).alias("kind"), "h", F.col("c").alias("v")).unionByName(dealt.applyInArrow(expand, "kind int, h bigint, v bigint"))

    def ask(group):
        w, c = [], []
        for b in chunks(iter(group.select(["blk", "text"]).to_batches()), 1, 1 << 19):
            texts = b.column(1).to_pylist()
            w.append(np.unique(token_hashes(texts)[0]))
            c += [np.unique(x) for x in pairs([t or b"" for t in texts])]
        w, c = np.unique(np.concatenate(w)), np.unique(decisions(code, np.unique(np.concatenate(c)))[0])
        return pa.table({"kind": np.repeat(np.array([0, 1], np.int32), [len(w), len(c)]), "h": np.concatenate([w, c]), "blk": np.full(len(w) + len(c), group.column("blk")[0].as_py(), np.int64)})

    answers = written(d.groupBy("blk").applyInArrow(ask, "kind int, h bigint, blk bigint").join(known, ["kind", "h"]), folder, "answers")
    held = d.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([d.schema["doc_id"], d.schema["held"], *T._parse_datatype_string(SCORED).fields])
    arrow = _arrow(schema)

    def score(left, right):
        lookups = []
        kind, h, v = (right.column(x).to_numpy() for x in ("kind", "h", "v"))
        for k, dtype in enumerate((np.int64, np.uint16)):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(h[own])]
            lookups.append(lambda q, keys=h[own], values=v[own].astype(dtype): values_of(keys, values, q))
        out: dict[str, list] = {f.name: [] for f in schema.fields[2:]}
        for batch in chunks(iter(left.select(["doc_id", "held", "text"]).to_batches()), 2, 2 << 20):
            for k, x in scored(batch.column(2).to_pylist(), held.value, *lookups).items():
                out[k] += x
        return pa.table([left.column("doc_id"), left.column("held"), *(pa.array(out[f.name], arrow.field(f.name).type) for f in schema.fields[2:])], schema=arrow)

    return d.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(score, schema)


def scores(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20, small_words: int = 16_000_000, small_pairs: int = 64_000_000) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Words are known by 64 bits of hash. At most small_words words (16 bytes each) and small_pairs pairs of a context and its next byte (10 bytes a
    decision, of which pairs of one context share some, and for the paths 12 bytes a pair and 4 a decision) are read from files by every task; more are joined by blocks.
    """
    prepared(docs.sparkSession)
    d = docs.select(F.col(doc).alias("doc_id"), held_out(doc).alias("held"), F.col(text).cast("binary").alias("text"))
    train, folder = d.where("not held"), shared_dir(docs.sparkSession)
    code = Code(summed(train, 1 << 16, byte_counts))
    words, contexts = written(word_counts(train), folder, "words"), written(pair_counts(train), folder, "pairs")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_pairs = contexts.count()
    small = v <= small_words and n_pairs <= small_pairs and mounted(folder)
    rows = scored_by_files(d, words, contexts, code, folder, n_pairs) if small else scored_by_blocks(d, words, contexts, code, folder, n_pairs, block_bytes)
    base = F.col("part") - F.col("n_tokens") * math.log10(n + v + 1)
    return rows.select(
        F.col("doc_id").alias(doc), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte")
    )
