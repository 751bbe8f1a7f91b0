"""Benchmark decontamination by a prefix-filtered join of word windows.

Every benchmark item is a set of windows of `window` consecutive words (a shorter item is one window). The shingles
(`shingle` words) of a window are ordered by rarity over all documents; since a window must occur whole, the rarest one
is the whole necessary prefix. A document is probed only where a prefix shingle occurs; the shingle's place in the
window gives the only possible start (positional bound), which must leave room for the window (length bound), and the
words there are then compared with the window's exactly.

The benchmark is never assumed small: it is streamed to the driver in blocks of at most `block_words` words, each block is
broadcast alone and meets all documents; hits of several blocks are carried from one pass to the next in a table of the shared folder.

Nulls: a null text has no words. Empty benchmark: no document is hit. Repeated rows are judged one by one; items with one id are
one item. All items with a null id are one without a name: its windows hit, it counts as an item, and it stands in `items` as a null, at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, map_texts, shared_dir, written

#: Bytes that end a word become spaces, A-Z lower case; what is left is 0-9, a-z and everything from 0x80 on.
TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


#: What stands after a text's words.
END = np.array([-2], np.int32)


class Known(dict):
    def __missing__(self, key):
        return -1


U = np.uint64
STEP = U(0x9E3779B97F4A7C15)


def codes(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the word ids in each row. What it finds is compared word by word afterwards."""
    h = np.zeros(len(columns[0]), U)
    for c in columns:
        h = (h + c.astype(U) + U(1)) * STEP
        h ^= h >> U(29)
    return h.view(np.int64)


class Block:
    """Some benchmark items (or parts of long ones): vocabulary, distinct windows, and the windows by their prefix shingle."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int, shingle: int):
        self.vocab = Known()
        self.names = [i for i, _ in items]
        rows, owners = [], []
        for k, (_, ws) in enumerate(items):
            ids = np.fromiter((self.vocab.setdefault(w, len(self.vocab)) for w in ws), np.int32, len(ws))
            if len(ids) < window:
                ids = np.append(ids, np.full(window - len(ids), -9, np.int32))
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            owners.append(np.full(len(rows[-1]), k))
        every = np.ascontiguousarray(np.concatenate(rows))
        _, first, inv = np.unique(every.view(f"V{every.itemsize * window}").ravel(), return_index=True, return_inverse=True)
        self.matrix = every[first]
        self.lengths = (self.matrix >= 0).sum(1).astype(np.int32)
        pairs = np.unique(inv.astype(np.int64) * len(items) + np.concatenate(owners))
        self.owner, self.owner_from = pairs % len(items), np.searchsorted(pairs // len(items), np.arange(len(first) + 1))
        self.shingle = shingle
        self.size = np.minimum(self.lengths, shingle)
        self.sizes = np.unique(self.size).tolist()
        self.codes = {k: np.unique(np.concatenate([c for _, _, c in self._codes(k)])) for k in self.sizes}
        self.windows_by: dict = {}

    def owners(self, w: int) -> list:
        return [self.names[k] for k in self.owner[self.owner_from[w] : self.owner_from[w + 1]].tolist()]

    def _codes(self, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each place in a window: the place, the windows (with shingles of k words) that have it, and the shingle's code there."""
        own = np.flatnonzero(self.size == k)
        for j in range(self.matrix.shape[1] - k + 1):
            has = own[self.lengths[own] >= j + k]
            if len(has):
                yield j, has, codes([self.matrix[has, j + t] for t in range(k)])

    def order(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """counts: by size, sorted codes and how often they stand in all documents. Chooses each window's rarest shingle, the first of equally rare ones."""
        best = np.full(len(self.matrix), np.iinfo(np.int64).max)
        code, off = np.zeros(len(self.matrix), np.int64), np.zeros(len(self.matrix), np.int64)
        for k in self.sizes:
            keys, n = counts.get(k, (np.empty(0, np.int64),) * 2)
            for j, has, c in self._codes(k):
                i = np.minimum(np.searchsorted(keys, c), max(0, len(keys) - 1))
                found = np.where(keys[i] == c, n[i], 0) if len(keys) else np.zeros(len(c), np.int64)
                less = found < best[has]
                at = has[less]
                best[at], code[at], off[at] = found[less], c[less], j
            own = np.flatnonzero((self.size == k) & (best > 0))  # without one of its shingles a window cannot occur
            own = own[np.argsort(code[own], kind="stable")]
            keys, first = np.unique(code[own], return_index=True)
            self.windows_by[k] = (keys, np.append(first, len(own)), own, off[own])

    def ids(self, texts: list, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts (-1: not in the benchmark), with a -2 after each text; words of each text. Words are objects a piece at a time only."""
        flat, sizes, get = [], [], self.vocab.__getitem__
        for t in texts:
            n, at, low = 0, 0, t.translate(TO_WORDS) if t else b""
            while at < len(low):
                end = low.find(b" ", at + piece)
                end = len(low) if end < 0 else end
                ws = low[at:end].split()
                flat.append(np.fromiter(map(get, ws), np.int32, len(ws)))
                n, at = n + len(ws), end
            sizes.append(n)
            flat.append(END)
        return np.concatenate(flat) if flat else np.empty(0, np.int32), np.array(sizes, np.int64)

    def places(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose k words are all known, and their codes."""
        ok, n = ids >= 0, len(ids) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ok = np.logical_and.reduce([ok[j : n + j] for j in range(k)])
        at = np.flatnonzero(ok)
        return at, codes([ids[at + j] for j in range(k)])

    def shingle_counts(self, texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids, _ = self.ids(texts)
        for k in self.sizes:
            _, code = self.places(ids, k)
            i = np.searchsorted(self.codes[k], code)
            i = i[(i < len(self.codes[k])) & (self.codes[k][np.minimum(i, len(self.codes[k]) - 1)] == code)]
            n = np.bincount(i, minlength=len(self.codes[k]))
            at = np.flatnonzero(n)
            yield k, self.codes[k][at], n[at]

    def occurrences(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; for each true occurrence its window, its start among all words and separators, and its text."""
        ids, sizes = self.ids(texts)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        wins, poss = [], []
        for k in self.sizes:
            keys, ptr, win, off = self.windows_by[k]
            if not len(keys):
                continue
            at, code = self.places(ids, k)
            i = np.searchsorted(keys, code)
            hit = (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] == code)
            at, i = at[hit], i[hit]
            n = ptr[i + 1] - ptr[i]
            which = np.repeat(ptr[i] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else ptr[i], n) + np.arange(n.sum())
            w, s = win[which], np.repeat(at, n) - off[which]
            size = self.lengths[w]
            ok = (s >= 0) & (s + size <= len(ids))
            w, s, size = w[ok], s[ok], size[ok]
            same = np.ones(len(w), bool)
            for j in range(self.matrix.shape[1]):
                more = j < size
                same &= ~more | (ids[np.minimum(s + j, len(ids) - 1)] == self.matrix[w, j])
            wins.append(w[same])
            poss.append(s[same])
        w = np.concatenate(wins) if wins else np.empty(0, np.int64)
        s = np.concatenate(poss) if poss else np.empty(0, np.int64)
        return sizes, w, s, np.searchsorted(starts, s, side="right") - 1


def blocks(benchmark: DataFrame, window: int, shingle: int, block_words: int, *, item: str, text: str) -> Iterator[Block]:
    """Streams the items; the driver holds one block and one partition at a time. An item of over block_words words comes in parts that overlap by a window less a word."""
    rows, n = [], 0
    for r in benchmark.select(F.col(item).alias("i"), F.col(text).cast("binary").alias("t")).toLocalIterator():
        ws = words(r.t)
        step = max(1, block_words - window + 1)
        for at in range(0, max(1, len(ws) - window + 1), step):
            if part := ws[at : at + step + window - 1]:
                if n and n + len(part) > block_words:
                    yield Block(rows, window, shingle)
                    rows, n = [], 0
                rows.append((r.i, part))
                n += len(part)
    if rows:
        yield Block(rows, window, shingle)


def ordered(docs: DataFrame, block: Block, text: str) -> Block:
    """The block with its windows under their rarest shingle by counts over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(block)

    def count(texts: list) -> dict:
        k, c, n = [], [], []
        for size, codes, ns in held.value.shingle_counts(texts):
            k += [size] * len(codes)
            c += codes.tolist()
            n += ns.tolist()
        return {"rows": [list(zip(k, c, n, strict=True))] + [[]] * (len(texts) - 1)}

    each = map_texts(docs, count, "rows array<struct<k:int,c:bigint,n:bigint>>", keep=(), text=text)
    got = each.select(F.explode("rows").alias("r")).groupBy("r.k", "r.c").agg(F.sum("r.n").alias("n")).orderBy("k", "c").toArrow()  # at most a row for each of the block's own shingles
    k, c, n = (got.column(x).to_numpy() for x in ("k", "c", "n"))
    block.order({size: (c[k == size], n[k == size]) for size in block.sizes})
    held.unpersist()
    return block


def find_items(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 3, block_words: int = 500_000, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document: its id, n_words, n_hit, items (ids as sorted strings, null last), spans of hit words (first, end)."""
    folder, state = shared_dir(docs.sparkSession), docs.select(F.col(doc).alias("doc"), F.col(text).cast("binary").alias("txt"))
    state = state.withColumns({"n": F.lit(None).cast("bigint"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<array<int>>")})
    k = 0
    for k, block in enumerate(blocks(benchmark, window, shingle, block_words, item=item, text=item_text), 1):
        held = docs.sparkSession.sparkContext.broadcast(ordered(docs, block, text))

        def hits(texts: list, held=held) -> dict:
            sizes, items, spans = occurring(held.value, texts)
            return {"n1": sizes, "items1": items, "spans1": spans}

        if k > 1:
            state = written(state, folder, f"hits{k - 1}")
        state = map_texts(state, hits, "n1 bigint, items1 array<string>, spans1 array<array<int>>", keep=tuple(state.columns), text="txt")
        joined = (F.col("items1"), F.col("spans1")) if k == 1 else (F.array_union("items", "items1"), F.concat("spans", "spans1"))
        state = state.select("doc", "txt", F.col("n1").alias("n"), joined[0].alias("items"), joined[1].alias("spans"))
    if not k:
        state = map_texts(state, lambda texts: {"n1": [len(words(t)) for t in texts]}, "n1 bigint", keep=tuple(state.columns), text="txt").drop("n").withColumnRenamed("n1", "n")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0]) if k < 2 else F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s[0], s[1] - 1))))).cast("bigint")
    return state.select(F.col("doc").alias(doc), F.col("n").alias("n_words"), n_hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans")


def occurring(block: Block, texts: list) -> tuple[list, list, list]:
    """Words, items (as strings) and merged spans of hit words of each text."""
    sizes, w, s, d = block.occurrences(texts)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    for i in np.lexsort((s, d)).tolist():
        a = int(s[i] - starts[d[i]])
        e = a + int(block.lengths[w[i]])
        own = spans[d[i]]
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([a, e])
    for i, j in set(zip(d.tolist(), w.tolist(), strict=True)):
        items[i].update(None if x is None else str(x) for x in block.owners(j))
    return sizes.tolist(), [sorted(x, key=lambda i: (i is None, i or "")) for x in items], spans


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 3, block_words: int = 500_000, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no window of any item."""
    folder, out = shared_dir(docs.sparkSession), docs
    for k, block in enumerate(blocks(benchmark, window, shingle, block_words, item=item, text=item_text)):
        if k:
            out = written(out, folder, f"clean{k}")
        held = docs.sparkSession.sparkContext.broadcast(ordered(docs, block, text))

        def setup(held=held):
            def clean(texts: list) -> list:
                hit = set(held.value.occurrences(texts)[3].tolist())
                return [i not in hit for i in range(len(texts))]

            return clean

        out = filter_texts(out, setup, text=text)
    return out
