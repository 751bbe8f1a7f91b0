"""Secret scans: fixed patterns, and strings that pass a battery of randomness tests.

A candidate is a maximal run of [A-Za-z0-9+/_=-] with `least` characters or more. Its encoding is inferred: the smallest of
hex, base32, small letters and digits, letters and digits, base64 whose alphabet holds it. The null hypothesis is "language in that alphabet", and what
language is like there is measured on all texts: counts of neighbouring symbols, and lengths of pieces (a piece ends where a capital follows a small letter
or a digit meets a letter). Three statistics of a candidate's letters and digits are compared with what language gives at its length:

* chi-squared uniformity of the alphabet, as the number of equal pairs of symbols (the chi-squared of a length is a linear function of it): language repeats its frequent letters;
* runs: language has few pieces; tested where the candidate has two kinds of characters;
* serial correlation of neighbours, in the coding of letters by numbers that has the strongest one in language (the first eigenvector of the corpus's table of neighbours).

Their normal scores are added (Stouffer). Scores of all candidates of all documents are counted by band of length (doublings), in a histogram of fixed size. There the null's
centre and spread are estimated from the lower half (an empirical null), and false discoveries controlled at `rate` (Benjamini-Hochberg) band by band, so that short strings
need stronger evidence. Spans that overlap a span of the fixed patterns are not added again.

Nulls: a null text is empty. Empty table: no thresholds, no rows. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, code_points, map_texts

#: The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
HINT = re.compile(rb"(?i)passw|secret|token|api")
DIGITS, SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = DIGITS + SMALL + SMALL.upper()
#: Alphabets, the smaller ones first; base64 has marks too, which join words in language and are not tested.
ENCODINGS = {"hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": SMALL.upper() + "234567", "base36": DIGITS + SMALL, "base62": SYMBOLS}
N = len(SYMBOLS)
#: Of each byte: its symbol (N: none), and its kind (0: none, 1: small, or beyond ASCII, 2: capital, 3: digit).
SYMBOL = np.full(256, N, np.int64)
SYMBOL[[ord(c) for c in SYMBOLS]] = np.arange(N)
KIND = np.array([1 if c >= 128 or chr(c).islower() else 2 if chr(c).isupper() else 3 if chr(c).isdigit() else 0 for c in range(256)], np.int8)
BINS, BANDS, STEP, LOW = 400, 16, 0.1, -10.0


def base_spans(text: bytes, s: str) -> list[tuple[str, int, int]]:
    out = []
    if HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(s) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(s) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(s)]
    return out


def piece_starts(kind: np.ndarray) -> np.ndarray:
    """Where a piece begins: after what is no letter or digit, between letter and digit, at a capital after a small letter."""
    before = np.concatenate([np.zeros(1, np.int8), kind[:-1]])
    return (kind > 0) & ((before == 0) | ((before == 1) & (kind == 2)) | ((before == 3) != (kind == 3)))


def language_counts(text: bytes) -> np.ndarray:
    """Counts of neighbouring symbols, then pieces, the sum of their lengths and of the squares."""
    b = np.frombuffer(text, np.uint8)
    sym, kind = SYMBOL[b], KIND[b]
    out = np.empty(N * N + 3, np.int64)
    near = sym[:-1] * (N + 1) + sym[1:]
    out[: N * N] = np.bincount(near, minlength=(N + 1) ** 2).reshape(N + 1, N + 1)[:N, :N].ravel()
    starts = piece_starts(kind)
    ends = (kind > 0) & np.append(starts[1:] | (kind[1:] == 0), True)
    size = np.flatnonzero(ends) - np.flatnonzero(starts) + 1
    out[N * N :] = len(size), size.sum(), (size**2).sum()
    return out


@dataclass
class Null:
    """What language is like in an alphabet. s2, s3: sums of the squares and cubes of the symbols' shares; value: the coding; serial, spread: of a product of neighbours."""

    s2: float
    s3: float
    value: np.ndarray
    serial: float
    spread: float


class Language:
    """The null hypotheses, from the counts over a corpus."""

    def __init__(self, counts: np.ndarray):
        near = counts[: N * N].reshape(N, N).astype(float)
        n, total, squares = (float(x) for x in counts[N * N :])
        self.piece = max(total / n, 1.5) if n else 5.0
        self.piece_var = max(squares / n - (total / n) ** 2, 1.0) if n else 8.0
        self.nulls = {name: self._null(near, np.array([SYMBOLS.index(c) for c in alphabet])) for name, alphabet in ENCODINGS.items()}

    @staticmethod
    def _null(near: np.ndarray, own: np.ndarray) -> Null:
        share = near[np.ix_(own, own)].sum(0) + near[np.ix_(own, own)].sum(1) + 0.5
        share /= share.sum()
        # Neighbouring letters, of either case: digits follow digits in language and in keys.
        fold = np.where(np.arange(N) >= 10, (np.arange(N) - 10) % 26, 26)
        letters = np.unique(fold[own][fold[own] < 26])
        p = np.zeros((27, 27))
        np.add.at(p, (fold[:, None], fold[None, :]), near)
        p = p[np.ix_(letters, letters)] + 0.5
        p = (p + p.T) / (2 * p.sum())
        each = p.sum(1)
        size, vector = np.linalg.eigh((p - np.outer(each, each)) / np.sqrt(np.outer(each, each)))
        v = vector[:, np.argmax(np.abs(size))] / np.sqrt(each)
        v = np.clip(v / np.abs(v).max() * 6, -2, 2)  # rare letters must not decide alone
        v -= each @ v
        v /= math.sqrt(each @ v**2)
        serial = float(v @ p @ v)
        value = np.zeros(27)
        value[letters] = v
        return Null(float((share**2).sum()), float((share**3).sum()), value[fold], serial, math.sqrt(max(float(v**2 @ p @ v**2) - serial**2, 1e-3)))

    def score(self, run: bytes, least: int) -> float:
        """How far the run is from language, towards random, in standard deviations; -inf without enough letters and digits."""
        b = np.frombuffer(run, np.uint8)
        sym, kind = SYMBOL[b], KIND[b]
        own = sym < N
        n = int(own.sum())
        if n < least:
            return -math.inf
        count = np.bincount(sym[own], minlength=N)
        has = {SYMBOLS[i] for i in np.flatnonzero(count)}
        null = self.nulls[next(name for name, alphabet in ENCODINGS.items() if has <= set(alphabet))]
        pairs, z = n * (n - 1) / 2, []
        equal = float((count * (count - 1)).sum()) / 2
        z.append((pairs * null.s2 - equal) / math.sqrt(pairs * (null.s2 - null.s2**2) + 2 * pairs * (n - 2) * max(null.s3 - null.s2**2, 0)))
        letter = (sym >= 10) & own
        near = letter[1:] & letter[:-1]
        if near.any():
            r = float((null.value[sym[:-1][near]] * null.value[sym[1:][near]]).mean())
            z.append((r - null.serial) * (1 if null.serial < 0 else -1) / (null.spread / math.sqrt(near.sum())))
        if len(set(kind[own].tolist())) > 1:
            z.append((int(piece_starts(kind).sum()) - n / self.piece) / math.sqrt(n * self.piece_var / self.piece**3))
        return sum(max(-4.0, min(8.0, x)) for x in z) / math.sqrt(len(z))


def band(n: int) -> int:
    return min(BANDS - 1, int(math.log2(n)))


class Scanner:
    """Candidates with their scores. Short runs come again and again: their scores are kept, in a bounded number."""

    def __init__(self, language: Language, least: int):
        self.pattern = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % least)
        self.long, self.short = lambda run: language.score(run, least), lru_cache(1 << 16)(lambda run: language.score(run, least))

    def __call__(self, text: bytes) -> list[tuple[int, int, float]]:
        out = [(m.start(), m.end(), (self.short if m.end() - m.start() <= 64 else self.long)(m[0])) for m in self.pattern.finditer(text)]
        return [x for x in out if x[2] > -math.inf]


def summed(docs: DataFrame, text: str, setup) -> dict[int, int]:
    """The sums of counts by cell over all texts; setup gives a function from texts to an array of counts of fixed size."""

    def per_task():
        count = setup()

        def fn(texts: list) -> dict:
            c = count([t for t in texts if t])
            at = np.flatnonzero(c)
            return {"rows": [list(zip(at.tolist(), c[at].tolist(), strict=True))] + [[]] * (len(texts) - 1)}

        return fn

    each = map_texts(docs, None, "rows array<struct<cell:int,n:bigint>>", keep=(), text=text, setup=per_task)
    return {r.cell: r.n for r in each.select(F.explode("rows").alias("r")).groupBy("r.cell").agg(F.sum("r.n").alias("n")).collect()}


def learned(docs: DataFrame, text: str = "text") -> Language:
    got = summed(docs, text, lambda: lambda texts: language_counts(b"\n".join(texts)) if texts else np.zeros(N * N + 3, np.int64))
    counts = np.zeros(N * N + 3, np.int64)
    counts[list(got)] = list(got.values())
    return Language(counts)


def histogram(docs: DataFrame, language: Language, *, text: str = "text", least: int = 12) -> np.ndarray:
    """Candidates of all documents by band of length and score, in steps of 0.1."""

    def setup():
        scan = Scanner(language, least)

        def count(texts: list[bytes]) -> np.ndarray:
            h = np.zeros(BANDS * BINS, np.int64)
            for t in texts:
                for a, e, z in scan(t):
                    h[band(e - a) * BINS + min(BINS - 1, max(0, int((z - LOW) / STEP)))] += 1
            return h

        return count

    out = np.zeros(BANDS * BINS, np.int64)
    for cell, n in summed(docs, text, setup).items():
        out[cell] = n
    return out.reshape(BANDS, BINS)


def thresholds(counts: np.ndarray, rate: float, few: int = 50) -> dict[int, float]:
    """By band: the least score whose expected false share, m p / (candidates at least so extreme), is at most rate.

    p is of a normal null whose centre and spread are estimated from the candidates up to the median; they may not move the null into what random strings score.
    """
    out, edges = {}, LOW + STEP * np.arange(BINS)
    for b, h in enumerate(counts):
        m = int(h.sum())
        if not m:
            continue
        low, mid = (float(edges[np.searchsorted(np.cumsum(h), q * m)]) for q in (0.16, 0.5)) if m >= few else (-1.0, 0.0)
        centre, spread = min(mid, 0.5), min(max(mid - low, 1.0), 2.0)
        p = np.array([0.5 * math.erfc((x - centre) / spread / math.sqrt(2)) for x in edges])
        above = np.cumsum(h[::-1])[::-1]
        ok = np.flatnonzero((above > 0) & (edges > centre) & (m * p <= rate * above))
        if len(ok):
            out[b] = float(edges[ok[0]])
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", least: int = 12, rate: float = 0.01) -> DataFrame:
    """A row for each document: n_assign, n_access, n_hex, n_random, base (spans of the patterns as text), spans (all)."""
    language = learned(docs, text)
    limits = thresholds(histogram(docs, language, text=text, least=least), rate)

    def setup():
        found = Scanner(language, least)

        def fn(texts: list) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_random", "base", "spans")}
            for t in texts:
                t = t or b""
                s = t.decode()
                base = base_spans(t, s)
                more = [(a, e) for a, e, z in found(t) if z >= limits.get(band(e - a), math.inf)]
                at = code_points(t, [a for a, _ in more]) if len(s) < len(t) else {a: a for a, _ in more}
                more = clear([("random", at[a], at[a] + e - a) for a, e in more], base)
                for k in KINDS[:3]:
                    out[f"n_{k}"].append(sum(x[0] == k for x in base))
                out["n_random"].append(len(more))
                out["base"].append(joined(base))
                out["spans"].append(joined(base + more))
            return out

        return fn

    return map_texts(docs, None, "n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base string, spans string", keep=(doc,), text=text, setup=setup)
