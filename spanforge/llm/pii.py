"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions, in numpy.

The network is trained on the driver from labelled spans: windows of a bounded sample of documents, labelled by the patterns, and the same prose
with personal data in other layouts put in (spaced or bracketed parts, "(at)", no plus sign). It labels characters B/I/O by kind.

Overlapping windows cover every whole text. Every window's Viterbi path gives candidate spans, scored by their margin over "no span"; those that
touch a cut edge of the window are left to its neighbour or, if no window holds them whole, joined with their parts there. The candidates of a whole
document are then reconciled by weighted interval scheduling, and those clear of the patterns' spans are added.

Nulls: a null text is empty. Without any document to sample, the network learns from generated text alone. Repeated rows get equal results.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear, code_points, map_texts, prepared, tidy

#: The patterns of the contract, in its order of kinds. What cannot match from a later place of a run of digits is not tried there.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "ip": re.compile(rb"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(rb"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
DIGIT = re.compile(rb"[0-9]")


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of a run of LOCAL, "@" and DOMAIN. From "@" to "@", so that no run of letters is tried from each of its places."""
    free = 0  # the end of the last match, or what follows the last "@"
    at = text.find(b"@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
        at = text.find(b"@", free)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def valid(kind: str, m: bytes) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip(b"0") or b"0" for p in m.split(b".")))
    digits = bytes(c for c in m if 48 <= c <= 57)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """Spans in code points, by kind, then start."""
    out = [("email", a, e) for a, e in emails(text)]
    if DIGIT.search(text):
        out += [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text) if valid(k, m[0])]
    if out and not text.isascii():
        at = code_points(text, [a for _, a, _ in out])
        out = [(k, at[a], at[a] + e - a) for k, a, e in out]
    return out


# Characters the network tells apart; every other code point is a letter beyond ASCII (the last class).
CLASSES = np.full(0x180, 21, np.int64)
CLASSES[:128] = 20
for _c in range(128):
    _s = chr(_c)
    CLASSES[_c] = 0 if _s.islower() else 1 if _s.isupper() else 2 if _s.isdigit() else {" ": 3, "\n": 4, "@": 5, ".": 6, "-": 7, "_": 8, "+": 9, "(": 10, ")": 11, ",": 12, ":": 13, "/": 14, "[": 15, "]": 16, '"': 17, "=": 18, "\t": 19}.get(_s, 20)
N_CLASSES, PAD = 23, 22
LABELS = 1 + 2 * len(KINDS)  # 0: outside; 1 + 2 k: begins kind k; 2 + 2 k: goes on


def classes(s: str) -> np.ndarray:
    return CLASSES[np.minimum(np.frombuffer(s.encode("utf-32-le"), np.uint32), len(CLASSES) - 1)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: sigmoid from -10 to 10 and, steeper, tanh from -6 to 6 in steps of 1 / STEPS of their arguments times 1 and 4; beyond, both stand still. Off by 1e-4 at most.
STEPS, STEEP = 2048, 4
SIGMOID, TANH = (f(np.arange(-m * STEPS, m * STEPS + 1) / STEPS / by).astype(np.float32) for f, m, by in ((sigmoid, 10, 1), (np.tanh, 24, STEEP)))
#: Added to a number of up to some thousands, it leaves the nearest step's number in the lowest bits.
SHIFT = np.float32(1.5 * 2**23 / STEPS)
ZERO = int(SHIFT.view(np.int32))


def looked_up(table: np.ndarray, x: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """The table's values for x, which is overwritten, as is at."""
    x += SHIFT
    np.subtract(x.view(np.int32), ZERO - len(table) // 2, out=at)
    np.take(table, at, out=out, mode="clip")


class Tagger:
    """Embedding, LSTM in both directions, linear emissions, CRF. Arrays are (time, batch, ...)."""

    def __init__(self, hidden: int = 8, embed: int = 10, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.w = {"emb": f(N_CLASSES, embed), "out": f(2 * hidden, LABELS), "ob": np.zeros(LABELS, np.float32), "tr": np.zeros((LABELS, LABELS), np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": f(embed, 4 * hidden), f"h{d}": f(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.w[f"c{d}"][hidden : 2 * hidden] = 1
        self.allowed = np.zeros((LABELS, LABELS), np.float32)
        for j in range(2, LABELS, 2):
            for i in range(LABELS):
                if i not in (j, j - 1):
                    self.allowed[i, j] = -1e4  # a span goes on only after its own kind

    def lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        w, n = self.w, self.h
        g = x @ w[f"x{d}"] + w[f"c{d}"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out, memo = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = g[t] + h @ w[f"h{d}"]
            s = sigmoid(z[:, : 3 * n])
            i, f, o, u = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            memo.append((t, h, c, i, f, o, u))
            c = f * c + i * u
            h = o * np.tanh(c)
            out[t] = h
        return out, memo

    def back(self, x: np.ndarray, d: str, memo: list, grad: np.ndarray, g: dict) -> np.ndarray:
        w, n = self.w, self.h
        dx, dh, dc = np.zeros_like(x), 0.0, 0.0
        for t, h0, c0, i, f, o, u in reversed(memo):
            c = f * c0 + i * u
            tc = np.tanh(c)
            dh_ = grad[t] + dh
            dc_ = dc + dh_ * o * (1 - tc * tc)
            z = np.concatenate([dc_ * u * i * (1 - i), dc_ * c0 * f * (1 - f), dh_ * tc * o * (1 - o), dc_ * i * (1 - u * u)], 1)
            g[f"x{d}"] += x[t].T @ z
            g[f"h{d}"] += h0.T @ z
            g[f"c{d}"] += z.sum(0)
            dx[t] = z @ w[f"x{d}"].T
            dh, dc = z @ w[f"h{d}"].T, dc_ * f
        return dx

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.w["emb"][ids]
        (f, mf), (b, mb) = self.lstm(x, "f"), self.lstm(x, "b")
        hb = np.concatenate([f, b], 2)
        return hb @ self.w["out"] + self.w["ob"], (x, mf, mb, hb)

    def step(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood a sequence, and its gradient."""
        e, (x, mf, mb, hb) = self.emissions(ids)
        tr, (n, b, k) = self.w["tr"] + self.allowed, e.shape
        top = lambda v, axis: (m := v.max(axis, keepdims=True), np.squeeze(m, axis) + np.log(np.exp(v - m).sum(axis)))[1]
        a = np.empty_like(e)
        z = np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, n):
            a[t] = top(a[t - 1][:, :, None] + tr, 1) + e[t]
        for t in range(n - 2, -1, -1):
            z[t] = top(tr + (e[t + 1] + z[t + 1])[:, None, :], 2)
        log_z = top(a[-1], 1)
        m = np.exp(a + z - log_z[None, :, None])
        rows = np.arange(b)
        score = e[np.arange(n)[:, None], rows, gold].sum(0) + tr[gold[:-1], gold[1:]].sum(0)
        g = {key: np.zeros_like(v) for key, v in self.w.items()}
        for t in range(1, n):
            g["tr"] += np.exp(a[t - 1][:, :, None] + tr + (e[t] + z[t])[:, None, :] - log_z[:, None, None]).sum(0)
        np.add.at(g["tr"], (gold[:-1], gold[1:]), -1)
        m[np.arange(n)[:, None], rows, gold] -= 1
        g["out"], g["ob"] = np.tensordot(hb, m, ([0, 1], [0, 1])), m.sum((0, 1))
        dh = m @ self.w["out"].T
        dx = self.back(x, "f", mf, dh[:, :, : self.h], g) + self.back(x, "b", mb, dh[:, :, self.h :], g)
        np.add.at(g["emb"], ids, dx)
        return float((log_z - score).mean()), {key: v / b for key, v in g.items()}

    def train(self, ids: np.ndarray, gold: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 5) -> float:
        """Adam. ids and gold: (windows, time). Returns the last loss."""
        r, loss = np.random.default_rng(seed), 0.0
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for t in range(1, steps + 1):
            at = r.integers(0, len(ids), batch)
            loss, g = self.step(ids[at].T, gold[at].T)
            norm = math.sqrt(sum(float((x**2).sum()) for x in g.values()))
            lr = rate * (1 - t / (steps + 1))
            for k, x in g.items():
                x = x * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.w[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return loss

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """(time, hidden + embedding + 1, windows): what a step multiplies. The hidden part is left free, the last row is the bias's."""
        emb, n = self.w["emb"], self.h
        x = np.empty((len(ids), n + emb.shape[1] + 1, ids.shape[1]), np.float32)
        for j, own in enumerate(np.ascontiguousarray(emb.T)):
            np.take(own, ids, out=x[:, n + j], mode="clip")
        x[:, -1] = 1
        return x

    def hidden(self, x: np.ndarray, d: str) -> np.ndarray:
        """As lstm, from inputs, without what learning needs, as (time, hidden, windows); sigmoid and tanh are looked up."""
        w, n = self.w, self.h
        wt = np.ascontiguousarray(np.concatenate([w[f"h{d}"], w[f"x{d}"], w[f"c{d}"][None]]).T)
        wt[3 * n :] *= STEEP
        out, (c, h) = np.empty((len(x), n, x.shape[2]), np.float32), np.zeros((2, n, x.shape[2]), np.float32)
        z, s = (np.empty((4 * n, x.shape[2]), np.float32) for _ in range(2))
        tc, at = np.empty_like(c), np.empty(z.shape, np.int64)
        i, f, o, u = s[:n], s[n : 2 * n], s[2 * n : 3 * n], s[3 * n :]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            x[t, :n] = h
            np.dot(wt, x[t], out=z)
            looked_up(SIGMOID, z[: 3 * n], at[: 3 * n], s[: 3 * n])
            looked_up(TANH, z[3 * n :], at[3 * n :], u)
            c *= f
            i *= u
            c += i
            looked_up(TANH, np.multiply(c, STEEP, out=z[:n]), at[:n], tc)
            h = np.multiply(o, tc, out=out[t])
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels and emissions of (windows, time)."""
        out, n, x = self.w["out"], self.h, self.inputs(np.ascontiguousarray(ids.T))
        e = np.matmul(out[:n].T.copy(), self.hidden(x, "f"))
        e += np.matmul(out[n:].T.copy(), self.hidden(x, "b"))
        e += self.w["ob"][:, None]
        tr = self.w["tr"] + self.allowed
        # What a place adds to a span's score against "outside": its emission and the transition to it. A span that is better than outside has a place that adds.
        gain = tr.max(0) - tr[0, 0] + max(0.0, float((tr[:, 0] - tr[0, 0]).max()))
        open_ = ((e[:, 1:] + gain[1:, None]).max(1) > e[:, 0]).T
        return self.stretches(e, tr, open_), e.transpose(2, 0, 1)

    def stretches(self, e: np.ndarray, tr: np.ndarray, open_: np.ndarray, quiet: int = 16, batch: int = 512) -> np.ndarray:
        """Best labels of (windows, time), from emissions (time, label, window): Viterbi over stretches of open places and `quiet` more on either side, a batch of about one length at a time; outside elsewhere."""
        n = open_.shape[1]
        labels = np.zeros(open_.shape, np.int64)
        row, at = np.nonzero(open_)
        if not len(row):
            return labels
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] - at[:-1] > 2 * quiet)]))
        row, first, end = row[new], np.maximum(at[new] - quiet, 0), np.minimum(at[np.append(new[1:], len(at)) - 1] + quiet + 1, n)
        size = end - first
        order = np.argsort(size, kind="stable")
        flat, many = e.reshape(-1), e.shape[2]
        for part in np.split(order, range(batch, len(order), batch)):
            step = np.arange(size[part[-1]])[:, None]
            at = np.minimum(first[part] + step, n - 1) * (LABELS * many) + row[part]
            own = np.empty((len(step), LABELS, len(part)), e.dtype)
            for k in range(LABELS):
                own[:, k] = np.take(flat[k * many :], at, mode="clip")
                own[:, k][step >= size[part]] = -1e4 * (k > 0)
            t, j = np.nonzero(got := self.viterbi(own.transpose(0, 2, 1), tr))
            labels[row[part][j], first[part][j] + t] = got[t, j]
        return labels

    def viterbi(self, e: np.ndarray, tr: np.ndarray) -> np.ndarray:
        n, b, k = e.shape
        e = np.ascontiguousarray(e.transpose(0, 2, 1))
        best, step = np.empty((n, k, b), e.dtype), np.empty((k, k, b), e.dtype)
        best[0] = e[0]
        for t in range(1, n):
            np.add(best[t - 1][:, None], tr[:, :, None], out=step)
            step.max(0, out=best[t])
            best[t] += e[t]
        out = np.empty((n, b), np.int64)
        out[-1] = best[-1].argmax(0)
        for t in range(n - 1, 0, -1):
            out[t - 1] = (best[t - 1] + tr[:, out[t]]).argmax(0)
        return out


def made_up(r: np.random.Generator, kind: str) -> str:
    """Personal data of a kind in one of several layouts."""
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    w = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, r.integers(3, 9)))
    pick = lambda *x: x[r.integers(0, len(x))]
    if kind == "email":
        return w() + pick(".", "_", "") + pick(d(2), w()) + pick("@", "@", " @ ", " (at) ", "[at]") + w() + pick("", d(1)) + "." + pick(w() + ".", "") + pick("com", "org", "net", "de")
    if kind == "ip":
        return pick(".", ".", ". ", " . ").join(str(x) for x in r.integers(0, 256, 4))
    if kind == "card":
        digits = d(15)
        digits += next(c for c in "0123456789" if luhn((digits + c).encode()))
        return pick("", " ", "-", ".").join(digits[i : i + 4] for i in range(0, 16, 4))
    return pick("+1 ", "+49 ", "001 ", "1-", "") + pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}")


def examples(texts: list[str], n: int, width: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts with labels: as they are, with made-up data put in, and with plain numbers put in (no label)."""
    r = np.random.default_rng(seed)
    texts = [t for t in texts if len(t) > 20] or ["word and other words, in lines of prose. " * 5]
    ids, gold = np.full((n, width), PAD), np.zeros((n, width), np.int64)
    for i in range(n):
        t = texts[r.integers(0, len(texts))]
        labelled = base_spans(t.encode())
        if labelled and r.random() < 0.5:
            mid = labelled[r.integers(0, len(labelled))][1]
        else:
            mid = int(r.integers(0, len(t)))
        a = max(0, mid - int(r.integers(5, width - 20)))
        s, spans = t[a : a + width], []
        for k, x, y in labelled:
            if x >= a and y <= a + width:
                spans.append((k, x - a, y - a))
            elif x < a + width and y > a:
                s = s[: max(0, x - a)] if x > a else s[y - a :]
                spans, s = ([], "") if x <= a else (spans, s)
        if not spans and r.random() < 0.85:
            at = s.find(" ", int(r.integers(0, max(1, len(s) // 2)))) + 1
            if r.random() < 0.75:
                k = KINDS[r.integers(0, len(KINDS))]
                x = made_up(r, k)
                spans = [(k, at, at + len(x))]
            else:
                x = str(r.integers(0, 10 ** int(r.integers(1, 7)))) + ["", ".5", "%", "-2"][r.integers(0, 4)]
                if r.random() < 0.5:  # keys and hashes are no personal data
                    x = "".join("0123456789abcdef"[c] for c in r.integers(0, 16, int(r.integers(12, 41))))
            s = s[:at] + x + " " + s[at:]
        s = s[:width]
        ids[i, : len(s)] = classes(s)
        for k, x, y in spans:
            if y <= len(s):
                j = 1 + 2 * KINDS.index(k)
                gold[i, x] = j
                gold[i, x + 1 : y] = j + 1
    return ids, gold


def trained(texts: list[str], *, windows: int = 1500, width: int = 64, steps: int = 500) -> Tagger:
    tagger = Tagger()
    tagger.train(*examples(texts, windows, width), steps)
    return tagger


def fitted(spark: SparkSession, texts: list[str]) -> Tagger:
    """The tagger, trained in one task, so that the driver stays free and numpy has the threads of a task."""
    prepared(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"w": pickle.dumps(trained(batch.column(0).to_pylist()[0]).w)}], schema=pa.schema([("w", pa.binary())]))

    tagger = Tagger()
    tagger.w = pickle.loads(spark.createDataFrame([(texts,)], "texts array<string>").mapInArrow(tidy(run), "w binary").first().w)
    return tagger


def window_starts(n: int, width: int, overlap: int) -> range:
    """Starts of windows that cover n characters and overlap."""
    return range(0, max(1, n - overlap), width - overlap)


def whole(parts: list[tuple[int, int, int, bool, bool, float]]) -> list[tuple[float, int, int, int]]:
    """Spans (score, start, end, kind) of parts (start, end, kind, cut at the start, cut at the end, sum of margins): those not cut, and chains of cut ones."""
    out, chains = [], []
    for a, e, kind, left, right, margin in sorted(parts):
        if not left and not right:
            out.append((margin / (e - a), a, e, kind))
        elif not left:
            chains.append((a, e, kind, margin, e - a))
        else:
            before = [c for c in chains if c[2] == kind and c[0] < a <= c[1] <= e]
            chains = [c for c in chains if c[1] >= a and c not in before]
            for s, _, _, m, n in before:
                if right:
                    chains.append((s, e, kind, m + margin, n + e - a))
                else:
                    out.append(((m + margin) / (n + e - a), s, e, kind))
    return out


def reconciled(spans: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """The set of disjoint spans (score, start, end, kind) with the greatest sum of scores."""
    spans = sorted(set(spans), key=lambda x: (x[2], x[1], x[3]))
    ends, best = [x[2] for x in spans], [(0.0, None, None)]
    for i, (score, a, _, _) in enumerate(spans):
        j = bisect_right(ends, a, 0, i)
        with_it = best[j][0] + score
        best.append((with_it, i, j) if with_it > best[-1][0] else (best[-1][0], None, len(best) - 1))
    out, k = [], len(best) - 1
    while k > 0:
        _, i, j = best[k]
        if i is not None:
            out.append(spans[i][1:])
        k = j
    return out[::-1]


def model_spans(tagger: Tagger, texts: list[str], *, width: int = 256, overlap: int = 32, least: float = 0.5, batch: int = 1024) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) of the model in each text, reconciled over the text."""
    parts: list[list[tuple[int, int, int, bool, bool, float]]] = [[] for _ in texts]
    codes: dict[int, np.ndarray] = {}
    todo = [(i, a) for i, s in enumerate(texts) if s for a in window_starts(len(s), width, overlap)]
    for at in range(0, len(todo), batch):
        part = todo[at : at + batch]
        ids = np.full((len(part), width), PAD)
        for r, (i, a) in enumerate(part):
            if i not in codes:
                codes = {i: classes(texts[i])}
            x = codes[i][a : a + width]
            ids[r, : len(x)] = x
        labels, e = tagger.decode(ids)
        for r in np.flatnonzero(labels.any(1)).tolist():
            i, a = part[r]
            row, size = labels[r], min(width, len(texts[i]) - a)
            starts = np.flatnonzero((row > 0) & ((row % 2 == 1) | (np.arange(width) == 0)))
            for x in starts[starts < size].tolist():
                y = x + 1
                goes_on = row[x] + row[x] % 2
                while y < size and row[y] == goes_on:
                    y += 1
                margin = float((e[r, np.arange(x, y), row[x:y]] - e[r, x:y, 0]).sum())
                parts[i].append((a + x, a + y, int(row[x] - 1) // 2, x == 0 and a > 0, y == width and a + width < len(texts[i]), margin))
    return [[(KINDS[k], a, e) for a, e, k in reconciled([x for x in whole(p) if x[0] >= least and possible(KINDS[x[3]], texts[i][x[1] : x[2]])])] for i, p in enumerate(parts)]


def possible(kind: str, span: str) -> bool:
    """A card number has a check digit: what fails it is none, however it looks."""
    return kind != "card" or valid("card", "".join(c for c in span if c in "0123456789").encode())


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{e}" for k, a, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", sample_docs: int = 400, sample_chars: int = 4000) -> DataFrame:
    """A row for each document: n_email, n_ip, n_card, n_phone (of the patterns), base, spans (all), as text.

    The network is fitted on at most sample_docs documents (the smallest hashes), of a text of over sample_chars characters on a stretch of so many,
    at a place that the hash chooses; all whole texts are searched.
    """
    hashed = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(doc)).alias("h"), F.col(text).alias("t"))
    bound = hashed.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    stretch = F.substring("t", F.pmod(F.xxhash64("h"), F.greatest(F.length("t") - sample_chars, F.lit(0)) + 1).cast("int") + 1, F.lit(sample_chars))
    sample = hashed.where(F.lit(False) if bound is None else F.col("h") <= bound).select("h", stretch.alias("t")).orderBy("h", "t").limit(sample_docs).collect()
    held = docs.sparkSession.sparkContext.broadcast(fitted(docs.sparkSession, [r.t for r in sample]))

    def setup():
        tagger = held.value

        def fn(texts: list) -> dict:
            out: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base", "spans")}
            base = [base_spans(t) if t else [] for t in texts]
            more = model_spans(tagger, [t.decode() if t else "" for t in texts])
            for b, m in zip(base, more, strict=True):
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x[0] == k for x in b))
                out["base"].append(joined(b))
                out["spans"].append(joined(b + clear(m, b)))
            return out

        return fn

    return map_texts(docs, None, ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string", keep=(doc,), text=text, setup=setup)
