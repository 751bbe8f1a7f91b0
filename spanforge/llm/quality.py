"""Quality rules: a decision list learned by sequential covering from labelled text statistics.

For the class "reject", a rule is grown by adding, one after another, the threshold condition with the highest
FOIL gain on the grow part; it is then pruned, from its end, to the prefix that is worth most on the prune part. An accepted rule's
examples are taken away and the next one is sought, until a rule is not precise enough. The rules come out, in order, as
one Spark conditional expression.

The learner sees at most `sample_rows` labelled documents (those with the smallest hash of their id); statistics and rules
then cover every whole text. Nulls: a null text has no words; labels without a doc_id or quality are left out, of
several labels of a document the lowest counts. Without labels of both kinds there are no rules, and only the base test rejects.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CONTINUATION, map_texts

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE = re.compile(rb"[\x20\x09-\x0d]")
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_distinct bigint, n_alone bigint, n_upper bigint, n_digits bigint, n_stops bigint"
UPPER, DIGIT = bytes(set(range(256)) - set(range(65, 91))), bytes(set(range(256)) - set(range(48, 58)))


def repeated(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of `size` words that the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(size)), strict=False))
    seen = set(grams)
    if len(seen) == n:
        return 0
    first: dict = {}
    hit = np.zeros(n + 1, bool)
    for i, g in enumerate(grams):
        j = first.setdefault(g, i)
        if j != i:
            hit[i] = hit[j] = True
    return covered(np.flatnonzero(hit), len(words), size)


def covered(starts: np.ndarray, n: int, size: int) -> int:
    """Places 0 to n - 1 inside windows of `size` with these starts."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + size] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def numbered_words(text: bytes, piece: int) -> tuple[np.ndarray, list[bytes]]:
    """The words of a long text as numbers of distinct ones; words are objects a piece at a time only."""
    known: dict[bytes, int] = {}
    parts, at = [np.empty(0, np.int64)], 0
    while at < len(text):
        end = SPACE.search(text, at + piece)
        end = end.start() if end else len(text)
        ws = text[at:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws)))
        at = end
    return np.concatenate(parts), list(known)


def repeated_numbers(ids: np.ndarray, distinct: int, size: int = 5) -> int:
    """As repeated, for words as numbers: windows are ranked exactly, a word longer at a time."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    rank = ids
    for k in range(1, size):
        _, rank, count = np.unique(rank[: len(ids) - k] * distinct + ids[k:], return_inverse=True, return_counts=True)
    return covered(np.flatnonzero(count[rank] > 1), len(ids), size)


def text_stats(text: bytes | None, long: int = 1 << 20) -> tuple[int, ...]:
    """The statistics of STATS. Texts of over `long` bytes take the same numbers from arrays."""
    if not text:
        return (0,) * 11
    if len(text) > long:
        ids, known = numbered_words(text, long)
        sizes = np.array([len(w) for w in known], np.int64)[ids]
        n_words, n_repeat, n_distinct, n_alone, n_short = len(ids), repeated_numbers(ids, len(known)), len(known), int((sizes == 1).sum()), int((sizes <= 4).sum())
    else:
        words = text.split()
        n_words, n_repeat, n_distinct, n_alone, n_short = len(words), repeated(words), len(set(words)), sum(1 for w in words if len(w) == 1), sum(1 for w in words if len(w) <= 4)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    continued = len(text) - len(text.translate(None, CONTINUATION))
    spaces = len(text) - len(text.translate(None, SPACES))
    return (
        n_words,
        len(text) - continued - spaces,
        len(text.translate(None, NOT_SYMBOLS)),
        len(lines) - len(set(lines)),
        n_repeat,
        len(lines),
        n_distinct,
        n_alone,
        len(text.translate(None, UPPER)),
        len(text.translate(None, DIGIT)),
        n_short,
    )


def stats(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row of statistics for each document."""
    names = [x.split()[0] for x in STATS.split(", ")]

    def fn(texts: list) -> dict:
        rows = [text_stats(t) for t in texts]
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_texts(docs, fn, STATS, keep=(doc, *keep), text=text)


def features() -> dict[str, Column]:
    """What the rules' conditions look at: shares, so that a threshold holds for long and short texts."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbol_share": F.col("n_symbols") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "line_words": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "distinct_share": F.col("n_distinct") / n,
        "alone_share": F.col("n_alone") / n,
        "upper_share": F.col("n_upper") / c,
        "digit_share": F.col("n_digits") / c,
        "short_share": F.col("n_stops") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        c = features()[self.feature]
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x[c.feature])
    return out


def grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> list[Condition]:
    """Adds conditions by FOIL gain, p1 * (log2 of the new share of rejects - of the old one), until no keeper is left."""
    rule: list[Condition] = []
    live = np.ones(len(y), bool)
    while len(rule) < most and (~y[live]).any():
        p0, n0 = y[live].sum(), live.sum()
        if not p0:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for name, col in x.items():
            v = col[live]
            order = np.argsort(v, kind="stable")
            s, t = v[order], y[live][order]
            cut = np.flatnonzero(s[1:] > s[:-1])
            if not len(cut):
                continue
            p_low, n_low = np.cumsum(t)[cut], cut + 1
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                gain = p * (np.log2(np.maximum(p, 1e-9) / n) - np.log2(p0 / n0))
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), Condition(name, above, float((s[cut[i]] + s[cut[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= best[1].holds(x[best[1].feature])
    return rule


def prune(rule: list[Condition], x: dict[str, np.ndarray], y: np.ndarray) -> list[Condition]:
    """The prefix with the highest (p - n) / (p + n) on the prune part; the shorter at a tie."""
    best, worth = rule, -2.0
    for k in range(len(rule), 0, -1):
        hit = covers(rule[:k], x, len(y))
        p, n = y[hit].sum(), (~y[hit]).sum()
        v = (p - n) / (p + n) if p + n else -1.0
        if v >= worth:
            best, worth = rule[:k], v
    return best


def learn(x: dict[str, np.ndarray], reject: np.ndarray, *, precision: float = 0.95, least: int = 3, most_rules: int = 12, most_conditions: int = 4) -> list[list[Condition]]:
    """The decision list; a rule must be right on `precision` of all examples left that it covers, and cover `least` rejects."""
    rules: list[list[Condition]] = []
    left = np.ones(len(reject), bool)
    part = np.arange(len(reject)) % 3
    while len(rules) < most_rules and reject[left].any() and (~reject[left]).any():
        g, p = left & (part != 2), left & (part == 2)
        rule = grow({k: v[g] for k, v in x.items()}, reject[g], most_conditions)
        if rule and p.any():
            rule = prune(rule, {k: v[p] for k, v in x.items()}, reject[p])
        hit = covers(rule, x, len(reject)) & left if rule else np.zeros(len(reject), bool)
        if not rule or reject[hit].sum() < least or reject[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learned_rules(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", label_doc: str = "doc_id", label: str = "quality", sample_rows: int = 6000, **options) -> list[list[Condition]]:
    """Rules from a bounded sample of labelled documents, fitted on the driver."""
    some = labels.select(F.col(label_doc).alias("ld"), F.col(label).alias("q")).where("ld is not null and q is not null")
    some = some.groupBy("ld").agg(F.min("q").alias("q")).orderBy(F.xxhash64("ld"), "ld").limit(sample_rows)
    hit = docs.select(F.col(doc).alias("ld"), F.col(text).alias("txt")).join(F.broadcast(some), "ld")  # at most sample_rows rows
    f = features()
    rows = stats(hit, doc="ld", text="txt", keep=("q",)).select("ld", "q", *[c.alias(k) for k, c in f.items()]).orderBy(F.xxhash64("ld"), "ld", *f).limit(2 * sample_rows).collect()
    reject = np.array([r.q == 0 for r in rows], bool)
    return learn({k: np.array([r[k] for r in rows], float) for k in f}, reject, **options)


def rule_column(rules: list[list[Condition]]) -> Column:
    """The first rule that a document meets, as text; null if it meets none."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column()
        out = F.when(cond, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judged(st: DataFrame, rules: list[list[Condition]], *, least_words: int = 10, most_repeat: int = 20) -> DataFrame:
    """Adds base_failed, rule and kept to the statistics."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    return st.withColumn("base_failed", base).withColumn("rule", rule_column(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
