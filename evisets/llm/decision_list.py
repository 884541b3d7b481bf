"""Quality rules as a learned decision list.

Text statistics are measured once per row and stored narrow. From labelled rows sequential covering learns conjunctions of thresholds for bad
texts: a conjunction grows by the condition of largest information gain on one part of the rows, is pruned on the other part, is kept if it is
precise there, and the rows it covers are set aside. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisets.llm.common import sampled

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
#: Rule feature: numerator and denominator among the counts.
RATIOS = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "line_words": ("n_words", "n_lines"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "word_chars"), "distinct": ("n_distinct", "n_words"),
}
SAMPLE = 20_000  # labelled rows used at most
CUTS, LONGEST, MOST, PRECISE, LEAST = 64, 4, 16, 0.95, 5


def repeated(words: list[bytes], window: int = WINDOW) -> tuple[int, int]:
    """Words inside windows that occur twice or more, and the number of distinct words."""
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.uint64, len(words))
    n = len(words) - window + 1
    if n < 2:
        return 0, len(code)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0, len(code)
    at = np.flatnonzero(np.isin(h, twice))
    exact = [tuple(words[i : i + window]) for i in at.tolist()]  # equal hashes are only candidates
    times = Counter(exact)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at.tolist(), exact, strict=True):
        if times[w] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum()), len(code)


def counts(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    again, distinct = repeated(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    letters = text.encode("utf-8", "surrogatepass").translate(None, delete=bytes(b for b in range(256) if not 65 <= b <= 90))
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again,
            len(lines), len(letters), sum(map(text.count, "0123456789")), sum(map(text.count, ".,;:!?")), distinct)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and COUNTS of the whole text; a null text has none of anything. Other columns are ignored."""
    narrow = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))

    def rows(batches):
        for b in batches:
            c = [counts(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), *(pa.array([x[i] for x in c], pa.int64()) for i in range(len(COUNTS)))], ["doc_id", *COUNTS])

    return narrow.mapInArrow(rows, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS))


class Condition(NamedTuple):
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return self.value() > self.cut if self.above else self.value() <= self.cut

    def value(self) -> Column:
        top, bottom = RATIOS[self.feature]
        return F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1)) if bottom else F.col(top).cast("double")

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut


def gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """Information a condition adds about the bad rows it still covers."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    inside, rule = np.ones(len(bad), bool), []
    while len(rule) < LONGEST and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best = (1e-9, None)
        for f, v in x.items():
            order = np.argsort(v[inside], kind="stable")
            values, hit = v[inside][order], bad[inside][order]
            ends = np.flatnonzero(np.diff(values))  # a cut lies between two different values
            if not len(ends):
                continue
            ends = ends[np.unique(np.linspace(0, len(ends) - 1, CUTS).astype(int))]
            below = np.cumsum(hit)
            for e in ends.tolist():
                p, n, cut = int(below[e]), e + 1 - int(below[e]), float((values[e] + values[e + 1]) / 2)
                for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                    g = gain(p0, n0, a, b)
                    if g > best[0]:
                        best = (g, Condition(f, above, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = inside & best[1].holds(x)
    return rule


def covered(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    inside = np.ones(n, bool)
    for c in rule:
        inside &= c.holds(x)
    return inside


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precise: float = PRECISE) -> list[list[Condition]]:
    """Ordered conjunctions for bad rows. A third of the rows, taken alternately, only prunes and tests."""
    test, rules = np.arange(len(bad)) % 3 == 2, []
    left = np.ones(len(bad), bool)
    while len(rules) < MOST:
        g, t = left & ~test, left & test
        if not (bad & g).any():
            break
        rule = grow({f: v[g] for f, v in x.items()}, bad[g])
        tested = []
        for k in range(1, len(rule) + 1):
            inside = t & covered(rule[:k], x, len(bad))
            p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
            tested.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        worth, k, p, n = max(tested, default=(-1.0, 0, 0, 0))
        if p < LEAST or p < precise * (p + n):
            break
        rules.append(rule[:-k])
        left &= ~covered(rules[-1], x, len(bad))
    return rules


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, precise: float = PRECISE) -> list[list[Condition]]:
    """Learn from rows of ``measured`` whose doc_id has a label, 0 for bad: of an id with several labels the lowest counts, null labels don't, of
    repeated rows one. At most ``sample`` labels, those of smallest hash, are used. Without bad rows there are no rules."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label"))
    rows = measured.join(sampled(known, "doc_id", sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("_label", *COUNTS)).alias("_row"))
    rows = rows.select("doc_id", "_row.*").toPandas().sort_values("doc_id")
    ratio = lambda top, bottom: rows[top].to_numpy(float) / (np.maximum(rows[bottom].to_numpy(float), 1) if bottom else 1)
    return learn({f: ratio(*r) for f, r in RATIOS.items()}, rows["_label"].to_numpy(int) == 0, precise)


def verdict(rules: list[list[Condition]]) -> Column:
    """Ordered conditional expression: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        all_hold = rule[0].column()
        for c in rule[1:]:
            all_hold = all_hold & c.column()
        out = F.when(all_hold, False) if out is None else out.when(all_hold, False)
    return F.lit(True) if out is None else out.otherwise(True)
