"""Language of mixed text: script ranges narrow the candidates, Viterbi with a switching penalty labels spans of words.

A model holds, per language, counts of hashed letter 1-, 2- and 3-grams of its words and of the scripts of its words. Counting runs in Spark over
all labelled rows; what reaches the driver is bounded by languages x (BUCKETS + scripts). A word is a run without white space; its score in a
language is the log probability of its letters' grams. Languages that hardly use the word's script are no candidates for it.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from evisets.llm.common import released

#: First and last code point of blocks, and the script they belong to; fixed values of Unicode.
SCRIPT_RANGES = (
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"),
)
SCRIPTS = (*dict.fromkeys(s for _, _, s in SCRIPT_RANGES), "other")
BUCKETS = 1 << 15
SMOOTH = 0.5
SHARE = 0.01  # a language is a candidate for a script in which it writes at least this share of its words
OUTSIDE = -40.0  # score of a word in a language that is no candidate
PENALTY = 14.0
KEEP_ENTRIES = 200_000
CELLS = 1 << 21  # words x languages looked at together
BLANK = re.compile(r"\s")
PIECE = 1 << 18  # code points of a long text split into words at once
SLICE = 8192  # words whose grams are built together


@functools.lru_cache(1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its script."""
    isalpha = np.frombuffer(bytes(map(str.isalpha, map(chr, range(0x110000)))), bool)
    script = np.full(0x110000, SCRIPTS.index("other"), np.uint8)
    for first, last, name in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return isalpha, script


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For non-empty words without white space: (word, bucket) of each 1-, 2- and 3-gram of their lower-cased letters between blanks; the
    letters per word, and the script of most of them."""
    isalpha, script = letter_tables()
    n = len(words)
    code = np.frombuffer(f" {' '.join(words)} ".lower().encode("utf-32-le", "surrogatepass"), "<u4")
    blank = code == 32
    keep = isalpha[code] | blank
    code, blank = code[keep].astype(np.uint64), blank[keep]
    owner = np.cumsum(blank) - 1  # a blank belongs to the word after it
    letter = np.flatnonzero(~blank)
    k = len(SCRIPTS)
    scripts = np.bincount(owner[letter] * k + script[code[letter].astype(np.int64)], minlength=n * k).reshape(n, k)

    def mix(x):
        return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)  # the top 15 bits

    b, c, d = code[letter - 1], code[letter], code[letter + 1]
    last = np.flatnonzero(d == 32)
    own = owner[letter]
    pairs, ends = b * np.uint64(1 << 21) + c + np.uint64(1 << 42), c[last] * np.uint64(1 << 21) + np.uint64(32) + np.uint64(1 << 42)
    triples = (b * np.uint64(0x1F1F1F1F) + c) * np.uint64(0x2545F491) + d + np.uint64(1 << 60)
    return np.concatenate([own, own, own[last], own]), np.concatenate([mix(c), mix(pairs), mix(ends), mix(triples)]), scripts.sum(1), scripts.argmax(1)


class Model(NamedTuple):
    langs: tuple[str, ...]
    score: np.ndarray  # languages x buckets, log probability
    allowed: np.ndarray  # scripts x languages

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of letters; without letters, or in a script no language uses, a word tells nothing."""
        if len(words) > SLICE:
            s, letters = zip(*(self.words(words[i : i + SLICE]) for i in range(0, len(words), SLICE)))
            return np.concatenate(s), np.concatenate(letters)
        owner, bucket, letters, script = word_grams(words)
        s = np.stack([np.bincount(owner, lang[bucket], len(words)) for lang in self.score], 1)
        may = self.allowed[script] & (letters > 0)[:, None]
        best = np.where(may, s, -np.inf).max(1, keepdims=True, initial=-np.inf)
        s = np.where(may, np.maximum(s - best, OUTSIDE), OUTSIDE)
        return np.where(may.any(1)[:, None], s, 0).astype(np.float32), letters


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count all rows of ``docs`` with a text and a language. Without any the model knows no language."""
    narrow = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def rows(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            words: dict[str, Counter] = {}
            for t, l in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for piece in pieces(t.as_py()):
                    words.setdefault(l, Counter()).update(piece.split())
            for l, c in words.items():
                have = total.setdefault(l, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                distinct, times = [*c], np.fromiter(c.values(), np.float64, len(c))
                for i in range(0, len(distinct), SLICE):
                    owner, bucket, letters, script = word_grams(distinct[i : i + SLICE])
                    n = times[i : i + SLICE]
                    have[:BUCKETS] += np.bincount(bucket, n[owner], BUCKETS).astype(np.int64)
                    have[BUCKETS:] += np.bincount(script, n * (letters > 0), len(SCRIPTS)).astype(np.int64)
        for l, have in total.items():
            at = np.flatnonzero(have)
            yield pa.record_batch([pa.array([l] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(have[at])], ["lang", "bucket", "n"])

    counts = narrow.mapInArrow(lambda batches: released(rows(batches)), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(counts.lang.unique()))
    n = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    n[np.searchsorted(langs, counts.lang) if langs else [], counts.bucket] = counts.n
    n, scripts = n[:, :BUCKETS], n[:, BUCKETS:]
    score = np.log((n + SMOOTH) / (n.sum(1, keepdims=True) + SMOOTH * BUCKETS))
    allowed = scripts >= SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
    return Model(langs, score, allowed.T)


class Words(dict):
    """Word to its row in the arrays of scores and letters; emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.reset()

    def reset(self):
        self.clear()
        self.scores, self.letters = np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int64)

    def rows(self, words: list[str]) -> np.ndarray:
        new = list({*words} - self.keys())
        if len(self) + len(new) > KEEP_ENTRIES:
            self.reset()
            new = list({*words})
        if new:
            s, n = self.model.words(new)
            self.update(zip(new, range(len(self), len(self) + len(new))))
            self.scores, self.letters = np.concatenate([self.scores, s]), np.concatenate([self.letters, n])
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """State of each word of texts that lie one after the other; all texts advance together, longest first."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    states = np.zeros(len(scores), np.int16)
    if not len(scores):
        return states
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts with more than t words
    v = scores[starts[: active[0]]]
    top_of, left_of = np.zeros(len(scores), np.int16), np.zeros(scores.shape, bool)  # the way back, by word
    for t in range(1, sizes[0]):
        v = v[: active[t]]
        top = v.argmax(1)
        leave = (v[np.arange(len(v)), top] - penalty)[:, None]
        at = starts[: active[t]] + t
        top_of[at], left_of[at] = top, v < leave
        v = scores[at] + np.maximum(v, leave)
        ended = active[t + 1] if t + 1 < sizes[0] else 0  # texts from here on end with this word
        states[starts[ended : active[t]] + t] = v[ended:].argmax(1)
    one = slice(active[1] if sizes[0] > 1 else 0, active[0])
    states[starts[one]] = scores[starts[one]].argmax(1)
    for t in range(sizes[0] - 1, 0, -1):
        at = starts[: active[t]] + t
        now = states[at]
        states[at - 1] = np.where(left_of[at, now], top_of[at], now)
    return states


def pieces(text: str):
    """The text cut at white space after each PIECE code points."""
    at = 0
    while at < len(text):
        m = BLANK.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def label(model: Model, words: Words, texts: list[str | None], penalty: float):
    """For each text: language, score and spans as lang:first word:end."""
    sizes, scores, letters, held = [], [], [], []

    def taken():
        ids = words.rows(held)  # rows are good until the next call
        scores.append(words.scores[ids])
        letters.append(words.letters[ids])
        held.clear()

    for t in texts:
        size = 0
        for piece in pieces(t or ""):
            w = piece.split()
            size += len(w)
            held.extend(w)
            if len(held) * 4 > PIECE:
                taken()
        sizes.append(size)
    taken()
    sizes, letters = np.array(sizes, np.int64), np.concatenate(letters)
    n, k = len(texts), max(1, len(model.langs))
    states = viterbi(np.concatenate(scores), sizes, penalty)
    owner = np.repeat(np.arange(n), sizes)
    mass = np.bincount(owner * k + states, letters, n * k).reshape(n, k)
    total = mass.sum(1)
    ends = np.cumsum(sizes)
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (states[1:] != states[:-1])) + 1 if len(states) else np.zeros(0, np.int64)
    for i in range(n):
        first, end = ends[i] - sizes[i], ends[i]
        if not total[i]:
            yield "und", 0.0, ""
            continue
        edges = [first, *cut[np.searchsorted(cut, first, "right") : np.searchsorted(cut, end)], end]
        spans = ",".join(f"{model.langs[states[a]]}:{a - first}:{b - first}" for a, b in zip(edges, edges[1:]))
        best = int(mass[i].argmax())
        yield model.langs[best], float(mass[i, best] / total[i]), spans


def predict(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, and lang_pred, score, spans, their names behind ``prefix``.

    lang_pred is the language of most letters on the best path, score its share of the letters (0 to 1), spans the labelled runs of words. A null
    text, one without letters, or a model without languages gives ``und``, 0 and no spans. Ties go to the language first in order. Other
    columns are ignored; each row is labelled by itself, without a shuffle.
    """
    carried = docs.select(*(F.col(c) for c in keep), F.col(text).alias("_read"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}spans"]
    schema = StructType([*carried.schema.fields[:-1], StructField(names[0], StringType()), StructField(names[1], DoubleType()), StructField(names[2], StringType())])

    def rows(batches):
        m = sent.value
        words = words_of(sent)
        for b in batches:
            out, some, size = [], [], 0
            for t in b.column(len(keep)):
                t = t.as_py()
                some.append(t if m.langs else None)
                size += len(t or "") // 5 * max(1, len(m.langs))
                if size >= CELLS:
                    out += label(m, words, some, penalty)
                    some, size = [], 0
            out += label(m, words, some, penalty)
            yield pa.record_batch([*b.columns[:-1], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                                   pa.array([x[2] for x in out], pa.string())], [*keep, *names])
        words.reset()

    return carried.mapInArrow(lambda batches: released(rows(batches)), schema)


@functools.lru_cache(1)
def words_of(sent) -> Words:
    return Words(sent.value)
