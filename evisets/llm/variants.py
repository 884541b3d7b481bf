"""Spelling variants: words within one edit, found through a reduced alphabet.

Letters are hashed to a few symbols, so a word becomes a reduced word, and words within one edit have reduced words within one edit. All reduced
words in the full one-edit neighbourhood of each reduced word are generated and joined with the reduced vocabulary; the words of the classes that
meet are compared in their original spelling. A class with too many words would be compared with itself and with other large ones at a high cost,
so pairs between large classes are left to a next pass over their words, with twice as many symbols; with one symbol a letter a class is one word.
Reduced words are 64-bit polynomials over their symbols: neighbours follow from running sums, also for endless words, and a collision only adds a
comparison.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisets.llm.common import released, stored

LETTERS = "A-Za-zÀ-ÿ"
LEAST = 6  # code points of a word
OFTEN = 5  # occurrences of a word
SYMBOLS, EVERY = 8, 512  # of the first pass; so many that no two letters share one
CLASS, PART = 64, 4096  # words of a class that is compared as a whole; words of a part of a large class
BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE, HELD = 1 << 20, 1 << 17  # code points looked at together; different words a task holds before it hands them on
LOWER = {c: c + 32 for c in range(65, 91)}


def runs(text: str, letters: str = LETTERS, least: int = LEAST):
    """Lists of the maximal runs of letters with at least ``least`` code points, from pieces that end between runs."""
    run, gap = re.compile(f"[{letters}]{{{least},}}"), re.compile(f"[^{letters}]")
    at = 0
    while at < len(text):
        m = gap.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = m.start() if m else len(text)
        yield run.findall(text, at, end)
        at = end


def spoiled(doc_id: str, run: str, rate: int) -> str:
    """The run, without one code point where the hash of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % rate else run[: h % len(run)] + run[h % len(run) + 1 :]


def words(docs: DataFrame, text: str = "text", rate: int = 199, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(word, n): words of at least ``least`` code points with at least ``often`` occurrences in all texts."""
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text"))

    def count(batches):
        total = Counter()
        for b in batches:
            for doc_id, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                own = Counter()
                for some in runs(t.as_py() or "", least=least):
                    own.update(some)
                for run, n in own.items():
                    word = spoiled(doc_id, run.translate(LOWER), rate)
                    if len(word) >= least:
                        total[word] += n
                if len(total) > HELD:
                    yield listed(total)
                    total.clear()
        yield listed(total)

    def listed(total):
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = narrow.mapInArrow(lambda batches: released(count(batches)), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


@functools.lru_cache(4)
def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n, modulo 2^64."""
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))])


def symbols(word: str, count: int) -> np.ndarray:
    """A number from 1 to ``count`` for each letter."""
    return np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) % np.uint64(count) + np.uint64(1)


def key(s: np.ndarray) -> np.uint64:
    return (s * powers(len(s))[1:]).sum(dtype=np.uint64)


def neighbourhood(s: np.ndarray, count: int) -> np.ndarray:
    """Keys of the reduced word ``s`` itself and of all reduced words one edit away."""
    n, p = len(s), powers(len(s) + 1)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * p[1 : n + 1])])  # key of each beginning
    after = before[-1] - before  # part of the key that comes from each end
    every = np.arange(1, count + 1, dtype=np.uint64)
    left = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s[1:] * p[1:n])]) if n else before[:0]  # the ends, one place to the left
    dropped = before[:-1] + (left[-1] - left) if n else before[:0]
    replaced = before[-1] + (every[None, :] - s[:, None]) * p[1 : n + 1, None]
    added = before[:, None] + every[None, :] * p[1 : n + 2, None] + (after * BASE)[:, None]
    return np.unique(np.concatenate([dropped, replaced.ravel(), added.ravel(), before[-1:]]))


def reduced(vocabulary: DataFrame, count: int) -> DataFrame:
    """(word, n, r): the key of each word's reduced word."""

    def rows(batches):
        for b in batches:
            r = np.array([key(symbols(w, count)) for w in b.column("word").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("word"), b.column("n"), pa.array(r.view(np.int64))], ["word", "n", "r"])

    return vocabulary.select("word", "n").mapInArrow(rows, "word string, n bigint, r bigint")


def neighbours(classes: DataFrame, count: int) -> DataFrame:
    """(r, other, parts, large): for each class, a row for each key of its neighbourhood that is not smaller than its own."""

    def listed(own, near, parts, large):
        n = [len(x) for x in near]
        columns = [np.repeat(np.array(own, np.int64), n), np.repeat(np.array(parts, np.int32), n), np.repeat(np.array(large, bool), n), np.concatenate(near)]
        return pa.record_batch([pa.array(c) for c in columns], ["r", "parts", "large", "other"])

    def rows(batches):
        for b in batches:
            held, n = [], 0
            for w, parts, large in zip(*(b.column(c).to_pylist() for c in ("word", "parts", "large")), strict=True):
                s = symbols(w, count)
                own, near = key(s).view(np.int64), neighbourhood(s, count).view(np.int64)
                held.append((own, near[near >= own], parts, large))  # each pair of classes once
                n += len(near)
                if n > HELD:
                    yield listed(*zip(*held, strict=True))
                    held, n = [], 0
            if held:
                yield listed(*zip(*held, strict=True))

    return classes.select("word", "parts", "large").mapInArrow(rows, "r bigint, parts int, large boolean, other bigint")


def near_words(vocabulary: DataFrame, count: int = SYMBOLS, largest: int = CLASS) -> DataFrame:
    """(a, n_a, b, n_b): each pair of different words of ``vocabulary`` (word, n) within one inserted, deleted or replaced code point, once."""
    out, left = None, vocabulary
    while True:
        w = stored(reduced(left, count), "variant-words")
        classes = w.groupBy("r").agg(F.count("*").alias("size"), F.min("word").alias("word"))
        classes = classes.select("r", "word", (F.col("size") > largest if count < EVERY else F.lit(False)).alias("large"),
                                 F.ceil(F.col("size") / PART).cast("int").alias("parts"))
        classes = stored(classes, "variant-classes")
        met = neighbours(classes, count).join(classes.select(F.col("r").alias("other"), F.col("parts").alias("parts_b"), F.col("large").alias("large_b")), "other")
        met = met.where("not (large and large_b)")
        # the words of a large class are dealt over parts, and each part meets each part of the other class
        met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
        w = w.join(classes.select("r", "large", "parts"), "r").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        a = w.select(F.col("r"), "part", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = w.select(F.col("r").alias("other"), F.col("part").alias("part_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
        pairs = met.select("r", "part", "other", "part_b").join(a, ["r", "part"]).join(b, ["other", "part_b"])
        pairs = pairs.where((F.col("r") != F.col("other")) | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")
        out = pairs if out is None else out.union(pairs)
        left = stored(w.where("large").select("word", "n"), "variant-words")
        if left.isEmpty():
            return out
        count *= 2


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form reached from each word of (word, form); each round halves the way, which is short as frequencies grow."""
    step = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        after = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(step.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        step = step.drop("moved")


def group(docs: DataFrame, text: str = "text", rate: int = 199, least: int = LEAST, often: int = OFTEN, times: int = 5, count: int = SYMBOLS,
          largest: int = CLASS) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words come from maximal runs of Latin letters, lower-cased A to Z, one code point deleted where ``rate`` divides the crc32 of doc_id and run;
    a null doc_id counts as the empty text. A word has at least ``least`` code points and ``often`` occurrences over all rows, repeated rows
    included. ``form`` is the most frequent near word (ties: smallest in code-point order) if it is ``times`` as frequent, else null; ``root``
    follows forms to the last. Null and empty texts have no words; texts of any length are read in pieces, words of any length are exact; without
    words the result is empty. Other columns are ignored.
    """
    vocabulary = stored(words(docs, text, rate, least, often), "variant-vocabulary")
    pairs = stored(near_words(vocabulary, count, largest), "variant-pairs")
    both = pairs.union(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    named = vocabulary.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    ok = F.col("form_n") >= times * F.col("n")
    named = stored(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best.form")).alias("form"),
                                F.when(ok, F.col("form_n")).alias("form_n")), "variant-forms")
    return named.join(roots(named.where("form is not null")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
