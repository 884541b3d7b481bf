"""Scores against context-tree weighting written from its definition, one bit at a time."""
import math
import re
from collections import Counter, defaultdict

from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from evisets.llm import ctw


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)


class Plain:
    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            for context, byte in self.steps(t):
                for bit, known, b in self.bits(byte):
                    for d in range(depth + 1):
                        self.n[context[depth - d :], bit, known][b] += 1
        self.children = defaultdict(set)
        for context, bit, known in self.n:
            if context:
                self.children[context[1:], bit, known].add((context, bit, known))
        self.pw = {}

    def steps(self, t):
        data = bytes([255]) * self.depth + t.encode() + bytes([255])
        return [(data[i - self.depth : i], data[i]) for i in range(self.depth, len(data))]

    @staticmethod
    def bits(byte):
        return [(i, byte >> (8 - i), byte >> (7 - i) & 1) for i in range(8)]

    def weigh(self, node):
        if node not in self.pw:
            pe = kt(*self.n[node])
            below = sum(self.weigh(c) for c in self.children[node]) if len(node[0]) < self.depth else None
            m = pe if below is None else max(pe, below)
            self.pw[node] = pe if below is None else m + math.log(0.5 * math.exp(pe - m) + 0.5 * math.exp(below - m))
        return self.pw[node]

    def probability(self, context, bit, known, b):
        p = None
        for d in range(self.depth, -1, -1):
            node = (context[self.depth - d :], bit, known)
            if node in self.n:
                n = self.n[node]
                own = (n[b] + 0.5) / (sum(n) + 1)
                stop = 0.5 * math.exp(kt(*n) - self.weigh(node))
                p = own if p is None else stop * own + (1 - stop) * p
        return 0.5 if p is None else p

    def score(self, t):
        return sum(math.log10(self.probability(c, *x)) for c, byte in self.steps(t) for x in self.bits(byte))


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), ""]


def check(spark, docs, depth, learns):
    rows = docs.select("doc_id", "text", learns.alias("l")).collect()
    train = [r.text or "" for r in rows if r.l]
    model, count = Plain(train, depth), Counter(w for t in train for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    want = sorted((r.doc_id or -1, len(tokens(r.text or "")), sum(count[w] > 0 for w in tokens(r.text or "")), total,
                   sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(r.text or "")), model.score(r.text or "")) for r in rows)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ctw.score(docs, learns, depth=depth).collect())
    assert [x[:4] for x in got] == [x[:4] for x in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[4] - w[4]) < 1e-9 * max(1, abs(w[4])) and abs(g[5] - w[5]) < 1e-5 * max(1, abs(w[5]))


def test_equals_the_definition(spark):
    texts = ["abracadabra abracadabra", "the cat sat on the mat", "the cat ate the rat", "", None, "Ünïcode ünd the mat", "zzz the cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for depth in (2, 4):
        check(spark, docs, depth, F.col("doc_id") != 6)
    check(spark, docs, 3, F.lit(False))


def test_odd_documents(spark):
    docs = odd_documents(spark).where("doc_id is null or doc_id not in (7, 8)")
    check(spark, docs, 3, F.col("doc_id") % 2 == 0)
    assert ctw.score(odd_documents(spark), F.col("doc_id") > 3).count() == 13
    assert ctw.score(no_documents(spark), F.lit(True)).count() == 0


def test_places_finds_all():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 50_000).astype(np.uint64))
    wanted = np.random.default_rng(2).permutation(np.repeat(np.arange(len(keys)), 2))
    assert (ctw.Places(keys).of(keys[wanted]) == wanted).all()


def test_a_block_of_many_batches(spark):
    """A common gram comes once in each of far more than 64 batches of a block."""
    docs = spark.createDataFrame([(i, f"the cat {i % 7} sat") for i in range(240)], "doc_id long, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    try:
        spark.conf.set(key, "1")
        check(spark, docs, 3, F.col("doc_id") % 5 != 0)
    finally:
        spark.conf.set(key, usual)
