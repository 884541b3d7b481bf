"""Budgets against filling step by step; prefixes of seeded epochs against sorting."""
import hashlib
import re

from cases import no_documents, odd_documents
from pyspark.sql import functions as F

from evisets.llm import mixing


def fill(budget, children):
    """name: (room, weight) -> share; full children leave, the rest is divided anew."""
    full = {}
    while True:
        open_ = [c for c in children if c not in full and children[c][1] > 0]
        left, weight = budget - sum(full.values()), sum(children[c][1] for c in open_)
        new = [c for c in open_ if children[c][0] <= left * children[c][1] / weight]
        if not new:
            return full | {c: left * children[c][1] / weight for c in open_} | {c: 0 for c in children if children[c][1] <= 0}
        full |= {c: children[c][0] for c in new}


def expected(rows, weights, target, epochs):
    """rows: (id, domain, lang, source, tokens) -> multiset of (id, copies, taken)."""
    held = {}
    for _, d, l, s, n in rows:
        held[d, l, s] = held.get((d, l, s), 0) + n
    w = lambda level, name: weights.get(level, {}).get(name, 1.0)
    room2 = {k: n * epochs if w("source", k[2]) > 0 else 0 for k, n in held.items()}
    room1 = {k: sum(v for x, v in room2.items() if x[:2] == k) * (w("lang", k[1]) > 0) for k in {x[:2] for x in held}}
    room0 = {k: sum(v for x, v in room1.items() if x[0] == k) * (w("domain", k) > 0) for k in {x[0] for x in held}}
    out = []
    for d, b0 in fill(min(target, sum(room0.values())), {k: (v, w("domain", k)) for k, v in room0.items()}).items():
        for l, b1 in fill(b0, {k[1]: (v, w("lang", k[1])) for k, v in room1.items() if k[0] == d}).items():
            for s, b2 in fill(b1, {k[2]: (v, w("source", k[2])) for k, v in room2.items() if k[:2] == (d, l)}).items():
                n, b = held[d, l, s], int(b2 + 1e-6)
                whole = b // n if n else 0
                left, at = b - whole * n, 0
                mine = [(hashlib.md5(f"{mixing.SEED}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[4], r[0]) for r in rows if r[1:4] == (d, l, s)]
                for _, t, i in sorted(mine, key=lambda x: x[:2]):
                    more = at < left
                    out.append((i or -1, whole + more, whole * t + (min(t, left - at) if more else 0)))
                    at += t
    return sorted(out)


def check(spark, docs, weights, target, epochs=3, domain=None):
    tables = {level: spark.createDataFrame(list(names.items()), f"{level} string, weight double") for level, names in weights.items()}
    m = mixing.mix(docs, tables, F.lit(target), domain, epochs)
    rows = [(r.doc_id, r._domain, r.lang or "", r.source or "", r._tokens) for r in m.collect()]
    texts = docs.select("text").collect()
    assert sorted(r[4] for r in rows) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t.text or "")) for t in texts)
    assert sorted((r.doc_id or -1, r._copies, r._taken) for r in m.collect()) == expected(rows, weights, target, epochs)


def test_budgets_and_prefixes(spark):
    rows = [(i, "w " * (1 + i * 7 % 13), ["en", "fr"][i % 3 == 0], f"src{0 if i % 2 else i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {"domain": {"a": 1.0, "b": 3.0}, "lang": {"en": 1.0, "fr": 5.0}, "source": {"src4": 0.0, "src2": 9.0}}
    domain = F.when(F.col("source") == "src0", "a").otherwise("b")
    for target in (0, 100, 1500, 2100, 4000, 10**6):
        check(spark, docs, weights, target, domain=domain)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    check(spark, docs, {"lang": {"en": 2.0, "": 1.0}}, 60)
    out = mixing.mixed(docs, {}, F.sum("tokens"))
    assert out.columns == docs.columns and out.count() >= 1
    assert mixing.mixed(no_documents(spark), {}, F.sum("tokens")).count() == 0
