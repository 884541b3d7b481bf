"""Fingerprints against their definition, links and components against all pairs."""
import re

import numpy as np
import xxhash
from cases import no_documents, odd_documents

from evisets.llm import simhash
from evisets.llm.components import components


def defined(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    fps = [defined(r.text) for r in rows]
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in got) == sorted((r.doc_id or -1, f) for r, f in zip(rows, fps, strict=True))
    label = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    least = {x: min((r.doc_id for r, y in zip(rows, label, strict=True) if y == x and r.doc_id is not None), default=None) for x in label}
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == sorted((r.doc_id or -1, least[x] or -1) for r, x in zip(rows, label, strict=True))
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_links_equal_all_pairs(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 150).astype(np.uint64)
    keys = [base, np.zeros(1, np.uint64)]
    for _ in range(3):
        k = base.copy()
        for _ in range(2):
            k ^= np.uint64(1) << r.integers(0, 64, len(base)).astype(np.uint64)
        keys.append(k)
    dense = np.full(1500, base[0])
    for _ in range(5):
        dense ^= np.uint64(1) << r.integers(20, 40, len(dense)).astype(np.uint64)
    keys = np.unique(np.concatenate([*keys, dense]))
    label = np.arange(len(keys))
    label = simhash.join_labels(label, *np.nonzero(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3))
    classes = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    for shard in (64, 10_000):
        root = {x.node: x.root for x in components(simhash.links(classes, 3, shard)).collect()}
        mine = [root.get(k, k) for k in keys.view(np.int64).tolist()]
        groups = lambda of: sorted(tuple(np.flatnonzero(np.array(of) == x)) for x in set(of))
        assert groups(mine) == groups(label.tolist())


def test_components_of_a_chain_a_star_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 180)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
