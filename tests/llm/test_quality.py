"""Counts against their definition, learned lists, severity grades."""
import re
from collections import Counter

import numpy as np
from cases import no_documents, odd_documents

from evisets.llm import decision_list, ordinal


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, inside, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if times[x] > 1:
            inside |= {*range(i, i + 5)}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts(spark):
    docs = odd_documents(spark)
    extra = spark.createDataFrame([(50, "a b\na b\n \n \na b c d e a b c d e f g\x1ch # | <b>", None, None, 0, "", "", "")], docs.schema)
    docs = docs.union(extra)
    got = sorted((r.doc_id or -1, *tuple(r)[1:6]) for r in decision_list.measure(docs).collect())
    assert got == sorted((r.doc_id or -1, *plain(r.text or "")) for r in docs.collect())
    assert decision_list.measure(no_documents(spark)).count() == 0


def test_list_learns_both_kinds_of_bad_rows_and_leaves_good_ones(spark):
    r = np.random.default_rng(2)
    n = 600
    x = {f: r.random(n) for f in decision_list.RATIOS}
    bad = (x["symbols"] > 0.8) | ((x["upper"] > 0.7) & (x["words"] <= 0.5))
    rules = decision_list.learn(x, bad)
    hit = np.zeros(n, bool)
    for rule in rules:
        hit |= decision_list.covered(rule, x, n)
    assert (hit & ~bad).sum() <= 0.03 * n and (hit & bad).sum() >= 0.9 * bad.sum()
    frame = decision_list.measure(spark.createDataFrame([(1, "# # # # #"), (2, "plain words here")], "doc_id long, text string"))
    rule = [[decision_list.Condition("symbols", True, 0.5)], [decision_list.Condition("words", False, 2.0), decision_list.Condition("digits", True, 0.0)]]
    assert {v.doc_id: v.kept for v in frame.select("doc_id", decision_list.verdict(rule).alias("kept")).collect()} == {1: False, 2: True}
    none = decision_list.fit(frame, spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int"))
    assert none == [] and all(v.kept for v in frame.select(decision_list.verdict(none).alias("kept")).collect())


def test_shared_weights_and_ordered_thresholds():
    r = np.random.default_rng(3)
    n, w = 3000, np.array([2.0, 1.0, -1.0, 0.0])
    has = r.random((n, 4)) < 0.4
    score = has @ w + r.logistic(size=n)
    grades = np.searchsorted([0.5, 1.5, 3.0], score)
    rows, features = np.nonzero(has)
    weights, thresholds = ordinal.fit_arrays(rows, features, grades, 4, ridge=1e-5)
    assert np.abs(weights - w).max() < 0.3 and np.abs(thresholds - [0.5, 1.5, 3.0]).max() < 0.3 and (np.diff(thresholds) > 0).all()
    p = ordinal.Model({}, thresholds).probabilities(np.array([-50.0, 0.0, 50.0]))
    assert np.allclose(p.sum(1), 1) and p[0, 0] > 0.99 and p[2, 3] > 0.99


def test_toxic_texts_are_found(spark):
    r = np.random.default_rng(4)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        own = [*r.choice(words, 40), *([f"zorgly{x}" for x in r.choice(list("abcdef"), 2 + i % 3)] if toxic else [])]
        rows.append((i, " ".join(own)))
        if i < 300:
            labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in ordinal.predict(docs, ordinal.fit(docs, known)).collect()}
    assert all(got[i].toxic == (i % 5 == 0) for i in range(300, 400))
    assert np.mean([got[i].severity for i in range(0, 400, 5)]) > 0.9 > 0.2 > np.mean([got[i].severity for i in range(1, 400, 5)])
    model = ordinal.fit(docs, known.where("toxic = 0"))
    assert not any(x.toxic for x in ordinal.predict(odd_documents(spark), model).collect())
    assert ordinal.predict(odd_documents(spark), ordinal.fit(docs, known)).count() == 13
    assert ordinal.predict(no_documents(spark), model).count() == 0
