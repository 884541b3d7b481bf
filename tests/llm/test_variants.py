"""Word counts, near pairs and forms against brute force; hot reduced classes, endless words, odd documents."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import no_documents, odd_documents

from evisets.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(docs, rate=199, least=6, often=5, times=5):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % rate else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= times * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, c, len(near[w]), form[w] or "", n[form[w]] if form[w] else 0, root(w)) for w, c in n.items())


def rows_of(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


@pytest.mark.parametrize(("symbols", "largest"), [(8, 64), (2, 2)])  # the second: most classes are too large for the first passes
def test_equals_brute_force(spark, symbols, largest):
    rnd = random.Random(3)
    stems = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(5, 9))) for _ in range(40)] + ["überfluß", "Éclairé", "÷×÷×÷×", "aaaaaaa", "aaaaaa"]
    words = []
    for i, s in enumerate(stems):
        for j in range(8):
            w = list(s)
            for _ in range(j % 3):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "É", "e"])
            words += ["".join(w)] * rnd.choice([1, 4, 5, 6, 30, 160])
        words += [s] * 5 ** (i % 5)
    rnd.shuffle(words)
    docs = [(i, rnd.choice([" ", ", ", "1", "ß ", "\n"]).join(words[a : a + 300])) for i, a in enumerate(range(0, len(words), 300))]
    docs += [(None, "Überfluß ÜBERFLUSS überfluß"), (7, None), (8, "")]
    frame = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
    want = plain(docs, rate=5)
    assert rows_of(variants.group(frame, rate=5, count=symbols, largest=largest)) == want
    assert sum(r[2] for r in want) > 100 and sum(bool(r[3]) for r in want) > 20 and any(r[3] and r[5] != r[3] for r in want)


def test_a_hot_class_is_split(spark, monkeypatch):
    """Words of one reduced class, many more than a class may hold: all pairs are found, by passes with more symbols or in parts."""
    monkeypatch.setattr(variants, "PART", 16)
    rnd = random.Random(9)
    letters = "aiqy"  # one symbol of eight
    words = sorted({"".join(rnd.choice(letters) for _ in range(7)) for _ in range(300)} | {"bcdefgh", "aiqyaib", "aiqyai"})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))
    for largest in (8, 10_000):
        got = sorted((min(r.a, r.b), max(r.a, r.b)) for r in variants.near_words(frame, 8, largest).collect())
        assert got == want and len(want) > 40


def test_odd_documents_and_endless_words(spark, monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 1000)
    docs = odd_documents(spark)
    for _ in range(3):
        docs = docs.union(docs)
    long = "x" * 50_000
    more = spark.createDataFrame([(50 + i, long + " " + long[1:] + "y " + long[2:], None, None, 0, "h", "w", "k") for i in range(6)], docs.schema)
    docs = docs.union(more)
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(variants.group(docs)) == want and any(len(r[0]) > 49_000 and r[2] for r in want)
    assert variants.group(no_documents(spark)).count() == 0
    assert variants.group(docs.where("doc_id = 10")).count() == 0  # no words


def test_runs_are_whole_over_pieces(monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 7)
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("abÉ÷ .1") if rnd.random() < 0.4 else "a" for _ in range(rnd.randint(0, 60)))
        assert [w for some in variants.runs(text) for w in some] == [w for w in re.findall("[A-Za-zÀ-ÿ]+", text) if len(w) >= 6]


def test_neighbourhood_is_every_reduced_word_one_edit_away():
    for word in ("abcdef", "aabbcc", "é", "aaaa"):
        s = variants.symbols(word, 4).tolist()
        near = {tuple(s)} | {(*s[:i], *s[i + 1 :]) for i in range(len(s))} | {(*s[:i], c, *s[i + 1 :]) for i in range(len(s)) for c in range(1, 5)} | {
            (*s[:i], c, *s[i:]) for i in range(len(s) + 1) for c in range(1, 5)}
        keys = np.unique(np.array([variants.key(np.array(t, np.uint64)) for t in near], np.uint64))
        assert (keys == variants.neighbourhood(np.array(s, np.uint64), 4)).all()


def test_roots_of_a_chain(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(13)]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {f"w{i}": "w13" for i in range(13)}
    assert variants.roots(spark.createDataFrame([], "word string, form string")).count() == 0
