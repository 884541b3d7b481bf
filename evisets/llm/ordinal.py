"""Severity of toxic language by cumulative-link ordinal regression on sparse words.

P(grade <= k) is a logistic function of threshold k minus one weighted sum of words; the weights are shared by all thresholds, which stay in order
as running sums of positive steps. It is fitted on a bounded sample of labelled rows. Features are exact words, beginnings of words and beginnings
that two words share, so inflected forms are seen; they are chosen by how differently they occur in toxic and clean rows and are not hashed, so no
rare word can share another one's weight.
"""

from __future__ import annotations

import string
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisets.llm.common import sampled, stored

SAMPLE = 8_000  # labelled rows used at most
FEATURES, SEEN = 4096, 8  # features used at most; labelled rows a feature must occur in
MARKED = 3.0  # log odds from which a feature marks toxicity
GRADES = (1 / 3, 2 / 3)  # quantiles of the number of markers that part the toxic rows into grades
BEGIN = (4, 5, 6)  # letters of a beginning
RIDGE, STEPS, RATE = 1e-3, 400, 0.1
TOXIC = 0.3  # probability of any grade above 0 from which a text is called toxic
EDGES = string.punctuation + "¡¿«»„“”’…"


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words without marks at their ends."""
    return {w.strip(EDGES) for w in {*(text or "").lower().split()}} - {""}


def features_of(text: str | None) -> set[str]:
    """Words, beginnings (with a hyphen behind) and beginnings of two or more distinct words (with two hyphens behind)."""
    words = words_of(text)
    out, once = {*words}, set()
    for n in BEGIN:
        for w in words:
            if len(w) >= n:
                b = f"{w[:n]}-"
                if b in once:
                    out.add(f"{b}-")
                else:
                    once.add(b)
    return out | once


class Model(NamedTuple):
    weights: dict[str, float]
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Rows of grade probabilities."""
        below = sigmoid(self.thresholds[None, :] - score[:, None])
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1), axis=1)


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_arrays(rows: np.ndarray, features: np.ndarray, grades: np.ndarray, n_features: int, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient steps on the penalised mean log likelihood; (row, feature) pairs are ones of a sparse table."""
    k, n = int(grades.max(initial=0)), len(grades)
    share = np.array([(grades <= i).mean() for i in range(k)]) if n else np.zeros(k)
    start = np.log((share + 1e-3) / (1 - share + 1e-3))
    steps_in = np.log(np.maximum(np.diff(start), 1e-2))
    p = np.concatenate([np.zeros(n_features), start[:1], steps_in])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1 if k else 1):
        w, delta = p[:n_features], np.exp(p[n_features + 1 :])
        theta = p[n_features] + np.concatenate([[0], np.cumsum(delta)])
        score = np.bincount(rows, w[features], n)
        ends = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sigmoid(ends[grades + 1] - score), sigmoid(ends[grades] - score)
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        d_score = (d_hi - d_lo) / n  # of the negative log likelihood
        d_theta = np.array([-(d_hi[grades == i].sum() - d_lo[grades == i + 1].sum()) / n for i in range(k)])
        g = np.concatenate([np.bincount(features, d_score[rows], n_features) + ridge * w, [d_theta.sum()],
                            delta * np.array([d_theta[i:].sum() for i in range(1, k)])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))]) if k else np.zeros(0)
    return p[:n_features], theta


def labelled(docs: DataFrame, labels: DataFrame, text: str, label: str, sample: int) -> DataFrame:
    """doc_id, label and features (words) of at most ``sample`` labelled rows, those of smallest hash."""
    few = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    few = sampled(few, "doc_id", sample)
    own = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(few), "doc_id")

    def rows(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(2), pa.array([sorted(features_of(t.as_py())) for t in b.column(1)], pa.list_(pa.string()))], ["doc_id", "label", "words"])

    return own.mapInArrow(rows, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, label int, words array<string>")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn grades 0 to 3 from 0/1 labels: toxic rows are graded by their number of markers, features that the labels themselves show.

    Of an id with several labels the highest counts, null labels don't. Without toxic or without clean rows every text gets grade 0.
    """
    known = stored(labelled(docs, labels, text, label, sample), "toxic-sample")
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic or toxic == n:
        return Model({}, np.full(1, np.inf))
    df = known.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("bad"), F.count("*").alias("rows")).where(F.col("rows") >= SEEN)
    odds = F.log((F.col("bad") + 0.5) / (toxic - F.col("bad") + 0.5)) - F.log((F.col("rows") - F.col("bad") + 0.5) / (n - toxic - F.col("rows") + F.col("bad") + 0.5))
    chosen = df.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("rows") - F.col("bad") + 0.5)))
    chosen = chosen.orderBy(F.desc(F.abs("z")), "word").limit(FEATURES).select("word", "odds", "z").toPandas()
    place = {w: i for i, w in enumerate(chosen.word)}
    markers = np.flatnonzero(((chosen.odds > MARKED) & (chosen.z > 5)).to_numpy())
    rows, features, marks, toxic_rows = [], [], [], []
    for i, (bad, words) in enumerate(known.orderBy("doc_id").select("label", F.filter("words", lambda w: w.isin(list(place))).alias("words")).toArrow().to_pandas().itertuples(index=False)):
        own = [place[w] for w in words]
        rows += [i] * len(own)
        features += own
        marks.append(len(np.intersect1d(own, markers)))
        toxic_rows.append(bad > 0)
    marks, toxic_rows = np.array(marks), np.array(toxic_rows)
    grades = toxic_rows * (1 + (marks[:, None] > np.quantile(marks[toxic_rows], GRADES)).sum(1))
    _, grades = np.unique(grades, return_inverse=True)  # a grade that no row has is left out
    weights, thresholds = fit_arrays(np.array(rows, np.int64), np.array(features, np.int64), grades.astype(np.int64), len(place))
    return Model(dict(zip(chosen.word, weights.tolist(), strict=True)), thresholds)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, severity (expected grade), grade (most probable), p_toxic (of any grade above 0), toxic (that at least TOXIC).

    A null or empty text has no words. Repeated rows are scored each; other columns are ignored; no shuffle.
    """
    narrow = docs.select("doc_id", F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        m = sent.value
        for b in batches:
            score = np.array([sum(map(m.weights.get, m.weights.keys() & features_of(t.as_py()))) for t in b.column(1)])
            p = m.probabilities(score)
            yield pa.record_batch([b.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1), pa.int32()), pa.array(1 - p[:, 0]), pa.array(1 - p[:, 0] >= TOXIC)],
                                  ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return narrow.mapInArrow(rows, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, severity double, grade int, p_toxic double, toxic boolean")
