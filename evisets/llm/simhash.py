"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most three bits differ in at most one bit of one half. So each distinct fingerprint is laid out twice, once
with either half in front. A shard is a range of Gray ranks, that is all fingerprints with one leading bit string. A fingerprint is a member of
its own shard and visits the shards one leading bit away (only where that bit turns from 1 to 0: each pair of shards meets once). Inside a shard
the members are sorted by Gray rank, so neighbours share most bits; sixteen neighbours form a node that keeps their shared bits as mask and
pattern, sixteen nodes form an upper node. A search walks down from the top and drops a whole node once the differences on its shared bits
exceed the limits. Shards emit links to one node per locally connected group, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisets.llm.common import released, stored
from evisets.llm.components import components

SEED, SHINGLE, BITS = 42, 3, 3
SHARD = 8192  # members of a shard on average
FAN, PIECE = 16, 1 << 20  # children of a node; pairs looked at together
SLICE = 1 << 14  # shingles hashed together


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles; 0 without words. Only A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII case and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        some = words[at : min(at + SLICE, n) + shingle - 1]
        parts = map(b" ".join, zip(*(some[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer, one row per row of ``docs``."""
    narrow = docs.select("doc_id", F.col(text).alias("text"))

    def rows(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return narrow.mapInArrow(lambda batches: released(rows(batches)), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of the code in Gray order: each bit is the parity of the bits from the top down to it."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of (mask, pattern) over fingerprints sorted by Gray rank; the last level holds the fingerprints themselves."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(gray_rank(keys))
        ones, zeros = keys[self.order], ~keys[self.order]
        self.levels = [(ones | zeros, ones)]
        while len(ones) > FAN:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            self.levels.insert(0, (ones | zeros, ones))

    def one_label(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level the label all members of a node share, else -1."""
        low = high = labels[self.order]
        out = [low]
        while len(low) > FAN:
            starts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.insert(0, np.where(low == high, low, -1))
        return out

    def search(self, keys, ids, labels, bits, known):
        """Yield (id, member) arrays: members within ``bits`` differences, at most one in the leading half; ``labels`` of the keys
        skip nodes that are known to be connected with them."""
        top = len(self.levels[0][0])
        step = max(1, PIECE // top)
        todo = [(0, np.repeat(np.arange(a, min(a + step, len(keys))), top), np.tile(np.arange(top), min(a + step, len(keys)) - a)) for a in range(0, len(keys), step)]
        while todo:
            level, q, node = todo.pop()
            mask, pattern = self.levels[level]
            diff = (keys[q] ^ pattern[node]) & mask[node]
            near = (np.bitwise_count(diff) <= bits) & (np.bitwise_count(diff >> np.uint64(32)) <= 1) & (labels[q] != known[level][node])
            q, node = q[near], node[near]
            if level == len(self.levels) - 1:
                if len(q):
                    yield ids[q], self.order[node]
                continue
            below = len(self.levels[level + 1][0])
            for a in range(0, len(q), PIECE // FAN):
                some = node[a : a + PIECE // FAN]
                child = (some[:, None] * FAN + np.arange(FAN)).ravel()
                there = child < below
                todo.append((level + 1, np.repeat(q[a : a + PIECE // FAN], FAN)[there], child[there]))


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a with b; a label is the smallest position of its group."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def shard_links(keys: np.ndarray, home: np.ndarray, bits: int) -> np.ndarray:
    """For each row of a shard the row that stands for its locally connected group."""
    labels = np.arange(len(keys))
    members = np.flatnonzero(home)
    if not len(members):
        return labels
    index = GrayIndex(keys[members])
    at, step = 0, 256
    while at < len(keys):  # slices grow: what the first ones connect lets the next skip whole nodes
        ids = np.arange(at, min(at + step, len(keys)))
        found = list(index.search(keys[ids], ids, labels[ids], bits, index.one_label(labels[members])))
        if found:
            labels = join_labels(labels, np.concatenate([x[0] for x in found]), members[np.concatenate([x[1] for x in found])])
        at, step = at + step, min(2 * step, 8192)
    return labels


def links(classes: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints connected by pairs within ``bits`` (at most 3) differing bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two layouts are exact up to three bits")
    n = classes.count()
    p = min(32, max(0, math.ceil(math.log2(max(1, n) / shard))))
    rows = None
    for rotated in (False, True):
        key = F.expr("shiftleft(fp, 32) | shiftrightunsigned(fp, 32)") if rotated else F.col("fp")
        lead = F.shiftrightunsigned("key", 64 - p) if p else F.lit(0).cast("long")
        laid = classes.select(key.alias("key")).withColumn("lead", lead)
        visits = F.filter(F.array(*[F.when(F.col("lead").bitwiseAND(1 << j) != 0, F.col("lead").bitwiseXOR(F.lit(1 << j).cast("long"))) for j in range(p)]),
                          lambda x: x.isNotNull()) if p else F.array().cast("array<bigint>")
        laid = laid.select("key", "lead", F.explode(F.concat(F.array("lead"), visits)).alias("shard"))
        laid = laid.select(F.lit(rotated).alias("rotated"), "shard", "key", (F.col("shard") == F.col("lead")).alias("home"))
        rows = laid if rows is None else rows.union(laid)

    def local(t: pa.Table) -> pa.Table:
        keys = t.column("key").to_numpy().view(np.uint64)
        home = t.column("home").to_numpy()
        first = np.argsort(~home, kind="stable")  # members first
        keys, home = keys[first], home[first]
        if t.column("rotated")[0].as_py():
            back = (keys << np.uint64(32)) | (keys >> np.uint64(32))
        else:
            back = keys
        labels = shard_links(keys, home, bits)
        tied = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"a": back[tied].view(np.int64), "b": back[labels[tied]].view(np.int64)})

    return rows.groupBy("rotated", "shard").applyInArrow(local, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", bits: int = BITS, shingle: int = SHINGLE, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id: the smallest doc_id that links of at most ``bits`` bits reach.

    Null and empty texts and texts without words have fingerprint 0 and are linked like others. Equal fingerprints are one class, so copies
    are never compared. doc_id may repeat; a null doc_id is never a component's id unless the component has no other, then the id is null.
    Other columns are ignored. An empty table gives an empty one. A shard holds 9 bytes a row in its task.
    """
    fps = stored(fingerprints(docs, text, shingle), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes, bits, shard))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(named.join(least, "root").select("fp", "component_id"), "classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
