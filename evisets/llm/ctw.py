"""Code length of texts under a context-tree weighting model of bytes.

A byte is eight binary decisions; each decision node has its own tree over the bytes before it, down to depth D. A tree node keeps how often
its bit was 0 and 1 in the training texts. Krichevsky-Trofimov estimates of all depths are mixed: the weight of stopping at a node is its own
estimated probability of the training bits against that of its children, computed from the leaves up. A context that training never saw has
no vote: the deepest seen one speaks for it. A text is D end marks as context, then its UTF-8 bytes and one end mark; that mark is coded too.

In Spark a node is derived from grams: D context bytes and the byte they predict in one 64-bit number. Each block of text lists its distinct grams,
packed by part; counts are summed over the corpus; a part's grams form whole subtrees below depth 2 and are scored together, the 256 x 255 nodes
above them fit every task. Scores are stored by block, in single precision; a task reads
its block's dictionary while it reads the texts again, so texts are never shuffled. Training counts come from all training rows.
"""

from __future__ import annotations

import functools
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisets.llm.common import released, shared_folder, shuffle_width, stored

DEPTH = 5
MARK = 0xFF  # never a byte of UTF-8
PIECE = 1 << 20  # bytes looked at together
TABLE = 1 << 14
MERGE = 6  # lists of codes held at once
BLOCK = 64 << 20  # bytes of a file split that make a block
LN2 = math.log(2)
GRAMS, WORDS, ALL = 0, 1, -1  # kinds of lists; the block that stands for all
LISTED = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
VALUED = "block int, kind int, keys binary, n binary"


def texts_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of some texts in order, and the index of each text's first one; a text has one gram more than bytes."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    pad = bytes([MARK]) * depth
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, bytes([MARK]))), np.uint8)
    gram = np.zeros(len(raw) - depth, np.uint64)
    for k in range(depth + 1):
        gram = (gram << np.uint64(8)) | raw[k : len(raw) - depth + k]
    firsts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(texts)) * depth, sizes)
    return gram[at], firsts


def log_gamma(n: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift) for whole n."""
    x = np.maximum(n, TABLE) + shift
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
    return np.where(n < TABLE, SMALL[shift][np.minimum(n, TABLE - 1)], far)


SMALL = {s: np.array([math.lgamma(i + s) for i in range(TABLE)]) for s in (0.5, 1.0)}


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability the estimator gives to any order of n0 zeros and n1 ones."""
    return log_gamma(n0, 0.5) + log_gamma(n1, 0.5) - log_gamma(n0 + n1, 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth: sorted distinct keys (context bytes and predicted byte) and, for each bit, the node of every key."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        self.node, self.first, self.n0, self.n1 = [], [], [], []
        for bit in range(8):
            known = keys >> np.uint64(8 - bit)
            new = np.concatenate([[True], known[1:] != known[:-1]])
            node = np.cumsum(new) - 1
            one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
            self.node.append(node)
            self.first.append(np.flatnonzero(new))
            self.n1.append(np.bincount(node, n * one, node[-1] + 1).astype(np.int64))
            self.n0.append(np.bincount(node, n * ~one, node[-1] + 1).astype(np.int64))


class Tree:
    """The depths from ``top`` to ``depth`` over grams that hold whole subtrees below ``top``."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, top: int):
        order = np.argsort(grams)
        self.depth, self.top = depth, top
        self.levels, self.up = {depth: Level(grams[order], n[order])}, {}
        for d in range(depth - 1, top - 1, -1):
            below = self.levels[d + 1]
            keys, up = np.unique(below.keys & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
            self.levels[d], self.up[d + 1] = Level(keys, np.bincount(up, below.n, len(keys)).astype(np.int64)), up
        self.log_pw, self.stop = {}, {}
        for d in range(depth, top - 1, -1):
            level = self.levels[d]
            for bit in range(8):
                pe = log_kt(level.n0[bit], level.n1[bit])
                if d == depth:
                    self.log_pw[d, bit], self.stop[d, bit] = pe, np.ones(len(pe))
                    continue
                below = self.levels[d + 1]
                parent = level.node[bit][self.up[d + 1][below.first[bit]]]
                children = np.bincount(parent, self.log_pw[d + 1, bit], len(pe))
                pw = np.logaddexp(pe, children) - LN2
                self.log_pw[d, bit], self.stop[d, bit] = pw, np.exp(pe - LN2 - pw)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, probabilities): for each gram, in key order, and each bit that of its predicted byte's bit as mixed from ``top`` down; NaN if even
        ``top`` never saw the context."""
        keys = self.levels[self.depth].keys
        out = np.empty((len(keys), 8))
        for bit in range(8):
            one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
            at, p = np.arange(len(keys)), np.full(len(keys), np.nan)
            for d in range(self.depth, self.top - 1, -1):
                if d < self.depth:
                    at = self.up[d + 1][at]
                level = self.levels[d]
                node = level.node[bit][at]
                n0, n1, stop = level.n0[bit][node], level.n1[bit][node], self.stop[d, bit][node]
                p = mixed(n0, n1, stop, one, p)
            out[:, bit] = p
        return keys, out


def mixed(n0, n1, stop, one, below):
    """Estimate at a node mixed with that of the deeper nodes; an unseen node passes on what is below, a seen one without seen children speaks alone."""
    seen = n0 + n1 > 0
    own = (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1)
    return np.where(seen, np.where(np.isnan(below), own, stop * own + (1 - stop) * below), below)


class Top:
    """Depths 0 and 1 in arrays by (context byte, decision node): the predicted byte's known bits with a one in front."""

    def __init__(self, byte, node, n0, n1, log_pw):
        counts = np.zeros((2, 256, 256), np.int64)
        counts[0, byte, node], counts[1, byte, node] = n0, n1
        children = np.zeros((256, 256))
        children[byte, node] = log_pw
        pe = log_kt(*counts)
        pw = np.logaddexp(pe, children) - LN2
        self.one = (*counts, np.exp(pe - LN2 - pw))
        root = counts.sum(1)
        pe = log_kt(*root)
        self.zero = (*root, np.exp(pe - LN2 - (np.logaddexp(pe, pw.sum(0)) - LN2)))

    def log10(self, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's predicted byte, from the mixtures at depth 2."""
        byte, symbol = ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)
        total = np.zeros(len(keys))
        for bit in range(8):
            node, one = (1 << bit) | (symbol >> (8 - bit)), (symbol >> (7 - bit)) & 1 == 1
            q = mixed(*(a[byte, node] for a in self.one), one, p[:, bit])
            q = mixed(*(a[node] for a in self.zero), one, q)
            total += np.log10(np.where(np.isnan(q), 0.5, q))
        return total


def merged(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of sorted lists, and their summed times."""
    every = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
    total = np.zeros(len(every), np.int64)
    for c, t in zip(codes, times, strict=True):
        total[np.searchsorted(every, c)] += t
    return every, total


def block_lists(batches, depth: int, parts: int):
    """For each batch, block in it and part: packed lists of distinct grams and of distinct words (empty: the end of a text), with their number
    in training texts. A part has all grams with the same two latest context bytes, so whole subtrees."""
    one = np.uint64(1)
    for b in batches:
        blocks, texts, learns = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
        for block in np.unique(blocks).tolist():
            codes, times, words = [], [], {}
            for rows in in_pieces_of(np.flatnonzero(blocks == block), texts):
                raw = [texts[int(i)].as_py().encode("utf-8", "surrogatepass") for i in rows]
                g, _ = texts_grams(raw, depth)
                c, t = np.unique((g << one) | np.repeat(learns[rows], [len(x) + 1 for x in raw]).astype(np.uint64), return_counts=True)
                codes.append(c)
                times.append(t)
                if len(codes) == MERGE:
                    codes, times = map(list, zip(merged(codes, times)))
                for x, learn in zip(raw, learns[rows].tolist(), strict=True):
                    for w in (*x.lower().split(), b""):
                        words[w] = words.get(w, 0) + learn
            code, n = merged(codes, times)
            n = n * (code & one == one).astype(np.int64)
            grams = code >> one
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            grams, n = grams[first], np.add.reduceat(n, first)
            part = ((((grams >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B1) >> np.uint64(12)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, block, GRAMS, grams[order[a:e]].tobytes(), n[order[a:e]].tobytes()) for p, (a, e) in enumerate(zip(ends[:-1], ends[1:])) if e > a]
            by_part: dict[int, list[bytes]] = {}
            for w in words:
                by_part.setdefault(zlib.crc32(w) % parts, []).append(w)
            rows += [(p, block, WORDS, b"\n".join(ws), np.array([words[w] for w in ws], np.int64).tobytes()) for p, ws in by_part.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LISTED)], schema=LISTED)


def numbers(packed: bytes, kind) -> np.ndarray:
    return np.frombuffer(packed, kind)


class Places:
    """Where each of some distinct numbers stands: a cascade of hash tables, each for those that lost their slot in the one before."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        left = np.arange(len(keys), dtype=np.int32)
        for turn in range(64):
            bits = max(4, int(len(left) * 2).bit_length())
            table = np.zeros(1 << bits, np.int32)
            odd, shift = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * turn & (1 << 64) - 1 | 1), np.uint64(64 - bits)
            slot = (keys[left] * odd) >> shift
            table[slot] = left
            self.tables.append((odd, shift, table))
            left = left[table[slot] != left]
            if not len(left):
                return
        raise ValueError("the keys are not distinct")

    def of(self, wanted: np.ndarray) -> np.ndarray:
        out = np.empty(len(wanted), np.int32)
        at, some = slice(None), wanted
        for odd, shift, table in self.tables:
            place = table[(some * odd) >> shift]
            out[at] = place
            miss = np.flatnonzero(self.keys[place] != some)
            if not len(miss):
                return out
            at = miss if isinstance(at, slice) else at[miss]
            some = some[miss]
        raise KeyError("a number that the table doesn't have")


def in_pieces_of(rows: np.ndarray, texts: pa.Array):
    sizes = pc.binary_length(texts).to_numpy()[rows]
    part = np.cumsum(sizes) // PIECE
    for p in np.unique(part):
        yield rows[part == p]


def summed(t: pa.Table) -> pa.Table:
    """The lists of a part, those of a block's batches merged to one of each kind, and for each kind one more with the counts over all blocks."""
    part, out, own = t.column("part")[0].as_py(), [], {}
    for block, kind, keys in zip(*(t.column(c).to_pylist() for c in ("block", "kind", "keys")), strict=True):
        own.setdefault((block, kind), []).append(keys)
    for (block, kind), lists in own.items():
        if kind == GRAMS:
            keys = np.unique(np.concatenate([numbers(k, np.uint64) for k in lists])).tobytes() if len(lists) > 1 else lists[0]
        else:
            keys = b"\n".join(dict.fromkeys(w for k in lists for w in k.split(b"\n"))) if len(lists) > 1 else lists[0]
        out.append((part, block, kind, keys, None))
    rows = list(zip(*(t.column(c).to_pylist() for c in ("kind", "keys", "n")), strict=True))
    grams = [(numbers(k, np.uint64), numbers(n, np.int64)) for kind, k, n in rows if kind == GRAMS]
    if grams:
        keys, n = merged([g for g, _ in grams], [n for _, n in grams])
        out.append((part, ALL, GRAMS, keys.tobytes(), n.tobytes()))
    words: dict[bytes, int] = {}
    for kind, k, n in rows:
        if kind == WORDS:
            for w, c in zip(k.split(b"\n"), numbers(n, np.int64).tolist(), strict=True):
                words[w] = words.get(w, 0) + c
    if words:
        out.append((part, ALL, WORDS, b"\n".join(words), np.array([*words.values()], np.int64).tobytes()))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), LISTED)], schema=LISTED)


def top_model(known: DataFrame, depth: int) -> tuple[Top, int, int]:
    """Depths 0 and 1 from sums over the subtrees of all parts, at most 256 x 255 rows whatever the corpus; all and distinct training tokens."""
    def sums(batches):
        for b in batches:
            for kind, keys, n in zip(*(b.column(c).to_pylist() for c in ("kind", "keys", "n")), strict=True):
                n = numbers(n, np.int64)
                if kind == WORDS:
                    yield pa.record_batch([pa.array([x]) for x in (-1, int(n.sum()), int((n > 0).sum()), 0.0)], ["node", "n0", "n1", "log_pw"])
                    continue
                tree, out = Tree(numbers(keys, np.uint64), n, depth, 2), []
                level = tree.levels[2]
                for bit in range(8):
                    first = level.keys[level.first[bit]]
                    symbol = (first & np.uint64(255)).astype(np.int64)
                    node = ((first >> np.uint64(8)) & np.uint64(255)).astype(np.int64) * 256 + ((1 << bit) | (symbol >> (8 - bit)))
                    out.append((node, level.n0[bit], level.n1[bit], tree.log_pw[2, bit]))
                node, n0, n1, pw = (np.concatenate(x) for x in zip(*out))
                at, of = np.unique(node, return_inverse=True)
                yield pa.record_batch([pa.array(at), pa.array(np.bincount(of, n0).astype(np.int64)), pa.array(np.bincount(of, n1).astype(np.int64)), pa.array(np.bincount(of, pw))],
                                      ["node", "n0", "n1", "log_pw"])

    rows = known.where(F.col("block") == ALL).select("kind", "keys", "n").mapInArrow(sums, "node bigint, n0 bigint, n1 bigint, log_pw double").groupBy("node").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_pw").alias("log_pw")).toPandas()
    words, rows = rows[rows.node < 0], rows[rows.node >= 0]
    top = Top(rows.node.to_numpy(np.int64) // 256, rows.node.to_numpy(np.int64) % 256, rows.n0.to_numpy(np.int64), rows.n1.to_numpy(np.int64), rows.log_pw.to_numpy(float))
    return top, int(words.n0.sum()), int(words.n1.sum())


def valued(t: pa.Table, top: Top, depth: int) -> pa.Table:
    """For each block's lists of a part the log probabilities of its grams and the counts of its words."""
    out, lists = [], [[], []]
    for block, kind, keys, n in zip(*(t.column(c).to_pylist() for c in ("block", "kind", "keys", "n")), strict=True):
        if block != ALL:
            lists[kind].append((block, keys))
        elif kind == GRAMS:
            every, p = Tree(numbers(keys, np.uint64), numbers(n, np.int64), depth, 2).predict()
            log = top.log10(every, p).astype(np.float32)
        else:
            words = dict(zip(keys.split(b"\n"), numbers(n, np.int64).tolist(), strict=True))
    out += [(b, GRAMS, k, log[np.searchsorted(every, numbers(k, np.uint64))].tobytes()) for b, k in lists[GRAMS]]
    out += [(b, WORDS, k, np.array([words[w] for w in k.split(b"\n")], np.int64).tobytes()) for b, k in lists[WORDS]]
    b, kind, keys, n = zip(*out)
    return pa.table({"block": pa.array(b, pa.int32()), "kind": pa.array(kind, pa.int32()), "keys": pa.array(keys, pa.binary()), "n": pa.array(n, pa.binary())})


class Dictionary:
    """What a block needs to score its texts: log probabilities of its grams and counts of its words, read from the stored table."""

    def __init__(self, path: str, block: int, total: int, distinct: int):
        where, name = fs.FileSystem.from_uri(path)
        t = pq.read_table(f"{name}/block={block}", filesystem=where, columns=["kind", "keys", "n"])
        packed = list(zip(*(t.column(c).to_pylist() for c in ("kind", "keys", "n")), strict=True))
        self.places = Places(np.concatenate([numbers(k, np.uint64) for kind, k, _ in packed if kind == GRAMS]))
        self.value = np.concatenate([numbers(n, np.float32) for kind, _, n in packed if kind == GRAMS])
        self.words = pa.concat_arrays([pa.array(k.split(b"\n"), pa.binary()) for kind, k, _ in packed if kind == WORDS])
        counts = np.concatenate([numbers(n, np.int64) for kind, _, n in packed if kind == WORDS])
        self.known, self.log = counts > 0, np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))

    def scores(self, data: list[bytes], depth: int) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, score of the words and score of the bytes of some texts."""
        g, firsts = texts_grams(data, depth)
        score = np.add.reduceat(self.value[self.places.of(g)].astype(float), firsts)
        tokens, sizes = [], []
        for x in data:
            own = x.lower().split()
            own.append(b"")
            tokens += own
            sizes.append(len(own))
        at, sizes = pc.index_in(pa.array(tokens, pa.binary()), self.words).to_numpy(), np.array(sizes)
        firsts = np.cumsum(sizes) - sizes
        return sizes, np.add.reduceat(self.known[at].astype(np.int64), firsts), np.add.reduceat(self.log[at], firsts), score


def score_rows(batches, path: str, depth: int, total: int, distinct: int):
    """Scores of the texts in their order; each block's dictionary is read as its texts come."""
    known = functools.lru_cache(1)(Dictionary)
    for b in batches:
        blocks, texts = b.column(3).to_numpy(), b.column(1)
        out = [np.zeros(len(b), t) for t in (np.int64, np.int64, float, float)]
        for block in np.unique(blocks).tolist():
            for rows in in_pieces_of(np.flatnonzero(blocks == block), texts):
                data = [texts[int(i)].as_py().encode("utf-8", "surrogatepass") for i in rows]
                for o, x in zip(out, known(path, block, total, distinct).scores(data, depth), strict=True):
                    o[rows] = x
        n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
        yield pa.record_batch([b.column(0), b.column(2), n_bytes, pa.array(out[0]), pa.array(out[1]), pa.array(np.full(len(b), total, np.int64)), pa.array(out[2]), pa.array(out[3])],
                              ["doc_id", "learns", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, learns, text: str = "text", depth: int = DEPTH, files: bool = False) -> DataFrame:
    """Score every row of ``docs`` with the model learned from the rows where the condition ``learns`` is true.

    One row per row: doc_id, learns, n_bytes, n_tokens, n_known, train_tokens, base_score (smoothed single words), score: log10 probability of the
    text (of its bytes and its end), bits_per_byte (end mark counted). A null text counts as empty: one token, its end. Without training rows every
    bit has probability 1/2. Rows are independent, doc_id may repeat or be null; other columns are ignored; an empty table gives an empty one.

    A block is a file split or a part of one, so it has a bounded share of the text; ``files`` says that ``docs`` is a plain scan of files, which
    both passes split alike. Anything else is stored first. ``depth`` is 2 to 6.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6")
    spark = docs.sparkSession
    src = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    src = src if files else stored(src, "ctw-texts")
    parts = max(1, math.ceil(float(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) / BLOCK))
    block = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    src = src.withColumn("block", F.pmod(block, F.lit(2**31 - 1)).cast("int"))
    width = shuffle_width(spark)
    listed = "part int, block int, kind int, keys binary, n binary"
    lists = src.select("block", "text", "learns").mapInArrow(lambda it: released(block_lists(it, depth, width)), listed)
    known = stored(lists.groupBy("part").applyInArrow(summed, listed), "ctw-lists")
    model, total, distinct = top_model(known, depth)
    top = spark.sparkContext.broadcast(model)
    values = known.groupBy("part").applyInArrow(lambda t: valued(t, top.value, depth), VALUED)
    path = f"{shared_folder(spark)}/ctw-values-{uuid.uuid4().hex}"
    values.repartition(width, "block").write.partitionBy("block").parquet(path)
    kind = src.schema["doc_id"].dataType.simpleString()
    out = src.select("doc_id", "text", "learns", "block").mapInArrow(
        lambda it: released(score_rows(it, path, depth, total, distinct)),
        f"doc_id {kind}, learns boolean, n_bytes bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumn("bits_per_byte", -F.col("score") * math.log2(10) / (F.col("n_bytes") + 1))
