"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of a word's prefix is unique, so is its last token. An automaton over the vocabulary yields, at each end position, every token
that is a suffix of the prefix; the one that may follow the last token of the prefix before it is kept. Two tokens may stand side by side if
replaying their merges never finds a pair across the border that should have been merged earlier. Following the stored tokens backwards emits
the ids. Time is linear in the word's length, so one endless word costs no more than many short ones.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisets.llm.common import released

#: Unicode White_Space, fixed values.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokenizer's pattern of the word-end vocabulary, fixed value.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
ENDED = 0x2000  # added to the code of a word's last symbol
KEEP_CHARS, KEEP_ENTRIES = 64, 150_000  # the cache of each Python worker: bounded, and it never changes a result
ROWS = 512  # texts whose ids and decoded texts are held together
INF = 1 << 60


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: bytes that print stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Vocabulary:
    """Tokens, merge ranks and the automaton, from a tokenizer file of the word-end kind."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = suffix = spec["model"]["end_of_word_suffix"]
        ids = spec["model"]["vocab"]
        self.names = {i: t for t, i in ids.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.symbol = byte_symbols()
        self.rank, self.parts, self.pair = dict.fromkeys(ids.values(), -1), {}, {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            whole = ids[a + b]
            self.rank[whole], self.parts[whole], self.pair[ids[a], ids[b]] = r, (ids[a], ids[b]), r
        self.fits: dict[tuple[int, int], bool] = {}
        spelled = {i: self.marked(t) for t, i in ids.items()}
        self.automaton = ahocorasick.Automaton()
        # shortest first: whether a token can occur at all depends on shorter ones only
        for i in sorted(spelled, key=lambda i: (len(spelled[i]), self.rank[i])):
            if self.occurs(i):
                self.automaton.add_word(spelled[i], (i, len(spelled[i])))
            else:
                self.rank[i] = INF
        self.automaton.make_automaton()
        self.pieces, self.gaps = regex.compile(PIECE), regex.compile(f"[{SPACE}]+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def marked(self, token: str) -> str:
        """The token as symbols, the last of a word raised by ENDED."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + ENDED)
        return token

    def occurs(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token: its two parts occur and nothing else merges first."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self.rank[a] < INF and self.rank[b] < INF and self.adjacent(a, b, self.rank[token])

    def adjacent(self, left: int, right: int, until: int = INF) -> bool:
        """Whether the two tokens stay apart until merge ``until``: walk their merges backwards and look at every pair that met at the border."""
        ends_l = ends_r = until  # the merge that used up the symbol at the border
        while True:
            met = self.pair.get((left, right), INF)
            if met < ends_l and (met < ends_r or met == ends_r < until):  # at equal rank the left pair goes first
                return False
            if self.rank[left] > self.rank[right] and left in self.parts:
                ends_l, left = self.rank[left], self.parts[left][1]
            elif right in self.parts:
                ends_r, right = self.rank[right], self.parts[right][0]
            elif left in self.parts:
                ends_l, left = self.rank[left], self.parts[left][1]
            else:
                return True

    def word(self, word: str) -> list[int]:
        """Ids of one piece of text, given as plain characters."""
        symbols = "".join(map(self.symbol.__getitem__, word.encode("utf-8", "surrogatepass")))
        if self.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + ENDED)
        last, fits = [0] * (len(symbols) + 1), self.fits
        width = [0] * (len(symbols) + 1)
        for end, (token, n) in self.automaton.iter(symbols):
            end += 1
            start = end - n
            if width[end]:
                continue
            if start:
                if not width[start]:
                    continue
                pair = (last[start], token)
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= 2 * KEEP_ENTRIES:
                        fits.clear()
                    ok = fits[pair] = self.adjacent(*pair)
                if not ok:
                    continue
            last[end], width[end] = token, n
        out, at = [], len(symbols)
        while at:
            out.append(last[at])
            at -= width[at]
        return out[::-1]

    def split(self, text: str) -> list[str]:
        """Text between white space; Python's own split also takes four control characters for white space."""
        return [x for x in self.gaps.split(text) if x] if any(map(text.__contains__, "\x1c\x1d\x1e\x1f")) else text.split()

    def chunk(self, chunk: str, chunks: Chunks | None = None) -> bytes:
        """Ids of text without white space, as little-endian 32-bit integers."""
        text = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        pieces = self.pieces.findall(text)
        if chunks is not None and (len(pieces) > 1 or text != chunk):
            return b"".join(chunks[w] if w.isascii() and w.isalpha() else packed(self.word(w)) for w in pieces)  # such a piece is a chunk too
        return b"".join(packed(self.word(w)) for w in pieces)


class Chunks(dict):
    """Ids by chunk, in two generations: when the young one is full it becomes the old one, so chunks in use stay."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.vocabulary.chunk(chunk, self)
        if len(chunk) <= KEEP_CHARS:
            if len(self) >= KEEP_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


@functools.lru_cache(2)
def loaded(path: str) -> tuple[Vocabulary, Chunks]:
    v = Vocabulary(path)
    return v, Chunks(v)


def encode_text(path: str, text: str | None) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers; strings of special tokens are those tokens. None: empty."""
    v, chunks = loaded(path)
    if not text:
        return b""
    out, at = [], 0
    for m in [*(v.specials.finditer(text) if v.specials else ()), None]:
        out += map(chunks.__getitem__, v.split(text[at : m.start() if m else len(text)]))
        if m:
            out.append(v.special[m[0]].to_bytes(4, "little"))
            at = m.end()
    return b"".join(out)


def decode_ids(path: str, ids: bytes) -> str:
    """Text of the ids: their names, blank between, as the file names no decoder."""
    return " ".join(map(loaded(path)[0].names.__getitem__, memoryview(ids).cast("I").tolist()))


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded.

    A null or empty text gives no ids and an empty decoded text. Other columns of ``docs`` are ignored; repeated rows are encoded each.
    ``vocabulary`` is a path that every executor can open. The work is row by row: no shuffle.
    """
    narrow = docs.select("doc_id", F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                b = batch.slice(at, ROWS)
                ids = [encode_text(vocabulary, t.as_py()) for t in b.column(1)]
                yield pa.record_batch([b.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                                       pa.array([decode_ids(vocabulary, i) for i in ids], pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return narrow.mapInArrow(lambda batches: released(rows(batches)), f"doc_id {kind}, ids binary, n_tokens bigint, decoded string")
