"""Encoding against the tokenizer library itself, on odd and random texts."""
import random
import struct

import public_tokenizers
from cases import no_documents, odd_documents
from tokenizers import Tokenizer

from evisets.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(texts):
    t = library()
    for text, want in zip(texts, t.encode_batch([x or "" for x in texts], add_special_tokens=False), strict=True):
        got = bpe.encode_text(PATH, text)
        assert got == struct.pack(f"<{len(want.ids)}I", *want.ids), repr((text or "")[:80])
        assert bpe.decode_ids(PATH, got) == t.decode(want.ids, skip_special_tokens=False)


def test_random_texts_equal_the_library():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ  \n\t'éèßÀΣσςİıǅﬁ0123.,!?_#😀中한あ́​ \x1c\x85\xa0᠎﻿"
    same(["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(1500)])
    same(["".join(r.choice("abcetnosrih") for _ in range(r.randint(50, 400))) for _ in range(300)])


def test_special_strings_contractions_and_endless_words():
    same(["<|startoftext|>a<|endoftext|>b <|endoftext|", "IT'S they're we'LL'd", "a" * 3000, "ha" * 2000, "!" * 999, None, "", " \n"])


def test_rows(spark):
    docs = odd_documents(spark)
    t = library()
    got = sorted((r.doc_id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode(docs, PATH).collect())
    want = []
    for r in docs.collect():
        e = t.encode(r.text or "", add_special_tokens=False)
        want.append((r.doc_id or 0, len(e.ids), struct.pack(f"<{len(e.ids)}I", *e.ids), t.decode(e.ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encode(no_documents(spark), PATH).count() == 0
