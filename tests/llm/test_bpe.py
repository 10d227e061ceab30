"""Own encoding and packing against the tokenizers library."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lateline.llm import bpe, packing

TEXTS = [
    None,
    "",
    " \n\t",
    "Hello, World's  finest tea; it's 1234 o'clock!!! we've I'll",
    "Éauouon.\nEnpaeux été ΣΊΣΥΦΟΣ İstanbul ǅ ß ﬁ",
    "<|endoftext|>a<|startoftext|> <|endoftext|><|endoftext| >b<|",
    "日本語のテキスト 한국어 😀😀👩‍👩‍👧 ​﻿ x\u0085y z᠎",
    "aaaaaaaaaaaaaaaaaaaaaaaa bbbbbbbbbbbbb ababababab" * 3,
    "$$$ *** ### | |x| 0x1F 3.14 ½ ² Ⅷ ١٢٣",
    "x" * 30_000,
    "the quick brown fox " * 20_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_ids_and_decoded_texts(library):
    rng = random.Random(3)
    letters = "abcdeéèüñ' ABC\n\t1$%-.,!’ΣςİŒœ漢"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(500)]
    own = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text, got in zip(texts, own.encode_batch(texts), strict=True):
        ids, decoded = wanted(library, text)
        assert got == as_bytes(ids), text and text[:80]
        assert own.decode(got) == decoded


def test_long_words_cost_little(library):
    rng = random.Random(11)
    encoder = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY))
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    begun = time.monotonic()
    coded = encoder.encode_batch([letters])[0]
    assert time.monotonic() - begun < 60
    assert coded == as_bytes(library.encode(letters, add_special_tokens=False).ids)
    for length in (bpe.LONG_WORD - 1, bpe.LONG_WORD, bpe.LONG_WORD + 1, 3 * bpe.LONG_WORD):
        for alphabet in ("ab", "a", "etaoinshr", "th\u00e9\u4e2d"):
            word = "".join(rng.choices(alphabet, k=length))
            assert encoder.encode_batch([word])[0] == as_bytes(library.encode(word, add_special_tokens=False).ids)
    assert encoder.cached_bytes > 1_000_000


def test_cache_is_bounded_in_bytes(monkeypatch):
    encoder = bpe.Encoder(public_tokenizers.path(bpe.VOCABULARY))
    first = encoder.encode_batch(["some words and more"])
    monkeypatch.setattr(bpe, "CACHE_BYTES", 10)
    assert encoder.encode_batch(["others"]) and "others" in encoder.cache and "words" not in encoder.cache
    assert encoder.encode_batch(["some words and more"]) == first


def test_every_character_alone(library):
    own = bpe.encoder()
    texts = [chr(c) for c in [*range(0x30000), 0xE0001, 0x10FFFF] if not 0xD800 <= c < 0xE000]
    for text, got in zip(texts, own.encode_batch(texts), strict=True):
        assert got == as_bytes(wanted(library, text)[0]), hex(ord(text))


def test_bpe_query(spark, tmp_path, library):
    rows = [(i, text, "clash") for i, text in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, "null id", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, bpe.query(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        ids, decoded = wanted(library, text)
        want.append((doc_id, len(ids), hashlib.sha256(as_bytes(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_packing_query(spark, tmp_path, library):
    rows = [(i, text, 5) for i, text in enumerate(TEXTS)] + [(3, TEXTS[3], 6), (None, "null id", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, length int").write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.query(spark, str(tmp_path)).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    by_doc = defaultdict(list)
    for r in got:
        assert r["offset"] == 0 and r["length"] <= 2048 and r["length"].bit_count() == 1
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for doc_id, text, _ in rows:
        ids = [*wanted(library, text)[0], 1]
        times = sum(r[0] == doc_id for r in rows)
        cuts = sorted(set(by_doc[doc_id]))
        assert len(by_doc[doc_id]) == times * len(cuts) and sum(c[1] for c in cuts) == len(ids)
        at = 0
        for start, length, crc, n in cuts:
            assert (start, n, crc) == (at, len(ids), zlib.crc32(as_bytes(ids[start : start + length])))
            at += length


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert bpe.query(spark, str(tmp_path)).count() == 0
    assert packing.query(spark, str(tmp_path)).count() == 0


def test_buckets_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here and more of them")], "doc_id long, text string")
    packing.write_buckets(packing.pieces(docs), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert b"".join(bytes(r["ids"]) for r in rows)[-4:] == b"\x01\0\0\0"
    assert [len(r["ids"]) // 4 for r in rows] == [r["length"] for r in rows] == packing.piece_lengths(8)
