"""Simple-8b files of token ids against the tokenizers library and plain bytes."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lateline.llm import token_ids
from lateline.llm.common import ready
from lateline.llm.tokens import ChunkEncoder, chunk_encoder, public_tokenizers

widths = st.one_of(st.integers(0, 1), st.just(0), st.integers(0, 300), st.integers(0, 1 << 20), st.integers(0, (1 << 64) - 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(widths, st.integers(1, 300)), max_size=60))
def test_pack_round_trip(runs):
    ids = np.repeat(np.array([v for v, _ in runs], np.uint64), [k for _, k in runs])
    raw = token_ids.frame(3, 7, [5], [len(ids)], ids)
    shard, first, doc_ids, sizes, found = token_ids.read_frame(raw)
    assert (shard, first, doc_ids, sizes.tolist()) == (3, 7, [5], [len(ids)])
    assert found.tolist() == ids.tolist()


def test_words_are_as_many_as_the_selectors_allow():
    words, escapes = token_ids.pack(np.zeros(480, np.uint64))
    assert len(words) == 2 and not len(escapes)
    words, escapes = token_ids.pack(np.array([1] * 60 + [50_000] * 3 + [1 << 63], np.uint64))
    assert len(words) == 3 and escapes.tolist() == [1 << 63]


def test_one_block_can_be_read_alone():
    ids = np.random.default_rng(1).integers(0, 50_000, 3 * token_ids.BLOCK + 5).astype(np.uint64)
    packed = [token_ids.pack(ids[at : at + token_ids.BLOCK]) for at in range(0, len(ids), token_ids.BLOCK)]
    one = packed[1][0]
    assert token_ids.unpack(one, np.array([len(one)]), one[:0], np.array([0]), token_ids.BLOCK).tolist() == ids[token_ids.BLOCK : 2 * token_ids.BLOCK].tolist()


def test_mark_inside_a_frame_is_masked():
    mark = int.from_bytes(token_ids.MARK.encode()[:8], "little"), int.from_bytes(token_ids.MARK.encode()[8:], "little")
    for ids in ([*mark], [int.from_bytes(b"\n<end-of", "little"), int.from_bytes(b"-frame>\n", "little")], [7, *mark, *mark]):
        ids = np.array(ids, np.uint64)
        raw = token_ids.frame(0, 0, [1], [len(ids)], ids)
        assert (raw + token_ids.MARK.encode()).find(token_ids.MARK.encode()) == len(raw)
        assert token_ids.read_frame(raw)[4].tolist() == ids.tolist()
    names = [mark[0], mark[1]]  # a mark made of document ids
    raw = token_ids.frame(0, 0, names, [1, 1], np.array([1, 2], np.uint64))
    assert token_ids.MARK.encode() not in raw and token_ids.read_frame(raw)[2] == names


def test_damage_is_an_error():
    raw = bytearray(token_ids.frame(0, 0, [1], [3], np.array([1, 2, 3], np.uint64)))
    raw[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_ids.read_frame(bytes(raw))
    with pytest.raises(ValueError, match="damaged"):
        token_ids.read_frame(bytes(raw[:-3]))


ODD = [
    None, "", " ", "plain words here", "two  spaces\n\n and\tlines \n end ", "<|endoftext|> inside<|endoftext|>", "it's we'll 'quoted'",
    "café ́x 　y z", "\U0001f44d‍ x", "line\nline\nline", "\r\n\x1c a\x85b", "İstanbul ΣΑΣ ß",
]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_library_ids(vocabulary):
    import pyarrow as pa

    library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    rng = np.random.default_rng(5)
    bits = [x for x in ODD if x] + ["a", "B", " ", "  ", "\n", "\n\n", "12", "中", "!", "가", "é"]
    texts = ODD + ["".join(rng.choice(bits, rng.integers(1, 9))) for _ in range(3000)]
    ids, bounds = chunk_encoder(vocabulary).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_a_word_is_learnt_once_whatever_closes_it():
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = ChunkEncoder(path), Tokenizer.from_file(path)
    text = "a stemlike stemlike, stemlike. stemlike***\nstemlike%%%\nstemlike stemlike'' ünter!? ünter ünter,$$$\nx9. x9"
    ids, bounds = encoder.encode(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert [sorted(known) for known in encoder.number][1:] == [["stemlike", "x9", "ünter"], []]
    assert {"a", "stemlike", "x9", "", "***\n"} <= set(encoder.number[0]) and "stemlike***" not in encoder.number[0]


def test_an_error_leaves_no_numbers_without_ids():
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = ChunkEncoder(path), Tokenizer.from_file(path)
    learn, encoder._learn = encoder._learn, None
    with pytest.raises(TypeError):
        encoder.encode(pa.array(["some words. and more"]))
    encoder._learn = learn
    for text in ("more words. and some", "some words. and more"):
        assert encoder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


LIBRARY = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}
marked = st.lists(
    st.sampled_from(["word", "Élan", "9", "中", "я", "it's", "'s", "'", ".", "***", "!!!!!!!!!", ",$$$", "²", "\x85", " ", "\n", "\n", "<|endoftext|>", "|>", "\u0301"]),
    max_size=14,
).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), marked, st.text(max_size=8)), min_size=1, max_size=6))
def test_closing_marks_give_the_library_ids(texts):
    import pyarrow as pa

    for vocabulary, library in LIBRARY.items():
        ids, bounds = chunk_encoder(vocabulary).encode(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def plain(rows):
    """doc_id, start, n_tokens, crc of every row, by the library alone."""
    library, before, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    return out


def test_files_against_the_library(spark, tmp_path):
    ready(spark)
    rows = [(9 - i, text, i) for i, text in enumerate(ODD)] + [(None, "no name", 0), (100, "word " * 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    path = str(tmp_path / "ids")
    token_ids.write_ids(docs, path, frame_ids=16)
    found = token_ids.with_start(token_ids.read_ids(spark, path))
    got = found.orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == plain([r[:2] for r in rows])
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    again = [(3, "same", 0)] * 5 + [(3, "other", 0)]
    path = str(tmp_path / "again")
    token_ids.write_ids(spark.createDataFrame(again, "doc_id long, text string, x int"), path)
    found = token_ids.with_start(token_ids.read_ids(spark, path)).collect()
    assert sorted(r["start"] for r in found) == [0, 2, 4, 6, 8, 10]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    token_ids.write_ids(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_ids.with_start(token_ids.read_ids(spark, path)).collect() == []


def test_query_reads_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, token_ids.query(spark, sf).collect())) == sorted(plain(rows))
