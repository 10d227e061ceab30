"""BPE encoding in batched numpy merge rounds, and decoding.

The words of a batch that were not seen before are encoded together: the symbols
of all of them lie in one flat array. Every round forms the pair keys of all
neighbours, finds their ranks by binary search over the sorted keys of the merge
table, and merges the lowest-ranked pair of every word at once, so the number of
rounds is that of the longest merge chain of a word, not the number of words. A
round costs all symbols left, so a word of LONG_WORD bytes and more, which may need
very many rounds, is merged on its own from a queue of its pairs by rank, n log n
steps for n bytes; its pairs' ranks are found by binary search in the same keys.

Works on the vocabulary files of public tokenizers whose pre-tokenizer is a
pattern whose matches are the words, mapped byte by byte to letters, and whose
words end in a suffix.
"""

import heapq
import json
import os
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lateline.llm.common import map_batches

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 400_000  # words a worker remembers; beyond it starts afresh, results do not depend on it
CACHE_BYTES = 64 << 20  # bytes of words and ids it remembers, likewise
LONG_WORD = 512
_NO_RANK = np.iinfo(np.int64).max


def byte_letters():
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain}
    for number, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + number)
    return [letters[b] for b in range(256)]


class Encoder:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {token["content"]: token["id"] for token in parts["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, number in [*vocabulary.items(), *self.special.items()]:
            self.tokens[number] = token
        splitter = next(p for p in parts["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(splitter["pattern"]["Regex"]).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        letters = byte_letters()
        self.library = Tokenizer.from_file(path)
        self.byte_of = {letter: number for number, letter in enumerate(letters)}
        self.inner = np.array([vocabulary[letter] for letter in letters], np.int64)
        self.last = np.array([vocabulary[letter + suffix] for letter in letters], np.int64)
        size = len(self.tokens)
        pairs = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in model["merges"]]
        left, right, merged = np.array(pairs, np.int64).T
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.ranks, self.merged = size, keys[order], order, merged[order]
        self.key_list = keys[order].tolist()
        # a special token stands among the words as the bytes of its id, and is known from the start
        self.special_ids = {number: number for number in (int(i).to_bytes(4, "little") for i in self.special.values())}
        self._forget()

    def _forget(self):
        self.cache, self.cached_bytes = dict(self.special_ids), 0

    # -- merge rounds

    def merge_words(self, words):
        """Ids of each word (bytes, not empty), as one flat array and the words' bounds in it."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_owner, done_symbols = [], []
        while len(symbols):
            found, place, rank = self._ranked(symbols, owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            best = np.repeat(best, sizes)
            over = best == _NO_RANK  # words without a pair left
            if over.any():
                done_owner.append(owner[over])
                done_symbols.append(symbols[over])
            chosen = found & (rank == best)
            chosen = _without_overlap(chosen)
            symbols = np.where(chosen, self.merged[place], symbols)
            gone = np.r_[False, chosen[:-1]] | over
            symbols, owner = symbols[~gone], owner[~gone]
        owner = np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(words) + 1))
        return np.concatenate(done_symbols)[order], bounds

    def _ranked(self, symbols, owner):
        """For each symbol with its right neighbour: is it a merge, its place in the table, its rank."""
        key = np.full(len(symbols), -1, np.int64)
        inside = owner[1:] == owner[:-1]
        key[:-1][inside] = (symbols[:-1] * self.size + symbols[1:])[inside]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[place] == key
        return found, place, np.where(found, self.ranks[place], _NO_RANK)

    def merge_long_word(self, word):
        """Ids of one word (bytes) as a list: its pairs wait in a queue by rank, then place, and a merge renews its neighbours only."""
        raw = np.frombuffer(word, np.uint8)
        symbols = np.r_[self.inner[raw[:-1]], self.last[raw[-1:]]]
        size = len(symbols)
        found, _, rank = self._ranked(symbols, np.zeros(size, np.int64))
        queue = (rank[found] * size + np.flatnonzero(found)).tolist()
        heapq.heapify(queue)
        ranks = np.where(found, rank, -1).tolist()  # of the pair that begins at a place, -1: none
        symbols, after, before = symbols.tolist(), list(range(1, size + 1)), list(range(-1, size - 1))
        keys, table_ranks, merged = self.key_list, self.ranks, self.merged

        def renew(left, right):
            key = symbols[left] * self.size + symbols[right]
            place = bisect_left(keys, key)
            if place < len(keys) and keys[place] == key:
                ranks[left] = int(table_ranks[place])
                heapq.heappush(queue, ranks[left] * size + left)
            else:
                ranks[left] = -1

        while queue:
            rank, left = divmod(heapq.heappop(queue), size)
            if ranks[left] != rank:
                continue  # a merge beside it came first
            right = after[left]
            symbols[left] = int(merged[bisect_left(keys, symbols[left] * self.size + symbols[right])])
            symbols[right], ranks[right] = -1, -1
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
                renew(left, after[left])
            else:
                ranks[left] = -1
            if before[left] >= 0:
                renew(before[left], left)
        return [symbol for symbol in symbols if symbol >= 0]

    def learn(self, words):
        """Encode words (text) that are not in the cache yet."""
        new = [word for word in words if word not in self.cache]
        if not new:
            return
        coded = [word.encode("utf-8") for word in new]
        ids = {}
        for at, word in enumerate(coded):
            if len(word) >= LONG_WORD:
                ids[at] = np.array(self.merge_long_word(word), "<u4").tobytes()
        short = [at for at in range(len(new)) if at not in ids]
        if short:
            flat, bounds = self.merge_words([coded[at] for at in short])
            raw, cuts = flat.astype("<u4").tobytes(), (4 * bounds).tolist()
            for at, start, end in zip(short, cuts[:-1], cuts[1:], strict=True):
                ids[at] = raw[start:end]
        for at, word in enumerate(new):
            self.cache[word] = ids[at]
            self.cached_bytes += len(coded[at]) + len(ids[at])

    # -- texts

    def encode_batch(self, texts):
        """The ids of each text (None: empty) as little-endian unsigned 32-bit integers, in bytes."""
        split = [self._words(text or "") for text in texts]
        if len(self.cache) > CACHE_WORDS or self.cached_bytes > CACHE_BYTES:
            self._forget()
        self.learn({word for words in split for word in words})
        found = self.cache.__getitem__
        out = []
        for words in split:
            out.append(b"".join(map(found, words)))
        return out

    def _words(self, text):
        """Words of the normalised text; special tokens in it are taken out first and stand as their id's bytes."""
        if "<|" not in text:
            return self._plain_words(text)
        words = []
        for piece in self.split_special(text):
            if piece in self.special:
                words.append(int(self.special[piece]).to_bytes(4, "little"))
            else:
                words.extend(self._plain_words(piece))
        return words

    def _plain_words(self, text):
        """Words of a text in which everyday scripts are normalised here, others by the library.

        What is a letter and what its lower case is depends on the Unicode version
        for characters off the everyday ranges; the library's own is the one to match.
        """
        if not _RARE(text):
            return self.words_of(normalise(text))
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, word)).decode("utf-8") for word, _ in split]

    def decode(self, ids):
        """Tokens of the ids, joined by single spaces; ids are bytes as encode_batch returns them."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _without_overlap(chosen):
    """Of runs of neighbouring merges of the same pair (a a a), keep the first, third and so on."""
    if not (chosen[1:] & chosen[:-1]).any():
        return chosen
    at = np.arange(len(chosen))
    starts = chosen & ~np.r_[False, chosen[:-1]]
    begun = np.maximum.accumulate(np.where(starts, at, 0))
    return chosen & ((at - begun) % 2 == 0)


# off the ranges whose characters stand alone under NFC and mean the same in all versions of Unicode
_RARE = regex.compile(r"[^\0-\u024f\u0391-\u03c9\u0410-\u044f\u2013-\u2026\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]").search


def normalise(text):
    """Lower case character by character, for texts without rare characters; white space is in no word and stays."""
    if "Σ" in text:
        text = text.replace("Σ", "σ")  # no final form: each character stands alone
    return text.lower()


@lru_cache(maxsize=4)
def encoder(vocabulary=VOCABULARY):
    """One encoder per worker and vocabulary; a name of a public vocabulary or a path."""
    return Encoder(vocabulary if os.path.exists(vocabulary) else public_tokenizers.path(vocabulary))


# ---- over a table -------------------------------------------------------------


def encode(docs, vocabulary=VOCABULARY):
    """(doc_id, ids) of every row; ids is binary: little-endian unsigned 32-bit integers."""

    def batch_of(batch):
        ids = encoder(vocabulary).encode_batch(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(docs, batch_of, "doc_id long, ids binary")


def decode(encoded, vocabulary=VOCABULARY):
    """The rows of encode() with the decoded text beside the ids."""

    def batch_of(batch):
        decoder = encoder(vocabulary)
        ids = batch.column(1)
        texts = [decoder.decode(value or b"") for value in ids.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return map_batches(encoded.select("doc_id", "ids"), batch_of, "doc_id long, ids binary, text string")


def query(spark, sf_dir):
    """Every whole text encoded and decoded again; digests of both. Null texts count as empty ones."""
    from lateline.llm.common import table

    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )
