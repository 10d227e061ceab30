"""Token ids of whole texts, by the tokenizers library at the price of the distinct words.

A text is cut at single spaces and line feeds that stand between two characters
which are certainly neither white space nor combining marks. No token of a
byte-level or word-wise vocabulary reaches over such a place, except that a
leading space or line feed belongs to the word behind it, where it is kept. So the
ids of a text are those of its chunks one after the other. Arrow cuts and numbers the
chunks of a batch, the library encodes those a worker has not seen yet, and
one gather over a flat array lays out the ids.

A byte-level vocabulary's pattern also parts a letter or digit from the marks behind it,
and a line feed from what is no white space. There the marks that close a word and the
line feed behind it are a chunk of their own, so a word is known whatever closes it.
"""

import json
import os
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count
from operator import attrgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from lateline.llm.bpe import byte_letters

CACHE_BYTES = 128 << 20  # what a worker remembers; beyond it starts afresh, results do not depend on it
_LIBRARY_TEXTS = 256  # words handed to the library at a time
# characters that are certainly no white space and combine with nothing before them
_FIRM = "[!-~¡-¬®-ɏΑ-ΡΣ-ωА-яぁ-ゖァ-ヺ一-龥가-힣]"
_LETTER = "[0-9A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-яぁ-ゖァ-ヺ一-龥가-힣]"  # those of them that are letters or digits
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MOST_MARKS = 8  # a word that more marks close stays whole
_LEADS = ("", " ", "\n")
# a word of letters: one token's worth under a byte-level vocabulary's pattern
_PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
_LETTERS = dict(enumerate(byte_letters()))
_ID = attrgetter("id")


class ChunkEncoder:
    """Ids of texts as tokenizers.Tokenizer.encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        # a vocabulary with word ends drops white space, so a chunk's lead says nothing there
        self.leads = parts["model"].get("end_of_word_suffix") is None
        self.added = [token["content"] for token in parts.get("added_tokens") or ()]
        self._forget()

    def _forget(self):
        number = count().__next__  # one series over all leads, a chunk gets the next when it is first looked up
        self.number, self.held = tuple(defaultdict(number) for _ in _LEADS), 0
        self.used = self.chunks = 0
        self.store = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, lead, words):
        """Encode words that are not known behind this lead yet; they have the numbers from self.chunks on."""
        for at in range(0, len(words), _LIBRARY_TEXTS):
            part = words[at : at + _LIBRARY_TEXTS]
            order, sizes, flat = self._ids(lead, part)
            self.store = _room(self.store, self.used + len(flat))
            self.starts, self.sizes = _room(self.starts, self.chunks + len(part)), _room(self.sizes, self.chunks + len(part))
            self.store[self.used : self.used + len(flat)] = flat
            self.sizes[self.chunks + order] = sizes
            self.starts[self.chunks + order] = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            self.chunks += len(part)
            self.held += 120 * len(part) + sum(map(len, part)) + 4 * len(flat)

    def _ids(self, lead, words):
        """(places of words, how many ids each has, the ids); plain words come first, they go to the library's model without its pattern."""
        before, plain, spelled, rest = _LEADS[lead], [], [], range(len(words))
        if self.leads:
            rest = []
            for place, word in enumerate(words):
                whole = before + word
                if not _PLAIN(whole):
                    rest.append(place)
                    continue
                plain.append(place)
                spelled.append(whole.replace(" ", "Ġ") if whole.isascii() else whole.encode().decode("latin-1").translate(_LETTERS))
        tokens = list(map(self.library.model.tokenize, spelled))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(map(_ID, chain.from_iterable(tokens)), np.uint32, int(sizes.sum()))
        if rest:
            encoded = self.library.encode([before + words[place] for place in rest], is_pretokenized=True, add_special_tokens=False)
            sizes = np.append(sizes, np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(rest)))
            flat = np.append(flat, np.array(encoded.ids, np.uint32))
        return np.array([*plain, *rest], np.int64), sizes, flat

    def _numbers(self, lead, words):
        """Numbers of words (each once) behind a lead."""
        try:
            numbers = np.fromiter(map(self.number[lead].__getitem__, words), np.int64, len(words))
            self._learn(lead, [words[place] for place in np.flatnonzero(numbers >= self.chunks).tolist()])
        except BaseException:
            self._forget()  # there may be numbers without ids
            raise
        return numbers

    def encode(self, texts):
        """(ids, bounds) of a string array: the ids of text i are ids[bounds[i]:bounds[i + 1]]; null is empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.held > CACHE_BYTES:
            self._forget()
        lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        of_text = lines.offsets.to_numpy()
        pieces = pc.split_pattern(lines.flatten(), " ")
        of_line = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        lead = np.ones(len(at), np.int8)  # what stands before a piece: nothing, a space, a line feed
        lead[of_line[:-1]] = 2
        first = of_line[of_text - of_text[0]]  # the first piece of each text, and the end
        lead[first[:-1]] = 0
        before = lead.copy()

        firm = pc.match_substring_regex(words, "^" + _FIRM).to_numpy(zero_copy_only=False).astype(np.int8)
        firm += 2 * pc.match_substring_regex(words, _FIRM + r"\z").to_numpy(zero_copy_only=False)
        firm = firm[at]
        clean = lead == 0
        clean[1:] |= (firm[:-1] >> 1 & firm[1:]).view(bool)
        runs = np.flatnonzero(clean)
        ends = np.append(runs[1:], len(at))
        single = ends - runs == 1

        # single pieces are told apart by lead, by a line feed that follows, and by word
        kind = lead[runs] if self.leads else np.zeros(len(runs), np.int8)
        code = at[runs]
        stems, stem_of, tails, tail_of = self._parted(words)
        if self.leads:
            fed = single[1:] & single[:-1] & (kind[1:] == 2) & (tail_of >= 0)[code[1:]]
            kind[1:][fed] = 0
            kind[:-1][fed] += len(_LEADS)
        code += np.multiply(kind, len(words), dtype=np.int64)
        seen = np.zeros(2 * len(_LEADS) * len(words) if self.leads else len(words), bool)
        seen[code[single]] = True
        codes = np.flatnonzero(seen)
        lead_of, word_of = np.divmod(codes, len(words))
        follows, lead_of = np.divmod(lead_of, len(_LEADS))
        chunks = np.zeros((len(codes), 2 if self.leads else 1), np.int64)
        for number in range(len(_LEADS)):
            chosen = lead_of == number
            if chosen.any():
                stem = stem_of[word_of[chosen]]
                wanted = np.flatnonzero(np.bincount(stem))
                number_of = np.zeros(len(stems), np.int64)
                number_of[wanted] = self._numbers(number, _strings(stems.take(pa.array(wanted))))
                chunks[chosen, 0] = number_of[stem]
        if self.leads:
            closing = self._numbers(0, [*tails, *(tail + "\n" for tail in tails)])
            chunks[:, 1] = closing[np.maximum(tail_of[word_of], 0) + len(tails) * follows]
        store, bounds = self._gather(chunks.ravel())
        bounds = bounds[:: chunks.shape[1]]
        place_of = np.zeros(len(seen), np.int32)
        place_of[codes] = np.arange(len(codes))
        place = place_of[code]
        odd = np.flatnonzero(~single)
        if len(odd):
            joined = [_joined(words, at, before, runs[i], ends[i]) for i in odd.tolist()]
            spelled = {text: number for number, text in enumerate(dict.fromkeys(joined))}
            more, more_bounds = self._gather(self._numbers(0, list(spelled)))
            place[odd] = [len(codes) + spelled[text] for text in joined]
            store, bounds = np.append(store, more), np.append(bounds, len(store) + more_bounds[1:])

        del code, ends, single, clean, firm  # a text may be long
        ids, bounds = _laid_out(store, bounds[:-1][place], np.diff(bounds)[place])
        return ids, bounds[np.searchsorted(runs, first)]

    def _gather(self, numbers):
        """(ids, bounds) of chunks one after the other."""
        return _laid_out(self.store, self.starts[numbers], self.sizes[numbers])

    def _parted(self, words):
        """(stems, the stem of each word, marks, those that close each word); -1 for a word that holds an added token."""
        if not self.leads:
            return words, np.arange(len(words)), [""], None
        cut = pc.utf8_rtrim(words, characters=_MARKS)
        marks = (pc.binary_length(words).to_numpy() - pc.binary_length(cut).to_numpy()).astype(np.int64)
        marks[~pc.match_substring_regex(cut, _LETTER + r"\z").to_numpy(zero_copy_only=False)] = 0
        marks[marks > _MOST_MARKS] = 0
        whole = np.zeros(len(words), bool)
        for token in self.added:
            whole |= pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        marks[whole] = 0
        coded = pc.if_else(pa.array(marks > 0), cut, words).dictionary_encode()
        tails, tail_of = {"": 0}, np.zeros(len(words), np.int64)
        for size in range(1, _MOST_MARKS + 1):
            rows = np.flatnonzero(marks == size)
            if len(rows):
                ends = pc.utf8_slice_codeunits(words.take(pa.array(rows)), start=-size).dictionary_encode()
                places = [tails.setdefault(tail, len(tails)) for tail in ends.dictionary.to_pylist()]
                tail_of[rows] = np.array(places)[ends.indices.to_numpy()]
        tail_of[whole] = -1
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64), list(tails), tail_of


def _laid_out(store, starts, sizes):
    """Slices of `store` one after the other, and where each begins and the last ends."""
    bounds = np.append(0, np.cumsum(sizes))
    where = np.repeat(starts - bounds[:-1], sizes)
    where += np.arange(bounds[-1])
    return store[where], bounds


def _strings(array):
    return array.to_numpy(zero_copy_only=False).tolist()


def _joined(words, at, before, start, end):
    """The chunk of several pieces, with what stands before each."""
    parts = _strings(words.take(pa.array(at[start:end])))
    return "".join(_LEADS[kind] + part for kind, part in zip(before[start:end].tolist(), parts, strict=True))


def _room(array, size):
    """The array, or a copy at least twice as long where `size` does not fit."""
    if size <= len(array):
        return array
    wider = np.zeros(max(size, 2 * len(array)), array.dtype)
    wider[: len(array)] = array
    return wider


@lru_cache(maxsize=4)
def chunk_encoder(vocabulary):
    """One encoder per worker and vocabulary; a name of a public vocabulary or a path."""
    return ChunkEncoder(vocabulary if os.path.exists(vocabulary) else public_tokenizers.path(vocabulary))
