"""Flat encoding of many texts: every distinct word goes to the tokenizer once.

The byte-level pre-tokenizer cuts a text into words, and each word is encoded on
its own. Here the cutting is done for a whole chunk of texts in numpy, words are
hashed, and only words that this worker has not met go to the tokenizers library.
Texts with characters outside the table below, or with a special token, go to the
library whole. The ids are those of ``Tokenizer.encode`` in either case.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

from leadloom.llm.common import Spans, code_table, ranges

TOP = 0x250                # characters below have had the same category in every Unicode version
CACHE_WORDS = 500_000      # a worker's cache of words starts anew beyond this
OTHER, LETTER, NUMBER, SPACE, ODD = 0, 1, 2, 3, 4


def _classes() -> np.ndarray:
    out = np.zeros(TOP, np.uint8)
    for code in range(TOP):
        category = unicodedata.category(chr(code))
        if code in (9, 10, 13, 32):
            out[code] = SPACE
        elif code < 32 or 0x7F <= code <= 0xA0 or category[0] == "Z" or category == "Cn":
            out[code] = ODD
        elif category[0] == "L":
            out[code] = LETTER
        elif category[0] == "N":
            out[code] = NUMBER
    return out


CLASS = _classes()
PLAIN = re.compile("[" + "".join(re.escape(chr(c)) for c in range(TOP) if CLASS[c] != ODD) + "]*")
CODE_HASH = code_table(TOP)
#: What the pattern of the public pre-tokenizer splits off after an apostrophe.
SHORT = ("s", "t", "m", "d")
LONG = ("re", "ve", "ll")


def word_starts(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the words of the pre-tokenizer start; ``codes`` are the joined texts, none empty."""
    n = len(codes)
    cls = CLASS[codes]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= cls[1:] != cls[:-1]
    starts = run[:n].copy()
    white = cls == SPACE
    # a run of white space before more text of the same document gives up its last character ...
    last = np.flatnonzero(white & run[1:] & ~first[1:])
    starts[last] = True
    # ... and a blank there belongs to the next word
    joined = last[codes[last] == 32] + 1
    starts[joined] = False
    # apostrophe, alone, not joined to a blank, before letters
    quote = np.flatnonzero((codes == 39) & run[:n] & run[1:] & ~first[1:])
    if len(quote):
        before = np.maximum(quote - 1, 0)
        quote = quote[first[quote] | (codes[before] != 32)]
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        stop = np.concatenate([first, np.ones(3, bool)])
        one = quote[np.isin(padded[quote + 1], [ord(c) for c in SHORT])]
        two = quote[~stop[quote + 2]]
        two = two[np.any([(padded[two + 1] == ord(a)) & (padded[two + 2] == ord(b)) for a, b in LONG], axis=0)]
        for hits, size in ((one, 1), (two, 2)):
            starts[hits + 1] = False
            after = hits + 1 + size
            starts[after[after < n]] = True
    return starts


class FlatEncoder:
    """Texts to one flat id array, with a cache of words. One per worker and vocabulary."""

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.blank_first = np.zeros(self.size, bool)
        for word, k in vocabulary.items():
            self.blank_first[k] = word[:1] == "Ġ"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)         # sorted word hashes
        self.at = np.zeros(0, np.int64)            # where the ids of the word lie
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids per word). Words of a blank and letters go in joined lines:
        the pre-tokenizer cuts them at the blanks again, and only their first ids begin with a blank."""
        counts = np.zeros(len(words), np.int64)
        simple = np.fromiter((w[0] == " " and w[1:].isalpha() for w in words), bool, len(words))
        parts: list[np.ndarray] = [np.zeros(0, self.kind)] * 2
        order = [np.flatnonzero(simple), np.flatnonzero(~simple)]
        if len(order[0]):
            chosen = [words[i] for i in order[0]]
            lines = ["".join(chosen[i:i + 500]) for i in range(0, len(chosen), 500)]
            ids = np.concatenate([np.array(e.ids, self.kind) for e in
                                  self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            begins = np.flatnonzero(self.blank_first[ids])
            if len(begins) != len(chosen):
                raise AssertionError("the pre-tokenizer has cut a word")
            counts[order[0]] = np.diff(np.append(begins, len(ids)))
            parts[0] = ids
        if len(order[1]):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in order[1]],
                                                                     add_special_tokens=False)]
            counts[order[1]] = [len(f) for f in found]
            parts[1] = np.array([i for f in found for i in f], self.kind)
        mixed = np.concatenate(parts)
        at = np.zeros(len(words), np.int64)
        both = np.concatenate(order)
        at[both] = np.cumsum(counts[both]) - counts[both]
        return mixed[ranges(at, counts)], counts

    def learn(self, keys: np.ndarray, words: Sequence[str]) -> None:
        ids, counts = self.encode_words(words)
        at = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, ids])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], np.concatenate([self.at, at])[order]
        self.count = np.concatenate([self.count, counts])[order]

    def words(self, codes: np.ndarray, doc_starts: np.ndarray, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """(index of each word of ``codes`` in the cache, starts of the words)."""
        begins = np.flatnonzero(word_starts(codes, doc_starts))
        stops = np.append(begins[1:], len(codes))
        hashes = Spans(codes, CODE_HASH).hash(begins, stops)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        if not known.all():
            fresh = np.flatnonzero(~known)
            a, b = begins[where[fresh]].tolist(), stops[where[fresh]].tolist()
            self.learn(distinct[fresh], [joined[i:j] for i, j in zip(a, b)])
            place = np.searchsorted(self.keys, distinct)
        return place[back], begins

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids per text) for texts without nulls."""
        counts = np.zeros(len(texts), np.int64)
        easy = np.fromiter((bool(t) and self.plain(t) for t in texts), bool, len(texts))
        chosen = [t for t, e in zip(texts, easy) if e]
        flat = np.zeros(0, self.kind)
        if chosen:
            sizes = np.fromiter(map(len, chosen), np.int64, len(chosen))
            joined = "".join(chosen)
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            doc_starts = np.cumsum(sizes) - sizes
            word, begins = self.words(codes, doc_starts, joined)
            flat = self.flat[ranges(self.at[word], self.count[word])]
            upto = np.append(0, np.cumsum(self.count[word]))
            cut = np.append(np.searchsorted(begins, doc_starts), len(begins))
            counts[easy] = np.diff(upto[cut])
        if easy.all():
            return flat, counts
        ends = np.append(0, np.cumsum(counts[easy]))
        parts, k = [], 0
        for i, text in enumerate(texts):
            if easy[i]:
                parts.append(flat[ends[k]:ends[k + 1]])
                k += 1
            elif text:
                parts.append(self.whole(text))
                counts[i] = len(parts[-1])
        return (np.concatenate(parts) if parts else flat), counts


_encoders: dict[str, FlatEncoder] = {}


def encoder(tokenizer_path: str) -> FlatEncoder:
    """This worker's encoder of a vocabulary file."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = FlatEncoder(tokenizer_path)
    return _encoders[tokenizer_path]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
