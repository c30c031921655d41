"""Byte-pair encoding by rounds of merges over many words at once, and decoding.

The symbols of all new words of a chunk lie in one flat array. A round looks up every
neighbouring pair by binary search over the sorted pair keys, takes the lowest rank of
each word, and merges all its places of that rank. Words without a known pair leave the
array. A rule is listed after the rules that make its parts, so merging all places of
the lowest rank at once gives the same ids as merging them one by one.

Null and empty texts have no ids and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadloom.llm.bpe import FlatEncoder, default_tokenizer
from leadloom.llm.common import ranges, text_chunks, texts

ROUND_BYTES = 1 << 20
NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    shown = set(visible)
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class RoundsEncoder(FlatEncoder):
    """The flat encoder with its own merges; of the library it uses the pre-tokenizer for unusual texts only."""

    def __init__(self, tokenizer_path: str):
        super().__init__(tokenizer_path)
        from tokenizers import pre_tokenizers
        self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        with open(tokenizer_path, encoding="utf-8") as file:
            loaded = json.load(file)
        vocabulary = loaded["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in loaded["model"]["merges"]]
        parts = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        key = parts[:, 0] * self.size + parts[:, 1]
        order = np.argsort(key, kind="stable")
        self.pair_keys, self.pair_ranks, self.made = key[order], order, parts[:, 2]
        letters = byte_letters()
        self.byte_ids = np.array([vocabulary[x] for x in letters], np.int64)
        back = {x: b for b, x in enumerate(letters)}
        self.added = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        spelled = [b""] * self.size
        for word, k in vocabulary.items():
            spelled[k] = bytes(back[x] for x in word) if all(x in back for x in word) else word.encode()
        for word, k in self.added.items():
            spelled[k] = word.encode()
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.spell_count = np.array([len(s) for s in spelled], np.int64)
        self.spell_at = np.cumsum(self.spell_count) - self.spell_count
        decimals = [b"%d," % k for k in range(self.size)]
        self.decimals = np.frombuffer(b"".join(decimals), np.uint8)
        self.decimal_count = np.array([len(s) for s in decimals], np.int64)
        self.decimal_at = np.cumsum(self.decimal_count) - self.decimal_count
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ranks_of(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The rank of each symbol with the next one of its word; NO_RANK where there is none."""
        out = np.full(len(symbols), NO_RANK)
        key = symbols[:-1] * self.size + symbols[1:]
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = np.flatnonzero((self.pair_keys[place] == key) & (word[:-1] == word[1:]))
        out[hit] = self.pair_ranks[place[hit]]
        return out

    def merge(self, data: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids per word) for words of at least one byte each."""
        symbols, word = self.byte_ids[data], np.repeat(np.arange(len(counts)), counts)
        done_ids, done_words = [], []
        while len(symbols):
            ranks = self.ranks_of(symbols, word)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(ranks, starts)
            size = np.diff(np.append(starts, len(symbols)))
            over = np.repeat(lowest == NO_RANK, size)
            if over.any():
                done_ids.append(symbols[over])
                done_words.append(word[over])
                left = ~over
                symbols, word, ranks = symbols[left], word[left], ranks[left]
                size, lowest = size[lowest != NO_RANK], lowest[lowest != NO_RANK]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(lowest, size)
            at = np.flatnonzero(hit)
            # of places side by side (one symbol repeated) every second one is free
            fresh = np.append(True, np.diff(at) != 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, word = symbols[stay], word[stay]
        ids = np.concatenate(done_ids) if done_ids else symbols
        words = np.concatenate(done_words) if done_words else word
        order = np.argsort(words, kind="stable")
        return ids[order].astype(self.kind), np.bincount(words, minlength=len(counts))

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        return self.merge(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))

    def whole(self, text: str) -> np.ndarray:
        out = []
        for piece in (self.splitter.split(text) if self.splitter else [text]):
            if piece in self.added:
                out.append(np.array([self.added[piece]], self.kind))
            elif piece:
                out.append(self.encode_words([piece[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(piece)])[0])
        return np.concatenate(out) if out else np.zeros(0, self.kind)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids spell."""
        return self.spelling[ranges(self.spell_at[ids], self.spell_count[ids])]


_encoders: dict[str, RoundsEncoder] = {}


def rounds_encoder(path: str) -> RoundsEncoder:
    if path not in _encoders:
        _encoders[path] = RoundsEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (array), ``decoded`` of every text."""
    vocabulary = tokenizer_path or default_tokenizer()

    def work(batches):
        for chunk in text_chunks(batches, limit=ROUND_BYTES):
            code = rounds_encoder(vocabulary)
            ids, counts = code(chunk.column("text").to_pylist())
            ends = np.append(0, np.cumsum(counts))
            upto = np.append(0, np.cumsum(code.spell_count[ids]))[ends]
            raw = code.decode(ids).tobytes()
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))),
                 pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"])

    return texts(docs).mapInArrow(work, "doc_id long, n_tokens long, ids array<int>, decoded string")


def round_trip_digest(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the hashes of the ids in decimal and of the decoded text, made next to the ids."""
    vocabulary = tokenizer_path or default_tokenizer()

    def work(batches):
        for chunk in text_chunks(batches, limit=ROUND_BYTES):
            code = rounds_encoder(vocabulary)
            ids, counts = code(chunk.column("text").to_pylist())
            ends = np.append(0, np.cumsum(counts))
            raw = code.decode(ids).tobytes()
            upto = np.append(0, np.cumsum(code.spell_count[ids]))[ends].tolist()
            digits = code.decimals[ranges(code.decimal_at[ids], code.decimal_count[ids])].tobytes()
            told = np.append(0, np.cumsum(code.decimal_count[ids]))[ends].tolist()
            hashed = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(counts),
                 pa.array([hashed(digits[a:max(a, b - 1)]) for a, b in zip(told[:-1], told[1:])], pa.string()),
                 pa.array([hashed(raw[a:b].decode("utf-8", "replace").encode()) for a, b in zip(upto[:-1], upto[1:])], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
