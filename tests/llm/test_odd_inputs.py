"""Very long texts, shared and missing ids, repeated labels, working column names; naive versions of the two classifiers."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from test_corpus import make, repeats

from leadloom.llm import bpe_rounds, imatch, packing, parity_join, pfor, prefix_free, separators, toxicity, zquality
from leadloom.llm.bpe import default_tokenizer
from leadloom.session import scratch_path
from tokenizers import Tokenizer

WORKING = ["stream", "doc_index", "part", "place", "width", "ids", "marks", "carried", "file", "start", "tie", "next_text", "fingerprint",
           "component_id", "n_shingles", "held_out", "digest"]


@pytest.fixture(scope="module")
def long_docs(spark):
    """One text of 1.5 MB, which is more than a chunk, between short ones; columns named like those used inside."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(3000)}" for _ in range(250_000)]
    texts = ["short one", " ".join(words), None, "short one", " ".join(words[:400]) + " end"]
    return make(spark, texts).withColumns({c: F.lit("x") for c in WORKING}), texts


def test_long_texts_as_tokens(spark, long_docs):
    docs, texts = long_docs
    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = {r.doc_id: r for r in pfor.encode_to_files(docs, end_id=2).collect()}
    assert all((got[i].n_tokens, got[i].ids_crc32) == (len(x) + 1, crc([*x, 2])) for i, x in enumerate(ids))
    assert {r.doc_id: r.n_tokens for r in separators.count_tokens(docs).collect()} == {i: len(x) + 1 for i, x in enumerate(ids)}
    got = {r.doc_id: r for r in bpe_rounds.round_trip_digest(docs).collect()}
    assert all(got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and got[i].n_tokens == len(ids[i])
               for i, t in enumerate(texts))
    pieces = Counter()
    for r in packing.pack_digest(docs, end_id=0).collect():
        pieces[r.doc_id] += r.length
    assert pieces == {i: len(x) + 1 for i, x in enumerate(ids)}


def test_long_texts_as_documents(spark, long_docs):
    docs, texts = long_docs
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in prefix_free.removal_digest(docs, 100).collect()}
    assert got == repeats(dict(enumerate(t or "" for t in texts)), 100)
    classes = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.similar_classes(docs, 3, 90).collect()}
    assert classes[1][0] > 240_000 and [classes[i][1] for i in range(5)] == [0, 1, 2, 0, 4]
    prints = {r.doc_id: r for r in imatch.fingerprint_edits(docs).collect()}
    assert prints[1].n_chars == len(texts[1]) and prints[0].fingerprint == prints[3].fingerprint
    q = len(texts[1]) // 4
    assert prints[1].edited_sha256 == hashlib.sha256(texts[1][:len(texts[1]) - q].encode()).hexdigest()      # the next text is empty


def test_token_files_of_shared_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(pfor, "FILE_FRAMES", 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_token_files(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def check_token_files(spark):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    texts = [f"text number {i}" for i in range(600)]
    ids = [None if i % 3 == 0 else 5 if i % 3 == 1 else i for i in range(600)]
    docs = make(spark, texts, ids)
    path = scratch_path(spark, "token-files")
    pfor.write_token_files(docs, path)
    found = pfor.read_token_files(spark, path)
    files = found.groupBy("file").agg(F.count_if(F.col("doc_id").isNull()).alias("none"), F.count_if(F.col("doc_id") == 5).alias("five")).collect()
    assert sum(f.none > 0 for f in files) > 1 and sum(f.five > 0 for f in files) > 1
    rows = sorted(pfor.token_file_digest(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = sorted(zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in texts)
    assert sorted(r.ids_crc32 for r in rows) == want


def test_sample_is_bounded_under_repeated_ids_and_labels(spark):
    docs = make(spark, [f"copy {i}" for i in range(500)] + ["other"], [1] * 500 + [2])
    labels = spark.createDataFrame([(1, 1)] * 300 + [(2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    for rows in (1, 5):
        got = toxicity.labelled_sample(docs, labels, "toxic", 9, 10, rows).collect()
        assert 1 <= len(got) <= 2 and len({r.doc_id for r in got}) == len(got)
    assert {(r.doc_id, r.y) for r in toxicity.labelled_sample(docs, labels, "toxic", 9, 10, 5).collect()} == {(1, 1), (2, 0)}


def naive_margin(model, text):
    """The network on one text, word by word."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    words, at = [], 0
    while at < len(low):
        if toxicity.IS_WORD[low[at]]:
            end = at
            while end < len(low) and toxicity.IS_WORD[low[end]]:
                end += 1
            words.append(low[at:end])
            at = end
        else:
            at += 1
    vectors = []
    for w in words:
        hashes, stems, _ = toxicity.hash_words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))
        vectors.append(model.words[toxicity.buckets_of(hashes, stems)[0]].sum(axis=0))
    vectors += [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    out = []
    for width, kernel in zip(toxicity.WIDTHS, model.filters):
        spots = range(len(words) + 1)                  # the last one is all padding
        out.append(np.max([sum(vectors[i + j] @ kernel[j] for j in range(width) if i + j < len(vectors)) for i in spots], axis=0))
    return np.maximum(np.concatenate(out) + model.bias, 0) @ model.out + model.out_bias


def test_network_equals_a_naive_convolution():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 0.3, (toxicity.BUCKETS + 1, toxicity.DIM)),
                           [rng.normal(0, 0.4, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS],
                           rng.normal(0, 0.1, 3 * toxicity.FILTERS), rng.normal(0, 0.3, 3 * toxicity.FILTERS))
    model.words[toxicity.BUCKETS] = 0
    texts = ["one", "Two words", "a b c d e, f G h's é", "x" * 40 + " y"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    hashes, stems, counts = toxicity.hash_words(np.concatenate(raw), np.append(0, np.cumsum([len(r) for r in raw])))
    got = model.pooled(toxicity.buckets_of(hashes, stems), counts, model.tables()) @ model.out + model.out_bias
    assert np.allclose(got, [naive_margin(model, t) for t in texts], atol=1e-4)      # whatever text comes next


def test_peaks_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(0, 0.3, (toxicity.BUCKETS + 1, toxicity.DIM)),
                           [rng.normal(0, 0.4, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], np.zeros(48), np.zeros(48))
    counts = np.array([5, 1, 700, 0, 33])
    padded, starts = toxicity.spaced(rng.integers(0, toxicity.BUCKETS, (counts.sum(), 2)), counts)
    stops = starts + counts + 1
    whole = toxicity.peaks(model, padded, starts, stops)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    parts = toxicity.peaks(model, padded, starts, stops)
    assert all((a == b).all() for x, y in zip(whole[:1], parts[:1]) for a, b in zip(x, y))
    assert all(np.allclose(a, b) for a, b in zip(whole[1], parts[1]))


def test_sizes_equal_naive_compression():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    good, bad = ([" ".join(word() for _ in range(300)).encode() for _ in range(30)] for _ in range(2))
    model = zquality.Model(zquality.build_dictionary(good), zquality.build_dictionary(bad))
    sizes = zquality.Sizes(model)
    for text in (good[0], b"".join(bad[:5]), b"x" * 5000, b"short"):
        blocks = [text[k:k + zquality.BLOCK] for k in range(0, len(text), zquality.BLOCK)]
        if len(blocks) > 1 and len(blocks[-1]) < zquality.BLOCK // 4:      # a short rest joins the block before
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        pairs = []
        for b in blocks:
            told = []
            for raw in (model.good, model.bad):
                held = zstandard.ZstdCompressionDict(raw)
                told.append(len(zstandard.ZstdCompressor(level=zquality.LEVEL, dict_data=held, write_content_size=False,
                                                         write_dict_id=False).compress(b)))
            pairs.append((*told, len(b)))
        gap = [(y - x) / (x + y) for x, y, _ in pairs]
        mean = sum(d * n for d, (_, _, n) in zip(gap, pairs)) / len(text)
        assert sizes.features(text)[:3] == pytest.approx([mean, min(gap), max(gap)], abs=0.02)
    assert zquality.build_dictionary([b"a few", b" bytes"]) == b"a few bytes"
