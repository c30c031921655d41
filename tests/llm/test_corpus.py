"""The corpus operators against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import (
    bpe_rounds, graph, graph_search, imatch, packing, parity_join, pfor, prefix_free, separators, toxicity, zquality)
from leadloom.llm.bpe import FlatEncoder, default_tokenizer
from leadloom.session import materialize
from tokenizers import Tokenizer

ODD = [None, "", " \n\t ", "one two", "ONE  two", "日本 語's text <|endoftext|> tail", "a" * 900, "it's we'LL they'll 'sh ''s\n\n x  \t",
       "é" * 130, "word " * 3000]


def make(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "k", i if i is None else -i, "x") for i, t in zip(ids, texts)]
    return materialize(spark.createDataFrame(
        rows, "doc_id long, text string, key string, node long, score string").repartition(3), "docs")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "Haus", "été", "año", "x", "tion", "42", "don't", "(so)"])
    made = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(40)]
    return make(spark, made + ODD + made[:5] + [made[0]])


def by_id(df):
    out = {}
    for r in df.collect():
        assert r.doc_id not in out
        out[r.doc_id] = r
    return out


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_flat_encoder_equals_library(tokenizer):
    rng = random.Random(1)
    letters = "ab sStTrevmld'' \n\n\t  1½2²é,.!-ª_ǰ ​"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [t or "" for t in ODD]
    for kind in (FlatEncoder, bpe_rounds.RoundsEncoder):
        code = kind(default_tokenizer())
        for _ in range(2):       # the second time from the cache
            ids, counts = code(made)
            ends = np.append(0, np.cumsum(counts))
            for i, t in enumerate(made):
                assert ids[ends[i]:ends[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_pfor_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 5000):
        for top in (1, 2, 300, 50_257, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[:n // 50] = top - 1
            for percentile in (0.0, 0.5, 0.95, 1.0):
                body, starts = pfor.pack_blocks(ids, percentile)
                assert (pfor.unpack_blocks(body, starts, n) == ids).all()


def test_token_files(spark, corpus, tokenizer):
    got, start = by_id(pfor.encode_to_files(corpus, end_id=2)), 0
    for i, t in sorted(texts_of(corpus).items()):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert pfor.encode_to_files(corpus.limit(0)).count() == 0
    odd = make(spark, ["b", "a", "a", "c"], [None, 4, 4, None])
    assert sorted((r.start, r.n_tokens) for r in pfor.encode_to_files(odd).collect()) == [(0, 2), (2, 2), (4, 2), (6, 2)]


def test_separators(spark, corpus, tmp_path):
    plain = Tokenizer.from_file(default_tokenizer())
    plain.encode_special_tokens = True
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts_of(corpus).items()}
    path = str(tmp_path / "flat")
    order = separators.write_flat_files(corpus, path, 50_256, docs_per_file=7)
    for block in (1, 3, 64, 1 << 20):        # documents across blocks
        found = order.join(separators.scan_separators(spark, path, 50_256, block_ids=block), ["stream", "doc_index"], "full")
        assert {r.doc_id: r.n_tokens + 1 for r in found.collect()} == want
    assert {r.doc_id: r.n_tokens for r in separators.count_tokens(corpus).collect()} == want
    assert separators.count_tokens(corpus.limit(0)).count() == 0
    raw = spark.createDataFrame([(bytearray(np.array([5, 9, 9, 6, 7, 8, 9, 1], "<u2").tobytes()),)], "b binary").coalesce(1)
    raw.select(F.col("b").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", "\x02\x00").text(str(tmp_path / "raw"))
    for block in (1, 2, 3, 100):
        got = sorted((r.doc_index, r.n_tokens, r.terminated) for r in
                     separators.scan_separators(spark, str(tmp_path / "raw"), 9, block_ids=block).collect())
        assert got == [(0, 1, True), (1, 0, True), (2, 3, True), (3, 2, False)]


def test_packing(spark, corpus, tokenizer):
    got, pieces, rows = texts_of(corpus), defaultdict(list), defaultdict(list)
    for r in packing.pack_digest(corpus, length=64).collect():
        pieces[r.doc_id].append(r)
        rows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(got)
    for i, t in got.items():
        ids, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    assert sorted(rows) == list(range(len(rows)))
    for k, spans in rows.items():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end == 64 or k == max(rows)
    assert packing.pack_digest(corpus.limit(0)).count() == 0


def test_round_trip(corpus, tokenizer):
    got, full = by_id(bpe_rounds.round_trip_digest(corpus)), by_id(bpe_rounds.encode_decode(corpus))
    for i, t in texts_of(corpus).items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        told = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert full[i].ids == ids and full[i].decoded == told
    assert bpe_rounds.round_trip_digest(corpus.limit(0)).count() == 0


def test_fingerprints(spark, corpus):
    rows, got = sorted(texts_of(corpus).items()), by_id(imatch.fingerprint_edits(corpus))
    prints = {}
    for k, (i, t) in enumerate(rows):
        q, after = len(t) // 4, rows[(k + 1) % len(rows)][1]
        edited = t[:len(t) - q] + after[:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == t:
            assert got[i].near_edited == 1
    assert imatch.fingerprint_edits(corpus.limit(0)).count() == 0
    one = make(spark, ["alone in the table"], [7])
    assert imatch.fingerprint_edits(one).first().near_next == 1
    far = make(spark, ["a b c d", "e f g h", "i j k l", None], [-5, 3_000_000_000, 2_000_000, None])
    told = {r.doc_id: r.edited_sha256 for r in imatch.fingerprint_edits(far).collect()}
    assert told[3_000_000_000] == hashlib.sha256(b"e f g ").hexdigest()      # the next one is the row without id and text


def test_fingerprints_of_hot_texts(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    hot = " ".join(f"hot{i}" for i in range(150))
    every_third = lambda text: [text(i) if i % 3 == 0 else fresh(150) for i in range(300)]
    for told in (lambda i: hot, lambda i: f"{hot} own{i}"):      # copies of one text, then a template
        got = by_id(imatch.fingerprint_edits(make(spark, every_third(told))))
        assert sum(got[i].near_edited > got[i].near_next for i in range(0, 300, 3)) >= 90      # the subsets are drawn
        assert np.mean([got[i].near_edited for i in range(0, 300, 3)]) > 0.3
    # copies count once: the lexicon is that of the distinct texts
    texts = every_third(lambda i: hot)
    assert imatch.fit_lexicon(make(spark, texts)) == imatch.fit_lexicon(make(spark, sorted(set(texts))))
    # few rows, nothing in the lexicon: other words are not alike, the same words are, and no words only if the texts are equal
    few = by_id(imatch.fingerprint_edits(make(spark, ["red green blue", "one two three", "two three one", " ", "", None, "\n"])))
    assert [few[i].near_next for i in range(7)] == [0, 1, 0, 0, 1, 0, 0]
    assert few[3].near_edited == 1 and few[0].fingerprint != few[1].fingerprint


def jaccard_classes(rows, words, percent):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[i] = {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (2, 80)])
def test_parity_join(spark, words, percent):
    rng, made = random.Random(3), []
    for n in (4, 8, 12, 30, 60, 200):
        for _ in range(3):
            base = [rng.choice("abcdefghijklmnop") for _ in range(n)]
            for v in range(10):
                x = list(base)
                for _ in range(rng.randint(0, max(1, n // 25))):
                    x[rng.randrange(n)] = rng.choice("qrst")
                made.append(" ".join(x).upper() if v % 3 == 0 else "\t ".join(x))
    docs = make(spark, made + ODD)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.similar_classes(docs, words, percent).collect()}
    assert got == jaccard_classes(texts_of(docs), words, percent)


def test_parity_join_odd_tables(spark):
    docs = make(spark, ["a b c d", "a b c d", "x y z w", "a b c d", None], [None, 9, 9, 4, 2])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in parity_join.similar_classes(docs, 3, 90).collect())
    assert got == [(0, 2, 0), (2, 0, 2), (4, 2, 4), (9, 2, 4), (9, 2, 4)]
    assert parity_join.similar_classes(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300) if i % 37] + [(1000, 2000 + i) for i in range(50)] + [(rng.randrange(9000, 9100), rng.randrange(9000, 9100)) for _ in range(60)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        if a != b:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: top(i) for i in up}


def repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            w = raw[k:k + length]
            if w in seen:
                gone[k:k + length] = True
            seen.add(w)
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("length, dictionary", [(100, 1 << 20), (100, 3000), (30, 1 << 20)])
def test_prefix_free(spark, monkeypatch, length, dictionary):
    rng = random.Random(length)
    noise = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [noise(n) for n in (99, 100, 101, 150, 400)]
    made = ["".join(noise(rng.randint(0, 200)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randint(0, 5)))
            for _ in range(60)]
    docs = make(spark, made + ODD + made[:4] + ["ab" * 300, "a" * 99], [3 * i - 40 for i in range(60 + len(ODD) + 6)])
    monkeypatch.setattr(prefix_free, "DICTIONARY_BYTES", dictionary)
    monkeypatch.setattr(prefix_free, "PIECE", 1000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in prefix_free.removal_digest(docs, length).collect()}
    assert got == repeats(texts_of(docs), length)


def test_prefix_free_odd_tables(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(300))
    docs = make(spark, [long, long, long, None], [None, 5, 5, None])
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in prefix_free.removal_digest(docs).collect())
    # the row without id comes first; the equal rows with one id are one document
    assert [g[:2] for g in got] == [(0, 0), (0, 300), (5, 300), (5, 300)] and got[2] == got[3] == (5, 300, 300)
    assert prefix_free.removal_digest(docs.limit(0)).count() == 0


def test_graph_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:420] = x[7]                                   # many copies of one vector
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(1000, None, "c"), (1100, [0.0] * 16, "c"), (1200, [float("nan")] * 16, "c"), (1300, [None, 1.0], "c"), (1400, [1.0, 2.0], "c"),
             (None, [1.0] * 16, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = defaultdict(list)
    for r in graph_search.nearest(df, shard_rows=200).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    hits = 0
    for q in range(0, 600, 100):
        near = np.where(np.arange(600) == q, np.inf, d[q])
        want = np.lexsort((np.arange(600), near))[:10]
        told = sorted(got[q])
        assert [t[0] for t in told] == list(range(1, 11))
        assert np.allclose([t[2] for t in told], near[[t[1] for t in told]], rtol=1e-14)
        hits += len(set(want.tolist()) & {t[1] for t in told})
    assert hits >= 54 and set(got) == set(range(0, 600, 100))
    assert [t[1] for t in sorted(got[300])] == [7, *range(301, 310)]          # ties by id
    assert graph_search.nearest(df.limit(0)).count() == 0


def classified(spark, label):
    rng = random.Random(9)
    noise = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    docs, marks = [], []
    for i in range(600):
        words = [noise() for _ in range(rng.randint(5, 80))]
        y = int(rng.random() < 0.3)
        if y and label == "toxic":
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zzscum", "zzidiot"]) + rng.choice(["", "s"]))
        if not y and label == "quality":
            words = [w.upper() + "!!" for w in words]
        docs.append(" ".join(words))
        marks.append((i, y, y))
    return make(spark, docs + ODD), spark.createDataFrame(marks + [(None, 1, 1), (3000, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, fold, folds", [(toxicity, "toxic", 1, 3), (zquality, "quality", 2, 4)])
def test_classifier(spark, module, label, fold, folds):
    docs, labels = classified(spark, label)
    model = module.fit(docs, labels, label, fold, folds)
    scored = module.score(docs, model, "p").join(labels, "doc_id").where(toxicity.held_out(fold, folds)).collect()
    right = sum((r.p >= 0.7) == (r[label] == 1) for r in scored)
    assert len(scored) > 100 and right / len(scored) > 0.9
    every = module.score(docs, model, "p").collect()
    assert len(every) == 610 and all(0 <= r.p <= 1 for r in every) and all(r.score == "x" for r in every)
    # other values of the columns that a score must not use leave it as it was
    moved = module.score(docs.withColumn("doc_id", -F.col("doc_id")).withColumn("key", F.lit("z")), model, "p")
    assert sorted(r.p for r in moved.collect()) == sorted(r.p for r in every)
    for some in (labels.limit(0), labels.where(f"{label} = 1")):
        flat = module.fit(docs, some, label, fold, folds)
        assert len({r.p for r in module.score(docs, flat, "p").collect()}) == 1
    assert module.score(docs.limit(0), model, "p").count() == 0


def test_thresholds_leave_the_rest_alone():
    p, even = np.array([0.9, 0.8, 0.3, 0.2, 0.1]), np.ones(5)
    assert 0.3 < toxicity.best_threshold(p, np.array([1.0, 1, 0, 0, 0]), even) < 0.8
    # a ranking that says nothing marks nothing, instead of everything
    assert toxicity.best_threshold(p, np.array([0.0, 0, 0, 0, 1]), even) > 0.9
    assert toxicity.best_threshold(np.full(5, 0.5), np.array([0.0, 0, 1, 0, 0]), even) > 0.5
