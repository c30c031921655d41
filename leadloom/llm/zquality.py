"""A quality classifier from compressed sizes.

Two zstandard dictionaries are built from text blocks labelled good and bad. A text is
cut into blocks, each block is compressed with both dictionaries, and the difference of
the sizes, divided by the block's length, tells which dictionary knows the block better.
A logistic fit turns the text's mean and extreme differences, and its compressed size per
byte (junk often repeats itself), into a calibrated score.

Defined results: null and empty texts are scored like a text without blocks. Without
labelled rows of both classes every score is the rate of label 1 (1 without labels). Half
of the sampled rows build the dictionaries and the others fit the score; where a half lacks
a label, all rows do both.
Rows with null labels or null ids are not learned from.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from leadloom.llm.common import prepare, text_chunks, trim
from leadloom.llm.toxicity import CUT, labelled_sample, logit

BLOCK = 2_048
DICTIONARY = 64 << 10
SAMPLE_ROWS = 3_000        # of each label, at most; the only bound on what is learned from
LEVEL = 3


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    offset: float = 0.0
    constant: float | None = None


class Sizes:
    """Compressed sizes of the blocks of a text."""

    def __init__(self, model: Model):
        # the dictionaries hold the raw text of the blocks they were built from
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_dict_id=False)
                   for d in (model.good, model.bad)]

    def features(self, text: bytes) -> list[float]:
        """Mean, lowest and highest difference; compressed size per byte: mean, lowest; log length."""
        n = len(text)
        if not n:
            return [0.0] * 8
        gap, rate, size = [], [], []
        for k in range(0, n, BLOCK):
            block = text[k:k + BLOCK]
            if k and len(block) < BLOCK // 4:      # a short rest joins the block before
                continue
            if n - k - BLOCK < BLOCK // 4:
                block = text[k:]
            good, bad = (len(c.compress(block)) for c in self.by)
            gap.append((bad - good) / (bad + good))
            rate.append(min(good, bad) / len(block))
            size.append(len(block))
        gap, rate, size = np.array(gap), np.array(rate), np.array(size)
        mean, low = float(gap @ size / size.sum()), float(gap.min())
        flat = float(rate @ size / size.sum())
        return [mean, low, float(gap.max()), flat, float(rate.min()), min(mean, 0.0), max(0.25 - float(rate.min()), 0.0), float(np.log1p(n))]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
    made.precompute_compress(level=LEVEL)
    return made


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples, their whole text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


def all_blocks(text: bytes) -> list[bytes]:
    return [text[k:k + BLOCK] for k in range(0, len(text), BLOCK)]


def fit_line(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic weights and offset, by Newton steps."""
    design = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(design.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty),
                               design.T @ (p - y) + penalty * beta)
        beta -= np.clip(step, -4, 4)
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 2, folds: int = 4,
        rows: int = SAMPLE_ROWS) -> Model:
    sample = labelled_sample(docs, labels, label, fold, folds, rows)

    def blocks(batches):
        for chunk in text_chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("y"),
                 pa.array([all_blocks(t.encode()) for t in chunk.column("text").to_pylist()], pa.list_(pa.binary()))],
                ["doc_id", "y", "blocks"])

    found = sample.mapInArrow(blocks, "doc_id long, y int, blocks array<binary>").toArrow().sort_by([("doc_id", "ascending")])
    y = found.column("y").to_numpy().astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 1.0)
    # a half builds the dictionaries, the other half, which they do not know, fits the score
    half = np.array([zlib.crc32(b"dictionary:%d" % i) % 2 == 0 for i in found.column("doc_id").to_pylist()])
    if min(y[half].sum(), (1 - y[half]).sum(), y[~half].sum(), (1 - y[~half]).sum()) < 1:
        half[:] = True
    texts_of = [[b for b in row.as_py()] for row in found.column("blocks")]
    model = Model(*(build_dictionary([b for i in np.flatnonzero(half & (y == k)) for b in texts_of[i] if b]) for k in (1, 0)))
    del found, texts_of
    trim()
    own = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        sizes = Sizes(own.value)
        for chunk in text_chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("y"),
                 pa.array([sizes.features(t.encode()) for t in chunk.column("text").to_pylist()], pa.list_(pa.float64()))],
                ["doc_id", "y", "x"])

    measured = sample.mapInArrow(measure, "doc_id long, y int, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    x = np.array(measured.column("x").to_pylist())
    used = ~half if not half.all() else half
    x, y = x[used], measured.column("y").to_numpy().astype(np.float64)[used]
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights, offset = fit_line((x - model.mean) / model.scale, y)
    p = 1 / (1 + np.exp(-np.clip((x - model.mean) / model.scale @ model.weights + offset, -30, 30)))
    model.offset = offset - logit(best_balance(p, y)) + logit(CUT)
    return model


def best_balance(p: np.ndarray, y: np.ndarray) -> float:
    """The probability whose cut has the largest mean of both classes' recalls."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    both = np.cumsum(y) / y.sum() - np.cumsum(1 - y) / (1 - y).sum()
    k = int(np.where(np.append(p[1:] != p[:-1], True), both, -2).argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in one more column ``name``."""
    prepare(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model)      # two dictionaries, whatever the data

    def work(batches):
        fitted = own.value
        sizes = Sizes(fitted) if fitted.constant is None else None
        for chunk in text_chunks(batches):
            if sizes is None:
                p = np.full(chunk.num_rows, fitted.constant)
            else:
                x = np.array([sizes.features((t or "").encode()) for t in chunk.column("text").to_pylist()])
                p = 1 / (1 + np.exp(-np.clip((x - fitted.mean) / fitted.scale @ fitted.weights + fitted.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(p)], [*chunk.schema.names, name])

    kept = [c for c in docs.columns if c != name]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept).mapInArrow(work, f"{fields}, `{name}` double")
