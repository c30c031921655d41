"""A convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling.

Words are runs of letters, digits and non-ASCII bytes of the lower-cased (A-Z) text; a
word's hash picks its embedding. Filters of 1, 2 and 3 words slide over the whole text,
the largest value of each goes to a logistic output. Fitting uses a bounded sample of the
labelled rows; a fifth of it is kept out of the weights to calibrate the output and to
choose a threshold for each language (of fewer than 20 rows kept out, or of one label only, the
rows of the fit serve for that, and a language with fewer than ten rows of a label shares the common threshold). The language is guessed from the function words of
the text, never read from a column. Scores are shifted so that every language's
threshold lies at 0.7.

Defined results: null and empty texts are scored like a text without words. Without
labelled rows of both classes every score is the rate of label 1 (0 without labels).
Rows with null labels or null ids are not learned from. Texts may be of any length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import BYTE_TABLE, Spans, bytes_of, mix, prepare, text_chunks, texts, trim, word_spans

BUCKETS = 1 << 15          # hashed words
STEM = 4                   # a word is its own embedding plus that of its first bytes
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
SAMPLE_ROWS = 3_000        # of each label, at most; the only bound on what is learned from
PIECE = 1 << 14            # words that one step of the convolution works on
EPOCHS, BATCH, RATE = 6, 32, 0.08
LEAST_STEPS = 300          # few labelled rows are gone through more often
CUT = 0.7
#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are as with be this have from or by".split(),
    "de": "der die und das ist nicht mit den von zu ein eine auf für im dem sich auch es als".split(),
    "fr": "le les et des est une que dans pour qui sur pas par plus au avec il ce ne sont".split(),
    "es": "el los las y del que en un por con una su para es al lo como más pero sus".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def hash_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, hash of its first bytes, words per text)."""
    low = LOWER[data]
    starts, stops, counts = word_spans(low, ends, IS_WORD)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), counts
    spans = Spans(low, BYTE_TABLE)
    return spans.hash(starts, stops), spans.hash(starts, np.minimum(stops, starts + STEM)), counts


def buckets_of(hashes: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """[words, 2]: the buckets of a word and of its stem."""
    return np.stack([hashes % np.uint64(BUCKETS), mix(stems) % np.uint64(BUCKETS)], axis=1).astype(np.int64)


def _language_keys() -> tuple[np.ndarray, np.ndarray]:
    seen: dict[int, list[int]] = {}
    for k, words in enumerate(FUNCTION_WORDS.values()):
        raw = " ".join(words).encode()
        for h in hash_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist():
            seen.setdefault(h, []).append(k)
    single = sorted((h, k[0]) for h, k in seen.items() if len(k) == 1)
    return np.array([h for h, _ in single], np.uint64), np.array([k for _, k in single])


def guess_language(hashes: np.ndarray, counts: np.ndarray, keys=None) -> np.ndarray:
    """Index into LANGUAGES of each text: the most hits of words that one list alone has."""
    known, which = keys or _language_keys()
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[place] == hashes
    doc = np.repeat(np.arange(len(counts)), counts)[hit]
    votes = np.zeros((len(counts), len(FUNCTION_WORDS)), np.int64)
    np.add.at(votes, (doc, which[place[hit]]), 1)
    best = votes.argmax(axis=1)
    return np.where(votes.max(axis=1) > 0, best, len(FUNCTION_WORDS))


@dataclass
class Model:
    words: np.ndarray                     # [buckets + 1, dim]; the last row pads
    filters: list[np.ndarray]             # per width [width, dim, filters]
    bias: np.ndarray                      # [widths * filters]
    out: np.ndarray                       # [widths * filters]
    out_bias: float = 0.0
    slope: float = 1.0                    # calibration of the margin
    shift: list[float] = field(default_factory=lambda: [0.0] * len(LANGUAGES))     # thresholds moved to CUT
    constant: float | None = None

    def tables(self) -> list[list[np.ndarray]]:
        """What each hashed word adds to each place of each filter."""
        return [[(self.words @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]

    def pooled(self, buckets: np.ndarray, counts: np.ndarray, tables) -> np.ndarray:
        """The largest value of each filter in each text; texts are parted by padding."""
        padded, starts = spaced(buckets, counts)
        whole, stem = np.ascontiguousarray(padded[:, 0]), np.ascontiguousarray(padded[:, 1])
        n = len(padded) - max(WIDTHS) + 1
        # from each text's first word to the first place that is all padding: nothing of the next text
        bounds = np.stack([starts, starts + counts + 1], axis=1).ravel()
        out = []
        for width, parts in zip(WIDTHS, tables):
            z = parts[0][whole[:n]]
            z += parts[0][stem[:n]]
            for j in range(1, width):
                z += parts[j][whole[j:n + j]]
                z += parts[j][stem[j:n + j]]
            out.append(np.maximum.reduceat(z, bounds, axis=0)[::2])
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def score(self, hashes: np.ndarray, stems: np.ndarray, counts: np.ndarray, tables, keys) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        margin = self.pooled(buckets_of(hashes, stems), counts, tables) @ self.out + self.out_bias
        shift = np.array(self.shift)[guess_language(hashes, counts, keys)]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + shift, -30, 30)))


def spaced(buckets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another with padding behind each; (words, start of each text)."""
    gap = max(WIDTHS)
    starts = np.cumsum(counts + gap) - (counts + gap)
    out = np.full((int(counts.sum()) + gap * len(counts) + gap, 2), BUCKETS, np.int64)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(buckets))
    out[at] = buckets
    return out, starts


def peaks(model: Model, padded: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per width the place and value of each filter's largest output in each text, piece by piece: texts of any length."""
    n = len(padded) - max(WIDTHS) + 1
    best = [np.zeros((len(starts), FILTERS), np.int64) for _ in WIDTHS]
    value = [np.full((len(starts), FILTERS), -np.inf) for _ in WIDTHS]
    for low in range(0, n, PIECE):
        high = min(n, low + PIECE)
        vectors = model.words[padded[low:high + max(WIDTHS) - 1]].sum(axis=1)
        inside = np.flatnonzero((starts < high) & (stops > low))
        for i, (width, kernel) in enumerate(zip(WIDTHS, model.filters)):
            z = sum(vectors[j:high - low + j] @ kernel[j] for j in range(width))
            for d in inside.tolist():
                a, b = max(int(starts[d]), low), min(int(stops[d]), high)
                at = z[a - low:b - low].argmax(axis=0)
                top = z[a - low + at, np.arange(FILTERS)]
                more = top > value[i][d]
                value[i][d][more], best[i][d][more] = top[more], (a + at)[more]
    return best, value


def fit_network(docs: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient steps with a rate per weight; gradients flow through the largest places only."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.02, (BUCKETS + 1, DIM)), [rng.normal(0, 0.4, (w, DIM, FILTERS)) for w in WIDTHS],
                  np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.3, len(WIDTHS) * FILTERS))
    model.words[BUCKETS] = 0
    squares = {"words": np.full(BUCKETS + 1, 1e-2), "bias": np.full_like(model.bias, 1e-2), "out": np.full_like(model.out, 1e-2),
               "out_bias": 1e-2, **{w: np.full((w, DIM, FILTERS), 1e-2) for w in WIDTHS}}
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(docs)))):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            pick = order[k:k + BATCH]
            counts = np.array([len(docs[i]) for i in pick])
            padded, starts = spaced(np.concatenate([docs[i] for i in pick]), counts)
            best, value = peaks(model, padded, starts, starts + counts + 1)
            raw = np.concatenate(value, axis=1) + model.bias
            hidden = np.maximum(raw, 0)
            margin = hidden @ model.out + model.out_bias
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) * weight[pick] / len(pick)
            to_hidden = np.outer(error, model.out) * (raw > 0)

            def step(name, target, gradient):
                squares[name] += gradient ** 2
                target -= RATE * gradient / np.sqrt(squares[name])

            step("out", model.out, hidden.T @ error + 1e-4 * model.out)
            squares["out_bias"] += error.sum() ** 2
            model.out_bias -= RATE * error.sum() / np.sqrt(squares["out_bias"])
            step("bias", model.bias, to_hidden.sum(axis=0))
            rows, pushes = [], []
            for i, width in enumerate(WIDTHS):
                g = to_hidden[:, i * FILTERS:(i + 1) * FILTERS]
                kernel, at = model.filters[i], best[i]
                seen = np.stack([model.words[padded[at + j]].sum(axis=2) for j in range(width)])      # width, batch, filter, dim
                for j in range(width):
                    push = (g[:, :, None] * kernel[j].T[None]).reshape(-1, DIM)
                    for part in (0, 1):
                        rows.append(padded[at + j, part].ravel())
                        pushes.append(push)
                step(width, kernel, np.einsum("wbfd,bf->wdf", seen, g) + 1e-5 * kernel)
            rows, pushes = np.concatenate(rows), np.concatenate(pushes)
            live = (rows < BUCKETS) & (np.abs(pushes).sum(axis=1) > 0)
            touched, back = np.unique(rows[live], return_inverse=True)
            total = np.zeros((len(touched), DIM))
            np.add.at(total, back, pushes[live])
            squares["words"][touched] += (total ** 2).mean(axis=1)
            model.words[touched] -= RATE * total / np.sqrt(squares["words"][touched])[:, None]
    return model


def logistic_line(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit, by Newton steps."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + ridge * (beta - [1, 0])
        beta -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), gradient)
    return max(float(beta[0]), 1e-3), float(beta[1])


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The probability whose cut has the largest F1 of weighted rows, half way to the next lower one.

    Only cuts above which label 1 is at least as frequent as label 0 count; if there is none, nothing lies above.
    """
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    last = np.append(p[1:] != p[:-1], True)
    hits = np.cumsum(y * weight)
    above = np.cumsum(weight)
    f1 = np.where(last & (2 * hits >= above), 2 * hits / (above + hits[-1]), -1)
    k = int(f1.argmax())
    if f1[k] < 0:
        return float((1 + p[0]) / 2)
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2)


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def calibrate(model: Model, margin: np.ndarray, language: np.ndarray, labels: np.ndarray, rate: float) -> None:
    """Calibrate the margin; thresholds are chosen as if label 1 were as frequent as ``rate``."""
    weight = np.where(labels == 1, rate / max(labels.mean(), 1e-9), (1 - rate) / max(1 - labels.mean(), 1e-9))
    slope, offset = logistic_line(margin, labels)
    p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
    common = best_threshold(p, labels, weight) if labels.any() else 0.5
    model.slope = slope
    for k in range(len(LANGUAGES)):
        mine = language == k
        cut = best_threshold(p[mine], labels[mine], weight[mine]) if labels[mine].sum() >= 10 and (1 - labels[mine]).sum() >= 10 else common
        model.shift[k] = offset - logit(cut) + logit(CUT)


def held_out(fold: int, folds: int):
    return F.crc32(F.col("doc_id").cast("string")) % folds == fold


def learnable(labels: DataFrame, label: str, fold: int, folds: int) -> DataFrame:
    """``doc_id`` and label ``y`` of the labelled rows outside the fold."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(fold, folds))
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, folds: int, rows: int) -> DataFrame:
    """At most ``rows`` texts of each label outside the fold, chosen by the hash of their ids.

    A repeated label row counts once; of the rows that share an id, the text with the least digest stands for all.
    """
    marked = learnable(labels, label, fold, folds).distinct()
    draw = F.xxhash64(F.col("doc_id"), F.lit(17))
    parts = [marked.where(F.col("y") == k).orderBy(draw, "doc_id").limit(rows) for k in (0, 1)]
    # 2 * rows ids at most, so the texts stay where they are
    found = texts(docs).join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id")
    least = F.min(F.struct(F.md5("text").alias("digest"), "text"))
    return found.groupBy("doc_id", "y").agg(least.alias("one")).select("doc_id", F.col("one.text").alias("text"), "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 1, folds: int = 3,
        rows: int = SAMPLE_ROWS) -> Model:
    def work(batches):
        for chunk in text_chunks(batches):
            hashes, stems, counts = hash_words(*bytes_of(chunk.column("text")))
            ends = np.append(0, np.cumsum(counts))
            pairs = buckets_of(hashes, stems).astype(np.int32)
            mine = [pairs[a:b].ravel() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("y"), pa.array(guess_language(hashes, counts)),
                 pa.array(mine, pa.list_(pa.int32()))], ["doc_id", "y", "language", "words"])

    sample = labelled_sample(docs, labels, label, fold, folds, rows).mapInArrow(
        work, "doc_id long, y int, language long, words array<int>").toArrow().sort_by([("doc_id", "ascending")])
    y = sample.column("y").to_numpy().astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        blank = Model(np.zeros((1, DIM)), [], np.zeros(0), np.zeros(0))
        blank.constant = float(y.mean()) if len(y) else 0.0
        return blank
    words = [w.values.to_numpy().reshape(-1, 2) for w in sample.column("words")]
    language = sample.column("language").to_numpy()
    kept_out = np.array([zlib.crc32(b"calibrate:%d" % i) % 5 == 0 for i in sample.column("doc_id").to_pylist()])
    if kept_out.sum() < 20 or not 0 < y[~kept_out].mean() < 1 or not 0 < y[kept_out].mean() < 1:
        kept_out[:] = False
    train = np.flatnonzero(~kept_out)
    model = fit_network([words[i] for i in train], y[train])
    check = np.flatnonzero(kept_out) if kept_out.any() else train
    tables, margin = model.tables(), []
    for k in range(0, len(check), 64):
        pick = check[k:k + 64]
        margin.append(model.pooled(np.concatenate([words[i] for i in pick]), np.array([len(words[i]) for i in pick]), tables) @ model.out + model.out_bias)
    rate = learnable(labels, label, fold, folds).agg(F.avg("y")).first()[0]
    calibrate(model, np.concatenate(margin), language[check], y[check], rate)
    model.words = model.words.astype(np.float32)
    del sample, words
    trim()
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in one more column ``name``."""
    prepare(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model)      # 2 MB, whatever the data

    def work(batches):
        fitted = own.value
        tables = fitted.tables() if fitted.constant is None else None
        keys = _language_keys()
        for chunk in text_chunks(batches, limit=1 << 20):
            p = fitted.score(*hash_words(*bytes_of(chunk.column("text"))), tables, keys)
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(p)], [*chunk.schema.names, name])

    kept = [c for c in docs.columns if c != name]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept).mapInArrow(work, f"{fields}, `{name}` double")
