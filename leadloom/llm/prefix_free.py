"""Removal of repeated passages by prefix-free parsing of the corpus.

The corpus is the documents' bytes in (id, place) order. Rolling hashes of short byte
strings are the triggers: in every window of ``length`` bytes the least one is the
window's trigger, so equal windows have equal triggers. Consecutive windows with one
trigger make a phrase, and phrases overlap by length - 1 bytes, so that every window
lies in exactly one phrase and no match crosses phrases.

The parse is the row of phrases in corpus order, the dictionary its distinct phrases.
A phrase whose trigger occurs once cannot hold a repeated window. A phrase that came
before in the parse is repeated as a whole. What is left are phrases that share a
trigger but differ somewhere: their text is put into a dictionary per task, whose suffix
array (prefix doubling, to the depth of ``length`` bytes) brings equal windows together;
with the parse's order the first of each class is known, and the classes of all tasks
meet by their hash. Firsts are chosen within a task before anything is shuffled, so one
hot phrase or window arrives once per task.

Every byte covered by a window that also starts earlier is removed; windows are judged
on the input. Defined results: null text is empty; texts shorter than ``length`` keep
all bytes; rows of one id follow each other by the hash of their text (rows equal in id
and text are one document, returned once per row); null ids come first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from leadloom.llm.common import BYTE_TABLE, Spans, bytes_of, offsets_of, prepare, ranges, text_chunks
from leadloom.llm.graph import discard, written

LENGTH = 100
TRIGGER = 40               # bytes of a trigger; long ones seldom repeat by chance, short ones make fewer phrases
PIECE = 1 << 20            # longer texts are parsed in overlapping pieces
LOCAL_PHRASES = 400_000    # phrases among which a task looks for firsts before it passes them on
DICTIONARY_BYTES = 1 << 20
NO_ID = -(1 << 63)


def parse(data: np.ndarray, ends: np.ndarray, length: int, trigger: int = TRIGGER):
    """Phrases of the texts: (text, start in all bytes, windows, trigger hash, phrase hash)."""
    sizes = np.diff(ends)
    windows = np.maximum(sizes - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not windows.any():
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    spans = Spans(data, BYTE_TABLE)
    trigger = min(trigger, length)
    hashes = spans.rolling(trigger)
    width = length - trigger + 1
    n = len(hashes)
    keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width + width, ~np.uint64(0))
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    text = np.repeat(np.arange(len(sizes)), windows)
    at = ranges(ends[:-1], windows)
    least = (np.minimum(behind[at], ahead[at + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])))
    count = np.diff(np.append(begins, len(at)))
    start = at[begins]
    return text[begins], start, count, hashes[least[begins]], spans.hash(start, start + count - 1 + length)


def pieces(data: np.ndarray, ends: np.ndarray, length: int):
    """(text, offset, bytes, ends): whole short texts together, long ones in overlapping pieces."""
    sizes = np.diff(ends)
    for k in np.flatnonzero(sizes > PIECE).tolist():
        for off in range(0, int(sizes[k]) - length + 1, PIECE):
            part = data[ends[k] + off:min(ends[k] + off + PIECE + length - 1, ends[k + 1])]
            yield np.array([k]), off, part, np.array([0, len(part)])
    if (sizes <= PIECE).all():
        yield np.arange(len(sizes)), 0, data, ends
    elif (sizes <= PIECE).any():
        short = np.flatnonzero(sizes <= PIECE)
        yield short, 0, data[ranges(ends[short], sizes[short])], np.append(0, np.cumsum(sizes[short]))


def first_of(keys: list[np.ndarray], doc: np.ndarray, part: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mask: the earliest place of each key, in every row that tells it."""
    order = np.lexsort((at, part, doc, *keys))
    if not len(order):
        return np.zeros(0, bool)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = (doc[order] == doc[lead]) & (part[order] == part[lead]) & (at[order] == at[lead])
    return out


def runs(doc, part, at, count):
    """Rows that continue each other, joined: (doc, part, at, count) in order."""
    if not len(at):
        return doc, part, at, count
    order = np.lexsort((at, part, doc))
    doc, part, at, count = doc[order], part[order], at[order], count[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (at[1:] > at[:-1] + count[:-1]))
    begins = np.flatnonzero(new)
    stop = np.maximum.reduceat(at + count, begins)
    return doc[begins], part[begins], at[begins], stop - at[begins]


ROW = "done boolean, key long, phrase long, doc long, part int, at long, count long"


def _rows(done: bool, key, phrase, doc, part, at, count) -> pa.RecordBatch:
    sign = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), done)), sign(key), sign(phrase), pa.array(doc), pa.array(part.astype(np.int32)),
         pa.array(at), pa.array(count)], [f.split(" ")[0] for f in ROW.split(", ")])


def _settled(doc, part, at, count) -> pa.RecordBatch:
    """Windows known to be repeated; their key is their own place, so they spread evenly."""
    doc, part, at, count = runs(doc, part, at, count)
    own = Spans(np.stack([doc, part.astype(np.int64), at], axis=1).ravel()).hash(3 * np.arange(len(at)), 3 * np.arange(len(at)) + 3)
    return _rows(True, own, np.zeros(len(at), np.int64), doc, part, at, count)


def parse_rows(rows: DataFrame, length: int) -> DataFrame:
    """The parse: a task's first occurrence of each phrase, and what is settled within the task."""
    def flush(held):
        doc, part, at, count, key, phrase = (np.concatenate(c) for c in zip(*held))
        first = first_of([phrase, key], doc, part, at)
        yield _rows(False, key[first], phrase[first], doc[first], part[first], at[first], count[first])
        if not first.all():
            yield _settled(doc[~first], part[~first], at[~first], count[~first])

    def work(batches):
        held, size = [], 0
        for chunk in text_chunks(batches):
            doc, part = (chunk.column(c).to_numpy() for c in ("doc", "part"))
            for which, off, data, ends in pieces(*bytes_of(chunk.column("text")), length):
                text, start, count, key, phrase = parse(data, ends, length)
                if len(text):
                    held.append((doc[which[text]], part[which[text]].astype(np.int64), start - ends[text] + off, count, key, phrase))
                    size += len(text)
            if size >= LOCAL_PHRASES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return rows.mapInArrow(work, ROW)


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """The rank of every suffix by its first ``depth`` bytes; ends of the data rank lowest. Equal prefixes share a rank."""
    rank, size = data.astype(np.int64) + 1, 1
    n = len(data)

    def doubled(step: int) -> np.ndarray:
        after = np.zeros(n, np.int64)
        if step < n:
            after[:n - step] = rank[step:]
        return np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1

    while size * 2 <= depth:
        rank, size = doubled(size), size * 2
    return doubled(depth - size) if size < depth else rank


def window_rows(edges: DataFrame, length: int) -> DataFrame:
    """From documents with their open phrases (``spots``): a task's first window of every class of its dictionary."""
    def flush(held):
        data = np.concatenate([h[0] for h in held])
        doc, part, at, count = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3, 4))
        begins = np.cumsum(count + length - 1) - (count + length - 1)
        place = ranges(begins, count)
        ranks = suffix_ranks(data, length)[place]
        own = np.repeat(np.arange(len(at)), count)
        spot = at[own] + place - begins[own]
        first = first_of([ranks], doc[own], part[own], spot)
        key = Spans(data, BYTE_TABLE).hash(place[first], place[first] + length)
        yield _rows(False, key, np.zeros(int(first.sum()), np.int64), doc[own][first], part[own][first], spot[first], np.ones(int(first.sum()), np.int64))
        if not first.all():
            yield _settled(doc[own][~first], part[own][~first], spot[~first], np.ones(int((~first).sum()), np.int64))

    def work(batches):
        held, size = [], 0
        for chunk in text_chunks(batches):
            data, ends = bytes_of(chunk.column("text"))
            doc, part = (chunk.column(c).to_numpy() for c in ("doc", "part"))
            spots = chunk.column("spots")
            cut = offsets_of(spots)
            inner = spots.flatten()
            at, count = (inner.field(i).to_numpy() for i in (0, 1))
            own = np.repeat(np.arange(chunk.num_rows), np.diff(cut))
            begin = 0
            while begin < len(at):       # a dictionary of bounded size at a time
                upto = np.cumsum(count[begin:] + length - 1)
                take = max(1, int(np.searchsorted(upto, DICTIONARY_BYTES, side="right")))
                one = slice(begin, begin + take)
                held.append((data[ranges(ends[own[one]] + at[one], count[one] + length - 1)], doc[own[one]],
                             part[own[one]].astype(np.int64), at[one], count[one]))
                size += int(upto[take - 1])
                begin += take
                if size >= DICTIONARY_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return edges.select("doc", "part", "text", "spots").mapInArrow(work, ROW)


def keyed_rows(docs: DataFrame, *more) -> DataFrame:
    """``doc`` (null id: least), ``part`` (hash of the text), ``text``: what names a document, and its text."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.shiftrightunsigned(F.xxhash64(text), 33).cast("int").alias("part"), text.alias("text"), *more)


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, str]:
    """``doc``, ``part``, ``at``, ``count``: runs of windows that also start earlier; with the path of what they read."""
    rows = keyed_rows(docs)
    trigger = Window.partitionBy("done", "key")
    phrase = Window.partitionBy("done", "key", "phrase").orderBy("doc", "part", "at")
    met = (parse_rows(rows, length)
           .withColumn("nth", F.rank().over(phrase))
           .withColumn("low", F.min("phrase").over(trigger)).withColumn("high", F.max("phrase").over(trigger)))
    # "done" and later occurrences are settled; a first one is open if its trigger has other phrases
    found, path = written(
        met.where(F.col("done") | (F.col("nth") > 1) | (F.col("low") != F.col("high")))
        .select((F.col("done") | (F.col("nth") > 1)).alias("done"), "doc", "part", "at", "count"), "phrases")
    spots = (found.where("not done").groupBy("doc", "part")
             .agg(F.collect_list(F.struct("at", "count")).alias("spots")))          # at most a document's phrases
    windows = window_rows(rows.join(spots, ["doc", "part"]), length)
    later = windows.withColumn("nth", F.rank().over(
        Window.partitionBy("done", "key").orderBy("doc", "part", "at"))).where("done or nth > 1")
    return found.where("done").select("doc", "part", "at", "count").unionAll(later.select("doc", "part", "at", "count")), path


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Every row with ``n_bytes``, ``spans`` (removed runs: start, length), ``kept`` (the other bytes; with ``as_text``
    as text without characters that were cut) and ``carried``, a struct of the columns ``keep``."""
    carried = F.struct(*[F.col(f"`{c}`") for c in keep] if keep else [F.lit(True).alias("none")]).alias("carried")
    windows, path = repeated_windows(docs, length)
    # written, so that the texts are not shuffled twice at once
    marks, _ = written(windows.groupBy("doc", "part").agg(F.collect_list(F.struct("at", "count")).alias("marks")), "marks")
    discard(docs.sparkSession, path)
    joined = keyed_rows(docs, carried).join(marks, ["doc", "part"], "left")

    def work(batches):
        for chunk in text_chunks(batches):
            data, ends = bytes_of(chunk.column("text"))
            marks = chunk.column("marks")
            cut = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
            inner = marks.flatten()
            at, count = (inner.field(i).to_numpy() for i in (0, 1))
            own = np.repeat(np.arange(chunk.num_rows), np.diff(cut))
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, ends[own] + at, 1)
            np.add.at(edge, ends[own] + at + count + length - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            whole = np.append(0, np.cumsum(~gone))[ends]
            cuts = list(zip(whole[:-1].tolist(), whole[1:].tolist()))
            kept = data[~gone].tobytes()
            change = np.zeros(len(data) + 1, bool)
            change[:-1][1:] = gone[1:] != gone[:-1]
            change[ends] = True
            points = np.unique(np.append(np.flatnonzero(change), len(data)))
            begins = points[:-1][gone[points[:-1]]] if len(data) else points[:0]
            stops = points[1:][gone[points[:-1]]] if len(data) else points[:0]
            doc_of = np.searchsorted(ends, begins, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(begins - ends[doc_of]), pa.array(stops - begins)], ["start", "length"])
            offsets = np.searchsorted(doc_of, np.arange(chunk.num_rows + 1), side="left")
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc"), chunk.column("carried"), pa.array(np.diff(ends)),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
                 pa.array([kept[a:b].decode("utf-8", "ignore") for a, b in cuts], pa.string()) if as_text else
                 pa.array([kept[a:b] for a, b in cuts], pa.binary())],
                ["doc", "carried", "n_bytes", "spans", "kept"])

    held = joined.select("doc", "text", "marks", "carried")
    schema = StructType([StructField("doc", LongType()), held.schema["carried"], StructField("n_bytes", LongType()),
                         StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType())]))),
                         StructField("kept", StringType() if as_text else BinaryType())])
    return held.mapInArrow(work, schema).select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "carried", "n_bytes", "spans", "kept")


def removal_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return remove_repeats(docs, length).select(
        "doc_id", "n_bytes", F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"]), F.lit(0)).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
