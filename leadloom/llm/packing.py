"""Concatenate and cut: all documents in one row of ids, cut into sequences of equal length.

Pass one encodes and writes each document's ids with the ids of its partition before
it. The partitions' totals, summed up in order, give every document its global offset,
and pass two cuts it at the multiples of the length. Only the last sequence is short;
nothing is shuffled but one total per partition.

A null text is an empty document; its end id is still packed. No documents: no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.bpe import default_tokenizer, encoder
from leadloom.llm.common import binary_array, offsets_of, ranges, text_chunks, texts
from leadloom.session import materialize

LENGTH = 1024


def encoded_partitions(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """Pass one, written: ``part``, ``place`` (ids of the partition before it), ``doc_id``, ``ids`` (unsigned 16 or 32 bits)."""
    vocabulary = tokenizer_path or default_tokenizer()

    def work(batches):
        part, place = TaskContext.get().partitionId(), 0
        for chunk in text_chunks(batches):
            ids, counts = encoder(vocabulary)(chunk.column("text").to_pylist())
            closed = np.full(len(ids) + len(counts), end_id, ids.dtype)
            keep = np.ones(len(closed), bool)
            ends = np.append(0, np.cumsum(counts + 1))
            keep[ends[1:] - 1] = False
            closed[keep] = ids
            size = closed.dtype.itemsize
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(chunk.num_rows, part)), pa.array(place + ends[:-1]), chunk.column("doc_id"),
                 pa.array(np.full(chunk.num_rows, size)), binary_array(closed.tobytes(), size * ends)],
                ["part", "place", "doc_id", "width", "ids"])
            place += int(ends[-1])

    return materialize(texts(docs).mapInArrow(work, "part long, place long, doc_id long, width long, ids binary"), "encoded")


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and the piece's
    ``ids`` (little-endian unsigned 32-bit)."""
    encoded = encoded_partitions(docs, tokenizer_path, end_id)
    size = (F.length("ids") / F.col("width")).cast("long")
    totals = encoded.groupBy("part").agg(F.max(F.col("place") + size).alias("total"))     # one row per partition
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    placed = encoded.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("place")).alias("at"), "width", F.col("ids").alias("text"))

    def cut(batches):
        for chunk in text_chunks(batches):
            at = chunk.column("at").to_numpy()
            width = int(chunk.column("width")[0].as_py())
            raw = chunk.column("text")
            ends = offsets_of(raw)
            ids = np.frombuffer(raw.buffers()[2], f"<u{width}", int(ends[-1] - ends[0]) // width, int(ends[0])).astype("<u4")
            counts = np.diff(ends) // width
            first = at // length
            pieces = (at + counts - 1) // length - first + 1
            doc = np.repeat(np.arange(len(at)), pieces)
            sequence = ranges(first, pieces)
            begin = np.maximum(sequence * length, at[doc])
            stop = np.minimum((sequence + 1) * length, (at + counts)[doc])
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id").take(pa.array(doc)), pa.array(begin - at[doc]), pa.array(stop - begin),
                 pa.array(counts[doc]), pa.array(sequence), pa.array(begin - sequence * length),
                 binary_array(ids.tobytes(), 4 * np.append(0, np.cumsum(stop - begin)))],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack_digest(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """``pack`` with the checksum of a piece in place of its ids."""
    return pack(docs, tokenizer_path, end_id, length).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
