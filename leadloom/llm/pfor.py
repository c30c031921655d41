"""Token-id files of patched frame-of-reference blocks.

A file is a row of frames, each closed by one line feed. A frame holds some whole
documents (about a chunk of text):

    "PFOR", block length u32, ids u64, documents u32, blocks u32, body bytes u64,
    start of each block in the body u32 [blocks],
    doc_id i64 [documents], ids of each document u32 [documents], body

and a block, of 256 ids: its minimum u32, packed width u8, bytes per exception u8,
exceptions u16, the packed low bits, the positions u8 and high parts of the exceptions.
The width is the bit length of the given percentile of (id - minimum); what does not
fit keeps its low bits in place and its high part in the exception list.

Frames are written by Spark's text writer (a row's bytes and a line feed) and read as
binary files, so any store that Spark knows will do, and the write is committed as a
whole. Files follow each other in ``doc_id`` order (nulls first, ties by text).
Null text is an empty document; it still has its end id. No documents: no frames.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.llm.bpe import default_tokenizer, encoder
from leadloom.llm.common import run_on_chunks, texts
from leadloom.session import materialize, scratch_path

BLOCK = 256
PERCENTILE = 0.95
HEAD = struct.Struct("<4sIQIIQ")
BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("high_bytes", "u1"), ("n_high", "<u2")])


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray]:
    """(body bytes, start of each block). All blocks are full; the last repeats its last id."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint32)
    full = np.empty(n_blocks * BLOCK, np.uint32)
    full[:len(ids)] = ids
    full[len(ids):] = ids[-1]
    full = full.reshape(n_blocks, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    rank = int(percentile * (BLOCK - 1))
    at_rank = np.partition(rest, rank, axis=1)[:, rank]
    bits = lambda x: np.frexp(x.astype(np.float64))[1]
    width = bits(at_rank)
    high = rest >> width[:, None].astype(np.uint32)
    n_high = np.count_nonzero(high, axis=1)
    high_bytes = np.where(n_high > 0, (bits(high.max(axis=1)) + 7) // 8, 0)
    size = BLOCK_HEAD.itemsize + width * (BLOCK // 8) + n_high * (1 + high_bytes)
    starts = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    heads = np.empty(n_blocks, BLOCK_HEAD)
    heads["low"], heads["width"], heads["high_bytes"], heads["n_high"] = low, width, high_bytes, n_high
    body[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)] = heads.view(np.uint8).reshape(n_blocks, -1)
    for w in np.unique(width):
        if w == 0:
            continue
        mine = np.flatnonzero(width == w)
        packed = np.packbits(np.unpackbits(rest[mine].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :w]
                             .reshape(len(mine), -1), axis=1, bitorder="little")
        body[(starts[mine] + BLOCK_HEAD.itemsize)[:, None] + np.arange(packed.shape[1])] = packed
    block, slot = np.nonzero(high)
    nth = np.arange(len(block)) - (np.cumsum(n_high) - n_high)[block]
    lists = starts + BLOCK_HEAD.itemsize + width * (BLOCK // 8)
    body[lists[block] + nth] = slot
    values = high[block, slot]
    for b in range(4):
        has = high_bytes[block] > b
        body[(lists + n_high)[block[has]] + nth[has] * high_bytes[block[has]] + b] = values[has] >> (8 * b) & 255
    return body, starts.astype(np.uint32)


def unpack_blocks(body: np.ndarray, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of the blocks that start at ``starts``; all blocks are independent."""
    starts = starts.astype(np.int64)
    n_blocks = len(starts)
    if not n_blocks:
        return np.zeros(0, np.uint32)
    heads = body[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)].copy().view(BLOCK_HEAD).reshape(-1)
    width, n_high = heads["width"].astype(np.int64), heads["n_high"].astype(np.int64)
    high_bytes = heads["high_bytes"].astype(np.int64)
    out = np.zeros((n_blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w == 0:
            continue
        mine = np.flatnonzero(width == w)
        packed = body[(starts[mine] + BLOCK_HEAD.itemsize)[:, None] + np.arange(w * (BLOCK // 8))]
        flags = np.unpackbits(packed, axis=1, bitorder="little").reshape(-1, w)
        four = np.zeros((len(flags), 32), np.uint8)
        four[:, :w] = flags
        out[mine] = np.packbits(four, axis=1, bitorder="little").view(np.uint32).reshape(len(mine), BLOCK)
    block = np.repeat(np.arange(n_blocks), n_high)
    nth = np.arange(len(block)) - (np.cumsum(n_high) - n_high)[block]
    lists = starts + BLOCK_HEAD.itemsize + width * (BLOCK // 8)
    slot = body[lists[block] + nth]
    values = np.zeros(len(block), np.uint32)
    for b in range(4):
        has = high_bytes[block] > b
        values[has] |= body[(lists + n_high)[block[has]] + nth[has] * high_bytes[block[has]] + b].astype(np.uint32) << np.uint32(8 * b)
    np.add.at(out, (block, slot), values << width[block].astype(np.uint32))
    return (out + heads["low"][:, None]).reshape(-1)[:n_ids]


def frame(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    body, starts = pack_blocks(ids, percentile)
    return b"".join([HEAD.pack(b"PFOR", BLOCK, len(ids), len(doc_ids), len(starts), len(body)), starts.astype("<u4").tobytes(),
                     doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), body.tobytes()])


def frames(content: bytes):
    """(doc_ids, ids per document, all ids) of each frame of a file."""
    at, view = 0, np.frombuffer(content, np.uint8)
    while at < len(content):
        magic, block, n_ids, n_docs, n_blocks, size = HEAD.unpack_from(content, at)
        if magic != b"PFOR" or block != BLOCK:
            raise ValueError("not a frame")
        at += HEAD.size
        starts = np.frombuffer(content, "<u4", n_blocks, at)
        at += 4 * n_blocks
        doc_ids = np.frombuffer(content, "<i8", n_docs, at)
        at += 8 * n_docs
        counts = np.frombuffer(content, "<u4", n_docs, at).astype(np.int64)
        at += 4 * n_docs
        yield doc_ids, counts, unpack_blocks(view[at:at + size], starts, n_ids)
        at += size
        if content[at:at + 1] != b"\n":
            raise ValueError("a frame is cut")
        at += 1


FILE_FRAMES = 64       # frames of about half a megabyte of text each, or of one longer text
NO_ID = -(1 << 63)     # stands for a null doc_id inside a file


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2,
                      percentile: float = PERCENTILE) -> None:
    """Encode every text, close it with ``end_id``, write the files in ``doc_id`` order.

    Rows that share an id, or have none, follow each other in the order of the scan and are dealt
    over partitions like all others. A file has at most ``FILE_FRAMES`` frames.
    """
    vocabulary = tokenizer_path or default_tokenizer()
    numbered = texts(docs).withColumn("tie", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def step(chunk: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder(vocabulary)(chunk.column("text").to_pylist())
        with_end = np.full(len(ids) + len(counts), end_id, np.uint32)
        keep = np.ones(len(with_end), bool)
        keep[np.cumsum(counts + 1) - 1] = False
        with_end[keep] = ids
        doc_ids = chunk.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.array([frame(doc_ids, counts + 1, with_end, percentile)], pa.binary())], ["frame"])

    run_on_chunks(ordered, step, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_FRAMES).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` (numbered in order), ``place`` (ids of the file before it), ``doc_id``, ``ids`` (little-endian unsigned 32-bit)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part, piece = (F.regexp_extract("path", p, 1).cast("long") for p in (r"part-(\d+)[^/]*$", r"-c(\d+)[^/]*$"))

    def work(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                place = 0
                for doc_ids, counts, ids in frames(content.as_py()):
                    ends = np.append(0, np.cumsum(counts))
                    raw = ids.astype("<u4").tobytes()
                    whole = pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(counts), file)), pa.array(place + ends[:-1]),
                        pa.array(doc_ids, mask=doc_ids == NO_ID),
                        pa.array([raw[4 * a:4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()),
                    ], ["file", "place", "doc_id", "ids"])
                    yield whole
                    place += int(ends[-1])

    return files.select((F.call_function("shiftleft", part, F.lit(24)) + piece).alias("file"), "content").mapInArrow(work, "file long, place long, doc_id long, ids binary")


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` of the files at ``path``."""
    found = materialize(read_token_files(spark, path).select(
        "file", "place", "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32")), "token-digest")
    # one row per file
    files = found.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    before = files.select("file", (F.sum("size").over(Window.orderBy("file")) - F.col("size")).alias("before"))
    return found.join(before, "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_files(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to fresh token files in the shared folder and describe what the files hold."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return token_file_digest(spark, path)
