"""Shared helpers: bounded Arrow batches, text columns, numpy over concatenated bytes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 512 << 10    # text that one numpy step works on at a time; one longer text is a chunk of its own
BATCH_ROWS = 2_000
BATCH_BYTES = 2 << 20


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches between the JVM and Python (texts may be long), and this package on every executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        # Spark's own file server hands this file to the executors.
        path = os.path.join(tempfile.mkdtemp(prefix="leadloom-package-"), "leadloom-package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        whole = os.path.join(folder, name)
                        out.write(whole, os.path.relpath(whole, os.path.dirname(package)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)


def trim() -> None:
    """Give memory that a fit has freed back to the system: the driver lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):      # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and no other column, whatever else the input has."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def no_null(column: str):
    """A column that never holds a null, marked so for Arrow."""
    return F.coalesce(F.col(column), F.lit(""))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` text bytes each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def offsets_of(array: pa.Array) -> np.ndarray:
    """The n + 1 offsets of a string or binary array, as int64."""
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind, width = (np.int64, 8) if large else (np.int32, 4)
    if len(array) == 0:
        return np.zeros(1, np.int64)
    whole = np.frombuffer(array.buffers()[1], kind, count=len(array) + 1, offset=array.offset * width)
    return whole.astype(np.int64)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets from 0) of a string or binary array; nulls are empty."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    at = offsets_of(array)
    data = array.buffers()[2] if len(array) else None
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, count=int(at[-1] - at[0]), offset=int(at[0])), at - at[0]


def binary_array(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array over ``data`` with the given n + 1 offsets."""
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(ends, np.int32)), pa.py_buffer(raw)])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count numbers) for each pair, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def run_on_chunks(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
                  limit: int = CHUNK_BYTES) -> DataFrame:
    """``step`` on every bounded slice of ``df``."""
    def work(batches):
        for chunk in text_chunks(batches, limit=limit):
            out = step(chunk)
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(work, schema)


# ------------------------------------------------------------------ 64-bit hashes in numpy

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done = 1
            while done < size:           # doubling: out[done:2*done] = out[:done] * base**done
                step = np.uint64(pow(base, done, 1 << 64))
                more = min(done, size - done)
                np.multiply(out[:more], step, out=out[done:done + more])
                done += more
            _powers[name] = out
    return _powers["up"][:n], _powers["down"][:n]


class Spans:
    """Hashes of any spans of one array of small integers (bytes, code points, hashes).

    The hash depends on the values of the span alone, not on its place.
    """

    def __init__(self, values: np.ndarray, table: np.ndarray | None = None):
        n = len(values)
        up, self.down = _power(n + 1)
        spread = table[values] if table is not None else mix(values.astype(np.uint64) + _ODD)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(spread * up[:n], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _ODD)

    def rolling(self, width: int) -> np.ndarray:
        """Hashes of all spans of one width, by start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def code_table(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=np.uint64) * _ODD)


BYTE_TABLE = code_table(256)


def word_spans(data: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes, never across texts: (starts, ends, number of words per text)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    change = np.flatnonzero(np.diff(inside))
    starts, stops = change[::2], change[1::2]
    # a run that goes over the end of a text is cut there
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):
        cuts = np.unique(cuts)
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        starts, stops = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([stops, cuts]))
    return starts, stops, np.diff(np.searchsorted(starts, ends, side="left"))
