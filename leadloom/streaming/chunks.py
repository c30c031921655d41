"""Append and score on Structured Streaming: each micro-batch is a chunk.

A checkpoint remembers which input files are done, so a stopped job resumes where
it was. Every batch writes to a path of its own number with overwrite, so a
replayed batch replaces its output instead of repeating it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from leadloom.functions.fixed import MISSING_TOKENS
from leadloom.operators.project import consolidate_missing
from leadloom.plans.binary_model import BinaryModel
from leadloom.plans.jobs import append_job, score_job
from leadloom.sources.delimited import checked_fields, csv_schema, decoded, latin_options
from leadloom.sources.sinks import OutputName, write_delimited


def read_chunks(spark: SparkSession, folder: str, names: Sequence[str], delimiter: str = "\t",
                has_header: bool = True, files_per_chunk: int = 1, safe: bool = False, malformed: str = "error") -> DataFrame:
    """A stream of delimited files, ``files_per_chunk`` at a time, all fields text.

    Records that are not UTF-8 are an error, or latin-1 with ``safe``. Blank lines are dropped;
    a record with too few fields is filled up with nulls. A record with more fields than ``names``
    is an error, as in :func:`read_delimited`; with ``malformed="PERMISSIVE"`` they are left out.
    """
    lines = (spark.readStream.schema(csv_schema(names, malformed)).options(**latin_options(delimiter, malformed))
             .options(header=str(has_header).lower(), maxFilesPerTrigger=str(files_per_chunk)).csv(folder))
    return decoded(checked_fields(lines, names, delimiter, malformed), names, safe)


def run_chunks(stream: DataFrame, work: Callable[[DataFrame], DataFrame], output: OutputName, checkpoint: str,
               delimiter: str = "\t", missing_values: Iterable[str] | None = None, timeout: int | None = None) -> int:
    """Run ``work`` on every available chunk and write each to its numbered output.

    Returns the number of micro-batches of this run. ``output`` must be numbered:
    one file per chunk is what makes a replay idempotent.
    """
    if not output.numbered:
        raise ValueError("a chunked stream needs a numbered output, e.g. out_{0:04d}")
    tokens = {*MISSING_TOKENS, *(missing_values or ())}

    written: set[int] = set()

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            written.add(number)
        write_delimited(work(consolidate_missing(batch, tokens)), output.path(number), delimiter, "overwrite")

    query = (stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    if not query.awaitTermination(timeout) if timeout else query.awaitTermination():
        query.stop()
        raise TimeoutError("the stream did not finish in time")
    return len(written)


def append_chunks(stream: DataFrame, providers: Sequence, output: OutputName, checkpoint: str, **options) -> int:
    return run_chunks(stream, lambda batch: append_job(batch, providers), output, checkpoint, **options)


def score_chunks(stream: DataFrame, model: BinaryModel, output: OutputName, checkpoint: str, *,
                 keep: dict | None = None, **options) -> int:
    return run_chunks(stream, lambda batch: score_job(batch, model, **(keep or {})), output, checkpoint, **options)
