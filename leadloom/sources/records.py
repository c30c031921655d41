"""Delimited records that may hold line breaks in quotes, cut from split files in parallel.

A line break ends a record only outside quotes, and whether a split begins inside quotes
depends on all text before it. So the lines are looked at twice. The first scan tells, per
split of a file, for both cases - the split begins outside or inside quotes - where it ends
and how many records begin in it: a row of numbers per split. A prefix scan over a file's
splits then gives every split its true beginning and the number of records before it. The
second scan cuts the records; only those that lie across splits are put together by a shuffle.

Record numbers come from the same counts: they follow the order of the files and of the
records in them, however the files are split.

Files may have different headers: a record is parsed into as many texts as the widest header
has, and each column takes the text at its place in the header of the record's file.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.operators.ranks import MAX_BROADCAST_ROWS
from leadloom.session import materialize

# The code travels to the Python workers with the task: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CLOSING = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')


def ends_inside(line: bytes, delimiter: bytes, inside: bool) -> bool:
    """Whether the end of ``line`` is inside quotes. A quote opens at the beginning of a field only; two are one inside."""
    at = 0
    while True:
        if inside:
            closed = _CLOSING.match(line, at)
            if closed is None:
                return True
            at = closed.end()
        elif line.startswith(b'"', at) and at == 0:
            inside, at = True, 1
            continue
        opened = line.find(delimiter + b'"', at)
        if opened < 0:
            return False
        inside, at = True, opened + len(delimiter) + 1


def _split_runs(batch: pa.RecordBatch):
    """(first row, row after the last) of the rows of one split, in order."""
    if batch.num_rows:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "start")]
        cuts = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        yield from zip(bounds[:-1], bounds[1:])


def _marks(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a quote, blank rows)."""
    quoted = np.flatnonzero(pc.find_substring(values, b'"').to_numpy(zero_copy_only=False) >= 0)
    blank = pc.or_(pc.equal(pc.binary_length(values), 0), pc.equal(values, b"\r")).to_numpy(zero_copy_only=False)
    return quoted, blank


def _file_key(path: str):
    """One number per file; the slashes after the scheme differ between Spark's lists and its metadata column."""
    return F.xxhash64(F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/"))


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    # Only line feeds end a line, so that a carriage return inside quotes stays.
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        _file_key("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"))


def split_summaries(lines: DataFrame, delimiter: bytes, keep_blank: bool) -> DataFrame:
    """Per split: where it ends if it begins outside (0) or inside (1) quotes, and how many records begin in it."""
    def work(batches):
        told: dict[tuple[int, int], list] = {}
        for batch in batches:
            for a, b in _split_runs(batch):
                values = batch.column("value").slice(a, b - a)
                spot = (batch.column("file")[a].as_py(), batch.column("start")[a].as_py())
                inside, begun = told.setdefault(spot, [[False, True], [0, 0]])
                quoted, blank = _marks(values)
                counted = np.append(0, np.cumsum(~blank | keep_blank))
                for case in (0, 1):
                    at = 0
                    for k in [*quoted.tolist(), len(values)]:
                        if not inside[case]:       # the lines up to this one, and this one, begin records
                            begun[case] += int(counted[min(k + 1, len(values))] - counted[at])
                        at = min(k + 1, len(values))
                        if k < len(values):
                            inside[case] = ends_inside(values[k].as_py(), delimiter, inside[case])
        if told:
            rows = [(f, s, *inside, *begun) for (f, s), (inside, begun) in told.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["file", "start", "end0", "end1", "n0", "n1"])

    return lines.mapInArrow(work, "file long, start long, end0 boolean, end1 boolean, n0 long, n1 long")


def split_entries(summaries: DataFrame) -> DataFrame:
    """Adds ``inside`` (how the split begins), ``before`` (records of the file before it) and ``after`` (how it ends)."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.col("end0") & ~F.col("end1")
    flipped = F.coalesce(F.sum(flips.cast("int")).over(before), F.lit(0))
    # The last split before that ends the same way however it begins decides; after it, flips are counted.
    known = F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").alias("end"), F.sum(flips.cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)).alias("flipped")))
    decided = summaries.withColumn("known", known)
    last = F.last("known", ignorenulls=True).over(before)
    odd = F.pmod(flipped - F.coalesce(last["flipped"], F.lit(0)), F.lit(2)) == 1
    entered = decided.withColumn("inside", F.coalesce(last["end"], F.lit(False)) != odd)
    begun = F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))
    return entered.select("file", "start", "inside", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("before"),
                          begun.alias("begun"), F.when(F.col("inside"), F.col("end1")).otherwise(F.col("end0")).alias("after"))


def cut_records(lines: DataFrame, entries: DataFrame, delimiter: bytes, keep_blank: bool, few_splits: bool) -> DataFrame:
    """``file``, ``number`` (from 0 in the file), ``record`` (binary)."""
    entered = lines.join(F.broadcast(entries) if few_splits else entries, ["file", "start"])
    if not few_splits:      # a join that shuffles loses the order of the lines
        entered = lines.withColumn("line", F.monotonically_increasing_id()).join(entries, ["file", "start"]).repartition(
            "file", "start").sortWithinPartitions("file", "start", "line")

    def work(batches):
        spot = held = None           # the split at hand and the lines of its open record
        number, inside, first = 0, False, False

        def out(rows):
            names = ["file", "number", "start", "whole", "record"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            rows = []
            for a, b in _split_runs(batch):
                here = (batch.column("file")[a].as_py(), batch.column("start")[a].as_py())
                if here != spot:
                    if held is not None:
                        rows.append((*spot[:1], number, spot[1], False, b"\n".join(held)))
                    spot, inside = here, batch.column("inside")[a].as_py()
                    number = batch.column("before")[a].as_py() - 1
                    held, first = ([], True) if inside else (None, False)      # the rest of a record that began before
                values = batch.column("value").slice(a, b - a)
                quoted = np.zeros(len(values), bool)
                marked, blank = _marks(values)
                quoted[marked] = True
                for line, has_quote, is_blank in zip(values.to_pylist(), quoted.tolist(), blank.tolist()):
                    if not inside:
                        if is_blank and not keep_blank:
                            continue
                        number += 1
                        if not has_quote:
                            rows.append((spot[0], number, spot[1], True, line))
                            continue
                        held, first = [], False
                    held.append(line)
                    if has_quote:
                        inside = ends_inside(line, delimiter, inside)
                    if not inside:
                        rows.append((spot[0], number, spot[1], not first, b"\n".join(held)))
                        held, first = None, False
            if rows:
                yield out(rows)
        if held is not None:
            yield out([(spot[0], number, spot[1], False, b"\n".join(held))])

    pieces = entered.mapInArrow(work, "file long, number long, start long, whole boolean, record binary")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("record").alias("record")))),
                                      lambda p: p["record"]), "0A")
    across = pieces.where("not whole").groupBy("file", "number").agg(F.unhex(joined).alias("record"))
    return pieces.where("whole").select("file", "number", "record").unionByName(across)


def scan_records(spark: SparkSession, files: Sequence[str], headers: Sequence[Sequence[str]], skip_first: bool, delimiter: str,
                 options: Mapping[str, str], corrupt: str, strict: bool, safe: bool, keep_blank: bool,
                 row_number: str | None = None) -> DataFrame:
    """The records of ``files`` (as Spark lists them, in order), each with its own header, as columns of text.

    With ``row_number`` a column of that name numbers the rows from 0.
    """
    mark = delimiter.encode("utf-8")
    distinct = sorted({tuple(h) for h in headers}, key=list(map(tuple, headers)).index)
    names = list(dict.fromkeys(n for h in distinct for n in h))
    if row_number in names:
        raise ValueError(f"the column {row_number!r} is in the files already")
    # one row per file
    listed = spark.createDataFrame([(f, i, distinct.index(tuple(h))) for i, (f, h) in enumerate(zip(files, headers))],
                                   "path string, place long, header int").select(_file_key("path").alias("file"), "path", "place", "header")
    plain = [hadoop_text(spark, f) for f in files]
    lines = _lines(spark, plain)
    # a row per split, written once: both scans must see the same splits
    entries = materialize(split_entries(split_summaries(lines, mark, keep_blank)), "splits")
    ends = entries.groupBy("file").agg(F.max_by("after", "start").alias("open"), F.sum("begun").alias("n"))
    if ends.join(listed, "file", "left_anti").head(1):
        raise IOError("the files changed while they were read")
    known = listed.join(ends, "file", "left")
    open_file = known.where("open").select("path").head(1)
    if open_file:
        raise ValueError(f"{open_file[0][0]}: a quoted field is not closed at the end of the file")
    first = 1 if skip_first else 0
    rows_of = F.greatest(F.coalesce(F.col("n"), F.lit(0)) - first, F.lit(0))
    earlier = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)      # one row per file
    based = known.select("file", "header", (F.coalesce(F.sum(rows_of).over(earlier), F.lit(0)) - first).alias("base"))
    records = cut_records(lines, entries, mark, keep_blank, entries.count() <= MAX_BROADCAST_ROWS)
    few_files = len(files) <= MAX_BROADCAST_ROWS
    placed = records.where(F.col("number") >= first).join(F.broadcast(based) if few_files else based, "file")

    # a carriage return before the line feed belongs to the line's end
    bare = F.when(F.right(F.col("record").cast("string"), F.lit(1)) == "\r", F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    text = bare.cast("string")
    decoded = F.when(F.is_valid_utf8(text), text).otherwise(F.decode(bare, "ISO-8859-1")) if safe else F.validate_utf8(text)
    width = max(len(h) for h in distinct)
    schema = ", ".join([f"c{i} string" for i in range(width)] + [f"{corrupt} string"])
    parsed = placed.select("header", "base", "number", F.from_csv(decoded, schema, dict(options)).alias("r"))
    fields = F.array(*[F.col("r")[f"c{i}"] for i in range(width)])
    of_header = lambda values: F.element_at(F.lit(values), F.col("header") + 1)
    if strict:
        whole = F.col("r")[corrupt]
        loose = F.regexp_replace(whole, '"[^"]*"', "")
        breaks = (F.length(loose) - F.length(F.replace(loose, F.lit(delimiter), F.lit("")))) / F.lit(len(delimiter))
        size = of_header([len(h) for h in distinct])
        error = F.raise_error(F.concat(F.lit("a record has more than "), size.cast("string"), F.lit(" fields: "), F.left(whole, F.lit(200))))
        fields = F.when(whole.isNotNull() & (breaks >= size), error.cast("array<string>")).otherwise(fields)
    told = parsed.select("header", (F.col("base") + F.col("number")).alias("_row"), fields.alias("f"))
    columns = []
    for n in names:
        spots = [h.index(n) + 1 if n in h else 0 for h in distinct]
        spot = F.lit(spots[0]) if len(set(spots)) == 1 else of_header(spots)
        columns.append(F.when(spot > 0, F.get("f", spot - 1)).alias(n))
    return told.select(*columns, *([F.col("_row").alias(row_number)] if row_number else []))


def hadoop_text(spark: SparkSession, uri: str) -> str:
    """A file's path as Spark's readers take it, from the URI that Spark lists it by."""
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString()
