"""Delimited text scans: every field is text, missing tokens become null."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.columns import quoted
from leadloom.functions.fixed import MISSING_TOKENS
from leadloom.operators.project import consolidate_missing
from leadloom.operators.ranks import row_index
from leadloom.sources.records import hadoop_text, scan_records


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hpath, fs = hadoop_path(spark, path)
    return fs.exists(hpath)


def expand_glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, by file-system metadata only."""
    hpath, fs = hadoop_path(spark, pattern)
    found = fs.globStatus(hpath)
    paths = sorted(s.getPath().toString() for s in (found or []))
    if not paths:
        raise IOError(f"no file matches {pattern}")
    return paths


def first_line(spark: SparkSession, path: str) -> bytes:
    """The first line of a file as raw bytes, without a byte-order mark; only the file's beginning is read."""
    line = _file_head(spark, hadoop_path(spark, path)[0])
    if line is None:
        raise IOError(f"{path} is empty: it has no header line")
    return line


def _file_head(spark: SparkSession, hpath) -> bytes | None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stream = hpath.getFileSystem(conf).open(hpath)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(hpath)
        reader = jvm.org.apache.hadoop.util.LineReader(codec.createInputStream(stream) if codec is not None else stream)
        line = jvm.org.apache.hadoop.io.Text()
        if reader.readLine(line) == 0:
            return None
        return bytes(line.copyBytes()).removeprefix(b"\xef\xbb\xbf")
    finally:
        stream.close()


def listed_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files (as URIs) behind paths, folders and patterns: path by path, by name in each. Metadata only."""
    out: dict[str, None] = {}
    for p in paths:
        out.update(dict.fromkeys(sorted(spark.read.text(p).inputFiles())))
    return list(out)


def file_headers(spark: SparkSession, files: Sequence[str]) -> dict[str, bytes]:
    """The first line of every file that has one."""
    jvm = spark.sparkContext._jvm

    def head(uri: str) -> bytes | None:
        return _file_head(spark, jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)))

    with ThreadPoolExecutor(min(16, max(1, len(files)))) as pool:
        found = list(pool.map(head, files))
    return {f: line for f, line in zip(files, found) if line is not None}


def parse_header(line: bytes, delimiter: str = "\t", quotechar: str = '"') -> list[str]:
    """Column names of a header line: UTF-8, or latin-1 if it is not valid UTF-8."""
    try:
        text = line.decode("utf-8")
    except UnicodeDecodeError:
        text = line.decode("latin-1")
    return next(csv.reader([text], delimiter=delimiter, quotechar=quotechar))


def get_header(spark: SparkSession, path: str, delimiter: str = "\t", quotechar: str = '"') -> list[str]:
    return parse_header(first_line(spark, path), delimiter, quotechar)


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _check_names(names: Sequence[str]) -> None:
    repeated = sorted({n for n in names if list(names).count(n) > 1})
    if repeated:
        raise ValueError(f"column names repeat: {repeated}")


def _ddl(names: Sequence[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` string" for n in names)


CORRUPT = "_leadloom_corrupt"


def _csv_options(delimiter: str, malformed: str) -> dict[str, str]:
    mode = "PERMISSIVE" if malformed == "error" else malformed
    return {"sep": delimiter, "quote": '"', "escape": '"', "mode": mode, "nullValue": "", "emptyValue": "",
            "columnNameOfCorruptRecord": CORRUPT}


def _checked(fields: list[Column], record: Column, width: int, delimiter: str) -> list[Column]:
    """The fields; reading one raises an error if its record has more than ``width`` fields.

    ``record`` is set for records of another width only, so the count is rarely made.
    """
    bare = F.regexp_replace(record, '"[^"]*"', "")
    breaks = (F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))) / F.lit(len(delimiter))
    long = record.isNotNull() & (breaks >= width)
    error = F.raise_error(F.concat(F.lit(f"a record has more than {width} fields: "), F.left(record, F.lit(200)))).cast("string")
    return [F.when(long, error).otherwise(f) for f in fields]


def latin_options(delimiter: str, malformed: str) -> dict[str, str]:
    """Options that read every byte as one character; ``decoded`` makes text of them."""
    sep = delimiter.encode("utf-8").decode("latin-1")
    return {**_csv_options(sep, malformed), "encoding": "ISO-8859-1", "enforceSchema": "true"}


def decoded(df: DataFrame, names: Sequence[str], safe: bool) -> DataFrame:
    """Records that are not UTF-8 stay latin-1 with ``safe``, otherwise they are an error."""
    raw = {n: F.encode(quoted(n), "ISO-8859-1").cast("string") for n in names}
    if not safe:
        return df.select(*[F.validate_utf8(raw[n]).alias(n) for n in names])
    valid = F.is_valid_utf8(F.concat_ws("", *raw.values()))
    return df.select(*[F.when(valid, raw[n]).otherwise(quoted(n)).alias(n) for n in names])


def csv_schema(names: Sequence[str], malformed: str) -> T.StructType:
    return text_schema([*names, CORRUPT] if malformed == "error" else names)


def checked_fields(df: DataFrame, names: Sequence[str], delimiter: str, malformed: str) -> DataFrame:
    """The named columns of the CSV source's latin-1 rows; over-long records are an error unless another mode is named."""
    if malformed != "error":
        return df
    sep = delimiter.encode("utf-8").decode("latin-1")
    fields = _checked([quoted(n) for n in names], F.col(CORRUPT), len(names), sep)
    return df.select(*[f.alias(n) for f, n in zip(fields, names)])


def _scan_csv(spark, paths, names, delimiter, has_header, safe, multiline, malformed) -> DataFrame:
    """The splittable CSV source: embedded line breaks if asked; drops blank lines.

    Columns are pruned unless over-long records are an error: that takes all fields.
    """
    reader = spark.read.schema(csv_schema(names, malformed)).options(
        **latin_options(delimiter, malformed), header=str(has_header).lower(), multiLine=str(multiline).lower())
    return decoded(checked_fields(reader.csv(paths), names, delimiter, malformed), names, safe)


def _scan_lines(spark, paths, names, delimiter, header_line: bytes | None, safe, malformed) -> DataFrame:
    """One record per line through the text source; a blank line is a record of nulls."""
    lines = spark.read.text(paths)
    raw = F.col("value").cast("binary")
    if header_line is not None:
        # Each file has one header line at its start. Equal lines further down are
        # data: all copies of one line are the same, so all but one are put back.
        is_header = raw == F.lit(bytearray(header_line))
        extra = (
            lines.where(is_header).groupBy(F.col("_metadata.file_path").alias("_file"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("value"))
            .where(F.col("_n") > 1)
            .select("value", F.explode(F.sequence(F.lit(2), F.col("_n").cast("int"))).alias("_i")).select("value"))
        lines = lines.where(~is_header).select("value").unionByName(extra)
    if safe:
        text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(raw, "ISO-8859-1"))
    else:
        text = F.validate_utf8("value")
    options = _csv_options(delimiter, malformed)
    strict = malformed == "error"
    parsed = lines.select(F.from_csv(text, _ddl([*names, CORRUPT] if strict else names), options).alias("r"))
    fields = [F.col("r").getField(n) for n in names]
    if strict:
        fields = _checked(fields, F.col("r").getField(CORRUPT), len(names), delimiter)
    return parsed.select(*[f.alias(n) for f, n in zip(fields, names)])


def _scan(spark, paths, names, delimiter, header_line, safe, keep_blank, multiline, malformed) -> DataFrame:
    _check_names(names)
    if keep_blank and not multiline:
        return _scan_lines(spark, paths, names, delimiter, header_line, safe, malformed)
    return _scan_csv(spark, paths, names, delimiter, header_line is not None, safe, multiline, malformed)


def read_delimited(spark: SparkSession, path: str | Sequence[str] | DataFrame, delimiter: str = "\t",
                   header: Sequence[str] | str | None = None, missing_values: Iterable[str] | None = None,
                   safe: bool = False, keep_blank: bool = True, multiline: bool = False,
                   malformed: str = "error", row_number: str | None = None) -> DataFrame:
    """Read delimited text as an all-string DataFrame with missing tokens as null.

    ``header``: None takes the first line of each file, a list gives the names
    (the data then has no header line), a text is the path of a header file.
    Files may have different headers, in one folder or pattern too; columns are
    matched by name, empty files have no rows. ``missing_values``
    are added to the standard tokens. ``safe`` reads records that are not valid
    UTF-8 as latin-1, otherwise such a record is an error. Blank lines are kept as records of nulls; set
    ``keep_blank=False`` for the plain CSV source, which prunes columns and reads
    the files once. ``multiline=True`` allows line breaks inside quotes; together with blank
    lines such files are cut by :mod:`leadloom.sources.records`, in parallel; a quoted field that is still
    open at the end of a file then is an error. ``row_number`` names a column that numbers the rows
    from 0, in the order of the files and of the records in them, whatever the splits.
    A DataFrame passes through.

    Records with too few fields are filled up with nulls. Records with more fields than
    columns are an error; with ``malformed="PERMISSIVE"`` their last fields are left out,
    and Spark's other modes can be named as well.
    """
    if isinstance(path, DataFrame):
        return path
    if isinstance(header, str):
        if not path_exists(spark, header):
            raise IOError(f"header file {header} does not exist")
        names = get_header(spark, header, delimiter)
    elif header is None or isinstance(header, (list, tuple)):
        names = list(header) if header is not None else None
    else:
        raise TypeError(f"header is a list, a path or None, not {type(header)}")
    if not isinstance(path, (str, list, tuple)):
        raise TypeError(f"path is a text or a list of texts, not {type(path)}")

    paths = [path] if isinstance(path, str) else list(path)
    found: dict[str, bytes] = {}
    if names is None:
        found = file_headers(spark, listed_files(spark, paths))
        if not found:
            raise IOError(f"{path} is empty: it has no header line")
    if row_number is not None or (multiline and keep_blank):
        files = list(found) if names is None else listed_files(spark, paths)
        headers = [parse_header(found[f], delimiter) if names is None else names for f in files]
        for h in headers:
            _check_names(h)
        strict = malformed == "error"
        df = scan_records(spark, files, headers, names is None, delimiter, _csv_options(delimiter, malformed), CORRUPT,
                          strict, safe, keep_blank, row_number)
        return consolidate_missing(df, {*MISSING_TOKENS, *(missing_values or ())})
    if names is not None:
        groups = [(None, tuple(names), paths)]
    else:
        by_line: dict[bytes, list[str]] = {}
        for f, line in found.items():
            by_line.setdefault(line, []).append(f)
        groups = [(line, tuple(parse_header(line, delimiter)), paths if len(by_line) == 1 else [hadoop_text(spark, f) for f in fs])
                  for line, fs in by_line.items()]
    parts = [_scan(spark, ps, cols, delimiter, line, safe, keep_blank, multiline, malformed)
             for line, cols, ps in groups]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return consolidate_missing(df, {*MISSING_TOKENS, *(missing_values or ())})


def concat_by_name(*frames: DataFrame) -> DataFrame:
    """Union of tables by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def chunks(df: DataFrame, chunksize: int, chunkstart: int = 0, order_by: str | None = None,
           out: str = "chunk", number: str | None = None) -> DataFrame:
    """Adds the number of the chunk a row is in, and resumes at ``chunkstart``.

    Rows are counted in the order of ``order_by``, or in scan order without it. ``number``
    names a column that has the rows' numbers already, as ``read_delimited(row_number=...)``
    gives it: the chunks then do not depend on splits, and no row is looked at twice.
    """
    if not chunksize or chunksize < 1:
        raise ValueError("chunksize must be at least 1")
    if number is not None:
        whole = quoted(number).cast("bigint")
        chunked = df.withColumn(out, ((whole - F.pmod(whole, F.lit(int(chunksize)))) / F.lit(int(chunksize))).cast("bigint"))
    else:
        chunked = row_index(df, "_row", order_by).withColumn(out, F.expr(f"_row div {int(chunksize)}L")).drop("_row")
    return chunked.where(F.col(out) >= chunkstart) if chunkstart else chunked
