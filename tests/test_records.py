"""Records with line breaks in quotes, headers per file and row numbers, over many splits of one file."""

import csv
import io
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from leadloom.sources.delimited import chunks, listed_files, read_delimited
from leadloom.sources.records import ends_inside
from leadloom.streaming.chunks import read_chunks


@pytest.fixture
def splits(spark):
    """Sets the bytes per split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def set_to(size):
        for n, v in zip(names, (str(size), "1", "1")):
            spark.conf.set(n, v)
    yield set_to
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_line_states():
    for line, outside, inside in [("", False, True), ("a,b", False, True), ('a,"b', True, False), ('a,"b"', False, False), ('5" x,y', False, False),
                                  ('"a""', True, True), ('"a""",x', False, False), ('x",y', False, False), ('x"",y', False, True),
                                  ('x",",z', True, False), ('x","y",z', False, False), ('"', True, False), ('""', False, True), ('"",""', False, False),
                                  ('a,"b,c",d"e', False, False), (',"', True, False)]:
        assert ends_inside(line.encode(), b",", False) == outside, line
        # inside quotes: as the line after one that opened a field
        assert ends_inside(line.encode(), b",", True) == ends_inside(b'"' + line.encode(), b",", False)
    assert ends_inside('x||"y'.encode(), b"||", False) and not ends_inside('x|"y'.encode(), b"||", False)


def made_file(rng, n, width):
    out = []
    for _ in range(n):
        if rng.random() < 0.1:
            out.append([])
            continue
        out.append(["".join(rng.choice('ab é,"\n') for _ in range(rng.randint(1, 9))) + "z" for _ in range(width)])
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n")
    for r in out:
        if r:
            writer.writerow(r)
        else:
            text.write("\n")
    return out, text.getvalue()


@pytest.mark.parametrize("size", [23, 200, 1 << 20])
def test_breaks_in_quotes_with_blank_lines(spark, splits, tmp_path, size):
    rng = random.Random(size)
    told, want = [], []
    for k, names in enumerate((["a", "b"], ["b", "c", "a"], ["a", "b"])):
        made, text = made_file(rng, 60, len(names))
        (tmp_path / f"f{k}.csv").write_text(",".join(names) + "\n" + text)
        told += [dict(zip(names, r)) for r in made]
    want = [(i, r.get("a"), r.get("b"), r.get("c")) for i, r in enumerate(told)]
    splits(size)
    got = read_delimited(spark, str(tmp_path), ",", multiline=True, row_number="n")
    assert got.columns == ["a", "b", "c", "n"] and rows(got, "n", "a", "b", "c") == want
    # without blank lines: they are not counted either
    filled = [r for r in told if r]
    got = read_delimited(spark, str(tmp_path), ",", multiline=True, keep_blank=False, row_number="n")
    assert rows(got, "n", "a", "b", "c") == [(i, r.get("a"), r.get("b"), r.get("c")) for i, r in enumerate(filled)]
    numbered = chunks(got, 25, 2, number="n")
    assert rows(numbered, "n", "chunk") == [(i, i // 25) for i in range(50, len(filled))]


def test_numbers_do_not_depend_on_splits(spark, splits, tmp_path):
    for name, n in (("b.tsv", 40), ("a.tsv", 70)):
        (tmp_path / name).write_text("v\n" + "".join(f"{name}-{i}\n" for i in range(n)))
    found = []
    for size in (10, 57, 1 << 20):
        splits(size)
        df = read_delimited(spark, str(tmp_path), row_number="n")
        found.append(rows(df, "n", "v"))
        parts = df.rdd.getNumPartitions()
    assert found[0] == found[1] == found[2] == [(i, f"a.tsv-{i}") for i in range(70)] + [(70 + i, f"b.tsv-{i}") for i in range(40)]
    assert parts >= 1


def test_headers_of_every_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a 1.tsv", "x\ty\n1\t2\n"), ("b.tsv", "y\tz\n3\t4\ny\tz\n"), ("c.tsv", "x\ty\n5\t6\n"), ("d.tsv", "z\n\n7\n"), ("e.tsv", "")):
        (tmp_path / "in" / name).write_text(text)
    want = [("1", "2", None), ("5", "6", None), (None, "3", "4"), (None, "y", "z"), (None, None, "7"), (None, None, None)]
    order = lambda got: sorted(got, key=repr)
    for path in (str(tmp_path / "in"), str(tmp_path / "in" / "*.tsv")):
        for options in ({}, {"multiline": True}, {"row_number": "n"}):
            got = read_delimited(spark, path, **options)
            assert order(rows(got, "x", "y", "z")) == order(want)
        assert order(rows(read_delimited(spark, path, keep_blank=False), "x", "y", "z")) == order(want[:-1])
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.tsv").write_text("")
    with pytest.raises(IOError, match="empty"):
        read_delimited(spark, str(tmp_path / "none"))
    assert [f.rsplit("/", 1)[1] for f in listed_files(spark, [str(tmp_path / "in" / "b.tsv"), str(tmp_path / "in")])][:2] == ["b.tsv", "a%201.tsv"]


def test_record_edges(spark, splits, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes('﻿a,b\r\n1,"x\r\ny"\r\n\r\n2,5" pipe\r\n'.encode() + b'3,"caf\xe9\n"\r\n')
    splits(7)
    got = read_delimited(spark, str(path), ",", multiline=True, safe=True, row_number="n")
    assert [(r.n, r.a, r.b and r.b.replace("\r\n", "\n")) for r in got.orderBy("n").collect()] == [
        (0, "1", "x\ny"), (1, None, None), (2, "2", '5" pipe'), (3, "3", "café\n")]
    with pytest.raises(Exception, match="(?i)utf"):
        read_delimited(spark, str(path), ",", multiline=True).collect()
    path.write_text('1,2\n3,"4\n5')
    with pytest.raises(ValueError, match="not closed"):
        read_delimited(spark, str(path), ",", header=["a", "b"], multiline=True)
    path.write_text('1,2\n"3\n",4,5\n')
    with pytest.raises(Exception, match="more than 2 fields"):
        read_delimited(spark, str(path), ",", header=["a", "b"], multiline=True).collect()
    assert rows(read_delimited(spark, str(path), ",", header=["a", "b"], multiline=True, malformed="PERMISSIVE")) == [("1", "2"), ("3\n", "4")]
    path.write_text('1\n2,3\n')
    assert rows(read_delimited(spark, str(path), ",", header=["a", "b"], multiline=True)) == [("1", None), ("2", "3")]
    with pytest.raises(ValueError, match="already"):
        read_delimited(spark, str(path), ",", header=["a", "b"], row_number="b")


def test_long_records_on_streams_are_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("a\tb\n1\n2\t3\t4\n")

    def run(name, **options):
        query = (read_chunks(spark, str(tmp_path / "in"), ["a", "b"], **options).writeStream.format("memory").queryName(name)
                 .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
        query.awaitTermination()
        return rows(spark.table(name).select(F.col("a"), F.col("b")))

    with pytest.raises(Exception, match="more than 2 fields"):
        run("strict")
    assert run("loose", malformed="PERMISSIVE") == [("1", None), ("2", "3")]
