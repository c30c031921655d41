import os

import pytest
from conftest import rows

from leadloom.operators.enrich import CallableProvider, LookupProvider, ProviderSpec
from leadloom.plans.jobs import append_job
from leadloom.sources.delimited import read_delimited
from leadloom.sources.sinks import OutputName
from leadloom.streaming.chunks import append_chunks, read_chunks, run_chunks


def drop(folder, name, ids):
    lines = "".join(f"{i}\t{'NA' if i % 4 == 0 else 'n' + str(i % 3)}\n" for i in ids)
    (folder / name).write_text("id\tname\n" + lines)


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame([("n0", "zero"), ("n1", "one")], "k string, word string")


def test_stop_and_resume_equals_batch(spark, tmp_path, lookup):
    folder, out, check = tmp_path / "in", tmp_path / "out", str(tmp_path / "check")
    folder.mkdir()
    providers = [LookupProvider(ProviderSpec("l://w", required_fields=["name"]), lookup, {"name": "k"}, unique=True)]
    name = OutputName(str(out / "$@_{1:03d}"), "/in/leads.tsv")
    for i in range(2):
        drop(folder, f"f{i}.tsv", range(i * 10, i * 10 + 10))
    ran = append_chunks(read_chunks(spark, str(folder), ["id", "name"]), providers, name, check)
    assert ran == 2 and sorted(os.listdir(out)) == ["leads_001", "leads_002"]
    for i in range(2, 4):
        drop(folder, f"f{i}.tsv", range(i * 10, i * 10 + 10))
    assert append_chunks(read_chunks(spark, str(folder), ["id", "name"]), providers, name, check) == 2
    assert append_chunks(read_chunks(spark, str(folder), ["id", "name"]), providers, name, check) == 0
    assert sorted(os.listdir(out)) == ["leads_001", "leads_002", "leads_003", "leads_004"]
    streamed = read_delimited(spark, str(out / "leads_*"))
    batch = append_job(read_delimited(spark, str(folder / "*.tsv")), providers)
    assert rows(streamed) == rows(batch) and streamed.count() == 40


def test_replayed_batch_replaces_its_output(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    drop(folder, "a.tsv", range(5))
    name = OutputName(str(out / "c_{0:d}"))
    for attempt in range(2):     # a lost checkpoint makes the same batch run again
        run_chunks(read_chunks(spark, str(folder), ["id", "name"]), lambda d: d, name, str(tmp_path / f"check{attempt}"))
    assert read_delimited(spark, str(out / "c_0")).count() == 5
    with pytest.raises(ValueError):
        run_chunks(read_chunks(spark, str(folder), ["id", "name"]), lambda d: d, OutputName("single"), "x")


def test_callable_provider_on_a_stream(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    drop(folder, "a.tsv", range(6))

    def make():
        return lambda params, url, headers, timeout: {"twice": int(params["id"]) * 2}

    spec = ProviderSpec("local://t", required_fields=["id"], queries_per_second=100)
    append_chunks(read_chunks(spark, str(folder), ["id", "name"]), [CallableProvider(spec, make(), ["twice"], tasks=1)],
                  OutputName(str(out / "c_{0:d}")), str(tmp_path / "check"))
    got = read_delimited(spark, str(out / "c_0"))
    assert rows(got, "id", "twice") == [(str(i), str(i * 2)) for i in range(6)]


def test_score_on_a_stream(spark, tmp_path):
    from leadloom.streaming.chunks import score_chunks

    class Doubler:
        whole_scores = True

        def transform(self, df):
            return df.withColumn("score", df["id"].cast("double") * 2)

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    drop(folder, "a.tsv", range(3))
    score_chunks(read_chunks(spark, str(folder), ["id", "name"]), Doubler(), OutputName(str(out / "s_{0:d}")),
                 str(tmp_path / "check"), keep={"include": ["id"]})
    assert rows(read_delimited(spark, str(out / "s_0"))) == [("0", "0"), ("1", "2"), ("2", "4")]


def test_stream_reads_utf8_and_latin1_per_record(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.tsv").write_bytes("id\tname\n1\tJosé\n".encode() + "2\tJosé\n".encode("latin-1"))
    name = OutputName(str(tmp_path / "safe_{0:d}"))
    run_chunks(read_chunks(spark, str(folder), ["id", "name"], safe=True), lambda d: d, name, str(tmp_path / "c1"))
    got = spark.read.csv(name.path(0), sep="\t", header=True).collect()
    assert sorted(map(tuple, got)) == [("1", "José"), ("2", "José")]
    with pytest.raises(Exception, match="(?i)utf"):
        run_chunks(read_chunks(spark, str(folder), ["id", "name"]), lambda d: d, name, str(tmp_path / "c2"))
