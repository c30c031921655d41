"""Provider calls on a schedule and the log of their answers."""

import os
import time
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from leadloom.operators.answers import Pacer, answer_log, answer_requests, enrich_logged, request_key
from leadloom.operators.enrich import CallableProvider, ProviderSpec
from leadloom.plans.jobs import append_job


def test_pacer_keeps_slots_and_distances():
    now = [100.0]
    pacer = Pacer(0.5, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    told = [pacer.acquire(slot) for slot in (100.2, 100.7, 103.0)]
    assert told == pytest.approx([100.2, 100.7, 103.0]) and now[0] == pytest.approx(103.0)
    # retries, and slots that have passed, are as far apart
    assert [pacer.acquire() for _ in range(2)] + [pacer.acquire(101.0)] == pytest.approx([103.5, 104.0, 104.5])
    late = Pacer(0.5, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert late.acquire(1.0) == pytest.approx(104.5) and late.acquire(1.1) == pytest.approx(105.0)


def make_provider(folder, stop_after=None):
    """Notes the time of every call in a file of its own; fails for ``bad``, and for ``once`` the first time."""
    def provider(params, url, **_):
        name = params["name"]
        before = [f for f in os.listdir(folder) if f.startswith(f"{name}-")]
        with open(f"{folder}/{name}-{time.time():.6f}-{os.getpid()}-{len(before)}", "w"):
            pass
        if name == "bad" or (name == "once" and not before):
            raise IOError("no answer")
        return {"upper": name.upper(), "more": {"n": len(name)}}

    return provider


def calls(folder):
    return Counter(f.split("-")[0] for f in os.listdir(folder))


def times(folder):
    return sorted(float(f.split("-")[1]) for f in os.listdir(folder))


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_rate_is_kept_for_any_number_of_tasks(spark, tmp_path, tasks):
    folder = tmp_path / "calls"
    folder.mkdir()
    df = spark.createDataFrame([(f"n{i:02d}" if i < 58 else ("bad", "once")[i % 2],) for i in range(60)], "name string").repartition(5)
    spec = ProviderSpec("local://u", required_fields=["name"], queries_per_second=30, n_retry=1, retry_wait_time=0)
    out = enrich_logged(df, spec, make_provider(str(folder)), ["upper"], tasks=tasks, success="ok", round_seconds=1)
    assert out.where("ok").count() == 59
    at = times(folder)
    assert len(at) == 62          # two calls are repeated
    assert max(sum(t <= x < t + 1 for x in at) for t in at) <= 30 + tasks
    assert at[-1] - at[0] >= 1.5


def test_requests_are_asked_once_and_logged(spark, tmp_path):
    folder, log = tmp_path / "calls", str(tmp_path / "log")
    folder.mkdir()
    people = [(1, "ann", "x"), (2, "ann", "x"), (3, None, "x"), (4, "bob", None), (5, "bad", None), (6, "ann", "y")]
    df = spark.createDataFrame(people * 10, "id int, name string, key string").repartition(7)
    spec = ProviderSpec("local://u", params={"cfg": "7"}, required_fields=["name"], optional_fields=["key"], n_retry=0,
                        queries_per_second=100, post_append_prefix="x_")
    first = enrich_logged(df.where("id < 4"), spec, make_provider(str(folder)), log=log, success="ok")
    assert first.columns == ["id", "name", "key", "x_more", "x_upper", "ok"]
    assert calls(folder) == {"ann": 1}
    out = enrich_logged(df, spec, make_provider(str(folder)), ["upper", "more", "gone"], log=log, success="ok")
    assert calls(folder) == {"ann": 2, "bob": 1, "bad": 1}
    want = [(i, n.upper() if ok else None, '{"n":3}' if ok else None, None, ok)
            for i, n, _ in people for ok in [n in ("ann", "bob")] for _ in range(10)]
    assert rows(out, "id", "x_upper", "x_more", "x_gone", "ok") == sorted(want, key=lambda t: t[0])
    # failures are asked again unless the caller says otherwise; nothing else is
    enrich_logged(df, spec, make_provider(str(folder)), ["upper"], log=log)
    enrich_logged(df, spec, make_provider(str(folder)), ["upper"], log=log, retry_failed=False)
    assert calls(folder) == {"ann": 2, "bob": 1, "bad": 2}
    assert answer_log(spark, log).count() == 4 and answer_log(spark, str(tmp_path / "none")) is None
    raw = ProviderSpec("local://u", required_fields=["name"], n_retry=0, return_json=True, queries_per_second=100)
    got = {r["id"]: r["response"] for r in enrich_logged(df, raw, make_provider(str(folder)), source_columns=["name"]).collect()}
    assert got[1]["success"] and '"ANN"' in got[1]["result"] and tuple(got[3]) == tuple(got[5]) == ("{}", False)
    empty = enrich_logged(df.where("id < 0"), spec, make_provider(str(folder)), ["upper"])
    assert empty.count() == 0 and empty.columns[-1] == "x_upper"


def test_a_stopped_job_goes_on_from_its_log(spark, tmp_path, monkeypatch):
    """A job that ends between two rounds: the next one asks only for what is missing."""
    folder, log = tmp_path / "calls", str(tmp_path / "log")
    folder.mkdir()
    df = spark.createDataFrame([(f"n{i:02d}",) for i in range(40)], "name string")
    spec = ProviderSpec("local://u", required_fields=["name"], queries_per_second=100, n_retry=0)
    requests = df.select(F.create_map(F.lit("name"), F.col("name")).alias("request"))
    from leadloom.operators import answers as module

    rounds, real = [], module._calls

    def stopping(*args):
        rounds.append(1)
        if len(rounds) == 3:
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(module, "_calls", stopping)
    with pytest.raises(KeyboardInterrupt):
        answer_requests(requests, spec, make_provider(str(folder)), log, tasks=4, round_seconds=0.1)
    assert answer_log(spark, log).count() == 20
    assert answer_requests(requests, spec, make_provider(str(folder)), log, tasks=4) == 20
    assert set(calls(folder).values()) == {1} and answer_log(spark, log).where("success").count() == 40
    assert answer_requests(requests, spec, make_provider(str(folder)), log) == 0


def test_key_does_not_depend_on_order(spark):
    df = spark.sql("select map('a', '1', 'b', '2') x, map('b', '2', 'a', '1') y, map('a', '1') z")
    r = df.select(*[request_key(F.col(c)).alias(c) for c in "xyz"]).first()
    assert r.x == r.y != r.z


def test_provider_in_a_job(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    df = spark.createDataFrame([(1, "ann"), (2, "ann"), (3, None)], "id int, name string")
    spec = ProviderSpec("local://u", required_fields=["name"], queries_per_second=100)
    out = append_job(df, [CallableProvider(spec, make_provider(str(folder)), ["upper"])])
    assert rows(out, "id", "upper") == [(1, "ANN"), (2, "ANN"), (3, None)] and calls(folder) == {"ann": 1}
    assert rows(out, "id", "upper") == [(1, "ANN"), (2, "ANN"), (3, None)] and calls(folder) == {"ann": 1}      # read twice, asked once
