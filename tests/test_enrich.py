import pytest
from conftest import rows
from pyspark.sql import functions as F

from leadloom.operators.enrich import (
    CallableProvider, HandlerRegistry, LookupProvider, ProviderSpec, TaskBudget, append_all, append_statistics, as_is,
    call_with_retry, collision_names, discover_schema, enrich_callable, enrich_lookup, first_result, task_count)
from leadloom.plans.jobs import append_job
from leadloom.session import materialize


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "ann", "x"), (2, "bob", None), (3, None, "y"), (4, "ann", "z")],
                                 "id int, name string, mail string")


@pytest.fixture
def ages(spark):
    return spark.createDataFrame([("ann", 30), ("ann", 20), ("bob", 40), (None, 99)], "who string, age int")


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_lookup_keeps_every_row_once(spark, people, ages, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = enrich_lookup(people, ages, {"name": "who"}, prefix="p_")
        assert rows(got, "id", "p_age") == [(1, 20), (2, 40), (3, None), (4, 20)]
        assert enrich_lookup(people, ages.select("who"), {"name": "who"}).count() == 4
        checked = enrich_lookup(people, ages, {"name": "who"}, required=["mail"])
        assert rows(checked, "id", "age") == [(1, 20), (2, None), (3, None), (4, 20)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_key_and_many_missing_keys(spark, ages):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "ann").when(F.col("id") % 3 == 1, None)
                                  .otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("name"))
    got = enrich_lookup(df, ages, {"name": "who"})
    assert got.count() == 3000 and got.where("age = 20").count() == 1000


def test_collisions():
    assert collision_names(["a"], ["a", "b"]) == ["a_append", "b"]
    with pytest.raises(ValueError):
        collision_names(["a", "a_append"], ["a"])


def test_spec_checks():
    for bad in ({"n_connections": 0}, {"queries_per_second": 101}, {"response_handler": "nope"}):
        with pytest.raises(ValueError):
            ProviderSpec("http://x/y", **bad)
    with pytest.raises(TypeError):
        ProviderSpec("http://x/y", response_handler=3)
    with pytest.raises(ValueError):
        ProviderSpec.from_config({"params": {}})
    with pytest.raises(ValueError, match="speed"):
        ProviderSpec.from_config({"url": "u", "speed": 1})
    spec = ProviderSpec.from_config({"url": "u", "required_fields": "a", "optional_fields": ["b"], "field_remap": {"a": "x"}})
    assert spec.request_fields(["a", "b", "c"]) == {"a": "x", "b": "b"}
    assert ProviderSpec("u").request_fields(["a", "c"]) == {"a": "a", "c": "c"}
    assert (spec.n_retry, spec.retry_wait_time, spec.timeout, spec.queries_per_second, spec.n_connections) == (3, 3, 10, 20, 100)


def test_handlers():
    registry = HandlerRegistry()
    handler = first_result("acme")
    registry.register("acme", handler, "api*.acme.com/*")
    assert registry.choose(None, "https://API2.acme.com/v2/q?x=1") is handler
    assert registry.choose(None, "https://other.com/v2") is as_is
    assert registry.choose("acme", "u") is handler
    assert handler({"acme": {"results": [{"a": 1}, {"a": 2}]}}, url="u") == {"a": 1}
    assert handler({"Acme": {"results": ["text"]}}, url="u") == {}
    assert handler({"Acme": {"results": []}}, url="u") == {}
    assert handler({"acme": {"n": 0}}, url="u", raw_json=True) == {"n": 0}
    with pytest.raises(KeyError):
        handler({"other": 1}, url="u")


def test_retry_waits_grow_and_give_up():
    waits, calls = [], []

    def fails(times):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise IOError("down")
            return {"ok": 1}
        return call

    assert call_with_retry(fails(2), 3, 3, lambda: None, waits.append) == ({"ok": 1}, True)
    assert waits == [0, 3] and len(calls) == 3
    waits.clear(), calls.clear()
    assert call_with_retry(fails(99), 3, 3, lambda: None, waits.append) == (None, False)
    assert waits == [0, 3, 6] and len(calls) == 4
    assert call_with_retry(lambda: None, 0, 1, lambda: None, waits.append) == (None, False)


def test_budget_shares_add_up():
    now = [0.0]
    budget = TaskBudget(20, 4, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(50):
        budget.acquire()
    assert budget.calls == 5 and now[0] == pytest.approx(9.0)
    slow = TaskBudget(1, 4, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    start = now[0]
    for _ in range(3):
        slow.acquire()
    assert slow.calls == 1 and now[0] - start == pytest.approx(8.0)
    assert task_count(ProviderSpec("u", n_connections=3), 8) == 3
    assert task_count(ProviderSpec("u", queries_per_second=0.5), 8) == 1


def make_provider():
    def local_provider(params, url, headers, timeout):
        if params["name"] == "bob":
            raise IOError("no answer")
        return {"upper": params["name"].upper(), "cfg": params.get("cfg"), "mail": params.get("mail")}

    return local_provider      # a closure, so it travels to the workers by value


local_provider = make_provider()


def test_callable_provider(spark, people):
    spec = ProviderSpec("local://u", params={"cfg": "7"}, required_fields=["name"], optional_fields=["mail"],
                        n_retry=1, retry_wait_time=0, queries_per_second=100, post_append_prefix="x_")
    out = materialize(enrich_callable(people, spec, local_provider, ["upper", "cfg", "mail", "gone"], tasks=2, success="ok"))
    assert rows(out, "id", "x_upper", "x_cfg", "x_mail", "x_gone", "ok") == [
        (1, "ANN", "7", "x", None, True), (2, None, None, None, None, False),
        (3, None, None, None, None, False), (4, "ANN", "7", "z", None, True)]
    stats = append_statistics(out, "ok", seconds=2.0).first()
    assert (stats["records"], stats["success_rate"], stats["records_per_second"]) == (4, 0.5, 2.0)
    raw = enrich_callable(people, ProviderSpec("local://u", required_fields=["name"], n_retry=0, return_json=True),
                          local_provider, tasks=1)
    got = {r["id"]: r["response"] for r in raw.collect()}
    assert got[1]["success"] and '"ANN"' in got[1]["result"] and got[3]["result"] == "{}"
    assert discover_schema(raw.select("response.result"), "result").startswith("OBJECT")


def test_providers_see_the_original_table(spark, people, ages):
    spec = ProviderSpec("local://u", required_fields=["name"], n_retry=0, queries_per_second=100)
    providers = [LookupProvider(ProviderSpec("l://a", required_fields=["name"]), ages, {"name": "who"}),
                 CallableProvider(spec, local_provider, ["mail"], tasks=2),
                 LookupProvider(ProviderSpec("l://b", required_fields=["name"], post_append_suffix="_2"), ages, {"name": "who"})]
    out = append_job(people, providers)
    assert out.columns == ["id", "name", "mail", "age", "mail_append", "age_2"]
    assert rows(out, "id", "age", "age_2") == [(1, 20, 20), (2, 40, 40), (3, None, None), (4, 20, 20)]
    assert append_all(people, []) is people
    with pytest.raises(ValueError):
        append_all(people, [LookupProvider(ProviderSpec("l://a"), ages, {"zip": "who"})])


def test_empty_input(spark, people):
    spec = ProviderSpec("local://u", required_fields=["name"])
    out = enrich_callable(people.where("id < 0"), spec, local_provider, ["upper"])
    assert out.count() == 0 and out.columns[-1] == "upper"


def test_answer_fields_are_found(spark, people):
    spec = ProviderSpec("local://u", params={"cfg": "7"}, required_fields=["name"], optional_fields=["mail"], n_retry=0,
                        queries_per_second=100, post_append_prefix="x_",
                        response_handler=first_result("acme"))

    def make():
        def provider(params, url, headers, timeout):
            extra = {"only_ann": {"n": 1}} if params["name"] == "ann" else {}
            return {"Acme": {"results": [{"upper": params["name"].upper(), **extra}]}}
        return provider

    out = enrich_callable(people, spec, make(), None, tasks=2, success="ok")
    assert out.columns == ["id", "name", "mail", "x_only_ann", "x_upper", "ok"]
    assert rows(out, "id", "x_upper", "x_only_ann", "ok") == [
        (1, "ANN", '{"n":1}', True), (2, "BOB", None, True), (3, None, None, False), (4, "ANN", '{"n":1}', True)]
    none = enrich_callable(people.where("id < 0"), spec, make(), None)
    assert none.columns == ["id", "name", "mail"]


def test_append_files_from_configuration(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("id\tfirstname\tzip\n1\tann\tNA\n2\t\t9\n")
    config = {"query_configs": [{"url": "local://a", "required_fields": ["firstname"], "optional_fields": ["zip"],
                                 "field_remap": {"firstname": "first"}, "post_append_prefix": "A_",
                                 "params": {"max": 1}, "queries_per_second": 50}],
              "required_fields": ["id"], "missing_values": ["9"]}

    def make():
        return lambda params, url, headers, timeout: {"seen": ",".join(f"{k}={v}" for k, v in sorted(params.items()))}

    from leadloom.plans.jobs import append_files
    out = append_files(spark, str(tmp_path / "in.tsv"), config, transports={"local://a": make()})
    assert rows(out) == [("1", "ann", None, "first=ann,max=1"), ("2", None, None, None)]
    with pytest.raises(ValueError, match="speed"):
        append_files(spark, "x", {"speed": 1})


def test_default_transport_builds_a_get(monkeypatch):
    import io
    import urllib.request

    from leadloom.operators.enrich import http_get
    seen = {}

    def fake(request, timeout):
        seen.update(url=request.full_url, headers=dict(request.header_items()), timeout=timeout)
        return io.BytesIO(b'{"a": 1}')

    monkeypatch.setattr(urllib.request, "urlopen", fake)
    assert http_get({"q": "x y"}, "http://h/p", {"Accept": "application/json"}, 5) == {"a": 1}
    assert seen == {"url": "http://h/p?q=x+y", "headers": {"Accept": "application/json"}, "timeout": 5}


def test_hot_key_is_split_by_the_skew_join(spark):
    """A third of the rows on one key, another third without a key, lookup too large to broadcast."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB", "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 300000, 1, 8).select(
            "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("key"))
        lookup = spark.range(0, 300000, 1, 8).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
        out = enrich_lookup(df, lookup, {"key": "k"}, unique=True)
        got = out.agg(F.count("*").alias("n"), F.sum(F.when(F.col("key") == 7, F.col("twice"))).alias("hot"),
                      F.count("twice").alias("hits"))
        n = got.first()
        assert (n["n"], n["hot"], n["hits"]) == (300000, 100001 * 14, 200000)
        out.cache().count()
        final = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final
        out.unpersist()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
