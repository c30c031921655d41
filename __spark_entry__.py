
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from leadloom.functions.columns import order_hash, quoted  # noqa: E402
from leadloom.functions.fixed import MISSING_TOKENS  # noqa: E402
from leadloom.operators import curves, importance  # noqa: E402
from leadloom.operators.answers import enrich_logged  # noqa: E402
from leadloom.operators.balance import balance_fill_rates, fill_rates  # noqa: E402
from leadloom.operators.encode import impute_indicator, ordinal_encode  # noqa: E402
from leadloom.operators.enrich import (  # noqa: E402
    LookupProvider, ProviderSpec, append_all, append_statistics, enrich_lookup, first_result_column, json_fields)
from leadloom.operators.profile import feature_roles, infer_types, label_counts, profile_columns  # noqa: E402
from leadloom.operators.project import (  # noqa: E402
    affix, booleanize_label, cast_features, consolidate_missing, field_remap, project, request_map, score_output)
from leadloom.operators.ranks import cached  # noqa: E402
from leadloom.operators.split import balanced_sample, stratified_folds, stratified_split  # noqa: E402
from leadloom.plans.features import fit_feature_pipeline  # noqa: E402
from leadloom.plans.jobs import append_job, score_job, train_job  # noqa: E402
from leadloom.plans.quantile import QuantileScore  # noqa: E402
from leadloom.plans.selector import FeatureSelector  # noqa: E402
from leadloom.plans.trees import (  # noqa: E402
    FEATURES, ID, LABEL, CalibratedTreesFactory, auc_value, cross_validated_score, out_of_fold)
from leadloom.session import materialize, scratch_path  # noqa: E402
from leadloom.sources.delimited import chunks, concat_by_name, read_delimited  # noqa: E402
from leadloom.sources.sinks import OutputName, write_delimited  # noqa: E402
from leadloom.streaming.chunks import append_chunks, read_chunks  # noqa: E402

# The corpus operators are a package of their own; without it the other queries work as before.
try:
    import corpus_pipeline
    from leadloom.llm import queries as corpus_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "leadloom.llm"):
        raise
    _LLM_QUERIES, _LLM_ORACLES = {}, {}
else:
    _LLM_QUERIES = {**corpus_queries.QUERIES, "pipeline": corpus_pipeline.run}
    _LLM_ORACLES = corpus_queries.ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


# ------------------------------------------------------------------ shared inputs

def _planted(value: str, key: str, digits: str):
    """``value``, null where the hash of the key starts with one of ``digits``."""
    first = F.substring(F.md5(F.concat(F.lit("plant:"), F.col(key).cast("string"))), 1, 1)
    return F.when(~first.isin(*digits), F.col(value))


def _planted_sql(value: str, key: str, digits: str) -> str:
    marks = ", ".join(f"'{d}'" for d in digits)
    return f"case when substr(md5('plant:' || cast({key} as varchar)), 1, 1) not in ({marks}) then {value} end"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as (key, label, probability, score) rows; the score has many ties."""
    o = _table(spark, sf_dir, "orders")
    p = F.col("o_totalprice") / (F.col("o_totalprice") + 100000.0)
    return o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"),
                    p.alias("p"), (F.floor(p * 1000.0) / 1000.0).alias("s"), "o_totalprice", "o_custkey")


_SCORED = """
scored as (
  select o_orderkey, cast(o_orderstatus = 'F' as int) as y, o_totalprice / (o_totalprice + 100000.0::double) as p,
         floor(o_totalprice / (o_totalprice + 100000.0::double) * 1000.0::double) / 1000.0::double as s,
         o_totalprice, o_custkey
  from orders)
"""


def _sparse_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a class-dependent share of missing priorities and prices."""
    o = _table(spark, sf_dir, "orders")
    is_f = F.col("o_orderstatus") == "F"
    return o.select(
        "o_orderkey", "o_orderstatus",
        F.when(is_f, _planted("o_orderpriority", "o_orderkey", "01")).otherwise(
            _planted("o_orderpriority", "o_orderkey", "0123456789")).alias("priority"),
        F.when(is_f, _planted("o_totalprice", "o_orderkey", "0123456")).otherwise(
            _planted("o_totalprice", "o_orderkey", "ab")).alias("price"),
        _planted("o_custkey", "o_orderkey", "c").alias("customer"))


_SPARSE = f"""
sparse as (
  select o_orderkey, o_orderstatus,
    case when o_orderstatus = 'F' then {_planted_sql('o_orderpriority', 'o_orderkey', '01')}
         else {_planted_sql('o_orderpriority', 'o_orderkey', '0123456789')} end as priority,
    case when o_orderstatus = 'F' then {_planted_sql('o_totalprice', 'o_orderkey', '0123456')}
         else {_planted_sql('o_totalprice', 'o_orderkey', 'ab')} end as price,
    {_planted_sql('o_custkey', 'o_orderkey', 'c')} as customer
  from orders)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text records with one column on each side of the role rules."""
    o = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.cast("string").alias("order key"), F.lpad(key.cast("string"), 12, "0").alias("padded_id"),
        F.lpad(F.pmod(F.col("o_custkey"), F.lit(50)).cast("string"), 5, "0").alias("zip"),
        F.lit("same").alias("constant"), F.lit(None).cast("string").alias("nothing"),
        "o_orderstatus", _planted("o_orderpriority", "o_orderkey", "0123456").alias("thin"),
        _planted("o_orderpriority", "o_orderkey", "012345").alias("full_enough"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.pmod(F.col("o_custkey"), F.lit(255)).cast("string").alias("cust_255"),
        F.concat(F.lit("c"), F.pmod(F.col("o_custkey"), F.lit(255)).cast("string")).alias("text_255"),
        F.concat(F.lit("c"), F.pmod(F.col("o_custkey"), F.lit(256)).cast("string")).alias("text_256"),
        F.when(F.pmod(key, F.lit(100)) == 0, F.lit("1d")).otherwise(key.cast("string")).alias("mixed"),
        F.concat(F.lit("+"), F.pmod(key, F.lit(97)).cast("string"), F.lit(".5e1")).alias("exponent"))


_RECORDS = f"""
records as (
  select cast(o_orderkey as varchar) as "order key", lpad(cast(o_orderkey as varchar), 12, '0') as padded_id,
    lpad(cast(o_custkey % 50 as varchar), 5, '0') as zip, 'same' as constant, cast(null as varchar) as nothing,
    o_orderstatus, {_planted_sql('o_orderpriority', 'o_orderkey', '0123456')} as thin,
    {_planted_sql('o_orderpriority', 'o_orderkey', '012345')} as full_enough,
    cast(o_totalprice as varchar) as price, cast(o_custkey % 255 as varchar) as cust_255,
    'c' || cast(o_custkey % 255 as varchar) as text_255, 'c' || cast(o_custkey % 256 as varchar) as text_256,
    case when o_orderkey % 100 = 0 then '1d' else cast(o_orderkey as varchar) end as mixed,
    '+' || cast(o_orderkey % 97 as varchar) || '.5e1' as exponent
  from orders)
"""

_RECORD_NAMES = ["order key", "padded_id", "zip", "constant", "nothing", "o_orderstatus", "thin", "full_enough",
                 "price", "cust_255", "text_255", "text_256", "mixed", "exponent"]

_INT = r"^[+-]?[0-9]+$"
_NUM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _profile_sql(names: list[str]) -> str:
    """Plain SQL profile: one aggregate per column."""
    parts = [
        f"""select '{n}' as "column", count(*) as "rows", count("{n}") as filled,
            count("{n}")::double / count(*) as fill_rate,
            min(length("{n}")) as min_length, max(length("{n}")) as max_length,
            coalesce(min(length("{n}")) = max(length("{n}")), false) as fixed_width,
            case when count("{n}") = 0 then 'float'
                 when bool_and(regexp_matches("{n}", '{_INT}')) filter (where "{n}" is not null) then 'integer'
                 when bool_and(regexp_matches("{n}", '{_NUM}')) filter (where "{n}" is not null) then 'float'
                 else 'string' end as type,
            count(distinct "{n}") + max(("{n}" is null)::int) as n_distinct
            from records""" for n in names]
    return " union all ".join(parts)


_ROLE_SQL = """
case when n_distinct < 2 or fill_rate < 0.6::double then 'dropped'
     when (type = 'string' or (type = 'integer' and fixed_width))
          and not (n_distinct::double / "rows" > 0.2::double or n_distinct > 255) then 'categorical'
     when type = 'integer' and fixed_width and (n_distinct::double / "rows" > 0.2::double or n_distinct > 255) then 'id'
     when type <> 'string' then 'numeric' else 'dropped' end
"""


def _draw(key: str, salt: str = "") -> str:
    return f"md5('123456:{salt}' || cast({key} as varchar))"


# ------------------------------------------------------------------------ queries

def q_read_delimited(spark, sf_dir):
    """Write customers as delimited text, read them back; quoting and missing tokens included."""
    c = _table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat("c_name", F.lit('\t"x"')).alias("full name"), "c_acctbal",
        F.when(F.col("c_mktsegment") == "MACHINERY", "N/A").otherwise(F.col("c_mktsegment")).alias("segment"))
    path = scratch_path(spark, "customer-tsv")
    write_delimited(c, path)
    back = read_delimited(spark, path, keep_blank=False)
    return back.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "full name",
                       F.col("c_acctbal").cast("double").alias("c_acctbal"), "segment")


def q_blank_lines(spark, sf_dir):
    """A blank line is a record of nulls; names come from the caller."""
    c = _table(spark, sf_dir, "customer")
    line = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(
        F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name"))
    path = scratch_path(spark, "customer-lines")
    c.select(line.alias("value")).write.text(path)
    back = read_delimited(spark, path, "|", header=["id", "name"])
    return back.select(F.col("id").cast("bigint").alias("id"), "name")


def q_encoding_fallback(spark, sf_dir):
    """Records that are not UTF-8 are latin-1."""
    c = _table(spark, sf_dir, "customer")
    name = F.concat(F.col("c_name"), F.lit(" é"))
    raw = F.when(F.col("c_mktsegment") == "MACHINERY", F.encode(name, "ISO-8859-1").cast("string")).otherwise(name)
    path = scratch_path(spark, "customer-mixed")
    c.select(F.concat(F.col("c_custkey").cast("string"), F.lit("\t"), raw).alias("value")).write.text(path)
    back = read_delimited(spark, path, header=["id", "name"], safe=True)
    return back.select(F.col("id").cast("bigint").alias("id"), "name")


def q_concat_by_name(spark, sf_dir):
    """A4: union of tables with partly different columns."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                                 F.col("c_mktsegment").alias("segment"))
    s = _table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"),
                                                 F.col("s_suppkey").alias("id"))
    return concat_by_name(c, s)


def q_headers_by_file(spark, sf_dir):
    """A4: one folder with files of three unlike headers; fields are placed by name."""
    folder = scratch_path(spark, "unlike-headers")
    write_delimited(_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), folder, mode="append")
    write_delimited(_table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")), folder, mode="append")
    write_delimited(_table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"),
                                                         F.col("p_brand").alias("segment")), folder, mode="append")
    back = read_delimited(spark, folder)
    return back.select(F.col("id").cast("bigint").alias("id"), "name", "segment", F.col("balance").cast("double").alias("balance"))


def q_quoted_breaks(spark, sf_dir):
    """Line breaks inside quotes and blank lines in files that are read in several splits."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    quoted_text = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("doc_id").cast("string"), quoted_text, F.col("n_chars").cast("string"))
    blank = F.pmod(F.col("doc_id"), F.lit(10)) == 3        # a blank line after the record
    path = scratch_path(spark, "quoted-breaks")
    docs.select(F.when(blank, F.concat(line, F.lit("\n"))).otherwise(line).alias("value")).write.text(path)
    names, bytes_before = ["id", "text", "n"], spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(512 << 10))
    try:
        back = materialize(read_delimited(spark, path, ",", header=names, multiline=True), "records")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_before)
    return back.select(F.col("id").cast("bigint").alias("id"), F.col("n").cast("bigint").alias("n"), F.md5("text").alias("digest"))


def q_file_chunks(spark, sf_dir):
    """Rows of files numbered in the order of files and rows, whatever the splits; chunks of 1,000 resumed at the third."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.monotonically_increasing_id().alias("at"))
    path = scratch_path(spark, "orders-file")
    # files in key order; equal keys stay as they were read, and share no file if there are many
    write_delimited(orders.orderBy("o_orderkey", "at").drop("at"), path)
    back = read_delimited(spark, path, row_number="n")
    return chunks(back, 1000, 2, number="n").select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), "n", "chunk")


def q_consolidate_missing(spark, sf_dir):
    """A5: every missing token becomes null, in all string columns."""
    tokens = list(MISSING_TOKENS)
    c = _table(spark, sf_dir, "customer")
    pick = F.element_at(F.lit(tokens), (F.pmod(F.col("c_custkey"), F.lit(len(tokens))) + 1).cast("int"))
    dirty = c.select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", pick).otherwise(
        F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_nationkey") == 7, "absent").otherwise(
        F.col("c_name")).alias("name"))
    return consolidate_missing(dirty, [*tokens, "absent"])


def q_chunk_resume(spark, sf_dir):
    """Numbered chunks in key order, resumed at the fourth."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return chunks(o, 1000, 3, order_by="o_orderkey")


def q_project_include_exclude(spark, sf_dir):
    """B1: names and patterns to include and exclude."""
    return project(_table(spark, sf_dir, "orders"), include=["o_orderstatus", "unknown"],
                   include_regex=["o_.*key", "total"], exclude_regex=["o_cust"])


def q_field_remap(spark, sf_dir):
    """Rename the columns that are present."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return field_remap(c, {"c_custkey": "id", "c_name": "first", "c_phone": "phone"})


def q_prefix_suffix(spark, sf_dir):
    """Prefix and suffix on appended fields."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return affix(c, "crm_", "_v1", keep=["c_custkey"])


def q_required_nonnull(spark, sf_dir):
    """Records without a required field are kept, but not looked up."""
    c = _table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"))
    return enrich_lookup(c, _table(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"}, unique=True,
                         required=["segment"])


def q_request_map(spark, sf_dir):
    """The request of a record: null fields dropped, constants filled in."""
    c = _table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"), "c_nationkey")
    request = request_map({"c_name": "first", "segment": "segment", "c_nationkey": "nation"},
                          {"cfg": "1", "segment": "any"})
    pairs = F.array_sort(F.transform(F.map_entries(request), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return c.select("c_custkey", F.concat_ws("&", pairs).alias("request"))


def q_booleanize_label(spark, sf_dir):
    """Text label to boolean and 0/1, null is negative."""
    o = _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("label"))
    out = booleanize_label(o, "label", "F")
    return out.withColumn("label_int", F.col("label").cast("int"))


def q_feature_cast(spark, sf_dir):
    """Categorical columns as text, numeric ones as double."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("string").alias("c_acctbal"),
                                                 F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("bad"))
    return cast_features(c, ["c_acctbal", "bad"], ["c_nationkey"], keep=["c_custkey"], strict=False)


def q_score_output(spark, sf_dir):
    """Whole scores beside kept fields; a taken name makes the score step aside."""
    o = _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("Score"), F.bround(F.col("o_totalprice") / 5000.0, 0).alias("raw"))
    return score_output(o, "raw", ["o_orderkey", "Score"])


def q_enrich_lookup(spark, sf_dir):
    """Orders enriched with their customer; every order once."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return enrich_lookup(o, c, {"o_custkey": "c_custkey"}, unique=True)


def q_append_dedupe(spark, sf_dir):
    """A lookup with many records per key still keeps every row exactly once."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return enrich_lookup(c, o, {"c_custkey": "o_custkey"})


def q_append_multi(spark, sf_dir):
    """Three lookups appended in order to every line item."""
    l = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    providers = [
        LookupProvider(ProviderSpec("lookup://part", required_fields="l_partkey", field_remap={"l_partkey": "part"},
                                    post_append_prefix="part_"), part, {"part": "p_partkey"}, unique=True),
        LookupProvider(ProviderSpec("lookup://supplier", post_append_suffix="_of_supplier"), supplier,
                       {"l_suppkey": "s_suppkey"}, unique=True),
        LookupProvider(ProviderSpec("lookup://orders"), orders, {"l_orderkey": "o_orderkey"}, unique=True)]
    return append_job(l, providers)


def q_stream_append(spark, sf_dir):
    """Files arrive in chunks, each is enriched and written to its numbered output."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    source, out = scratch_path(spark, "chunks-in"), scratch_path(spark, "chunks-out")
    write_delimited(c.repartition(4), source)
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), "n_name")
    provider = LookupProvider(ProviderSpec("lookup://nation", required_fields="c_nationkey"), nation,
                              {"c_nationkey": "key"}, unique=True)
    append_chunks(read_chunks(spark, source, c.columns, files_per_chunk=2), [provider],
                  OutputName(f"{out}/part_{{0:04d}}"), scratch_path(spark, "chunks-state"))
    back = read_delimited(spark, f"{out}/part_*", keep_blank=False)
    return back.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "n_name")


def _nation_facts() -> Callable:
    """A provider that needs no network: facts about a nation key; some keys are not known to it."""
    def facts(params, url, **_):
        key = int(params["nation"])
        if key % 5 == 4:
            raise KeyError(key)
        return {"double": 2 * key, "code": f"N{key:02d}"}

    return facts      # a closure travels to the workers by value


def q_provider_calls(spark, sf_dir):
    """A provider function asked once per distinct request, on a schedule, with an answer log that a second run goes on from."""
    c = _table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey")).alias("c_nationkey"))
    spec = ProviderSpec("local://nations", required_fields="c_nationkey", field_remap={"c_nationkey": "nation"},
                        queries_per_second=100, n_retry=1, retry_wait_time=0.01, post_append_prefix="nation_")
    log = scratch_path(spark, "provider-log")
    enrich_logged(c.where("c_custkey % 2 = 0"), spec, _nation_facts(), ["double", "code"], log=log)      # an earlier run over half of the rows
    return enrich_logged(c, spec, _nation_facts(), ["double", "code"], log=log, success="answered")


def q_append_collision(spark, sf_dir):
    """An appended field whose name is taken gets ``_append``."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), "s_nationkey")
    n = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), "n_regionkey")
    return append_all(s, [LookupProvider(ProviderSpec("lookup://nation"), n, {"s_nationkey": "n_nationkey"}, unique=True)])


def q_json_unpack(spark, sf_dir):
    """JSON answers: a plain object, and the first of a wrapped result list."""
    e = _table(spark, sf_dir, "events").select("event_id", "props")
    m = F.pmod(F.col("event_id"), F.lit(4))
    answer = (F.when(m == 0, F.concat(F.lit('{"acme":{"results":['), "props", F.lit(',{"k":-1}]}}')))
              .when(m == 1, F.concat(F.lit('{"Acme":{"results":['), "props", F.lit("]}}")))
              .when(m == 2, F.lit('{"acme":{"results":[]}}')).otherwise(F.lit('{"acme":{"results":["text"]}}')))
    return e.withColumn("answer", answer).select(
        "event_id", json_fields(F.col("props"), "k bigint")["k"].alias("plain"),
        *[c.cast("bigint").alias("first") for c in first_result_column(F.col("answer"), "acme", ["k"])])


def q_append_stats(spark, sf_dir):
    """Records and success rate of an append."""
    e = q_required_nonnull(spark, sf_dir)
    return _round(append_statistics(e, F.col("n_name").isNotNull()), "success_rate")


def q_fill_rates(spark, sf_dir):
    """Share of filled values per field and class."""
    return _round(fill_rates(_sparse_orders(spark, sf_dir), "o_orderstatus", "F", ["priority", "price", "customer"]),
                  "rate_positive", "rate_negative")


def q_balance_fill(spark, sf_dir):
    """Seeded removal of values until both classes are equally filled."""
    return balance_fill_rates(_sparse_orders(spark, sf_dir), "o_orderkey", "o_orderstatus", "F",
                              ["priority", "price", "customer"])


def q_infer_types(spark, sf_dir):
    """Integer, float or string."""
    return infer_types(_records(spark, sf_dir))


def q_profile_columns(spark, sf_dir):
    """Rows, fill, lengths, width, type and distinct values per column."""
    return _round(profile_columns(_records(spark, sf_dir)), "fill_rate")


def q_feature_roles(spark, sf_dir):
    """E5: categorical, numeric, id or dropped, from the screened profile."""
    return feature_roles(profile_columns(_records(spark, sf_dir), exact=False)).select("column", "type", "role")


def q_select_features(spark, sf_dir):
    """Fitted selection with casts; the key stays."""
    r = _records(spark, sf_dir)
    model = FeatureSelector(excludeFields=["order key", "text_256"]).fit(r)
    return model.transform(r).select("order key", *[quoted(c) for c in model.feature_names])


def q_label_counts(spark, sf_dir):
    """Rows per label value."""
    return label_counts(_table(spark, sf_dir, "labels"), "quality")


def q_stratified_split(spark, sf_dir):
    """seeded stratified hold-out."""
    return stratified_split(_scored(spark, sf_dir).select("o_orderkey", "y"), "o_orderkey", "y")


def q_kfold(spark, sf_dir):
    """seeded stratified folds."""
    return stratified_folds(_scored(spark, sf_dir).select("o_orderkey", "y"), "o_orderkey", "y", 5)


def q_balanced_sample(spark, sf_dir):
    """the same number of rows from both classes."""
    return balanced_sample(_scored(spark, sf_dir).select("o_orderkey", "y"), "o_orderkey", "y", 500)


class _GroupRate:
    """A tiny model for out-of-fold prediction: positive share per priority."""

    def __init__(self, rates: DataFrame):
        self.rates = rates

    def transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.rates, "o_orderpriority", "left")


def q_out_of_fold(spark, sf_dir):
    """every row predicted by a model fitted without its fold."""
    o = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    folds = stratified_folds(o, "o_orderkey", "y", 5)
    fit = lambda d: _GroupRate(d.groupBy("o_orderpriority").agg(F.avg("y").alias("rate")))
    return _round(out_of_fold(folds, fit, 5, "fold").select("o_orderkey", "fold", "rate"), "rate")


def q_cross_validated(spark, sf_dir):
    """mean area under the curve on the training and the test side of five folds."""
    o = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    folds = cached(stratified_folds(o, "o_orderkey", "y", 5))
    fit = lambda d: _GroupRate(d.groupBy("o_orderpriority").agg(F.avg("y").alias("rate")))
    scores = cross_validated_score(folds, fit, 5, lambda d: auc_value(d, "y", "rate"), "fold")
    folds.unpersist()
    return _round(spark.createDataFrame([(scores["train"], scores["test"])], "train double, test double"), "train", "test")


def q_ordinal_encode(spark, sf_dir):
    """G1: position among the sorted categories, null for missing."""
    s = _sparse_orders(spark, sf_dir).select("o_orderkey", "priority", "o_orderstatus")
    return ordinal_encode(s, ["priority", "o_orderstatus"])


def q_impute_indicator(spark, sf_dir):
    """Training median and a mark for missing numbers."""
    s = _sparse_orders(spark, sf_dir).select("o_orderkey", "price", "customer")
    return _round(impute_indicator(s, ["price", "customer"]), "price", "customer")


def _document_features(spark, sf_dir) -> DataFrame:
    text = F.col("text")

    def count_of(chars: str):
        return F.length(text) - F.length(F.translate(text, chars, ""))

    return _table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", (count_of(" ") + 1).alias("n_words"),
        count_of("0123456789").alias("n_digits"), count_of("\n").alias("n_lines"), count_of(".!?").alias("n_stops"))


def _labelled_documents(spark, sf_dir) -> DataFrame:
    return _document_features(spark, sf_dir).join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def q_train_score(spark, sf_dir):
    """The training job with its defaults on the labelled documents, then a score of every document.

    ``quality`` is null where a document has no label.
    """
    labelled = cached(_labelled_documents(spark, sf_dir))
    factory, _ = train_job(labelled, "quality", 1, key="doc_id", insights=False)
    labelled.unpersist()
    scored = score_job(_document_features(spark, sf_dir), factory.model, include=["doc_id"])
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return scored.join(labels, "doc_id", "left").select("doc_id", "quality", "Score")


def q_search(spark, sf_dir):
    """Seeded random search with its default space, rounds and folds, cross-validated; one row per trial."""
    docs = cached(_labelled_documents(spark, sf_dir))
    features = fit_feature_pipeline(docs, FeatureSelector(labelCol="quality", excludeFields=["doc_id", "source"]).fit(docs))
    table = cached(features.transform(docs.withColumns({ID: order_hash("doc_id"), LABEL: F.col("quality").cast("double")}))
                   .select(ID, LABEL, FEATURES))
    factory = CalibratedTreesFactory(scoring=["roc_auc", "average_precision", "neg_log_loss"])
    factory.optimize(table)
    table.unpersist()
    docs.unpersist()
    rows = [(i, float(t["params"].stepSize), t["params"].maxIter, t["params"].maxLeaves, t["params"].maxDepth,
             t["params"].minInstancesPerNode, t["train"], t["test"], t["scores"]["average_precision"]["test"],
             t["scores"]["neg_log_loss"]["test"]) for i, t in enumerate(factory.trials)]
    return spark.createDataFrame(rows, "trial int, step_size double, rounds int, leaves int, depth int, least int, train double, "
                                       "test double, average_precision double, neg_log_loss double")


def _quantile_input(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The train side of the stratified split, and all rows."""
    rows = _scored(spark, sf_dir).select("o_orderkey", "y", "s")
    return stratified_split(rows, "o_orderkey", "y").where("split = 'train'"), rows


def q_quantile_fit(spark, sf_dir):
    """H1: up to 1000 exact interpolated quantiles."""
    train, _ = _quantile_input(spark, sf_dir)
    return _round(QuantileScore(inputCol="s").quantile_table(train), "value")


def q_quantile_score(spark, sf_dir):
    """H2: training rank of a value as a score from 0 to 100."""
    train, rows = _quantile_input(spark, sf_dir)
    model = QuantileScore(inputCol="s").fit(train)
    return model.transform(rows).select("o_orderkey", F.col("score").cast("bigint").alias("score"))


def q_split_counts(spark, sf_dir):
    """Rows per split and class."""
    return curves.split_counts(q_stratified_split(spark, sf_dir), "split", "y")


def q_split_summary(spark, sf_dir):
    """Class counts of both parts, feature count and test share."""
    return _round(curves.split_summary(q_stratified_split(spark, sf_dir), "split", "y", 7), "test_ratio")


def q_decile_lift(spark, sf_dir):
    """Positives per score decile against an even spread."""
    return _round(curves.decile_lift(_scored(spark, sf_dir), "y", "o_totalprice"), "lift")


def q_roc_curve(spark, sf_dir):
    """ROC points without those on straight lines."""
    return _round(curves.roc_curve(_scored(spark, sf_dir), "y", "s"), "threshold", "fpr", "tpr")


def q_roc_auc(spark, sf_dir):
    """I4: area under the ROC curve, ties count half."""
    return _round(curves.roc_auc(_scored(spark, sf_dir), "y", "s"), "roc_auc")


def q_calibration(spark, sf_dir):
    """Observed share against mean probability in ten bins."""
    return _round(curves.calibration_curve(_scored(spark, sf_dir), "y", "p"), "prob_true", "prob_pred")


def q_prob_hist(spark, sf_dir):
    """Ten bins of the probability."""
    return _round(curves.probability_histogram(_scored(spark, sf_dir), "p"), "low", "high")


def q_score_hist(spark, sf_dir):
    """Ten bins of a score between its lowest and highest value."""
    return _round(curves.score_histogram(_scored(spark, sf_dir), "o_totalprice"), "low", "high")


def q_score_hist_100(spark, sf_dir):
    """Ten bins of 0-100 scores."""
    rows = _scored(spark, sf_dir).select((F.floor(F.col("p") * 100.0)).cast("double").alias("score"))
    return _round(curves.score_histogram(rows, "score"), "low", "high")


def q_threshold_curve(spark, sf_dir):
    """I8: counts at or above each threshold."""
    return _round(curves.threshold_curve(_scored(spark, sf_dir), "y", "p"), "threshold", "tpr", "fpr")


def q_threshold_weighted(spark, sf_dir):
    """I8: the same with row weights; rows of weight zero do not count."""
    rows = _scored(spark, sf_dir).withColumn("w", F.pmod(F.col("o_custkey"), F.lit(3)))
    return _round(curves.threshold_curve(rows, "y", "p", weight="w"), "threshold", "tps", "fps", "fns", "tns", "tpr", "fpr")


def q_threshold_metrics(spark, sf_dir):
    """Quality measures per threshold."""
    out = curves.threshold_metrics(curves.threshold_curve(_scored(spark, sf_dir), "y", "p"))
    return _round(out, "threshold", "accuracy", "balanced_accuracy", "recall", "precision", "f1", "mcc")


def _importance(spark, sf_dir) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderpriority") < "3").cast("int").alias("y"), "o_totalprice", "o_orderpriority",
        "o_orderstatus")
    sample = balanced_sample(o, "o_orderkey", "y", 500)
    weight = F.when(F.col("o_orderpriority") < "3", 0.5).otherwise(0.0)
    scorer = lambda d: d.withColumn(
        "score", F.floor(F.col("o_totalprice") / 10000.0) / 100.0 + weight
        + F.when(F.col("o_orderstatus") == "F", 0.25).otherwise(0.0))
    return importance.permutation_importance(
        sample, "o_orderkey", "y", ["o_totalprice", "o_orderpriority", "o_orderstatus"], scorer)


def q_perm_importance(spark, sf_dir):
    """Drop of the area under the curve when one feature is shuffled."""
    return _round(_importance(spark, sf_dir), "importance")


def q_relative_importance(spark, sf_dir):
    """Mean, spread and share of importance per feature."""
    return _round(importance.importance_summary(_importance(spark, sf_dir)), "mean", "std", "relative")


def q_average_importance(spark, sf_dir):
    """Features by average relative importance, positive ones only."""
    summary = importance.importance_summary(_importance(spark, sf_dir))
    return _round(importance.average_importance(summary), "average_relative_importance")


def q_unpivot(spark, sf_dir):
    """Wide to long, then the mean per name."""
    l = _table(spark, sf_dir, "lineitem")
    names = ["l_quantity", "l_discount", "l_tax"]
    return _round(importance.mean_by_feature(importance.wide_to_long(l, names)), "importance")


def _copied_keys(spark, sf_dir):
    """Orders by a key that 60 % of the rows share; ``v`` is filled for all of one class and a quarter of the other."""
    y = (F.col("o_orderstatus") == "F").cast("int")
    return _table(spark, sf_dir, "orders").select(
        y.alias("y"), F.when(F.col("o_orderkey") % 5 < 3, 0).otherwise(F.col("o_custkey")).cast("bigint").alias("k"),
        F.when((y == 1) | (F.col("o_orderkey") % 4 == 0), F.col("o_totalprice")).alias("v"))


def q_split_copies(spark, sf_dir):
    """exact hold-out sizes where many rows share a key."""
    got = stratified_split(_copied_keys(spark, sf_dir), "k", "y")
    return got.groupBy("y", "k", "split").agg(F.count(F.lit(1)).alias("n"))


def q_fold_copies(spark, sf_dir):
    """even folds where many rows share a key."""
    got = stratified_folds(_copied_keys(spark, sf_dir), "k", "y", 5)
    return got.groupBy("y", "k", "fold").agg(F.count(F.lit(1)).alias("n"))


def q_sample_copies(spark, sf_dir):
    """a sample of exact size where many rows share a key."""
    return balanced_sample(_copied_keys(spark, sf_dir), "k", "y", 500).groupBy("y", "k").agg(F.count(F.lit(1)).alias("n"))


def q_balance_copies(spark, sf_dir):
    """As many values removed as the gap asks for where many rows share a key."""
    got = balance_fill_rates(_copied_keys(spark, sf_dir), "k", "y", 1, ["v"])
    return got.groupBy("y", "k").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("filled"))


_QUERIES = [
    q_split_copies, q_fold_copies, q_sample_copies, q_balance_copies,
    q_read_delimited, q_blank_lines, q_encoding_fallback, q_concat_by_name, q_headers_by_file, q_quoted_breaks, q_file_chunks,
    q_consolidate_missing, q_chunk_resume,
    q_project_include_exclude, q_field_remap, q_prefix_suffix, q_required_nonnull, q_request_map, q_booleanize_label,
    q_feature_cast, q_score_output, q_enrich_lookup, q_append_dedupe, q_append_multi, q_stream_append, q_provider_calls, q_append_collision,
    q_json_unpack, q_append_stats, q_fill_rates, q_balance_fill, q_infer_types, q_profile_columns, q_feature_roles,
    q_select_features, q_label_counts, q_stratified_split, q_kfold, q_balanced_sample, q_out_of_fold, q_cross_validated,
    q_ordinal_encode, q_impute_indicator, q_train_score, q_search, q_quantile_fit, q_quantile_score, q_split_counts,
    q_split_summary, q_decile_lift, q_roc_curve, q_roc_auc, q_calibration, q_prob_hist, q_score_hist,
    q_score_hist_100, q_threshold_curve, q_threshold_weighted, q_threshold_metrics, q_perm_importance,
    q_relative_importance, q_average_importance, q_unpivot,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{q.__name__: q for q in _QUERIES}, **_LLM_QUERIES}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: train on labelled documents and score them."""
    return q_train_score(spark, "/root/testdata/sf0.001")


# -------------------------------------------------------------------------- oracle

_SPLIT = f"""
split as (
  select o_orderkey, y, case when row_number() over (partition by y order by {_draw('o_orderkey')})
         <= ceil(count(*) over (partition by y) * 0.2::double) then 'test' else 'train' end as split
  from scored)
"""


_COPIED = """
copied as (
  select y, k, case when y = 1 or o_orderkey % 4 = 0 then o_totalprice end as v from (
    select cast(o_orderstatus = 'F' as int) as y, cast(case when o_orderkey % 5 < 3 then 0 else o_custkey end as bigint) as k,
           o_orderkey, o_totalprice from orders))
"""


def _copy_groups(salt: str = "", counted: str = "*", where: str = "true") -> str:
    """Groups of one key with the rows before them in draw order and the rows of their class."""
    return f"""{_COPIED}, sized as (select y, k, count({counted}) as n from copied where {where} group by all),
placed as (select *, cast(sum(n) over (partition by y order by {_draw('k', salt)} rows unbounded preceding) as bigint) - n as before,
                  cast(sum(n) over (partition by y) as bigint) as total from sized)"""


_FOLD_RATES = f"""
folds as (select o_orderkey, o_orderpriority, y,
    cast(((row_number() over (partition by y order by {_draw('o_orderkey')}) - 1) * 5)
         // count(*) over (partition by y) as int) as fold
    from scored join (select o_orderkey, o_orderpriority from orders) using (o_orderkey)),
parts as (select o_orderpriority, fold, sum(y) as p, count(*) as n from folds group by all),
rates as (select a.o_orderpriority, b.fold, sum(p) filter (where a.fold <> b.fold)::double
          / sum(n) filter (where a.fold <> b.fold) as rate
          from parts a, range(0, 5) b(fold) group by all)
"""


def _quantiles_sql(source: str, value: str, points: str) -> str:
    """Interpolated quantiles by integer positions: columns k, value, n."""
    return f"""
    ranked as (select {value} as v, row_number() over (order by {value}) - 1 as r, count(*) over () as n
               from {source} where {value} is not null),
    size as (select max(n) as n, least({points}, max(n)) as m from ranked),
    spots as (select k, n, m, (k * (n - 1)) // (m - 1) as lo, (k * (n - 1)) % (m - 1) as part
              from size, range(0, 1000) t(k) where k < m),
    quantiles as (select k, a.v + (b.v - a.v) * (part / (m - 1)::double) as value, spots.n
                  from spots join ranked a on a.r = lo join ranked b on b.r = lo + (part > 0)::int)"""


_CURVE = f"""
with {_SCORED},
grid as (select g from (select floor(round((greatest(0, min(p) - 0.001::double)) * 1000)) as lo,
                               floor(round((max(p) + 0.001::double) * 1000)) as hi from scored) b,
         lateral (select unnest(generate_series(lo::bigint, hi::bigint)) as g) s),
curve as (select g / 1000::double as threshold,
    (select count(*) from scored where y = 1 and p >= g / 1000::double) as tp,
    (select count(*) from scored where y = 0 and p >= g / 1000::double) as fp from grid),
total as (select sum(y)::bigint as pos, sum(1 - y)::bigint as neg from scored)
"""

_IMPORTANCE = f"""
with base as (select o_orderkey, cast(o_orderpriority < '3' as int) as y, o_totalprice, o_orderpriority, o_orderstatus
              from orders),
sizes as (select least(500, count(*) filter (where y = 1), count(*) filter (where y = 0)) as m from base),
sample as (select * exclude (rn) from (
    select *, row_number() over (partition by y order by {_draw('o_orderkey')}) as rn from base), sizes where rn <= m),
places as (select *, row_number() over (order by {_draw('o_orderkey', 'base:')}) as spot from sample),
cells as (select f, r, name from (values (0, 'o_totalprice'), (1, 'o_orderpriority'), (2, 'o_orderstatus')) v(f, name),
          range(0, 10) t(r)),
donors as (select f, r, name, o_totalprice as d0, o_orderpriority as d1, o_orderstatus as d2,
    row_number() over (partition by f, r order by md5('123456:' || name || ':' || cast(r as varchar) || ':' || cast(o_orderkey as varchar))) as spot
    from sample, cells),
swapped as (
    select y, f, r, name, case when f = 0 then d0 else o_totalprice end as price,
           case when f = 1 then d1 else o_orderpriority end as prio, case when f = 2 then d2 else o_orderstatus end as status
    from places join donors using (spot)
    union all select y, -1, 0, '', o_totalprice, o_orderpriority, o_orderstatus from sample),
marked as (select *, floor(price / 10000.0::double) / 100.0::double + case when prio < '3' then 0.5::double else 0 end
                  + case when status = 'F' then 0.25::double else 0 end as score from swapped),
ranks as (select *, rank() over (partition by f, r order by score) + (count(*) over (partition by f, r, score) - 1) / 2.0::double as mid
          from marked),
auc as (select f, r, any_value(name) as name, (sum(mid) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0::double)
               / (sum(y) * (count(*) - sum(y)))::double as v from ranks group by f, r),
raw as (select 'roc_auc' as metric, name as feature, r as repeat, (select v from auc where f = -1) - v as importance
        from auc where f >= 0),
per as (select metric, feature, avg(importance) as mean, stddev_pop(importance) as std from raw group by all),
summary as (select *, greatest(mean, 0) / nullif(sum(greatest(mean, 0)) over (partition by metric), 0) as relative from per)
"""

_TENTHS = "(select count(*) from range(1, 10) t(k) where {x} {op} {low} + k * {step})"


def oracle_sql() -> dict[str, str]:
    tokens = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
    planted_segment = "nullif(c_mktsegment, 'MACHINERY')"
    return {
        **_LLM_ORACLES,
        "q_read_delimited": """
            select c_custkey, c_name || chr(9) || '"x"' as "full name", c_acctbal,
                   nullif(c_mktsegment, 'MACHINERY') as segment from customer""",
        "q_blank_lines": """
            select case when c_mktsegment <> 'MACHINERY' then c_custkey end as id,
                   case when c_mktsegment <> 'MACHINERY' then c_name end as name from customer""",
        "q_encoding_fallback": "select c_custkey as id, c_name || ' é' as name from customer",
        "q_concat_by_name": """
            select c_custkey as id, c_name as name, c_mktsegment as segment from customer
            union all by name select s_acctbal as balance, s_name as name, s_suppkey as id from supplier""",
        "q_headers_by_file": """
            select c_custkey as id, c_name as name, c_mktsegment as segment from customer
            union all by name select s_acctbal as balance, s_name as name, s_suppkey as id from supplier
            union all by name select p_name as name, p_partkey as id, p_brand as segment from part""",
        "q_quoted_breaks": """
            select doc_id as id, n_chars as n, md5(text) as digest from documents
            union all select null, null, null from documents where doc_id % 10 = 3""",
        "q_file_chunks": """
            select * from (select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as n,
                                  (row_number() over (order by o_orderkey) - 1) // 1000 as chunk from orders) where chunk >= 2""",
        "q_consolidate_missing": f"""
            select c_custkey, case when segment not in ({tokens}) then segment end as segment, nullif(name, 'absent') as name
            from (select c_custkey, case when c_mktsegment = 'MACHINERY' then 'N/A' else c_mktsegment end as segment,
                  case when c_nationkey = 7 then 'absent' else c_name end as name from customer)""",
        "q_chunk_resume": """
            select * from (select o_orderkey, o_custkey, (row_number() over (order by o_orderkey) - 1) // 1000 as chunk
            from orders) where chunk >= 3""",
        "q_project_include_exclude": "select o_orderkey, o_orderstatus from orders",
        "q_field_remap": "select c_custkey as id, c_name as first, c_nationkey from customer",
        "q_prefix_suffix": "select c_custkey, c_name as crm_c_name_v1, c_acctbal as crm_c_acctbal_v1 from customer",
        "q_required_nonnull": f"""
            select c_custkey, c_nationkey, {planted_segment} as segment,
                   case when {planted_segment} is not null then n_name end as n_name,
                   case when {planted_segment} is not null then n_regionkey end as n_regionkey
            from customer left join nation on c_nationkey = n_nationkey""",
        "q_request_map": f"""
            select c_custkey, 'cfg=1&first=' || c_name || '&nation=' || cast(c_nationkey as varchar)
                   || '&segment=' || coalesce({planted_segment}, 'any') as request from customer""",
        "q_booleanize_label": """
            select o_orderkey, o_orderstatus = 'F' as label, cast(o_orderstatus = 'F' as int) as label_int from orders""",
        "q_feature_cast": """
            select c_custkey, cast(c_nationkey as varchar) as c_nationkey, c_acctbal, cast(null as double) as bad
            from customer""",
        "q_score_output": """
            select o_orderkey, o_orderstatus as "Score",
                   cast(round_even(o_totalprice / 5000.0::double, 0) as bigint) as "Score_SCORED" from orders""",
        "q_enrich_lookup": """
            select o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment, c_acctbal
            from orders left join customer on o_custkey = c_custkey""",
        "q_append_dedupe": """
            select c_custkey, c_name, o_orderkey, o_orderstatus from customer left join
            (select o_custkey, min(o_orderkey) as o_orderkey, arg_min(o_orderstatus, o_orderkey) as o_orderstatus
             from orders group by o_custkey) on c_custkey = o_custkey""",
        "q_append_multi": """
            select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_brand as part_p_brand,
                   p_size as part_p_size, s_name as s_name_of_supplier, o_orderstatus, o_totalprice
            from lineitem left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey
            left join orders on l_orderkey = o_orderkey""",
        "q_stream_append": """
            select c_custkey, c_name, n_name from customer left join nation on c_nationkey = n_nationkey""",
        "q_provider_calls": """
            select c_custkey, k as c_nationkey, case when k % 5 <> 4 then (2 * k)::varchar end as nation_double,
                   case when k % 5 <> 4 then 'N' || lpad(k::varchar, 2, '0') end as nation_code, coalesce(k % 5 <> 4, false) as answered
            from (select c_custkey, case when c_mktsegment <> 'MACHINERY' then c_nationkey end as k from customer)""",
        "q_append_collision": """
            select s_suppkey, s_name as name, s_nationkey, n_name as name_append, n_regionkey
            from supplier left join nation on s_nationkey = n_nationkey""",
        "q_json_unpack": """
            select event_id, cast(json_extract_string(props, '$.k') as bigint) as plain,
                   case when event_id % 4 < 2 then cast(json_extract_string(props, '$.k') as bigint) end as first
            from events""",
        "q_append_stats": f"""
            select count(*) as records, round(avg(({planted_segment} is not null)::int), 6) as success_rate from customer""",
        "q_fill_rates": "with " + _SPARSE + " " + " union all ".join(f"""
            select '{f}' as field, count(*) filter (where o_orderstatus = 'F') as n_positive,
                   count(*) filter (where o_orderstatus <> 'F') as n_negative,
                   count({f}) filter (where o_orderstatus = 'F') as filled_positive,
                   count({f}) filter (where o_orderstatus <> 'F') as filled_negative,
                   round(avg(({f} is not null)::int) filter (where o_orderstatus = 'F'), 6) as rate_positive,
                   round(avg(({f} is not null)::int) filter (where o_orderstatus <> 'F'), 6) as rate_negative
            from sparse""" for f in ("priority", "price", "customer")),
        "q_balance_fill": "with " + _SPARSE + "," + ",".join(f"""
            rate_{f} as (select p > n as fuller, case when abs(p - n) > 0.1::double then
                floor(abs(p - n) * case when p > n then np else nn end) else 0 end as removal from (
                select count({f}) filter (where o_orderstatus = 'F')::double / count(*) filter (where o_orderstatus = 'F') as p,
                       count({f}) filter (where o_orderstatus <> 'F')::double / count(*) filter (where o_orderstatus <> 'F') as n,
                       count(*) filter (where o_orderstatus = 'F') as np, count(*) filter (where o_orderstatus <> 'F') as nn
                from sparse))""" for f in ("priority", "price", "customer")) + """
            select o_orderkey, o_orderstatus, """ + ", ".join(f"""
                case when (o_orderstatus = 'F') = (select fuller from rate_{f}) and
                     row_number() over (partition by o_orderstatus = 'F', {f} is null order by {_draw('o_orderkey', f + ':')})
                     <= (select removal from rate_{f}) then null else {f} end as {f}"""
                for f in ("priority", "price", "customer")) + " from sparse",
        "q_infer_types": f"with {_RECORDS} select \"column\", type from ({_profile_sql(_RECORD_NAMES)})",
        "q_profile_columns": f"""
            with {_RECORDS} select * replace (round(fill_rate, 6) as fill_rate) from ({_profile_sql(_RECORD_NAMES)})""",
        "q_feature_roles": f"""
            with {_RECORDS} select "column", type, {_ROLE_SQL} as role from ({_profile_sql(_RECORD_NAMES)})""",
        "q_select_features": f"""
            with {_RECORDS} select "order key", zip, o_orderstatus, full_enough, cast(price as double) as price,
            cast(cust_255 as double) as cust_255, text_255, cast(exponent as double) as exponent from records""",
        "q_label_counts": "select quality, count(*) as n from labels group by quality",
        "q_stratified_split": f"with {_SCORED}, {_SPLIT} select * from split",
        "q_kfold": f"""
            with {_SCORED} select o_orderkey, y, cast(((row_number() over (partition by y order by {_draw('o_orderkey')}) - 1)
            * 5) // count(*) over (partition by y) as int) as fold from scored""",
        "q_split_copies": f"""
            with {_copy_groups()}, cut as (
              select *, greatest(0, least(n, cast(ceil(total * 0.2::double) as bigint) - before)) as test from placed)
            select y, k, 'test' as split, test as n from cut where test > 0
            union all select y, k, 'train' as split, n - test as n from cut where n > test""",
        "q_fold_copies": f"""
            with {_copy_groups()}, edges as (
              select *, cast(f as int) as fold, (f * total + 4) // 5 as lo, ((f + 1) * total + 4) // 5 as hi
              from placed, range(5) t(f))
            select y, k, fold, least(before + n, hi) - greatest(before, lo) as n from edges
            where least(before + n, hi) > greatest(before, lo)""",
        "q_sample_copies": f"""
            with {_copy_groups()}, sizes as (select least(500, min(total)) as m from placed)
            select y, k, least(n, m - before) as n from placed, sizes where before < m""",
        "q_balance_copies": f"""
            with {_copy_groups('v:', 'v', 'v is not null')}, sums as (
              select count(*) filter (where y = 1) as p, count(v) filter (where y = 1) as fp,
                     count(*) filter (where y = 0) as q, count(v) filter (where y = 0) as fq from copied),
            drop_of as (select cast(trunc((fp::double / p::double - fq::double / q::double) * p) as bigint) as m from sums)
            select y, k, count(*) as n, count(v) - coalesce(max(case when c.y = 1 then greatest(0, least(g.n, m - g.before)) end), 0)
                   as filled
            from copied c left join placed g using (y, k), drop_of group by y, k""",
        "q_balanced_sample": f"""
            with {_SCORED}, sizes as (select least(500, sum(y), sum(1 - y)) as m from scored)
            select o_orderkey, y from (select *, row_number() over (partition by y order by {_draw('o_orderkey')}) as rn
            from scored), sizes where rn <= m""",
        "q_out_of_fold": f"""
            with {_SCORED}, {_FOLD_RATES}
            select o_orderkey, fold, round(rate, 6) as rate from folds left join rates using (o_orderpriority, fold)""",
        "q_cross_validated": f"""
            with {_SCORED}, {_FOLD_RATES},
            sides as (select r.fold as model, f.fold = r.fold as test, y, rate
                      from folds f join rates r using (o_orderpriority)),
            mids as (select model, test, y, rank() over (partition by model, test order by rate)
                     + (count(*) over (partition by model, test, rate) - 1) / 2.0::double as mid from sides),
            auc as (select model, test, (sum(mid) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0::double)
                    / (sum(y)::double * sum(1 - y)::double) as v from mids group by model, test)
            select round(avg(v) filter (where not test), 6) as train, round(avg(v) filter (where test), 6) as test from auc""",
        "q_ordinal_encode": f"""
            with {_SPARSE} select o_orderkey, priority, o_orderstatus,
            case when priority is not null then dense_rank() over (order by priority nulls last) - 1 end as priority_code,
            dense_rank() over (order by o_orderstatus) - 1 as o_orderstatus_code from sparse""",
        "q_impute_indicator": f"""
            with {_SPARSE}, m as (select quantile_cont(price, 0.5) as mp, quantile_cont(customer::double, 0.5) as mc from sparse)
            select o_orderkey, round(coalesce(price, mp), 6) as price, round(coalesce(customer::double, mc), 6) as customer,
                   (price is null)::int as price_missing, (customer is null)::int as customer_missing from sparse, m""",
        "q_quantile_fit": f"""
            with {_SCORED}, {_SPLIT}, train as (select s from scored join split using (o_orderkey) where split = 'train'), {_quantiles_sql('train', 's', '1000')}
            select k, round(value, 6) as value, n from quantiles""",
        "q_quantile_score": f"""
            with {_SCORED}, {_SPLIT}, train as (select s from scored join split using (o_orderkey) where split = 'train'), {_quantiles_sql('train', 's', '1000')},
            knots as (select value as v, min(k) / 999::double as first, max(k) / 999::double as last from quantiles group by value),
            linked as (select *, lead(v) over (order by v) as next_v, lead(first) over (order by v) as next_first from knots),
            ends as (select min(v) as lo, max(v) as hi from knots)
            select o_orderkey, cast(round_even(100.0::double * case
                when s <= lo then 0.0::double when s >= hi then 1.0::double when s = v then (first + last) / 2
                else last + (next_first - last) * (s - v) / (next_v - v) end, 0) as bigint) as score
            from scored cross join ends asof left join linked on s >= v""",
        "q_split_counts": f"""
            with {_SCORED}, {_SPLIT} select split, y = 1 as positive, count(*) as n from split group by all""",
        "q_split_summary": f"""
            with {_SCORED}, {_SPLIT} select count(*) filter (where split = 'train' and y = 1) as n_train_positive,
            count(*) filter (where split = 'train' and y = 0) as n_train_negative,
            count(*) filter (where split = 'test' and y = 1) as n_test_positive,
            count(*) filter (where split = 'test' and y = 0) as n_test_negative, 7 as n_features,
            round(count(*) filter (where split = 'test') / count(*)::double, 6) as test_ratio from split""",
        "q_decile_lift": f"""
            with {_SCORED}, {_quantiles_sql('scored', 'o_totalprice', '11')},
            bins as (select y, (select count(*) from quantiles where k between 1 and 9 and value < o_totalprice) as b from scored)
            select case when b = 0 then '1-10' else cast(b * 10 + 1 as varchar) || '-' || cast(b * 10 + 10 as varchar) end as decile,
                   sum(y)::bigint as positives, round(sum(y) / ((select sum(y) from scored) / 10.0::double), 6) as lift
            from bins group by b""",
        "q_roc_curve": f"""
            with {_SCORED}, ties as (select s, sum(y)::bigint as pos, sum(1 - y)::bigint as neg from scored group by s),
            points as (select *, sum(pos) over w as tp, sum(neg) over w as fp, lead(pos) over w as np, lead(neg) over w as nn,
                       row_number() over w as rn from ties window w as (order by s desc)),
            total as (select sum(pos)::double as p, sum(neg)::double as n from ties),
            kept as (select * from points where rn = 1 or np is null or np <> pos or nn <> neg)
            select round(s, 6) as threshold, round(fp / n, 6) as fpr, round(tp / p, 6) as tpr from kept, total
            union all select round(max(s) + 1, 6), 0.0::double, 0.0::double from scored""",
        "q_roc_auc": f"""
            with {_SCORED}, mids as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as mid
            from scored) select round((sum(mid) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0::double)
            / (sum(y)::double * sum(1 - y)::double), 6) as roc_auc, sum(y)::bigint as n_positive,
            sum(1 - y)::bigint as n_negative from mids""",
        "q_calibration": f"""
            with {_SCORED}, bins as (select y, p, {_TENTHS.format(x='p', op='>', low='0', step='0.1::double')} as bin from scored)
            select bin, count(*) as n, round(avg(y::double), 6) as prob_true, round(avg(p), 6) as prob_pred from bins group by bin""",
        "q_prob_hist": f"""
            with {_SCORED}, bins as (select {_TENTHS.format(x='p', op='>=', low='0', step='0.1::double')} as b from scored)
            select k as bin, round(k / 10::double, 6) as low, round((k + 1) / 10::double, 6) as high,
                   (select count(*) from bins where b = k) as n from range(0, 10) t(k)""",
        "q_score_hist": f"""
            with {_SCORED}, ends as (select min(o_totalprice) as lo, max(o_totalprice) as hi from scored),
            bins as (select {_TENTHS.format(x='o_totalprice', op='>=', low='lo', step='((hi - lo) / 10)')} as b from scored, ends)
            select k as bin, round(lo + k * ((hi - lo) / 10), 6) as low,
                   round(case when k = 9 then hi else lo + (k + 1) * ((hi - lo) / 10) end, 6) as high,
                   (select count(*) from bins where b = k) as n from range(0, 10) t(k), ends""",
        "q_score_hist_100": f"""
            with {_SCORED}, bins as (select least(floor(floor(p * 100.0::double) / 10), 9) as b from scored)
            select k as bin, k * 10.0::double as low, (k + 1) * 10.0::double as high,
                   (select count(*) from bins where b = k) as n from range(0, 10) t(k)""",
        "q_threshold_curve": _CURVE + """
            select round(threshold, 6) as threshold, tp as tps, fp as fps, pos - tp as fns, neg - fp as tns,
                   round(tp / pos::double, 6) as tpr, round(fp / neg::double, 6) as fpr from curve, total""",
        "q_threshold_weighted": f"""
            with {_SCORED}, weighted as (select y, p, (o_custkey % 3)::double as w from scored where o_custkey % 3 <> 0),
            grid as (select unnest(generate_series(floor(round(greatest(0, min(p) - 0.001::double) * 1000))::bigint,
                     floor(round((max(p) + 0.001::double) * 1000))::bigint)) as g from weighted),
            total as (select sum(w * y) as pos, sum(w * (1 - y)) as neg from weighted),
            curve as (select g / 1000::double as threshold,
                coalesce((select sum(w) from weighted where y = 1 and p >= g / 1000::double), 0) as tp,
                coalesce((select sum(w) from weighted where y = 0 and p >= g / 1000::double), 0) as fp from grid)
            select round(threshold, 6) as threshold, tp as tps, fp as fps, pos - tp as fns, neg - fp as tns,
                   round(tp / pos, 6) as tpr, round(fp / neg, 6) as fpr from curve, total""",
        "q_threshold_metrics": _CURVE + """,
            counts as (select threshold, tp::double as tp, fp::double as fp, (pos - tp)::double as fn, (neg - fp)::double as tn
                       from curve, total),
            rates as (select *, tp / nullif(tp + fn, 0) as recall, tp / nullif(tp + fp, 0) as prec, tn / nullif(tn + fp, 0) as spec
                      from counts)
            select round(threshold, 6) as threshold, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn,
                   round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round((recall + spec) * 0.5::double, 6) as balanced_accuracy,
                   round(recall, 6) as recall, round(prec, 6) as precision,
                   round(2 * recall * prec / nullif(recall + prec, 0), 6) as f1,
                   round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) as mcc
            from rates""",
        "q_perm_importance": _IMPORTANCE + "select metric, feature, repeat, round(importance, 6) as importance from raw",
        "q_relative_importance": _IMPORTANCE + """
            select metric, feature, round(mean, 6) as mean, round(std, 6) as std, round(relative, 6) as relative from summary""",
        "q_average_importance": _IMPORTANCE + """
            select feature, round(avg(relative), 6) as average_relative_importance from summary group by feature
            having avg(relative) > 0 order by 2 desc limit 12""",
        "q_unpivot": """
            select feature_name, round(avg(importance), 6) as importance from
            (unpivot (select l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax
             into name feature_name value importance) group by feature_name""",
    }
