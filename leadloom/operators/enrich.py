"""Record enrichment from lookup tables and from user-supplied providers."""

from __future__ import annotations

import re
import sys
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields as dataclass_fields, replace
from threading import Lock
from typing import Any
from urllib.parse import urlparse

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.columns import quoted
from leadloom.functions.fixed import MAX_QUERIES_PER_SECOND, PROVIDER_DEFAULTS
from leadloom.operators.project import all_present, request_map, require_columns
from leadloom.session import materialize

# Provider code travels to the Python workers with the task: nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPREAD = 64      # join partitions that rows without a key are spread over


# --------------------------------------------------------------- response handlers

def as_is(response, url: str, **_):
    """The response unchanged."""
    return response


def first_result(wrapper: str) -> Callable:
    """Handler for ``{wrapper: {"results": [{...}, ...]}}``, wrapper capitalised or not.

    Gives the first result if it is an object, else an empty record; the whole
    wrapped object when raw results are wanted.
    """
    def handle(response, url: str, raw_json: bool = False, **_):
        body = response[wrapper.capitalize()] if wrapper.capitalize() in response else response[wrapper]
        if raw_json:
            return body
        results = body.get("results") or []
        return results[0] if results and isinstance(results[0], dict) else {}

    return handle


def first_result_column(payload: Column, wrapper: str, names: Sequence[str]) -> list[Column]:
    """The same unpacking for a JSON column, as text expressions: one per field name.

    All of them share one parse of the payload.
    """
    parsed = F.try_parse_json(payload)

    def field_of(wrapped: str, name: str) -> Column:
        return F.try_variant_get(parsed, f"$['{wrapped}'].results[0]['{name}']", "string")

    return [F.coalesce(field_of(wrapper.capitalize(), n), field_of(wrapper, n)).alias(n) for n in names]


def json_fields(payload: Column, schema: str | T.StructType) -> Column:
    """A JSON column as a struct of declared fields; absent ones are null."""
    return F.from_json(payload, schema)


def discover_schema(df: DataFrame, payload: str) -> str:
    """Union of the keys seen in a JSON column, as a DDL type; one aggregate."""
    return df.agg(F.schema_of_variant_agg(F.parse_json(quoted(payload))).alias("s")).first()["s"]


class HandlerRegistry:
    """Named handlers, and handlers chosen by a wildcard over host and path."""

    def __init__(self):
        self._names: dict[str, Callable] = {"as_is": as_is}
        self._patterns: list[tuple[re.Pattern, Callable]] = []

    def register(self, name: str, handler: Callable, url_pattern: str | None = None) -> None:
        self._names[name] = handler
        if url_pattern:
            text = ".*".join(re.escape(piece) for piece in url_pattern.split("*"))
            self._patterns.append((re.compile(text, re.IGNORECASE), handler))

    def choose(self, handler, url: str) -> Callable:
        if handler is None:
            parts = urlparse(url)
            target = parts.netloc + parts.path
            return next((h for p, h in self._patterns if p.match(target)), as_is)
        if isinstance(handler, str):
            if handler not in self._names:
                raise ValueError(f"unknown response handler {handler!r}")
            return self._names[handler]
        if callable(handler):
            return handler
        raise TypeError(f"a response handler is a name, a callable or None, not {type(handler)}")


HANDLERS = HandlerRegistry()


# ------------------------------------------------------------------ provider specs

def _names(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


@dataclass
class ProviderSpec:
    """How records become requests, and responses become columns."""

    url: str
    params: Mapping[str, str] = field(default_factory=dict)
    headers: Mapping[str, str] = field(default_factory=dict)
    n_retry: int = PROVIDER_DEFAULTS["n_retry"]
    retry_wait_time: float = PROVIDER_DEFAULTS["retry_wait_time"]
    timeout: float = PROVIDER_DEFAULTS["timeout"]
    n_connections: int = PROVIDER_DEFAULTS["n_connections"]
    queries_per_second: float = PROVIDER_DEFAULTS["queries_per_second"]
    return_json: bool = False
    response_handler: Any = None
    required_fields: Sequence[str] = ()
    optional_fields: Sequence[str] = ()
    field_remap: Mapping[str, str] = field(default_factory=dict)
    post_append_prefix: str = ""
    post_append_suffix: str = ""

    def __post_init__(self):
        if not isinstance(self.n_connections, int) or self.n_connections < 1:
            raise ValueError(f"n_connections must be an integer of at least 1, not {self.n_connections}")
        if not 0 < self.queries_per_second <= MAX_QUERIES_PER_SECOND:
            raise ValueError(f"queries_per_second must be above 0 and at most {MAX_QUERIES_PER_SECOND}")
        self.params, self.field_remap = dict(self.params or {}), dict(self.field_remap or {})
        self.headers = dict(self.headers or {})
        self.required_fields, self.optional_fields = _names(self.required_fields), _names(self.optional_fields)
        self.handler = HANDLERS.choose(self.response_handler, self.url)

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> "ProviderSpec":
        if "url" not in config:
            raise ValueError("each provider needs a url")
        unknown = set(config) - {f.name for f in dataclass_fields(cls)}
        if unknown:
            raise ValueError(f"unknown provider options: {sorted(unknown)}")
        return cls(**config)

    def request_fields(self, columns: Sequence[str]) -> dict[str, str]:
        """Column name -> request name; all columns when none are named."""
        chosen = [*self.required_fields, *self.optional_fields] or list(columns)
        return {c: self.field_remap.get(c, c) for c in chosen}

    def renamed(self, name: str) -> str:
        return f"{self.post_append_prefix}{name}{self.post_append_suffix}"


# -------------------------------------------------------------------- lookup tables

def one_row_per_key(lookup: DataFrame, key: Sequence[str]) -> DataFrame:
    """The smallest record of each key; combined on the map side, so hot keys are fine."""
    rest = [c for c in lookup.columns if c not in key]
    if not rest:
        return lookup.select(*[quoted(k) for k in key]).distinct()
    picked = lookup.groupBy(*[quoted(k) for k in key]).agg(F.min(F.struct(*[quoted(c) for c in rest])).alias("_r"))
    return picked.select(*[quoted(k) for k in key], *[F.col("_r").getField(c).alias(c) for c in rest])


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer's size estimate is within the session's broadcast threshold."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return 0 <= size <= int(conf.autoBroadcastJoinThreshold())


def enrich_lookup(df: DataFrame, lookup: DataFrame, on: Mapping[str, str] | Sequence[str], *,
                  prefix: str = "", suffix: str = "", unique: bool = False,
                  required: Sequence[str] = (), spread_missing: bool = True) -> DataFrame:
    """Left equi join that keeps every row of ``df`` exactly once.

    ``on`` maps columns of ``df`` to key columns of ``lookup``. ``unique`` says
    the lookup has one row per key; otherwise the smallest record of a key is
    used. Whether the lookup is broadcast is the optimizer's decision by its size
    against the session's threshold. Otherwise the join shuffles: a hot key of
    ``df`` is split by the adaptive skew join, and rows with a null in
    ``required`` or in the key, which match nothing, are spread over the
    partitions instead of piling up in one.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    require_columns(df, [*pairs, *required], ValueError)
    right = lookup if unique else one_row_per_key(lookup, list(pairs.values()))
    fields_ = [c for c in right.columns if c not in pairs.values()]
    right = right.select(
        *[quoted(v).alias(f"_k{i}") for i, v in enumerate(pairs.values())],
        *[quoted(c).alias(f"_v{i}") for i, c in enumerate(fields_)])
    names = [f"{prefix}{c}{suffix}" for c in fields_]
    left_names = collision_names(df.columns, names)

    eligible = all_present(list(dict.fromkeys([*pairs, *required])))
    left, right_cols = df, [f"_k{i}" for i in range(len(pairs))]
    condition = None
    for i, c in enumerate(pairs):
        left = left.withColumn(f"_j{i}", F.when(eligible, quoted(c)))
        test = F.col(f"_j{i}") == F.col(f"_k{i}")
        condition = test if condition is None else condition & test
    if spread_missing and not fits_broadcast(right):
        # 0 for rows that can match; 1..SPREAD, by row content, for the rest.
        hashed = [quoted(f.name) for f in df.schema.fields if _hashable(f.dataType)] or [F.lit(0)]
        spot = F.when(eligible, F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*hashed), F.lit(SPREAD)).cast("int") + 1)
        left = left.withColumn("_spot", spot)
        # Always 0, but not a constant to the optimizer: it has to stay a join key.
        right = right.withColumn("_zero", F.pmod(F.xxhash64("_k0"), F.lit(1)).cast("int"))
        condition = condition & (F.col("_spot") == F.col("_zero"))
    joined = left.join(right, condition, "left")
    return joined.select(*[quoted(c) for c in df.columns],
                         *[F.col(f"_v{i}").alias(n) for i, n in enumerate(left_names)])


def _hashable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.BinaryType))


def collision_names(taken: Sequence[str], new: Sequence[str]) -> list[str]:
    """Names for appended columns: ``_append`` where a name is already in use."""
    used, out = set(taken), []
    for name in new:
        chosen = f"{name}_append" if name in used else name
        if chosen in used:
            raise ValueError(f"appended field {name!r} collides twice: give the provider a prefix or suffix")
        used.add(chosen)
        out.append(chosen)
    return out


# ----------------------------------------------------------------- callable providers

class TaskBudget:
    """One task's share of a provider's call rate: at most ``calls`` per ``period`` seconds."""

    def __init__(self, queries_per_second: float, tasks: int, clock=time.monotonic, sleep=time.sleep):
        share = queries_per_second / tasks
        self.calls, self.period = (int(share), 1.0) if share >= 1 else (1, 1.0 / share)
        self._clock, self._sleep = clock, sleep
        self._start, self._used, self._lock = clock(), 0, Lock()

    def acquire(self) -> None:
        while True:
            with self._lock:
                now = self._clock()
                if now - self._start >= self.period:
                    self._start, self._used = now, 0
                if self._used < self.calls:
                    self._used += 1
                    return
                wait = self.period - (now - self._start)
            self._sleep(max(wait, 0.0))


def call_with_retry(call: Callable[[], Any], n_retry: int, wait: float, acquire: Callable[[], None],
                    sleep=time.sleep) -> tuple[Any, bool]:
    """Up to ``n_retry + 1`` tries; after failed try i the pause is ``wait * i``; then give up."""
    for attempt in range(n_retry + 1):
        acquire()
        try:
            result = call()
            if result is None:
                raise ValueError("nothing returned")
            return result, True
        except Exception:    # a failed provider call must never fail the task
            if attempt < n_retry:
                sleep(wait * attempt)
    return None, False


def task_count(spec: ProviderSpec, wanted: int | None) -> int:
    """Tasks for a provider stage: as many as wanted, but no more than connections or whole queries per second allow."""
    most = min(spec.n_connections, max(1, int(spec.queries_per_second)))
    return max(1, min(wanted or most, most))


def _provider_udf(spec: ProviderSpec, provider: Callable, tasks: int, out_type: T.StructType):
    """Arrow-batched, one budget and one small thread pool per task."""
    import json

    names = [f.name for f in out_type.fields if f.name != "_success"]
    n_retry, wait, qps = spec.n_retry, spec.retry_wait_time, spec.queries_per_second
    threads, url, raw = max(1, spec.n_connections // tasks), spec.url, spec.return_json
    handler, headers, timeout = spec.handler, dict(spec.headers), spec.timeout

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget = TaskBudget(qps, tasks)

        def one(item):
            eligible, request = item
            if not eligible:
                return None, False
            params = dict(request)
            return call_with_retry(
                lambda: handler(provider(params, url=url, headers=headers, timeout=timeout), url=url, raw_json=raw),
                n_retry, wait, budget.acquire)

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                answers = list(pool.map(one, zip(batch["eligible"], batch["request"])))
                if raw:
                    cols = {"result": [json.dumps(a if ok else {}) for a, ok in answers]}
                else:
                    cols = {n: [None if not ok or not isinstance(a, Mapping) or a.get(n) is None else str(a[n])
                                for a, ok in answers] for n in names}
                cols["_success"] = [ok for _, ok in answers]
                yield pd.DataFrame(cols, columns=[*cols])

    return F.pandas_udf(run, out_type).asNondeterministic()


def http_get(params: Mapping[str, str], url: str, headers: Mapping[str, str], timeout: float):
    """The default transport: one GET per record, the JSON body of a successful answer."""
    import json
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    glue = "&" if "?" in url else "?"
    target = f"{url}{glue}{urlencode(params)}" if params else url
    with urlopen(Request(target, headers=dict(headers)), timeout=timeout) as answer:
        return json.loads(answer.read().decode("utf-8"))


def enrich_callable(df: DataFrame, spec: ProviderSpec, provider: Callable, fields_: Sequence[str] | None = (), *,
                    tasks: int | None = None, success: str | None = None,
                    source_columns: Sequence[str] | None = None) -> DataFrame:
    """Append the fields of a provider function, one call per eligible record.

    ``provider(params, url=, headers=, timeout=)`` returns a JSON-like object or
    raises; transport is the caller's. Only the request fields travel to Python.
    Columns of the answer are declared in ``fields_`` (Spark needs the schema at
    plan time); absent ones are null. ``fields_=None`` finds them: the answers are
    written once, and the union of their keys becomes the columns. With ``return_json`` the answer is one
    struct column ``<prefix>response<suffix>`` of (result, success).

    Delivery is at least once: a retried task calls again. Pass the result
    through :func:`leadloom.session.materialize` before using it twice.
    """
    if fields_ is None and not spec.return_json:
        return _enrich_discovered(df, spec, provider, tasks, success, source_columns)
    source = list(source_columns or df.columns)
    require_columns(df, spec.required_fields, ValueError)
    tasks = task_count(spec, tasks)
    request = request_map(spec.request_fields(source), spec.params)
    names = ["result"] if spec.return_json else list(fields_)
    out_type = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_success", T.BooleanType())])
    call = _provider_udf(spec, provider, tasks, out_type)
    # The partition count of this stage is the divisor of the call rate.
    answered = df.repartition(tasks).withColumn("_answer", call(F.struct(
        all_present(spec.required_fields).alias("eligible"), request.alias("request"))))
    if spec.return_json:
        new = [F.struct(F.col("_answer.result").alias("result"), F.col("_answer._success").alias("success"))]
        renamed = [spec.renamed("response")]
    else:
        new = [F.col("_answer").getField(n) for n in names]
        renamed = [spec.renamed(n) for n in names]
    if success:
        new.append(F.col("_answer._success"))
        renamed.append(success)
    final = collision_names(df.columns, renamed)
    return answered.select(*[quoted(c) for c in df.columns], *[c.alias(n) for c, n in zip(new, final)])


def _enrich_discovered(df: DataFrame, spec: ProviderSpec, provider: Callable, tasks: int | None,
                       success: str | None, source_columns: Sequence[str] | None) -> DataFrame:
    held = replace(spec, return_json=True, post_append_prefix="_", post_append_suffix="_raw",
                   response_handler=unwrapped(spec.handler))
    raw = materialize(enrich_callable(df, held, provider, tasks=tasks, source_columns=source_columns), "answers")
    answer = F.from_json(F.col("_response_raw.result"), "map<string,string>")
    keys = raw.select(F.explode(F.map_keys(answer)).alias("k")).groupBy("k").count()      # one row per field name
    names = sorted(r["k"] for r in keys.collect())
    renamed = [spec.renamed(n) for n in names] + ([success] if success else [])
    final = collision_names(df.columns, renamed)
    values = [F.try_element_at(answer, F.lit(n)) for n in names] + ([F.col("_response_raw.success")] if success else [])
    return raw.select(*[quoted(c) for c in df.columns], *[v.alias(n) for v, n in zip(values, final)])


def unwrapped(handler: Callable) -> Callable:
    """The handler as it works on unpacked answers, also when the JSON text is kept."""
    def handle(response, url: str, **_):
        return handler(response, url=url, raw_json=False)

    return handle


@dataclass
class LookupProvider:
    """A lookup table as a provider: ``on`` maps request names to key columns."""

    spec: ProviderSpec
    table: DataFrame
    on: Mapping[str, str]
    unique: bool = False

    def append(self, df: DataFrame, source: Sequence[str]) -> DataFrame:
        back = {r: c for c, r in self.spec.request_fields(source).items()}
        absent = [r for r in self.on if r not in back]
        if absent:
            raise ValueError(f"provider key fields are not in the data: {absent}")
        return enrich_lookup(df, self.table, {back[r]: k for r, k in self.on.items()},
                             prefix=self.spec.post_append_prefix, suffix=self.spec.post_append_suffix,
                             unique=self.unique, required=self.spec.required_fields)


@dataclass
class CallableProvider:
    """A Python function as a provider; ``fields`` it returns, or None to find them.

    Batches are asked on a schedule, each distinct request once, with a log of the answers
    (:mod:`leadloom.operators.answers`) in the folder ``log``, or in scratch space. A streaming
    DataFrame is asked record by record inside its own plan.
    """

    spec: ProviderSpec
    function: Callable = http_get
    fields: Sequence[str] | None = None
    tasks: int | None = None
    log: str | None = None

    def append(self, df: DataFrame, source: Sequence[str]) -> DataFrame:
        if df.isStreaming:
            return enrich_callable(df, self.spec, self.function, self.fields, tasks=self.tasks, source_columns=source)
        from leadloom.operators.answers import enrich_logged      # it builds on this module

        return enrich_logged(df, self.spec, self.function, self.fields, log=self.log, tasks=self.tasks, source_columns=source)


def append_all(df: DataFrame, providers: Sequence[LookupProvider | CallableProvider]) -> DataFrame:
    """Append every provider in order; each builds its requests from the original columns."""
    source = list(df.columns)
    for provider in providers:
        df = provider.append(df, source)
    return df


def append_statistics(df: DataFrame, success: str | Column, seconds: float | None = None) -> DataFrame:
    """Records, success rate and, for a known duration, records per second."""
    hit = quoted(success) if isinstance(success, str) else success
    out = df.agg(F.count(F.lit(1)).alias("records"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("success_rate"))
    if seconds:
        out = out.withColumn("records_per_second", F.col("records") / F.lit(float(seconds)))
    return out
