"""Provider calls on a schedule, with a log of their answers.

Records become requests; identical requests are one, and records that lack a required
field have none. Each request that the log does not hold yet gets a rank, and with it a
time slot: the rank divided by the call rate. The ranks are dealt to the tasks in turn, so
that every task has each ``tasks``-th slot; a task never calls before the slot has come nor
within ``tasks / rate`` seconds of its last call (a retry is a call). So the rate holds for
any number of tasks, for late ones and for retries as well.

Requests are answered in rounds of some seconds' worth of calls. A round's answers are
committed to the log before the next begins: a lost executor repeats its part of one round
at most, and a job that is started again asks only for what the log lacks.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.columns import quoted
from leadloom.operators.enrich import call_with_retry, collision_names, enrich_lookup
from leadloom.operators.project import all_present, request_map, require_columns
from leadloom.operators.ranks import row_index
from leadloom.session import materialize, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUND_SECONDS = 30.0       # calls of one round, at the full rate
ANSWER = "key string, result string, success boolean, tries int, at double"


class Pacer:
    """Times of one task's calls: not before their slots, and ``every`` seconds apart at least."""

    def __init__(self, every: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.every, self._clock, self._sleep = every, clock, sleep
        self._next, self._lock = float("-inf"), Lock()

    def acquire(self, slot: float | None = None) -> float:
        """Waits for the next free time, for ``slot`` if that is later; returns it."""
        with self._lock:
            due = max(self._next, self._clock() if slot is None else slot, self._clock())
            self._next = due + self.every
        wait = due - self._clock()
        if wait > 0:
            self._sleep(wait)
        return due


def request_key(request: Column) -> Column:
    """A text that is the same for the same request, whatever the order of its fields."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(request))), 256)


def answer_log(spark, path: str) -> DataFrame | None:
    """One row per request of the log: a successful answer if there is one, else the latest."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        return None
    told = spark.read.schema(ANSWER).parquet(path)
    best = told.groupBy("key").agg(F.max(F.struct("success", "at", "result", "tries")).alias("a"))
    return best.select("key", "a.result", "a.success", "a.tries", "a.at")


def as_text(value) -> str | None:
    """A field of an answer as text: nested values as JSON."""
    if isinstance(value, (Mapping, list, tuple)):
        return json.dumps(value, separators=(",", ":"))
    return None if value is None else str(value)


def _calls(spec, provider: Callable, tasks: int, start: float) -> Callable:
    n_retry, wait, rate = spec.n_retry, spec.retry_wait_time, spec.queries_per_second
    threads, url, raw = max(1, spec.n_connections // tasks), spec.url, spec.return_json
    handler, headers, timeout = spec.handler, dict(spec.headers), spec.timeout

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pacer = Pacer(tasks / rate)

        def one(request, slot) -> tuple:
            slots, tries = [start + slot / rate], []

            def acquire():
                pacer.acquire(slots.pop() if slots else None)
                tries.append(1)

            answer, success = call_with_retry(
                lambda: handler(provider(dict(request), url=url, headers=headers, timeout=timeout), url=url, raw_json=raw),
                n_retry, wait, acquire)
            if not raw:
                answer = {k: as_text(v) for k, v in answer.items()} if isinstance(answer, Mapping) else {}
            return json.dumps(answer if success else {}), success, len(tries), time.time()

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                told = list(pool.map(one, batch["request"], batch["slot"]))
                out = pd.DataFrame(told, columns=["result", "success", "tries", "at"])
                out.insert(0, "key", batch["key"].to_numpy())
                yield out

    return run


def answer_requests(requests: DataFrame, spec, provider: Callable, log: str, tasks: int | None = None,
                    retry_failed: bool = True, round_seconds: float = ROUND_SECONDS) -> int:
    """Ask for the ``request`` maps of all rows that the log does not answer yet; returns the number of calls' requests.

    With ``retry_failed`` requests whose answer in the log is a failure are asked again.
    """
    spark = requests.sparkSession
    keyed = requests.select(request_key(F.col("request")).alias("key"), "request")
    # equal requests meet within a task first, so a hot one is a row per task
    distinct = keyed.groupBy("key").agg(F.first("request").alias("request"))
    known = answer_log(spark, log)
    if known is not None:
        distinct = distinct.join(known.where("success") if retry_failed else known, "key", "left_anti")
    ranked = row_index(materialize(distinct, "requests"), "rank")
    total = ranked.count()
    tasks = max(1, min(tasks or spark.sparkContext.defaultParallelism, spec.n_connections, max(total, 1)))
    per_round = max(tasks, int(spec.queries_per_second * round_seconds))
    for first in range(0, total, per_round):
        turn = ranked.where((F.col("rank") >= first) & (F.col("rank") < first + per_round)).select(
            "key", "request", (F.col("rank") - first).alias("slot"))
        dealt = turn.repartitionByRange(tasks, F.pmod("slot", F.lit(tasks)))
        dealt.mapInPandas(_calls(spec, provider, tasks, time.time()), ANSWER).write.mode("append").parquet(log)
    return total


def enrich_logged(df: DataFrame, spec, provider: Callable, fields_: Sequence[str] | None = None, *, log: str | None = None,
                  tasks: int | None = None, success: str | None = None, source_columns: Sequence[str] | None = None,
                  retry_failed: bool = True, round_seconds: float = ROUND_SECONDS) -> DataFrame:
    """Append the fields of a provider function, called once per distinct request of an eligible record.

    The calls are made here, not when the result is read. ``fields_=None`` takes the union of
    the answers' keys. With ``return_json`` the answer is one struct column of (result, success).
    ``log`` is a folder that later or restarted runs go on from; without one it is scratch space.
    """
    source = list(source_columns or df.columns)
    require_columns(df, spec.required_fields, ValueError)
    spark, log = df.sparkSession, log or scratch_path(df.sparkSession, "answers")
    request = request_map(spec.request_fields(source), spec.params)
    eligible = all_present(spec.required_fields)
    answer_requests(df.where(eligible).select(request.alias("request")), spec, provider, log, tasks, retry_failed, round_seconds)
    answers = answer_log(spark, log)
    if answers is None:                       # nobody was asked, ever
        answers = spark.createDataFrame([], ANSWER)
    told = F.from_json("result", "map<string,string>")
    if spec.return_json:
        failed = F.struct(F.lit("{}").alias("result"), F.lit(False).alias("success"))
        columns = [(spec.renamed("response"), F.struct("result", "success"), failed)]
    else:
        if fields_ is None:
            found = answers.where("success").select(F.explode(F.map_keys(told)).alias("k")).groupBy("k").count()    # a row per field name
            fields_ = sorted(r["k"] for r in found.collect())
        columns = [(spec.renamed(n), F.when(F.col("success"), F.try_element_at(told, F.lit(n))), None) for n in fields_]
    if success:
        columns.append((success, F.col("success"), F.lit(False)))
    final = collision_names(df.columns, [name for name, _, _ in columns])
    values = answers.select("key", *[v.alias(f"_value{i}") for i, (_, v, _) in enumerate(columns)])
    keyed = df.withColumn("_request_key", F.when(eligible, request_key(request)))
    joined = enrich_lookup(keyed, values, {"_request_key": "key"}, unique=True)
    return joined.select(*[quoted(c) for c in df.columns], *[
        (F.col(f"_value{i}") if absent is None else F.coalesce(f"_value{i}", absent)).alias(name)
        for i, (name, (_, _, absent)) in enumerate(zip(final, columns))])
