"""Ranks, running totals and exact quantiles without a single-task sort.

A window over a whole table, or over one of two classes, ends up on one or two
tasks. The helpers here give the same answers in pieces of bounded size:

* seeded draws never sort the table: a cutoff hash per group is found from
  prefix counts plus one narrow slice, and membership is a plain comparison;
* running totals over ordered values collapse ties first, then run per range
  bucket and add the totals of the buckets before;
* exact quantiles count rows per range bucket and order only the buckets that a
  wanted rank falls into.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.columns import quoted
from leadloom.session import materialize

HASH_PREFIX = 4            # 16**4 prefix groups: 1/65536 of a group is sorted per cutoff
VALUES_PER_BUCKET = 500_000
VALUES_PER_SPLIT = 16      # values seen per bucket when placing splitters
MAX_BROADCAST_ROWS = 1_000_000     # of two numbers each
MAX_BUCKETS = 16_384


# ---------------------------------------------------------------- seeded draws

def hash_cutoffs(rows: DataFrame, groups: Sequence[str], hash_col: str,
                 takes: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """For each group the hash value that closes its first ``take`` rows.

    ``takes`` maps the row count of a group to the wanted sizes; the result has
    one row per (group, cut) with ``take > 0``: ``groups..., cut, cutoff, want,
    have``. A cut holds the rows with ``hash < cutoff`` and ``want`` of the
    ``have`` rows with ``hash = cutoff``; if the two agree, ``hash <= cutoff``
    says it all. Two narrow passes over ``groups`` and the hash only: prefix
    counts (combined on the map side), then the rows of the prefixes that a cut
    falls into. Rows with the same hash are counted before they are ordered.
    """
    groups = list(groups)
    prefix = F.substring(hash_col, 1, HASH_PREFIX)
    keyed = rows.select(*groups, F.col(hash_col).alias("_h"), prefix.alias("_p"))
    per_group = Window.partitionBy(*groups)
    counts = keyed.groupBy(*groups, "_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(per_group.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(per_group)
    cuts = (
        counts.select(*groups, "_p", "_n", upto.alias("_upto"), total.alias("_total"))
        .select(*groups, "_p", "_n", "_upto",
                F.posexplode(F.array(*[t.cast("bigint") for t in takes(F.col("_total"))])).alias("cut", "_take"))
        .where((F.col("_take") > F.col("_upto") - F.col("_n")) & (F.col("_take") <= F.col("_upto")))
        .select(*groups, "_p", "cut", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_want"))
    )
    # At most one row per (group, cut): the callers' groups are class x field.
    slices = (
        keyed.join(F.broadcast(cuts), [*groups, "_p"])
        .groupBy(*groups, "cut", "_want", "_h").agg(F.count(F.lit(1)).alias("_n"))
    )
    within = Window.partitionBy(*groups, "cut").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    return (
        slices.withColumn("_upto", F.sum("_n").over(within))
        .where(F.col("_upto") >= F.col("_want"))
        .groupBy(*groups, "cut").agg(F.min(F.struct(
            F.col("_h"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("want"), F.col("_n").alias("have"))).alias("_first"))
        .select(*groups, "cut", F.col("_first._h").alias("cutoff"), "_first.want", "_first.have")
    )


def copy_numbers(df: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """Adds, per mark, the number (from 0) of a row among the rows that fulfil its condition; 0 elsewhere.

    The rows with a mark are written once, so that every reader sees them in one
    order; they are counted per scan partition and numbered inside it, and the
    counts of the partitions before are added. No other row moves.
    """
    found = {name: F.coalesce(mark, F.lit(False)) for name, mark in marks.items()}
    any_mark = reduce(lambda a, b: a | b, found.values())
    tied = materialize(df.where(any_mark), "ties")
    sizes = tied.select(F.spark_partition_id().alias("_pid"), *[m.cast("bigint").alias(n) for n, m in found.items()]).groupBy(
        "_pid").agg(*[F.sum(n).alias(n) for n in found])
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_start{i}") for i, n in enumerate(found)])
    if tied.rdd.getNumPartitions() <= MAX_BROADCAST_ROWS:      # one row per scan partition
        starts = F.broadcast(starts)
    upto = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        tied.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
        .select("*", *[F.sum(m.cast("bigint")).over(upto).alias(f"_upto{i}") for i, m in enumerate(found.values())])
        .join(starts, "_pid")
        .select(*[quoted(c) for c in df.columns],
                *[F.when(m, F.col(f"_start{i}") + F.col(f"_upto{i}") - 1).otherwise(0).alias(n)
                  for i, (n, m) in enumerate(found.items())])
    )
    return df.where(~any_mark).select("*", *[F.lit(0).cast("bigint").alias(n) for n in found]).unionByName(numbered)


# ------------------------------------------------------------- range bucketing

@dataclass(frozen=True)
class RangeBuckets:
    """Splitters that cut an ordered column into pieces of similar size.

    Results never depend on the splitters, only the balance of tasks does.
    """

    splits: tuple[float, ...] = ()
    rows: int = 0     # non-null values seen by ``fit``

    @property
    def count(self) -> int:
        return len(self.splits) + 1

    @classmethod
    def fit(cls, df: DataFrame, column: str, values_per_bucket: int | None = None, at_least: int = 1) -> "RangeBuckets":
        """Small jobs over one column: distinct estimate, then splitters if needed.

        Splitters come from the distinct values whose hash falls into a share
        that leaves about ``VALUES_PER_SPLIT`` values per bucket: a bounded number
        of values, and a hot value counts once. ``at_least`` asks for finer
        buckets when there is more than one.
        """
        size = values_per_bucket or VALUES_PER_BUCKET
        value = quoted(column).cast("double")
        seen = df.agg(F.approx_count_distinct(value).alias("u"), F.count(value).alias("n")).first()
        n = ceil(seen["u"] / size)
        if n <= 1:
            return cls(rows=seen["n"])
        n = min(MAX_BUCKETS, max(n, at_least))
        share = max(1, seen["u"] // (n * VALUES_PER_SPLIT))
        chosen = df.select(value.alias("v")).where(
            F.col("v").isNotNull() & ~F.isnan("v") & (F.pmod(F.xxhash64("v"), F.lit(share)) == 0)).distinct()
        found = sorted(chosen.toArrow()["v"].to_pylist())      # about MAX_BUCKETS * VALUES_PER_SPLIT at most
        splits = {found[len(found) * i // n] for i in range(1, n)} if found else set()
        return cls(tuple(sorted(splits)), seen["n"])

    def assign(self, df: DataFrame, column: str, out: str = "_bucket") -> DataFrame:
        if not self.splits:
            return df.withColumn(out, F.lit(0.0))
        edges = [float("-inf"), *self.splits, float("inf")]
        as_double = df.withColumn("_value", quoted(column).cast("double"))
        bucketed = Bucketizer(splits=edges, inputCol="_value", outputCol=out, handleInvalid="keep")
        return bucketed.transform(as_double).drop("_value")


def running_totals(counts: DataFrame, order: str, sums: Sequence[str], buckets: RangeBuckets,
                   descending: bool = False, following: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of ``sums`` in the order of ``order``.

    ``counts`` has one row per distinct ``order`` value. Adds ``cum_<name>`` for
    each sum and ``next_<name>`` for each column in ``following``.
    """
    direction = quoted(order).desc() if descending else quoted(order).asc()
    if buckets.count == 1:   # checked: at most one bucket's worth of distinct values
        whole = Window.partitionBy(F.lit(0)).orderBy(direction)
        upto = whole.rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(
            "*", *[F.sum(quoted(s)).over(upto).alias(f"cum_{s}") for s in sums],
            *[F.lead(quoted(f)).over(whole).alias(f"next_{f}") for f in following])

    placed = buckets.assign(counts, order)
    head = F.max_by if descending else F.min_by
    # Counting over all columns keeps both readers of ``placed`` identical, so that
    # they share one exchange instead of aggregating the rows twice.
    names = ", ".join("`" + c.replace("`", "``") + "`" for c in counts.columns)
    totals = placed.groupBy("_bucket").agg(
        F.expr(f"count({names})").alias("_all"), *[F.sum(quoted(s)).alias(f"_t_{s}") for s in sums],
        *[head(quoted(f), quoted(order)).alias(f"_f_{f}") for f in following])
    order_b = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    across = Window.partitionBy(F.lit(0)).orderBy(order_b)   # at most MAX_BUCKETS rows
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.where(F.col("_all") >= 0).select(
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.lead(f"_f_{f}").over(across).alias(f"_n_{f}") for f in following])
    inside = Window.partitionBy("_bucket").orderBy(direction)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        "*", *[F.sum(quoted(s)).over(upto).alias(f"_l_{s}") for s in sums],
        *[F.lead(quoted(f)).over(inside).alias(f"_w_{f}") for f in following])
    joined = local.join(F.broadcast(offsets), "_bucket")
    return joined.select(
        *[quoted(c) for c in counts.columns],
        *[(F.col(f"_l_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.coalesce(F.col(f"_w_{f}"), F.col(f"_n_{f}")).alias(f"next_{f}") for f in following])


def row_index(df: DataFrame, out: str = "row_index", order_by: str | None = None,
              buckets: RangeBuckets | None = None) -> DataFrame:
    """Dense 0-based row numbers.

    With ``order_by`` (a numeric, unique column) rows are numbered in its order.
    Without, they are numbered in scan order: the count of rows in the scan
    partitions before plus the position inside, with no shuffle of the data. A
    result of a shuffle has no stable partitions, so it is written out first.
    """
    if order_by is None:
        if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
            df = materialize(df, "numbered")
        tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
        sizes = df.select(F.spark_partition_id().alias("_pid")).groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
        if df.rdd.getNumPartitions() <= MAX_BROADCAST_ROWS:      # one row per scan partition
            starts = F.broadcast(starts)
        return (
            tagged.join(starts, "_pid", "left")
            .withColumn(out, F.col("_start") + inside).drop("_pid", "_mid", "_start")
        )
    buckets = buckets or RangeBuckets.fit(df, order_by)
    placed = buckets.assign(df, order_by)
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(quoted(order_by)))
    return (
        placed.withColumn("_rn", inside).join(F.broadcast(starts), "_bucket")
        .withColumn(out, F.col("_start") + F.col("_rn") - 1).drop("_bucket", "_rn", "_start")
    )


# -------------------------------------------------------------- exact quantiles

def exact_quantiles(df: DataFrame, column: str, points: int, values_per_bucket: int | None = None) -> DataFrame:
    """``points`` evenly spaced quantiles (0 ... 1) with linear interpolation.

    Returns ``k`` (0 ... points-1), ``value`` and ``n``, the number of non-null
    values; at most ``points`` rows. Positions use integer arithmetic, so an
    edge that falls on a data value is exactly that value.
    """
    clean = df.select(quoted(column).cast("double").alias("value")).where(
        F.col("value").isNotNull() & ~F.isnan("value"))
    buckets = RangeBuckets.fit(clean, "value", values_per_bucket, at_least=16 * points)
    n = buckets.rows
    if n == 0:
        return df.sparkSession.createDataFrame([], "k bigint, value double, n bigint")
    if n == 1 or points == 1:
        low = clean.agg(F.min("value").alias("value"))
        return low.select(F.explode(F.expr(f"sequence(0L, {points - 1}L)")).alias("k"), "value",
                          F.lit(n).cast("bigint").alias("n"))
    steps, span = points - 1, n - 1
    # Ranks count from 0. Of the rows with ranks a ... b: the k whose lower
    # neighbour is among them, and the k whose upper neighbour is.
    low_from = F.expr(f"(a * {steps}L + {span - 1}L) div {span}L")
    low_to = F.expr(f"least(((b + 1) * {steps}L + {span - 1}L) div {span}L - 1, {steps}L)")
    high_from = F.expr(f"case when a = 0 then 0L else ((a - 1) * {steps}L) div {span}L + 1 end")
    high_to = F.expr(f"least((b * {steps}L) div {span}L, {steps}L)")

    def ks(start: Column, stop: Column, side: int) -> Column:
        numbers = F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda k: F.struct(k.alias("k"), F.lit(side).alias("side")))

    if buckets.count == 1:
        counts = clean.groupBy("value").agg(F.count(F.lit(1)).alias("c"))
        ranked = running_totals(counts, "value", ["c"], buckets)
        ranked = ranked.select("value", (F.col("cum_c") - F.col("c")).alias("a"), (F.col("cum_c") - 1).alias("b"))
    else:
        # Rows are only counted per bucket; then the buckets that hold a wanted
        # rank are ordered, the others never move.
        placed = buckets.assign(clean, "value")
        sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        across = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        wanted = sizes.select("_bucket", (F.sum("_n").over(across) - F.col("_n")).alias("a"),
                              (F.sum("_n").over(across) - 1).alias("b"))
        wanted = wanted.where((low_from <= low_to) | (high_from <= high_to)).select("_bucket", F.col("a").alias("_start"))
        inside = placed.join(F.broadcast(wanted), "_bucket")      # at most MAX_BUCKETS rows
        counts = inside.groupBy("_bucket", "_start", "value").agg(F.count(F.lit(1)).alias("c"))
        upto = Window.partitionBy("_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("_upto", F.col("_start") + F.sum("c").over(upto)).select(
            "value", (F.col("_upto") - F.col("c")).alias("a"), (F.col("_upto") - 1).alias("b"))

    ranked = ranked.where((low_from <= low_to) | (high_from <= high_to))
    picked = ranked.select("value", F.explode(F.concat(ks(low_from, low_to, 0), ks(high_from, high_to, 1))).alias("t"))
    sides = picked.groupBy("t.k").agg(
        F.max(F.when(F.col("t.side") == 0, F.col("value"))).alias("lo"),
        F.max(F.when(F.col("t.side") == 1, F.col("value"))).alias("hi"))
    part = F.expr(f"cast((k * {span}L) % {steps}L as double)") / F.lit(float(steps))
    return sides.select("k", (F.col("lo") + (F.col("hi") - F.col("lo")) * part).alias("value"),
                        F.lit(n).cast("bigint").alias("n"))


def quantile_list(df: DataFrame, column: str, points: int) -> list[float]:
    """The quantiles as a driver list; at most ``points`` values."""
    return [r["value"] for r in sorted(exact_quantiles(df, column, points).collect(), key=lambda r: r["k"])]


def cached(df: DataFrame) -> DataFrame:
    """Keep a result that several jobs read; lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
