"""Fill rates by class, and levelling them by removing values at random."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.columns import is_positive, order_hash, quoted
from leadloom.functions.fixed import DEFAULT_SEED
from leadloom.operators.ranks import copy_numbers, hash_cutoffs


def fill_rates(df: DataFrame, label: str, positive, fields: Sequence[str]) -> DataFrame:
    """One row per field: rows, filled values and fill rate of each class.

    One scan of the label and the fields with partial aggregation.
    """
    pos = is_positive(label, positive)
    sums = df.agg(
        F.count(F.when(pos, 1)).alias("p"), F.count(F.when(~pos, 1)).alias("n"),
        *[F.count(F.when(pos, quoted(f))).alias(f"p{i}") for i, f in enumerate(fields)],
        *[F.count(F.when(~pos, quoted(f))).alias(f"n{i}") for i, f in enumerate(fields)])
    rows = F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col("p").alias("n_positive"), F.col("n").alias("n_negative"),
                 F.col(f"p{i}").alias("filled_positive"), F.col(f"n{i}").alias("filled_negative"))
        for i, f in enumerate(fields)]))
    return sums.select(rows).select(
        "*",
        F.try_divide(F.col("filled_positive").cast("double"), F.col("n_positive").cast("double")).alias("rate_positive"),
        F.try_divide(F.col("filled_negative").cast("double"), F.col("n_negative").cast("double")).alias("rate_negative"))


def balance_fill_rates(df: DataFrame, key, label: str | None, positive, fields: Sequence[str],
                       tolerance: float | None = 0.1, seed: int = DEFAULT_SEED) -> DataFrame:
    """Null values of the fuller class until the fill rates of a field agree.

    For a gap above ``tolerance``, ``int(gap * rows of the fuller class)`` values
    drawn by seeded hash go. A class without rows, or no tolerance, leaves the
    field alone. Fitting reads label, key and fields twice (counts, then one
    narrow slice per field); the result is one projection without a shuffle, but
    for rows that share a key with a field's last removed value.
    """
    if not label:
        raise ValueError("balancing needs a label column")
    if df.isStreaming:
        raise RuntimeError("fill rates need the whole table: balance before streaming")
    absent = [f for f in fields if f not in df.columns]
    if absent:
        raise ValueError(f"columns selected for balancing are not in the data: {absent}")
    if not fields or tolerance is None:
        return df

    removals = {}
    for r in fill_rates(df, label, positive, fields).collect():     # one row per field
        p, n = r["rate_positive"], r["rate_negative"]
        if p is None or n is None or not abs(p - n) > tolerance:
            continue
        fuller = p > n
        count = int(abs(p - n) * (r["n_positive"] if fuller else r["n_negative"]))
        if count > 0:
            removals[r["field"]] = (fuller, count)
    if not removals:
        return df

    pos = is_positive(label, positive)
    candidates = df.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.when((pos if fuller else ~pos) & quoted(f).isNotNull(),
                                                 order_hash(key, seed, f)).alias("_order"))
        for f, (fuller, _) in removals.items()]))).where(F.col("_order").isNotNull())
    take = F.create_map(*[F.lit(v) for f, (_, count) in removals.items() for v in (f, count)])[F.col("field")]
    cuts = hash_cutoffs(candidates, ["field"], "_order", lambda n: [take])
    drawn_from = {r["field"]: r for r in cuts.collect()}       # one row per field
    marks, copy_of = {}, {}
    for i, (f, r) in enumerate(drawn_from.items()):
        if r["want"] < r["have"]:       # the cut falls among rows that share a key: these are numbered
            copy_of[f] = f"_leadloom_copy{i}"
            marks[copy_of[f]] = ((pos if removals[f][0] else ~pos) & quoted(f).isNotNull()
                                 & (order_hash(key, seed, f) == F.lit(r["cutoff"])))
    marked = copy_numbers(df, marks) if marks else df

    def balanced(f: str):
        if f not in drawn_from:
            return quoted(f)
        r, order = drawn_from[f], order_hash(key, seed, f)
        inside = order <= F.lit(r["cutoff"])
        if f in copy_of:
            inside = (order < F.lit(r["cutoff"])) | ((order == F.lit(r["cutoff"])) & (F.col(copy_of[f]) < r["want"]))
        return F.when(~((pos if removals[f][0] else ~pos) & inside), quoted(f)).alias(f)

    return marked.select(*[balanced(c) for c in df.columns])
