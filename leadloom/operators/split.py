"""Re-creatable stratified splits, folds and samples.

Each is fitted once (two narrow passes, at most a few cutoff hashes per class
come back) and then is a plain comparison of ``md5(seed:key)`` with a literal:
no shuffle, no sort, the same rows on every cluster, on streams too. Sizes are
exact: if a cut falls among rows that share a key, these rows (and no others) are
numbered and as many as are missing are taken. ``grouped=True`` keeps rows that
share a key on one side instead, at the price of sizes that are then rounded up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.columns import is_positive, order_hash
from leadloom.functions.fixed import DEFAULT_SEED
from leadloom.operators.ranks import copy_numbers, hash_cutoffs


@dataclass(frozen=True)
class ClassCutoffs:
    """Cutoff hashes of the two classes, in draw order."""

    key: str | tuple[str, ...]
    label: str
    positive: object
    seed: int
    positives: tuple[str, ...]
    negatives: tuple[str, ...]
    takes: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())     # rows of each cutoff hash inside, by class as above
    tied: tuple[tuple[bool, str], ...] = ()                       # (class, hash) of which a cut takes a part only

    @classmethod
    def fit(cls, df: DataFrame, key, label: str, takes: Callable[[Column], Sequence[Column]],
            positive=1, seed: int = DEFAULT_SEED) -> "ClassCutoffs":
        key = key if isinstance(key, str) else tuple(key)
        rows = df.select(is_positive(label, positive).alias("_pos"), order_hash(key, seed).alias("_order"))
        found = hash_cutoffs(rows, ["_pos"], "_order", takes).collect()   # 2 classes x cuts
        by_class = {p: {r["cut"]: r for r in found if r["_pos"] is p} for p in (True, False)}
        size = max([1 + max(m) for m in by_class.values() if m], default=0)
        # A cut of size 0 has no row: the empty text is below every hash.
        in_order = {p: tuple(m[i]["cutoff"] if i in m else "" for i in range(size)) for p, m in by_class.items()}
        takes = tuple(tuple(by_class[p][i]["want"] if i in by_class[p] else 0 for i in range(size)) for p in (True, False))
        tied = tuple(sorted({(r["_pos"], r["cutoff"]) for r in found if r["want"] < r["have"]}))
        return cls(key, label, positive, seed, in_order[True], in_order[False], takes, tied)

    def _order(self) -> Column:
        return order_hash(self.key, self.seed)

    def _is_positive(self) -> Column:
        return is_positive(self.label, self.positive)

    def inside(self, cut: int = 0) -> Column:
        """True for the rows of the cut; all rows of the cutoff hash are inside."""
        sides = [F.lit(c[cut] if c else "") for c in (self.positives, self.negatives)]
        return self._order() <= F.when(self._is_positive(), sides[0]).otherwise(sides[1])

    def position(self, copy: Column | None = None) -> Column:
        """How many cuts lie before the row: its fold number. ``copy`` numbers the rows of a tied hash."""
        order = self._order()

        def number(cuts: tuple[str, ...], takes: tuple[int, ...]) -> Column:
            total = F.lit(0)
            for c, take in zip(cuts, takes):
                past = order > F.lit(c)
                if copy is not None:
                    past = past | ((order == F.lit(c)) & (copy >= take))
                total = total + past.cast("int")
            return total

        return F.when(self._is_positive(), number(self.positives, self.takes[0])).otherwise(
            number(self.negatives, self.takes[1]))

    def place(self, df: DataFrame, out: str, grouped: bool = False) -> DataFrame:
        """Adds the row's ``position`` with exact sizes; only rows of a tied hash are moved."""
        if grouped or not self.tied:
            return df.withColumn(out, self.position())
        marks = {f"_leadloom_copy{i}": (self._is_positive() == F.lit(p)) & (self._order() == F.lit(h))
                 for i, (p, h) in enumerate(self.tied)}
        copy = sum((F.col(m) for m in list(marks)[1:]), F.col("_leadloom_copy0"))      # a row has one mark at most
        return copy_numbers(df, marks).withColumn(out, self.position(copy)).drop(*marks)

    def mark(self, df: DataFrame, out: str, grouped: bool = False) -> DataFrame:
        """Adds ``out``: whether the row is in the first cut, with exact sizes."""
        if not self.positives:          # no class has a row to take
            return df.withColumn(out, F.lit(False))
        if grouped or not self.tied:
            return df.withColumn(out, self.inside())
        return self.place(df, "_leadloom_cut").withColumn(out, F.col("_leadloom_cut") == 0).drop("_leadloom_cut")


def fit_holdout(df: DataFrame, key, label: str, test_size: float = 0.2, positive=1,
                seed: int = DEFAULT_SEED) -> ClassCutoffs:
    return ClassCutoffs.fit(df, key, label, lambda n: [F.ceil(n * F.lit(float(test_size)))], positive, seed)


def stratified_split(df: DataFrame, key, label: str, test_size: float = 0.2, positive=1,
                     seed: int = DEFAULT_SEED, out: str = "split", grouped: bool = False) -> DataFrame:
    """Adds ``split``: ``test`` for ``ceil(test_size * n)`` rows of each class, else ``train``."""
    marked = fit_holdout(df, key, label, test_size, positive, seed).mark(df, "_leadloom_test", grouped)
    return marked.withColumn(out, F.when(F.col("_leadloom_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_leadloom_test")


def fit_folds(df: DataFrame, key, label: str, k: int = 5, positive=1,
              seed: int = DEFAULT_SEED) -> ClassCutoffs:
    return ClassCutoffs.fit(
        df, key, label, lambda n: [F.expr(f"0L + ({j}L * _total + {k - 1}L) div {k}L") for j in range(1, k)],
        positive, seed)


def stratified_folds(df: DataFrame, key, label: str, k: int = 5, positive=1,
                     seed: int = DEFAULT_SEED, out: str = "fold", grouped: bool = False) -> DataFrame:
    """Adds ``fold`` (0 ... k-1): blocks of the seeded order, sizes within a class differ by at most one."""
    return fit_folds(df, key, label, k, positive, seed).place(df, out, grouped)


def balanced_sample(df: DataFrame, key, label: str, size: int = 500, positive=1,
                    seed: int = DEFAULT_SEED) -> DataFrame:
    """``min(positives, negatives, size)`` rows of each class, without replacement."""
    pos = is_positive(label, positive)
    have = df.agg(F.count(F.when(pos, 1)).alias("p"), F.count(F.when(~pos, 1)).alias("n")).first()
    take = min(have["p"], have["n"], size)
    cut = ClassCutoffs.fit(df, key, label, lambda n: [F.lit(take)], positive, seed)
    return cut.mark(df, "_leadloom_in").where("_leadloom_in").drop("_leadloom_in")
