"""Column expressions shared by the operators. All stay on the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.fixed import DEFAULT_SEED, INTEGER_PATTERN, NUMBER_PATTERN


def quoted(name: str) -> Column:
    """A top-level column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def order_hash(key: str | Sequence[str], seed: int = DEFAULT_SEED, salt: str | None = None) -> Column:
    """Hex text that puts rows in a seeded, reproducible "random" order.

    It depends on the row key only, never on partitioning, so every
    re-evaluation (retry, replay, other cluster size) draws the same rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    parts = [F.lit(str(seed))] + ([F.lit(salt)] if salt is not None else [])
    parts += [quoted(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def is_positive(label: str, positive) -> Column:
    """Class membership; a null label is negative."""
    return F.coalesce(quoted(label) == F.lit(positive), F.lit(False))


def looks_integer(text: Column) -> Column:
    return text.rlike(INTEGER_PATTERN)


def looks_number(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERN)


def ratio(num: Column, den: Column) -> Column:
    """Division where x/0 is null instead of an ANSI error."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def count_edges(value: Column, edges: Sequence[float], closed: str) -> Column:
    """How many ``edges`` lie below ``value``.

    ``closed='right'``: edges strictly below (bins closed on the right);
    ``closed='left'``: edges at or below. A short sum of comparisons, so it is
    generated code; meant for a handful of edges.
    """
    total = F.lit(0)
    for edge in edges:
        hit = value > F.lit(float(edge)) if closed == "right" else value >= F.lit(float(edge))
        total = total + hit.cast("int")
    return total


def grid_floor(score: Column, decimals: int = 3) -> Column:
    """Largest integer g with ``g / 10**decimals <= score``, exact for doubles."""
    scale = float(10 ** decimals)
    guess = F.floor(score * F.lit(scale))
    return (
        F.when((guess + 1).cast("double") / F.lit(scale) <= score, guess + 1)
        .when(guess.cast("double") / F.lit(scale) > score, guess - 1)
        .otherwise(guess)
        .cast("bigint")
    )


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    total = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        total = total * x + F.lit(float(c))
    return total


# Wichura's AS 241 rational approximation of the normal quantile,
# highest power first (numerator, denominator) for the centre, middle and tail.
_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_MIDDLE = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
     3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
     0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
     0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
     0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution for 0 < p < 1."""
    q = p - F.lit(0.5)
    centre = F.lit(0.180625) - q * q
    tail = F.sqrt(-F.ln(F.when(q <= 0, p).otherwise(F.lit(1.0) - p)))
    sign = F.when(q < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(F.abs(q) <= 0.425, q * _horner(centre, _CENTRE[0]) / _horner(centre, _CENTRE[1]))
        .when(tail <= 5.0, sign * _horner(tail - 1.6, _MIDDLE[0]) / _horner(tail - 1.6, _MIDDLE[1]))
        .otherwise(sign * _horner(tail - 5.0, _TAIL[0]) / _horner(tail - 5.0, _TAIL[1]))
    )
