"""Allow or block a URL: rules first, else a logistic regression on hashed character n-grams of host and path.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
path: from there up to ``?``, ``#`` or the end. A null url and one without ``://`` have both
empty. A rule names a host and the beginning of a path; it fits that host and its
subdomains; of the fitting rules the longest wins (host and path together, then the host),
and of one rule given twice with both verdicts ``block`` counts.

The classifier sees the n-grams of the host and of the path, each closed by a mark on both
sides, as 2**18 hashed features (a feature is there or not) scaled by the square root of
their number, and is trained in numpy with a quadratic penalty on a small labelled URL
table. Only url parts are inputs, so rows that repeat a url get the same verdict; a score
of one half counts as ``block``; empty parts get the score of an empty url. Columns of the
input pass through ``judge`` as they are, but those that are named like a result give way to it.

The rules and the weights (2 MB) go to the executors; both are parameters that the caller
holds on the driver. No shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import Spans, bytes_of, code_table, prepare, ranges, text_chunks

BITS = 18
GRAMS = (3, 4, 5)
LABEL_ROWS = 50_000        # rows of a labelled URL table that a model is fitted on
PENALTY = 0.02
STEPS = 400
MARK = 256                 # the symbol at both ends of a part
ALLOW, BLOCK = "allow", "block"

# A small labelled URL table; 1 is a url to block.
LABELLED_URLS = (
    ("https://www.morning-herald.example/en/politics/1024", 0), ("https://news.riverside.example/world/2024/05/story.html", 0),
    ("https://docs.python-guide.example/3/library/index.html", 0), ("http://blog.gardening.example/en/spring-bulbs", 0),
    ("https://en.encyclopedia.example/wiki/River", 0), ("https://m.weather.example/de/heute", 0),
    ("https://library.university.example/catalog/item/551", 0), ("https://www.recipes.example/fr/tarte", 0),
    ("http://forum.woodwork.example/thread/99?page=2", 0), ("https://shop.bookstore.example/en/history/312", 0),
    ("https://www.museum.example/es/obras/18", 0), ("https://support.printer.example/manual.html", 0),
    ("https://travel.mountains.example/en/hiking/7", 0), ("https://science.journal.example/articles/4411", 0),
    ("https://www.citycouncil.example/meetings/2023/11", 0), ("https://blog.thinking.example/en/415/", 0),
    ("https://m.theather.example/en/120", 0), ("https://theration.example/fr/88?page=2&ref=x", 0),
    ("http://www.station.example/de/501.html", 0), ("https://blog.nation.example/en/17#top", 0),
    ("https://thething.example/es/903/", 0), ("http://m.theories.example/en/64?utm_source=feed", 0),
    ("https://www.thistle.example/en/777", 0), ("https://notable.example/en/30", 0),
    ("https://casino-royal.example/en/bonus", 1), ("http://best-casino-win.example/spin/100", 1),
    ("https://win-casino.example/jackpot", 1), ("http://free-bets-now.example/odds", 1),
    ("https://sport-bets.example/free/signup", 1), ("https://www.free-bets.example/en/12", 1),
    ("http://cheap-pills-online.example/buy/viagra", 1), ("https://pills-cheap.example/en/order", 1),
    ("https://blog.cheap-meds.example/no-prescription", 1), ("http://adult-video-x.example/watch/18", 1),
    ("https://x-adult.example/cams/live", 1), ("https://www.adult-xxx.example/en/5", 1),
    ("http://spam-farm-link.example/seo/backlinks", 1), ("https://link-farm.example/cheap-traffic", 1),
    ("https://spam-mail.example/unsubscribe/991", 1), ("http://ads-track.example/pixel.gif", 1),
    ("https://m.ads-tracker.example/click?id=77", 1), ("https://track-ads.example/redirect", 1),
    ("http://lottery-winner.example/claim/prize", 1), ("https://free-iphone-win.example/survey", 1),
    ("https://quick-loans-cash.example/apply", 1), ("http://crypto-double.example/send/btc", 1),
    ("https://replica-watches-cheap.example/rolex", 1), ("https://download-crack.example/keygen.exe", 1),
)


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self):
        if self.verdict not in (ALLOW, BLOCK) or not self.host:
            raise ValueError(f"a rule allows or blocks a host: {self}")

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (UrlRule(ALLOW, "org"), UrlRule(BLOCK, "example.org", "/es/"), UrlRule(BLOCK, "example.org", "/en/1"),
         UrlRule(ALLOW, "com", "/fr/"), UrlRule(BLOCK, "com", "/de/"))


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_CODES = code_table(MARK + 1)


def features(parts: Sequence[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, row of each) of the rows' distinct n-grams, from one string array per part."""
    found = []
    for number, part in enumerate(parts):
        data, ends = bytes_of(part)
        rows = len(ends) - 1
        sizes = np.diff(ends)
        # every part with a mark on both sides
        symbols = np.full(len(data) + 2 * rows, MARK, np.int64)
        at = ends[:-1] + 2 * np.arange(rows)
        symbols[ranges(at + 1, sizes)] = data
        spans = Spans(symbols, _CODES)
        for width in GRAMS:
            count = np.maximum(sizes + 3 - width, 0)
            start = ranges(at, count)
            key = spans.hash(start, start + width) + np.uint64(number)
            bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
            found.append((np.repeat(np.arange(rows), count) << BITS) | bucket)
    told = np.unique(np.concatenate(found))
    return told & ((1 << BITS) - 1), told >> BITS


def scores(model: UrlModel, parts: Sequence[pa.Array]) -> np.ndarray:
    """Probability that a url is one to block."""
    rows = len(parts[0])
    number, row = features(parts)
    size = np.sqrt(np.maximum(np.bincount(row, minlength=rows), 1))
    return 1 / (1 + np.exp(-(np.bincount(row, model.weights[number].astype(np.float64), rows) / size + model.bias)))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", rows: int = LABEL_ROWS, penalty: float = PENALTY,
        steps: int = STEPS) -> UrlModel:
    """Fit on a labelled URL table: at most ``rows`` rows with label 0 or 1, chosen by the hash of the url.

    Both labels weigh the same in all. Rows of another label are left out; with one label
    only, or none, the score is constant: that label, or 0.
    """
    known = labelled.where(F.col(label).isin(0, 1)).select(
        host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(label).cast("int").alias("y"))
    # the bound makes this fit the driver
    told = known.orderBy(F.xxhash64("host", "path", "y"), "host", "path", "y").limit(rows).toArrow()
    y = told.column("y").to_numpy().astype(np.float64)
    weights = np.zeros(1 << BITS)
    if len(y) == 0 or y.min() == y.max():
        return UrlModel(weights.astype(np.float32), 30.0 if len(y) and y[0] else -30.0)
    number, row = features([told.column(c).combine_chunks() for c in ("host", "path")])
    used, slot = np.unique(number, return_inverse=True)
    value = 1 / np.sqrt(np.bincount(row, minlength=len(y)))[row]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b, aim_w, aim_b, pace = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0, 1.0
    rate = 1 / (0.5 + penalty / len(y))           # rows have length one, and so has the bias
    for _ in range(steps):                                    # accelerated gradient steps
        p = 1 / (1 + np.exp(-(np.bincount(row, value * aim_w[slot], len(y)) + aim_b)))
        off = share * (p - y)
        new_w = aim_w - rate * (np.bincount(slot, value * off[row], len(used)) + penalty / len(y) * aim_w)
        new_b = aim_b - rate * off.sum()
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        aim_w, aim_b = new_w + (pace - 1) / after * (new_w - w), new_b + (pace - 1) / after * (new_b - b)
        w, b, pace = new_w, new_b, after
    weights[used] = w
    return UrlModel(weights.astype(np.float32), float(b))


def rule_table(rules: Sequence[UrlRule]) -> dict[str, list[tuple[str, str, str]]]:
    """host -> (path, text, verdict), the longest path first."""
    verdicts: dict[tuple[str, str], str] = {}
    for r in rules:
        spot = (r.host, r.path)
        verdicts[spot] = BLOCK if BLOCK in (r.verdict, verdicts.get(spot)) else ALLOW
    out: dict[str, list[tuple[str, str, str]]] = {}
    for (host, path), verdict in sorted(verdicts.items(), key=lambda kv: -len(kv[0][1])):
        out.setdefault(host, []).append((path, host + path, verdict))
    return out


def longest_rule(table: dict[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits."""
    best: tuple[str | None, str | None] = (None, None)
    size, at = -1, 0
    while host:
        for beginning, text, verdict in table.get(host[at:], ()):
            if path.startswith(beginning):
                if len(text) > size:
                    best, size = (text, verdict), len(text)
                break
        at = host.find(".", at) + 1
        if not at:
            break
    return best


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[UrlRule] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the method's, whatever the rule)."""
    spark = pages.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((model, rule_table(rules)))
    own = F.col(f"`{url}`").cast("string")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "score")]
    parts = pages.select(*kept, host_of(own).alias("host"), path_of(own).alias("path"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)

    def work(batches):
        fitted, table = shared.value
        for chunk in text_chunks(batches, "path"):
            host, path = chunk.column("host"), chunk.column("path")
            p = scores(fitted, [host, path])
            found = [longest_rule(table, h, w) for h, w in zip(host.to_pylist(), path.to_pylist())]
            verdict = [v or (BLOCK if x >= 0.5 else ALLOW) for (_, v), x in zip(found, p.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*chunk.columns, pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string()), pa.array(p)],
                [*chunk.schema.names, "rule", "verdict", "score"])

    return parts.mapInArrow(work, f"{fields}, rule string, verdict string, score double")


def labelled_table(spark, urls: Sequence[tuple[str, int]] = LABELLED_URLS) -> DataFrame:
    return spark.createDataFrame(list(urls), "url string, label int")
