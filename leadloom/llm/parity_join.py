"""A similarity join of texts by parity sketches of their shingle sets.

If two sets have a Jaccard similarity of t or more, their symmetric difference has at
most m (1 - t) / t elements, m the smaller size. Elements fall into K blocks by hash, and
a block's word is the XOR of its elements' hashes: one differing element changes one
word, so at most D words of a similar pair differ. With K > D blocks at least one word
agrees, and pairs are looked for among equal words only. Sizes are cut into bands, each
with its own K; a set also takes part in the bands of its possible smaller partners.

A second sketch has one parity bit per element. The Hamming distance of two sketches is
at most the symmetric difference, so a pair whose distance is larger is no link. What is
left is verified on the texts.

Links inside a word's bucket are found without listing its pairs: first every member is
compared with the bucket's first, linked sets grow together into components, and then
only pairs of members of different components are compared (by their sketches, within
the join). So every link that could join two components is verified.

Copies are one set: they take part once. Hot words arrive once per task and set.

Defined results: null and empty texts, and texts without words, have no shingles and
link with nothing. With fewer words than a shingle has, the whole sequence is one.
Rows with a null id link with nothing and have a null component; rows that share an id
are one document that holds the links of all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import BYTE_TABLE, Spans, bytes_of, mix, text_chunks, texts, word_spans
from leadloom.llm.graph import components, discard, written
from leadloom.llm.toxicity import LOWER

WORDS, PERCENT = 5, 80     # shingle length and similarity, unless a caller says otherwise
BAND_RATIO = 1.5
SKETCH_WORDS = 16          # 64 parity bits each
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(9, 14)]] = False


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct hashed shingles of each text."""
    low = LOWER[data]
    starts, stops, counts = word_spans(low, ends, IS_WORD)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(counts)
    spans = Spans(Spans(low, BYTE_TABLE).hash(starts, stops))
    at = np.append(0, np.cumsum(counts))
    rolled = spans.rolling(words) if len(starts) >= words else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            x = np.sort(rolled[a:b - words + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            out.append(spans.hash(np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def difference_bound(size: int, percent: int) -> int:
    """The most elements by which a similar pair differs, if the smaller set has ``size``."""
    return size * (100 - percent) // percent


@cache
def bands(percent: int, top: int = 1 << 40) -> tuple[list[int], list[int], list[int]]:
    """(first sizes, blocks, words that agree for certain) of the size bands; smaller sizes link with copies only."""
    size = next(n for n in range(1, 1000) if difference_bound(n, percent) >= 1)
    firsts, blocks, agree = [], [], []
    while size < top:
        after = max(size + 1, int(size * BAND_RATIO))
        most = difference_bound(after - 1, percent)
        # so many spare blocks that a set hardly ever leaves more of them empty
        spare = 1
        for _ in range(8):
            spare = 1 + math.ceil(1.5 * (most + spare) * math.exp(-size / (most + spare)))
        firsts.append(size)
        blocks.append(most + spare)
        agree.append(spare)
        size = after
    return firsts, blocks, agree


def block_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the words of a set, in all bands where it may have a partner."""
    firsts, blocks, agree = bands(percent)
    n = len(shingles)
    top = int(np.searchsorted(firsts, n, side="right")) - 1
    low = max(int(np.searchsorted(firsts, -(-n * percent // 100), side="right")) - 1, 0)
    out = []
    spread = mix(shingles ^ np.uint64(0xD1B54A32D192ED03))
    for band in range(low, top + 1):
        k = blocks[band]
        block = ((shingles >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)      # in order, as the hashes are
        begins = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        word = np.bitwise_xor.reduceat(spread, begins)
        where = block[begins]
        if k - len(begins) >= agree[band]:       # the agreeing words might all be empty: those count too
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), where)
            word, where = np.append(word, np.zeros(len(empty), np.uint64)), np.append(where, empty)
        out.append(mix(word + mix(where + np.uint64((band + 1) << 40))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One parity bit per element."""
    bits = np.bincount((mix(shingles) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
FOLDED = [f"f{i}" for i in range(SKETCH_WORDS // 2)]
ID_BITS = 1 << 22          # half a megabyte in the plan
LOOK_BACK = 6              # keys before, by which a pair is known to have met already


def set_digests(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``sum``, ``xor`` (which name the set) and its parity sketch."""
    def work(batches):
        for chunk in text_chunks(batches):
            sets = shingle_sets(*bytes_of(chunk.column("text")), words)
            sketches = np.stack([sketch(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(_signed([s.sum(dtype=np.uint64) for s in sets])),
                 pa.array(_signed([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets])),
                 *[pa.array(sketches[:, i]) for i in range(SKETCH_WORDS)]],
                ["doc_id", "n_shingles", "sum", "xor", *SKETCH])

    fields = ", ".join(f"{s} long" for s in SKETCH)
    return texts(docs).mapInArrow(work, f"doc_id long, n_shingles long, sum long, xor long, {fields}")


def word_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``key``, ``node`` (the set's sum): the words of every set, once per task and set."""
    least = bands(percent)[0][0]

    def work(batches):
        seen: set[tuple[int, int]] = set()
        for chunk in text_chunks(batches):
            keys, nodes = [], []
            for s in shingle_sets(*bytes_of(chunk.column("text")), words):
                if len(s) < least:
                    continue
                node = int(s.sum(dtype=np.uint64).view(np.int64))
                if (node, len(s)) in seen:
                    continue
                seen.add((node, len(s)))
                keys.append(block_keys(s, percent))
                nodes.append(node)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(keys))), pa.array(np.repeat(nodes, [len(k) for k in keys]))], ["key", "node"])

    return texts(docs).where(F.col("doc_id").isNotNull()).mapInArrow(work, "key long, node long")


def folded() -> list[Column]:
    """The sketch in half as many words: the parity of two of its bits at a time, which is a sketch as well."""
    return [F.col(SKETCH[i]).bitwiseXOR(F.col(SKETCH[i + SKETCH_WORDS // 2])) for i in range(SKETCH_WORDS // 2)]


def _possible(a: str, b: str, percent: int, sketch: list[str] = SKETCH) -> Column:
    """Whether sizes and sketches leave the pair a chance."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in sketch[1:]),
                F.bit_count(F.col(f"{a}.{sketch[0]}").bitwiseXOR(F.col(f"{b}.{sketch[0]}"))))
    apart = F.greatest(apart.cast("long"), F.abs(n - m))
    # n + m = union + common, and union - common is at least this distance
    return (n + m - apart) * 100 >= (n + m + apart) * percent


def _among(ids: DataFrame) -> Callable[[Column], Column]:
    """Whether an id may be one of ``ids``: a bit per hash of them, in at most ``ID_BITS`` bits whatever the table."""
    n = ids.count()
    bits = min(ID_BITS, max(1 << 10, 1 << (8 * n).bit_length()))

    def place(c: Column) -> Column:
        return F.xxhash64(c).bitwiseAND(bits - 1)

    slot = place(F.col("id"))
    one = F.call_function("shiftleft", F.lit(1), slot.bitwiseAND(7).cast("int"))
    found = ids.groupBy(F.shiftright(slot, 3).alias("byte")).agg(F.bit_or(one).alias("set")).toArrow()      # a row per byte at most
    held = np.zeros(bits >> 3, np.uint8)
    held[found["byte"].to_numpy()] = found["set"].to_numpy()
    told = F.lit(held.tobytes())

    def test(c: Column) -> Column:
        byte = F.conv(F.hex(F.substr(told, (F.shiftright(place(c), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, place(c).bitwiseAND(7).cast("int")).bitwiseAND(1) == 1

    return test


def verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``: ids) whose texts are similar. ``pairs`` are read several times; other texts hardly move."""
    member = _among(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    d = texts(docs).where(F.col("doc_id").isNotNull()).where(member(F.col("doc_id")))
    both = (pairs.join(d.select(F.col("doc_id").alias("a"), "text"), "a")
            .join(d.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "text", "other"))

    def work(batches):
        for chunk in text_chunks(batches, limit=1 << 20):
            left, right = (shingle_sets(*bytes_of(chunk.column(c)), words) for c in ("text", "other"))
            common = np.array([np.isin(x, y, assume_unique=True).sum() for x, y in zip(left, right)])
            union = np.array([len(x) + len(y) for x, y in zip(left, right)]) - common
            yield chunk.select(["a", "b"]).filter(pa.array((100 * common >= percent * union) & (union > 0)))

    return both.mapInArrow(work, "a long, b long")


def similar_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) of every row."""
    spark = docs.sparkSession
    digests, digest_path = written(set_digests(docs, words), "sets")
    named = ["n_shingles", "sum", "xor"]
    known = digests.where("doc_id is not null and n_shingles > 0")
    firsts, first_path = written(known.groupBy(*named).agg(F.min("doc_id").alias("node"), *[F.first(s).alias(s) for s in SKETCH]), "set-firsts")
    reps = firsts.select(F.col("sum").alias("name"), "node", "n_shingles", *SKETCH)

    key = Window.partitionBy("key")
    buckets, bucket_path = written(
        word_rows(docs, words, percent).withColumn("lo", F.min("node").over(key)).withColumn("hi", F.max("node").over(key))
        .where("lo <> hi").select("key", F.col("node").alias("name"), "lo"), "buckets")

    def pairs_of(candidates: DataFrame) -> DataFrame:
        """Names to ids, without the pairs that the sketches rule out."""
        return (candidates.join(reps.alias("x"), F.col("p") == F.col("x.name")).join(reps.alias("y"), F.col("q") == F.col("y.name"))
                .where(_possible("x", "y", percent) & (F.col("x.node") != F.col("y.node")))
                .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())

    stars, star_path = written(pairs_of(buckets.where("name <> lo").select(F.col("lo").alias("p"), F.col("name").alias("q")).distinct()), "pairs")
    links, link_path = written(verify(stars, docs, words, percent), "links")
    grown, grown_path = written(components(links), "components")

    def mixed(found: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components; a set without a link is its own.

        ``before`` has a set's last keys before this one, in the order of the keys.
        """
        of = reps.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).select(
            "name", "node", "component", "n_shingles", *[x.alias(s) for s, x in zip(FOLDED, folded())])
        part = buckets.select("key", "name").distinct().join(of.select("name", "component"), "name")
        keys = part.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key")
        last = Window.partitionBy("name").orderBy("key").rowsBetween(-LOOK_BACK, -1)
        kept = part.join(keys, "key", "left_semi").select("key", "name", F.collect_list("key").over(last).alias("before"))
        return kept.join(of, "name").drop("name")

    rest, rest_path = written(mixed(grown), "mixed-buckets")
    discard(spark, star_path, bucket_path, grown_path)
    # A pair meets in many buckets. It is passed over where both sets had one of their last keys in common: they
    # met there, and in the first bucket of all they cannot have met before. What is told twice is told once after.
    across = (rest.alias("x").join(rest.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))
                                   & _possible("x", "y", percent, FOLDED) & ~F.arrays_overlap("x.before", "y.before"))
              .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    by_node = reps.drop("name")
    likely, likely_path = written(
        across.join(by_node.withColumnRenamed("node", "a").alias("x"), "a").join(by_node.withColumnRenamed("node", "b").alias("y"), "b")
        .where(_possible("x", "y", percent)).select("a", "b"), "pairs")
    discard(spark, rest_path)
    more, more_path = written(verify(likely, docs, words, percent), "links")

    # rows that share an id tie their sets together
    shared = known.join(firsts.select(*named, "node"), named).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    extra = shared.join(known.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("a")), "a", "left_semi")
    final, final_path = written(components(links.unionAll(more).unionAll(extra)), "components")
    member = (digests.select("doc_id", *named).join(firsts.select(*named, F.col("node").alias("_rep")), named, "left")
              .join(final, F.coalesce("_rep", "doc_id") == F.col("node"), "left")
              .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "_rep", "doc_id")).alias("component_id")))
    out, _ = written(member, "classes")
    discard(spark, digest_path, first_path, link_path, likely_path, more_path, final_path)
    return out
