"""A Merkle manifest of a dataset with a witness for every row, grown by appending.

Leaves are the rows' digests; every tree (here: one per language) has its leaves in
ascending order, and the trees' roots are the leaves of one more tree. Two consecutive
nodes become one; the last node of an odd row of nodes is hashed alone, until one node
is left.

A block is an aligned row of 2**bits leaves. Inside a block leaves are appended one by
one to a list of open subtrees: a new leaf starts with an empty witness, and whenever
two open subtrees of one height close into one, the root of each extends the witnesses
in the other. The block roots are appended in the same way to the next round's blocks,
so that ``n`` leaves take log(n) / bits rounds and no task ever holds more than 2**bits
nodes. A row's witness is its block's part followed by those of the blocks above.

Places in a tree come from one range shuffle of the digests (never the texts) and counts
per partition; the sort key ends with the row number, so equal rows are split too.

Defined results: a field that is null is ``-``; rows without an id come first in their
tree, equal ids by their digest; equal rows are leaves of their own, beside each other;
rows without a language are a tree of their own, the first; an empty table has no rows.
Only the columns of the manifest are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import prepare
from leadloom.llm.graph import discard, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 10                  # 1,024 leaves a block


def digest(*parts: bytes) -> bytes:
    """sha256 of the inputs' hexadecimal texts, one after another."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf_of(values: dict[str, Column]) -> Column:
    """The binary digest of a row's fields: byte count, colon and value each, or ``-``."""
    texts = [v.cast("string") for v in values.values()]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*told), 256))


class OpenSubtrees:
    """Nodes appended from the left; ``witnesses`` holds a sibling (or None) per node and height."""

    def __init__(self, levels: int):
        self.levels, self.size = levels, 0
        self.open: list[tuple[int, int, bytes]] = []        # height, first node, root; heights fall
        self.witnesses: list[list[bytes | None]] = []

    def append(self, node: bytes) -> None:
        self.open.append((0, self.size, node))
        self.witnesses.append([])
        self.size += 1
        self._complete()

    def _complete(self) -> None:
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            _, middle, right = self.open.pop()
            height, first, left = self.open.pop()
            for w in self.witnesses[first:middle]:
                w.append(right)
            for w in self.witnesses[middle:]:
                w.append(left)
            self.open.append((height + 1, first, digest(left, right)))

    def close(self) -> bytes:
        """The root ``levels`` above the nodes: what is still open is hashed alone where nothing is beside it."""
        while self.open[-1][0] < self.levels:
            height, first, root = self.open.pop()
            for w in self.witnesses[first:]:
                w.append(None)
            self.open.append((height + 1, first, digest(root)))
            self._complete()
        return self.open[0][2]


def fold(leaf: bytes, place: int, witness: Sequence[bytes | None]) -> bytes:
    """The root that a leaf and its witness lead to."""
    for sibling in witness:
        leaf = digest(leaf) if sibling is None else digest(sibling, leaf) if place & 1 else digest(leaf, sibling)
        place >>= 1
    return leaf


def in_order(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, str]:
    """``rows`` (``tree`` and others) with ``pos`` in their tree and its size ``n``; also the scratch path."""
    keys = ["tree", *order, "tie"]
    sorted_rows = (rows.withColumn("tie", F.monotonically_increasing_id())
                   .repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumns({"part": F.spark_partition_id(),
                                 "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).drop("tie"))
    kept, path = written(sorted_rows, "merkle-order")
    counts = kept.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per tree and partition it lies in
    placed = counts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("rows").over(tree).alias("n"))
    return kept.join(placed, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift"), path


def append_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """``nodes`` (``tree``, ``pos``, ``n``, ``node`` and others) with ``block``, ``witness`` inside it and its root ``top``."""
    blocks = nodes.withColumn("block", F.shiftright("pos", bits))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields)

    def grow(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        height = (block.column("n")[0].as_py() - 1).bit_length()
        subtrees = OpenSubtrees(min(bits, height))
        for node in block.column("node").to_pylist():
            subtrees.append(node)
        root = subtrees.close()
        return (block.append_column("witness", pa.array(subtrees.witnesses, pa.list_(pa.binary())))
                .append_column("top", pa.array([root] * block.num_rows, pa.binary())))

    return blocks.groupBy("tree", "block").applyInArrow(grow, f"{fields}, witness array<binary>, top binary")


def grow_trees(nodes: DataFrame, bits: int) -> tuple[list[DataFrame], list[str]]:
    """One table per round: the blocks of the leaves, of the block roots, and so on until every tree is one block."""
    rounds, paths = [], []
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        grown, path = written(append_blocks(nodes, bits), "merkle-blocks")
        rounds.append(grown)
        paths.append(path)
        if largest <= 1 << bits:
            return rounds, paths
        largest = -(-largest >> bits)
        nodes = grown.where(F.col("pos") % (1 << bits) == 0).select(
            "tree", F.col("block").alias("pos"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), F.col("top").alias("node"))


def extended(rounds: Sequence[DataFrame]) -> DataFrame:
    """The first round's rows with whole witnesses and the root of their tree: each round's joins have 2**bits rows a key."""
    above = None
    for grown in reversed(rounds):
        if above is None:
            whole = grown.withColumnRenamed("top", "tree_root")
        else:
            whole = (grown.drop("top").join(above, ["tree", "block"])
                     .withColumn("witness", F.concat("witness", "upper")).drop("upper"))
        above = whole.select("tree", F.col("pos").alias("block"), F.col("witness").alias("upper"), "tree_root",
                             *[c for c in ("place", "outer", "root") if c in whole.columns])
    return whole


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, tree: str = "lang", key: str = "doc_id",
             changed: Column | None = None, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs`` with the manifest and the row's witness.

    ``doc_id`` (the ``key``), ``leaf``, ``subroot``, ``root`` (binary), ``pos`` and ``place``
    (of the leaf in its tree and of the tree among the trees), ``witness`` and ``outer``
    (siblings from the leaf to the subroot and on to the root; null where a node was alone).
    ``changed`` is carried along as a column of that name, e.g. the digest of an altered row.
    """
    spark = docs.sparkSession
    prepare(spark)
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    leaves = docs.select(name.alias("tree"), F.col(key).cast("long").alias("doc_id"),
                         leaf_of({f: F.col(f) for f in fields}).alias("node"),
                         (F.lit(None).cast("binary") if changed is None else changed).alias("changed"))
    placed, order_path = in_order(leaves, ["doc_id", "node"])
    rounds, paths = grow_trees(placed, bits)
    roots = rounds[-1].where("pos = 0").select("tree", F.col("top").alias("node"))
    ranked, roots_path = in_order(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"])
    outer, outer_paths = grow_trees(ranked, bits)
    tops = extended(outer).select(F.col("name").alias("tree"), F.col("pos").alias("place"), F.col("witness").alias("outer"),
                                  F.col("tree_root").alias("root"))
    # the last round has one block per tree, so that a large tree is no hot key
    whole, _ = written(extended([*rounds[:-1], rounds[-1].join(tops, "tree")]).select(
        "doc_id", F.col("node").alias("leaf"), "changed", F.col("tree_root").alias("subroot"), "root",
        "pos", "place", "witness", "outer"), "merkle-manifest")
    discard(spark, order_path, roots_path, *paths, *outer_paths)
    return whole


def refolded(rows: DataFrame, leaf: str) -> DataFrame:
    """``rows`` of a manifest with ``folded``, the root that column ``leaf`` leads to, and ``proof``, the digest of the siblings."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def work(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (leaf, "pos", "place", "witness", "outer")]
            roots, proofs = [], []
            for node, pos, place, inner, outer in zip(*columns):
                roots.append(fold(fold(node, pos, inner), place, outer))
                proofs.append(digest(*[s for s in (*inner, *outer) if s is not None]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary()), pa.array(proofs, pa.binary())],
                                             [*batch.schema.names, "folded", "proof"])

    return rows.mapInArrow(work, f"{fields}, folded binary, proof binary")


def verified_manifest(docs: DataFrame, tampered: Column, bits: int = BITS) -> DataFrame:
    """The manifest of ``docs`` with every row checked against the root, as it is or, where ``tampered``, with one more ``n_chars``.

    ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (hexadecimal), ``verified``. A row without
    ``n_chars`` cannot be altered that way.
    """
    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1)         # no overflow at the greatest long
    altered = leaf_of({f: F.when(F.coalesce(tampered, F.lit(False)), more).otherwise(F.col(f).cast("decimal(20,0)"))
                       if f == "n_chars" else F.col(f) for f in FIELDS})
    told = refolded(manifest(docs, changed=altered, bits=bits), "changed")
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")}
    return told.select("doc_id", *[v.alias(c) for c, v in text.items()], F.lower(F.hex("proof")).alias("proof_sha256"),
                       F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
