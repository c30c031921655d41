"""Nearest neighbours by a robust-pruned directed graph in every shard.

Vectors are dealt to shards of bounded size by the hash of their id. A shard's task
builds its graph in batches: a beam search over the graph so far proposes neighbours, the
relaxed rule drops a candidate that is closer (by a factor alpha) to a neighbour already
kept, and kept edges are added the other way round, pruned again where a list is full.
The graphs are written once. Queries come in blocks of bounded size; each block meets each
shard's graph in a group of its own, answers by beam search, and the answers meet per query.

Copies of one vector are one node with its smallest ids (as many as can be asked for).
Distances of the answers are computed anew in double precision from the given vectors.

Defined results: vectors that are null, zero, empty, or hold null or non-finite values
take no part, nor do rows with a null id; vectors are compared with those of their own
dimension. With fewer candidates than asked for, all are returned. If an id has several
vectors its nearest counts. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import prepare
from leadloom.llm.graph import written

SHARD_ROWS = 5_000
QUERY_BLOCK = 20_000       # queries that one group answers, or so
DEGREE, BUILD_BEAM, ALPHA = 32, 48, 1.2
SEARCH_BEAM, WIDE, STARTS = 96, 4, 8
BATCH = 256


class Graph:
    def __init__(self, vectors: np.ndarray, seed: int = 11, built: tuple[np.ndarray, np.ndarray] | None = None):
        """Builds the graph, or takes the edges and starts of one that was ``built`` from these vectors."""
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.square = np.einsum("nd,nd->n", self.x, self.x)
        n = len(self.x)
        if built is not None:
            self.out, self.starts = built
            return
        rng = np.random.default_rng(seed)
        self.out = np.full((n, DEGREE), -1, np.int32)
        first = min(DEGREE // 4, n - 1)
        if first > 0:       # a random start that a pass over all nodes replaces
            self.out[:, :first] = (np.arange(n)[:, None] + rng.integers(1, n, (n, first))) % n
        middle = np.argmin(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1))
        self.starts = np.unique(np.append(rng.integers(0, n, STARTS - 1), middle))
        for alpha in (1.0, ALPHA):
            order = rng.permutation(n)
            for k in range(0, n, BATCH):
                self.insert(order[k:k + BATCH], alpha)

    def distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of ids; infinite where the id is -1."""
        got = self.x[ids]
        d = np.einsum("bd,bd->b", queries, queries)[:, None] + self.square[ids] - 2 * np.einsum("bd,bcd->bc", queries, got)
        return np.where(ids < 0, np.inf, np.maximum(d, 0))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the beam of every query, nearest first; -1 fills up."""
        b = len(queries)
        squares = np.einsum("bd,bd->b", queries, queries)
        ids = np.full((b, beam), -1, np.int32)
        ids[:, :min(len(self.starts), beam)] = self.starts[:beam]
        dist = self.distances(queries, ids)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        seen = ids < 0
        met = np.full(b * len(self.x), -1, np.int32)      # a node's distance to a query is computed once
        row, col = np.nonzero(ids >= 0)
        met[row * len(self.x) + ids[row, col]] = 0
        live = np.arange(b)
        while len(live):
            now, far, closed = ids[live], dist[live], seen[live]
            pick = np.argsort(closed, axis=1, kind="stable")[:, :WIDE]          # the nearest that are not expanded
            fresh = ~np.take_along_axis(closed, pick, 1)
            np.put_along_axis(closed, pick, True, 1)
            row, col = np.nonzero(fresh)
            reach = self.out[now[row, pick[row, col]]]
            row, reach = np.repeat(row, DEGREE), reach.ravel()
            spot = live[row] * len(self.x) + reach
            new = (reach >= 0) & (met[spot] < 0)
            row, reach, spot = row[new], reach[new], spot[new]
            nth = np.arange(len(spot), dtype=np.int32)
            met[spot] = nth
            new = met[spot] == nth      # of repeats in one step one stays
            row, reach = row[new], reach[new]
            count = np.bincount(row, minlength=len(live))
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            more = np.full((len(live), int(count.max(initial=0))), -1, np.int32)
            apart = np.full(more.shape, np.inf, dist.dtype)
            mine = queries[live[row]]
            more[row, place] = reach
            apart[row, place] = np.maximum(squares[live[row]] + self.square[reach] - 2 * np.einsum("nd,nd->n", mine, self.x[reach]), 0)
            both, apart = np.concatenate([now, more], 1), np.concatenate([far, apart], 1)
            flags = np.concatenate([closed, more < 0], 1)
            keep = np.argsort(apart, axis=1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(apart, keep, 1)
            ids[live] = np.take_along_axis(both, keep, 1)
            seen[live] = np.take_along_axis(flags, keep, 1)
            live = live[~seen[live].all(axis=1)]
        return ids, dist

    def prune(self, nodes: np.ndarray, pool: np.ndarray, alpha: float) -> np.ndarray:
        """Up to DEGREE neighbours of each node out of its pool, diverse ones first."""
        pool = np.where(pool == nodes[:, None], -1, pool)
        ordered = np.sort(pool, axis=1)
        pool = np.where(np.concatenate([np.zeros((len(pool), 1), bool), ordered[:, 1:] == ordered[:, :-1]], 1), -1, ordered)
        far = self.distances(self.x[nodes], pool)
        got, square = self.x[pool], self.square[pool]
        alive, kept = np.isfinite(far), np.full((len(nodes), DEGREE), -1, np.int32)
        rows = np.arange(len(nodes))
        for r in range(DEGREE):
            left = np.where(alive, far, np.inf)
            best = left.argmin(axis=1)
            ok = np.isfinite(left[rows, best])
            if not ok.any():
                break
            kept[ok, r] = pool[rows, best][ok]
            chosen = got[rows, best]
            between = np.einsum("bd,bd->b", chosen, chosen)[:, None] + square - 2 * np.einsum("bd,bcd->bc", chosen, got)
            alive &= alpha * alpha * between > far
            alive[rows, best] = False
        return kept

    def insert(self, nodes: np.ndarray, alpha: float) -> None:
        found, _ = self.search(self.x[nodes], BUILD_BEAM)
        self.out[nodes] = kept = self.prune(nodes, np.concatenate([found, self.out[nodes]], 1), alpha)
        source, target = np.repeat(nodes, DEGREE), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        while len(target):      # up to eight new edges of a node at a time
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            begins = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
            nth = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
            turn = nth < 8
            to = target[begins]
            extra = np.full((len(to), 8), -1, np.int32)
            extra[np.searchsorted(to, target[turn]), nth[turn]] = source[turn]
            pool = np.concatenate([self.out[to], extra], 1)
            ordered = np.sort(pool, axis=1)
            distinct = (ordered >= 0).sum(1) - ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] >= 0)).sum(1)
            full = distinct > DEGREE
            if full.any():
                self.out[to[full]] = self.prune(to[full], pool[full], alpha)
            if (~full).any():   # there is room: all stay
                some = ordered[~full]
                some[:, 1:][some[:, 1:] == some[:, :-1]] = -1
                self.out[to[~full]] = -np.sort(-some, axis=1)[:, :DEGREE]
            source, target = source[~turn], target[~turn]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``vector`` (doubles) of the rows that take part."""
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .where(F.coalesce(sound, F.lit(False)) & F.exists("embedding", lambda v: v != 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform("embedding", lambda v: v.cast("double") + 0.0).alias("vector")))


def built_graphs(vectors: DataFrame, copies: int, shards: int) -> DataFrame:
    """One row per node: ``size``, ``shard``, ``node`` (its number there), ``ids``, ``vector``, ``edges``, ``is_start``."""
    # the smallest ids of a vector; Spark cuts each task's share to so many before the shuffle
    order = Window.partitionBy("vector").orderBy("vec_id")
    nodes = (vectors.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= copies)
             .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    dealt = nodes.select(F.size("vector").alias("size"), F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(shards)).alias("shard"),
                         "ids", "vector", F.element_at("ids", 1).alias("first"))

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("first", "ascending")]).drop_columns(["first"])
        graph = Graph(np.array(shard.column("vector").combine_chunks().flatten()).reshape(shard.num_rows, -1))
        ends = np.arange(shard.num_rows + 1, dtype=np.int32) * DEGREE
        whole = (shard.append_column("node", pa.array(np.arange(shard.num_rows, dtype=np.int32)))
                 .append_column("edges", pa.ListArray.from_arrays(pa.array(ends), pa.array(graph.out.ravel())))
                 .append_column("is_start", pa.array(np.isin(np.arange(shard.num_rows), graph.starts))))
        lists = {"ids": pa.int64(), "vector": pa.float64(), "edges": pa.int32()}
        return whole.cast(pa.schema([(f.name, pa.list_(lists[f.name]) if f.name in lists else f.type) for f in whole.schema]))

    kinds = "size int, shard long, ids array<long>, vector array<double>, node int, edges array<int>, is_start boolean"
    return dealt.groupBy("size", "shard").applyInArrow(build, kinds)


def nearest(vectors: DataFrame, k: int = 10, query_step: int = 100, shard_rows: int = SHARD_ROWS,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for each id divisible by ``query_step``."""
    prepare(vectors.sparkSession)
    held = usable(vectors)
    told = held.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("vec_id") % query_step == 0).alias("queries")).first()
    shards, blocks = max(1, -(-told["rows"] // shard_rows)), max(1, -(-told["queries"] // query_block))
    graphs, _ = written(built_graphs(held, k + 1, shards), "graphs")
    each_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    # the stated query set goes to every shard
    asked = held.where(F.col("vec_id") % query_step == 0).select(
        F.size("vector").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "vector")
    width = k + 1

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.sort_by([("node", "ascending")])
        x, q = (np.array(t.column("vector").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (left, right))
        edges = np.array(left.column("edges").combine_chunks().flatten()).reshape(len(x), DEGREE)
        graph = Graph(x, built=(edges, np.flatnonzero(left.column("is_start").to_numpy())))
        parts = []
        for at in range(0, len(q), BATCH):
            some = q[at:at + BATCH]
            found = graph.search(some.astype(np.float32), SEARCH_BEAM)[0]
            exact = np.sqrt(((some[:, None, :] - x[found]) ** 2).sum(axis=2))
            exact[found < 0] = np.inf
            order = np.argsort(exact, axis=1, kind="stable")[:, :width]
            best, score = np.take_along_axis(found, order, 1), np.take_along_axis(exact, order, 1)
            row, col = np.nonzero(np.isfinite(score))
            parts.append((right.column("vec_id").to_numpy()[at + row], best[row, col], score[row, col]))
        query, node, score = (np.concatenate(p) for p in zip(*parts))
        return pa.table([pa.array(query), left.column("ids").combine_chunks().take(pa.array(node)), pa.array(score)], schema=schema)

    found = (graphs.select("*", each_block).groupBy("size", "shard", "block")
             .cogroup(asked.groupBy("size", "shard", "block")).applyInArrow(answer, "query_id long, ids array<long>, score double"))
    each = (found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
            .groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (each.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
