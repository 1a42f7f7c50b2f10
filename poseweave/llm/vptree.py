"""Nearest vectors by largest inner product over vantage-point trees, one for each shard.

Vectors get one more component that brings all of them to the largest norm; a query gets a zero there.  Then the
largest inner product is the smallest Euclidean distance, which the triangle inequality can prune.  A branch is left out when its
lower bound times ``factor`` exceeds the distance of the k-th vector found so far; with factor one the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poseweave.session import pin

K = 20
EVERY = 20
#: Vectors of a shard (on average), vectors of a leaf, queries of a block.
SHARD_ROWS = 8192
LEAF = 256
BLOCK_QUERIES = 1024
#: Rounding of a squared distance, and of what is pruned by it, as a share of the squared norms it is made from, for each component.
ROUNDING = 4e-15


class Tree:
    """A vantage-point tree over the distinct rows of ``points``; a leaf keeps its rows together.

    ``nodes`` has for each node its vantage row, its two children and the range of distances from the vantage row to the
    rows of each child; leaves have a span of rows instead.
    """

    def __init__(self, points: np.ndarray, seed: int = 0, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.points, self.leaf, self.random = points, leaf, np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.root = self._grow(0, len(points))
        self.points = points[self.order]

    def _grow(self, start: int, stop: int) -> int:
        if stop - start <= self.leaf:
            return self._leaf(start, stop)
        rows = self.order[start:stop]
        vantage = self.points[rows[self.random.integers(len(rows))]]
        away = np.linalg.norm(self.points[rows] - vantage, axis=1)
        by = np.argsort(away, kind="stable")
        self.order[start:stop], away = rows[by], away[by]
        if away[0] == away[-1]:
            return self._leaf(start, stop)
        middle = len(rows) // 2
        me = len(self.nodes)
        self.nodes.append(())
        inner, outer = self._grow(start, start + middle), self._grow(start + middle, stop)
        self.nodes[me] = (vantage, inner, outer, away[0], away[middle - 1], away[middle], away[-1])
        return me

    def _leaf(self, start: int, stop: int) -> int:
        self.nodes.append((start, stop))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> list[np.ndarray]:
        """For each query the original numbers of all rows that are, within rounding, among its k nearest."""
        n = len(queries)
        best = np.full((n, k), np.inf)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.seen = 0
        square = np.einsum("ij,ij->i", queries, queries)
        norms = np.einsum("ij,ij->i", self.points, self.points)
        loose = ROUNDING * (queries.shape[1] + 16) * (square + norms.max(initial=0.0))

        def limit(rows: np.ndarray) -> np.ndarray:
            """The largest computed distance that may belong to one of the k nearest."""
            return np.sqrt(best[rows, -1] ** 2 + loose[rows])

        def visit(node: int, active: np.ndarray) -> None:
            if not len(active):
                return
            entry = self.nodes[node]
            if len(entry) == 2:
                start, stop = entry
                rows = self.points[start:stop]
                self.seen += len(active) * (stop - start)
                gap = np.sqrt(np.maximum(0, square[active, None] + norms[start:stop] - 2 * queries[active] @ rows.T))
                keep = gap <= limit(active)[:, None]
                both = np.concatenate([best[active], gap], axis=1)
                best[active] = np.sort(np.partition(both, k - 1, axis=1)[:, :k], axis=1)
                for i in np.flatnonzero(keep.any(axis=1)):
                    at = np.flatnonzero(keep[i])
                    found[active[i]].append((start + at, gap[i, at]))
                return
            vantage, inner, outer, *span = entry
            away = np.linalg.norm(queries[active] - vantage, axis=1)
            bounds = [np.maximum(0, np.maximum(span[c] - away, away - span[c + 1])) for c in (0, 2)]
            first_inner = bounds[0] <= bounds[1]
            for child, mask in ((inner, first_inner), (outer, ~first_inner), (outer, first_inner), (inner, ~first_inner)):
                low = bounds[0] if child == inner else bounds[1]
                near = mask & (low * factor <= limit(active))
                visit(child, active[near])

        visit(self.root, np.arange(n))
        out, last = [], limit(np.arange(n))
        for i in range(n):
            rows, gaps = (np.concatenate(c) for c in zip(*found[i], strict=True)) if found[i] else (np.zeros(0, np.int64), np.zeros(0))
            out.append(self.order[rows[gaps <= last[i]]])
        return out


def products(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component on: equal vectors give equal sums."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += query[d] * rows[:, d]
    return total


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, row, embedding, size)`` of the rows that take part: id and components present, finite and not all zero."""
    fine = F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").where(fine & some).withColumn("size", F.size("embedding"))
    return pin(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for rows whose id ``every`` divides, the ``k`` other rows of largest inner product.

    Ties go to the smaller id.  Vectors of different length never meet.  Repeated rows are rows of their own.  Rows are
    dealt to shards by hash, so copies of one vector are spread; within a shard equal vectors are one tree row with their
    smallest ids, of which no query can use more than ``k + 1``.  Queries meet shards in blocks, and only the
    best ``k`` of each shard are merged.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    tops = {r["size"]: (r["n"], r["top"]) for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.max(F.aggregate(
        "embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("top")).collect()}
    lengths = spark.createDataFrame([(s, -(-n // shard_rows), top) for s, (n, top) in tops.items()], "size int, shards long, top double")
    dealt = rows.join(F.broadcast(lengths), "size").withColumn("shard", F.pmod(F.xxhash64("row"), "shards"))

    def grow(batch: pd.DataFrame) -> pd.DataFrame:
        points = np.array(batch["embedding"].tolist(), dtype=np.float64)
        distinct, at = np.unique(points, axis=0, return_inverse=True)
        by = np.lexsort((batch["row"], batch["vec_id"], at.ravel()))
        first = np.searchsorted(at.ravel()[by], np.arange(len(distinct) + 1))
        owners = [by[a: min(b, a + k + 1)] for a, b in zip(first[:-1], first[1:], strict=True)]
        keys = np.concatenate([np.stack([np.full(len(o), i), batch["vec_id"].to_numpy()[o], batch["row"].to_numpy()[o]], axis=1) for i, o in enumerate(owners)])
        return pd.DataFrame({"size": batch["size"].iloc[:1], "shard": batch["shard"].iloc[:1], "top": batch["top"].iloc[:1],
                             "points": [distinct.tobytes()], "keys": [keys.astype(np.int64).tobytes()]})

    shards = pin(dealt.groupBy("size", "shard").applyInPandas(grow, "size int, shard long, top double, points binary, keys binary"), "shards")
    asked = dealt.where(F.col("vec_id") % every == 0).select("vec_id", "row", "size", "embedding")
    many = max(1, -(-sum(n for n, _ in tops.values()) // every // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(many)).cast("int")

    def gather(batch: pd.DataFrame) -> pd.DataFrame:
        keys = batch[["vec_id", "row"]].to_numpy(np.int64)
        return pd.DataFrame({"size": batch["size"].iloc[:1], "block": batch["block"].iloc[:1], "asked": [keys.tobytes()],
                             "queries": [np.array(batch["embedding"].tolist(), dtype=np.float64).tobytes()]})

    blocks = asked.withColumn("block", block).groupBy("size", "block").applyInPandas(
        gather, "size int, block int, asked binary, queries binary")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, tree = None, None
        for batch in batches:
            for job in batch.itertuples():
                points = np.frombuffer(job.points).reshape(-1, job.size)
                keys = np.frombuffer(job.keys, dtype=np.int64).reshape(-1, 3)
                if held != (job.size, job.shard):
                    lift = np.sqrt(np.maximum(0, job.top - np.einsum("ij,ij->i", points, points)))
                    held, tree = (job.size, job.shard), Tree(np.column_stack([points, lift]))
                first = np.searchsorted(keys[:, 0], np.arange(len(points) + 1))
                queries = np.frombuffer(job.queries).reshape(-1, job.size)
                ids = np.frombuffer(job.asked, dtype=np.int64).reshape(-1, 2)
                lifted = np.column_stack([queries, np.zeros(len(queries))])
                out = []
                # One more than k: the query itself may be the nearest.
                for (query_id, row), query, hits in zip(ids, queries, tree.search(lifted, k + 1, factor), strict=True):
                    at = np.concatenate([np.arange(first[h], first[h + 1]) for h in hits]) if len(hits) else np.zeros(0, np.int64)
                    at = at[keys[at, 2] != row]
                    scores = products(query, points[keys[at, 0]])
                    best = np.lexsort((keys[at, 2], keys[at, 1], -scores))[:k]
                    out.append(pd.DataFrame({"query_id": query_id, "query_row": row, "vec_id": keys[at[best], 1], "row": keys[at[best], 2], "score": scores[best]}))
                if out:
                    yield pd.concat(out)

    # Every block meets every shard: the meetings are numbers; a shard's rows travel once, to all its blocks.
    meetings = shards.select("size", "shard", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("block"))
    met = meetings.join(blocks, ["size", "block"]).join(shards, ["size", "shard"])
    best = met.mapInPandas(search, "query_id long, query_row long, vec_id long, row long, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
