"""Approximate nearest neighbours by a forest of random-projection trees.

Distinct vectors are dealt by hash to blocks of bounded size; each block grows its own forest over
all its rows. A tree splits by the hyperplane between two rows picked at random. A query descends
all trees of the forest at once, level by level, and the leaves of all trees are ordered by the largest margin
against the query on the way: the most promising leaf of any tree is opened next, until enough candidates are
gathered. These are ranked again by exact cosines. The blocks' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quaystone.llm.common import bound_arrow
from quaystone.llm.topk import ranked


def usable(vec: str) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vec, lambda x: x != 0)


class Forest:
    """Random-projection trees over the rows of a matrix of unit vectors, searched in single precision.

    Inner nodes are numbered from 0, as their planes; a leaf i is written as -1 - i.
    """

    def __init__(self, unit: np.ndarray, trees: int, leaf: int, seed: int):
        self.unit, self.leaf = unit.astype(np.float32), leaf
        self.rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.leaves: list[np.ndarray] = []
        self.roots = [self._grow(np.arange(len(unit))) for _ in range(trees)]
        self.normals = np.stack(self.planes) if self.planes else np.zeros((0, unit.shape[1]), np.float32)
        self.shifts = np.asarray(self.offsets, np.float32)
        self._walk()

    def _grow(self, rows: np.ndarray) -> int:
        """Depth is logarithmic: a split that leaves one side under a tenth falls back to the median."""
        n = len(rows)
        if n <= self.leaf:
            self.leaves.append(rows)
            return -len(self.leaves)
        i, j = (self.rng.random(2) * (n, n - 1)).astype(np.int64)
        normal = self.unit[rows[i]] - self.unit[rows[j + (j >= i)]]
        size = float(normal @ normal) ** 0.5
        normal = normal / np.float32(size) if size > 0 else self.rng.normal(size=self.unit.shape[1]).astype(np.float32)
        side = self.unit[rows] @ normal
        offset = 0.0
        right = side > offset
        if not 0.1 * n <= np.count_nonzero(right) <= 0.9 * n:
            order = np.argsort(side, kind="stable")
            right = np.zeros(n, bool)
            right[order[n // 2 :]] = True
            offset = float(side[order[n // 2]])
        at = len(self.planes)
        self.planes.append(normal)
        self.offsets.append(offset)
        self.low.append(0)
        self.high.append(0)
        self.low[at], self.high[at] = self._grow(rows[~right]), self._grow(rows[right])
        return at

    def _walk(self) -> None:
        """Levels of all trees from the roots down, for :meth:`reached`, and the leaf that each row is in, tree by tree."""
        self.levels, level = [], np.asarray(self.roots, np.int64)
        low, high = np.asarray(self.low, np.int64), np.asarray(self.high, np.int64)
        inner = level[level >= 0]
        while len(inner):
            self.levels.append((inner, low[inner], high[inner]))
            below = np.concatenate([low[inner], high[inner]])
            inner = below[below >= 0]
        self.of = np.empty((len(self.roots), len(self.unit)), np.int64)
        tree = 0
        filled = 0
        for i, rows in enumerate(self.leaves):
            self.of[tree, rows] = i
            filled += len(rows)
            if filled == len(self.unit):
                tree, filled = tree + 1, 0

    def reached(self, margins: np.ndarray) -> np.ndarray:
        """For each row the smallest cost of a leaf that holds it in any tree: the largest margin by which the way to that leaf leaves the query's side."""
        nodes, leaves = np.zeros(len(self.planes), np.float32), np.zeros(len(self.leaves), np.float32)
        for at, low, high in self.levels:
            m, cost = margins[at], nodes[at]
            for child, far in ((low, m), (high, -m)):
                c = np.maximum(cost, far)
                inner = child >= 0
                nodes[child[inner]] = c[inner]
                leaves[-1 - child[~inner]] = c[~inner]
        best = leaves[self.of[0]]
        for of in self.of[1:]:
            np.minimum(best, leaves[of], out=best)
        return best

    def margins(self, queries: np.ndarray, batch: int = 64) -> Iterator[np.ndarray]:
        """For each query its distances from all planes, a batch in one product."""
        for start in range(0, len(queries), batch):
            yield from queries[start : start + batch].astype(np.float32) @ self.normals.T - self.shifts

    def candidates(self, query: np.ndarray, k: int, most: int, margins: np.ndarray | None = None, first: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the leaves opened, most promising first over all trees, and their cosines in single precision.

        Leaves are opened in the order of their costs, so a row is in by the cheapest leaf that holds it.
        It ends with the leaf that brings ``most`` distinct rows in, or earlier when every leaf left in any
        tree lies beyond a hyperplane that is farther away than the k-th nearest of the ``first`` rows: then no row
        that is left is nearer. Rows that are equally promising come in together.
        """
        query, n = query.astype(np.float32), len(self.unit)
        cost = self.reached(self.normals @ query - self.shifts if margins is None else margins)
        limit = np.partition(cost, most - 1)[most - 1] if most < n else np.inf
        few = np.flatnonzero(cost <= np.partition(cost, first - 1)[first - 1]) if first < n else np.arange(n)
        if len(few) >= k:  # of unit vectors, squared distance is 2 - 2 cosine; single precision is given its room
            kth = np.partition(self.unit[few] @ query, -k)[-k]
            limit = min(limit, max(0.0, 2 - 2 * float(kth) + 1e-5) ** 0.5 + 1e-5)
        opened = cost <= limit
        opened[few] = True
        rows = np.flatnonzero(opened)
        return rows, self.unit[rows] @ query


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = 32, leaf: int = 16, share: float = 0.55, block_rows: int = 16_384, query_rows: int = 16_384
) -> DataFrame:
    """(query_id, rank int, id, score double): the k nearest found by cosine, exact for what is found.

    Every usable row is in the index. A query examines at most ``share`` of each block's rows, which
    is what vectors without any structure need for a recall of 0.9, and fewer where the trees show
    that no nearer row is left. A row is no candidate for the query of its own id; ties go to the
    smaller id. Null, empty and zero vectors and those with null or non-finite components take no
    part, nor do null ids; a vector of another length than the query's is no candidate. Equal
    vectors are one entry of the index that carries their k + 1 smallest ids, which is all that can
    be returned of them. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    bound_arrow(spark)
    data = vectors.where(usable(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id_"), F.transform(vec_col, lambda x: x.cast("double")).alias("v_"))
    asked = queries.where(usable(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id_"), F.transform(vec_col, lambda x: x.cast("double")).alias("v_"))
    # The limit is applied before the shuffle too, so a vector that is very common stays small.
    few = data.withColumn("r_", F.row_number().over(Window.partitionBy("v_").orderBy("id_"))).where(F.col("r_") <= k + 1).groupBy("v_").agg(F.sort_array(F.collect_list("id_")).alias("ids_"))
    n, q = data.count(), asked.count()
    if not n or not q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double").withColumnRenamed("vec_id", id_col)
    blocks, query_blocks = max(1, -(-n // block_rows), min(spark.sparkContext.defaultParallelism, n // 8_192)), max(1, -(-q // query_rows))
    rows = few.withColumn("block_", F.pmod(F.xxhash64("v_"), F.lit(blocks)).cast("int")).withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    sent = asked.withColumn("part_", F.pmod(F.xxhash64("id_"), F.lit(query_blocks)).cast("int")).withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.assign(first=[x[0] for x in left["ids_"]]).sort_values("first")
            values = np.stack(left["v_"].to_numpy())
            norms = np.sqrt((values * values).sum(axis=1))
            ids = left["ids_"].to_numpy()
            forest = Forest(values / norms[:, None], trees, leaf, 7)
            asked_ = np.stack(right["v_"].to_numpy()).astype(np.float64)
            sizes = np.sqrt((asked_ * asked_).sum(axis=1))
            for qid, v, size, margins in zip(right["id_"].tolist(), asked_, sizes, forest.margins(asked_ / sizes[:, None])):
                found, near = forest.candidates(v / size, k + 1, max(int(share * len(values)), k + 1), margins)
                # All that single precision cannot tell from the k + 1 best are ranked again.
                best = found[near >= np.partition(near, -min(len(near), k + 1))[-min(len(near), k + 1)] - 1e-5]
                exact = (values[best] * v).sum(axis=1) / (norms[best] * size)
                hits = sorted((-s, i) for row, s in zip(best, exact.tolist()) for i in ids[row].tolist() if i != qid)[:k]
                out += [(qid, i, -s) for s, i in hits]
        return pd.DataFrame(out, columns=["query_id", "id_", "score"]).astype({"query_id": "int64", "id_": "int64", "score": "float64"})

    keys, length = ("block_", "part_", "size_"), F.size("v_").alias("size_")
    found = rows.select("block_", "part_", length, "ids_", "v_").groupBy(*keys).cogroup(sent.select("block_", "part_", length, "id_", "v_").groupBy(*keys)).applyInPandas(search, "query_id long, id_ long, score double")
    return ranked(found, k, id_col)
