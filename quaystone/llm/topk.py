"""Exact top-k by a bit-sliced index.

Vectors are quantised to integers. Each block of rows keeps, for every attribute, one bitmap for
each of its bits (two's complement). A query's score is a sum of attributes times integer weights:
the slices of each attribute are added, shifted by the weight's signed binary digits, with a tree of
bitwise full adders, so all rows of a block are scored at once by bitmap arithmetic. The slices of
the sum, from the most significant downward, select the rows that can be among the best. To keep
the work small only the upper bits of each attribute are added; the bits left out give every row
the same span of error, so rows above the boundary less that span are the boundary rows, and these
are resolved exactly.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quaystone.llm.common import bound_arrow


def quantised(vec: str, scale: int):
    """array<long> of floor(scale * x), or null where the vector takes no part."""
    ok = (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(ok, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def slices(values: np.ndarray, low: int) -> list[list[np.ndarray]]:
    """For each attribute the bitmaps of its bits from ``low`` up; the last is the sign."""
    out = []
    for column in values.T:
        upper = column >> low
        bits = max(int(upper.max()).bit_length() if len(upper) else 0, int(-upper.min() - 1).bit_length() if len(upper) and upper.min() < 0 else 0) + 1
        out.append([np.packbits((upper >> b & 1).astype(np.uint8), bitorder="little") for b in range(bits)])
    return out


def signed_digits(weight: int) -> list[tuple[int, int]]:
    """(shift, sign) of the non-adjacent form: as few terms as possible."""
    out, shift = [], 0
    while weight:
        if weight & 1:
            sign = 2 - (weight & 3)
            out.append((shift, sign))
            weight -= sign
        weight >>= 1
        shift += 1
    return out


def add_all(terms: list[tuple[int, int, list[np.ndarray]]], width: int, words: int) -> list[np.ndarray]:
    """The bit slices, modulo 2**width, of the sum of sign * 2**shift * value over terms, by full adders column by column.

    A value's sign slice stands for -2**top: it is added as its complement there, and the constant
    that this and each subtraction owe is added once at the end.
    """
    columns: list[list[np.ndarray]] = [[] for _ in range(width + 1)]
    constant = 0
    for shift, sign, value in terms:
        top = len(value) - 1
        for b, s in enumerate(value):
            at = shift + b
            negative = (b == top) != (sign < 0)
            if at >= width:
                raise OverflowError("the sum is wider than its slices")
            if negative:  # -s = ~s - 1
                columns[at].append(~s)
                constant -= 1 << at
            else:
                columns[at].append(s)
    ones = np.full(words, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for b in range(width):
        if constant >> b & 1:
            columns[b].append(ones)
    out = []
    for b in range(width):
        column, carry = columns[b], columns[b + 1]
        while len(column) > 2:
            x, y, z = column.pop(), column.pop(), column.pop()
            half = x ^ y
            column.append(half ^ z)
            carry.append((x & y) | (half & z))
        if len(column) == 2:
            x, y = column.pop(), column.pop()
            column.append(x ^ y)
            carry.append(x & y)
        out.append(column[0] if column else np.zeros(words, np.uint64))
    return out


def best_rows(sums: list[np.ndarray], valid: np.ndarray, k: int, span: int) -> np.ndarray:
    """Rows whose sum can be among the k best if each may be up to ``span`` larger than it is here.

    From the sign slice downward: a row stays undecided while its bits equal those of the k-th best.
    """
    top = len(sums) - 1
    undecided, above = valid.copy(), np.zeros_like(valid)
    bound = 0
    need = min(k, int(np.bitwise_count(valid).sum()))
    for b in range(top, -1, -1):
        ones = undecided & (~sums[b] if b == top else sums[b])
        n = int(np.bitwise_count(ones | above).sum())
        if n >= need:
            undecided = ones
            bound |= 0 if b == top else 1 << b
        else:
            above |= ones
            undecided &= ~ones
            bound -= 1 << b if b == top else 0
    # bound is the k-th best sum; select all sums >= bound - span, again from the top slice down.
    limit = bound - span
    if limit < -(1 << top):
        return np.flatnonzero(np.unpackbits(valid.view(np.uint8), bitorder="little"))
    equal, larger = valid.copy(), np.zeros_like(valid)
    for b in range(top, -1, -1):
        s = ~sums[b] if b == top else sums[b]
        want = (limit < 0) ^ True if b == top else bool(limit >> b & 1)
        if want:
            equal = equal & s
        else:
            larger |= equal & s
            equal = equal & ~s
    return np.flatnonzero(np.unpackbits((larger | equal).view(np.uint8), bitorder="little"))


class BitSlicedBlock:
    """One block of rows: ids, exact values and the slices of their upper bits."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, low: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values, self.low = ids[order], values[order], low
        n = len(ids)
        self.words = -(-n // 64)
        pad = np.zeros((self.words * 64, values.shape[1]), np.int64)
        pad[:n] = self.values
        self.slices = [[s.view(np.uint64) for s in column] for column in slices(pad, low)]
        mask = np.zeros(self.words * 64, np.uint8)
        mask[:n] = 1
        self.valid = np.packbits(mask, bitorder="little").view(np.uint64)
        self.peaks = [max(abs(int(c.max())), abs(int(c.min()))) if n else 0 for c in self.values.T]

    def others(self, query_id: int) -> np.ndarray:
        """The bitmap of the rows of other ids. Rows are in the order of ids, so those of one id are a stretch."""
        first, end = np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right")
        if first == end:
            return self.valid
        mask = np.unpackbits(self.valid.view(np.uint8), bitorder="little")
        mask[first:end] = 0
        return np.packbits(mask, bitorder="little").view(np.uint64)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products. Where sums of the block could leave a long, they are taken in Python's integers; one that does is an error."""
        if sum(abs(q) * p for q, p in zip(query.tolist(), self.peaks)) < 1 << 63:
            return self.values[rows] @ query
        wide = [sum(q * x for q, x in zip(query.tolist(), row)) for row in self.values[rows].tolist()]
        if any(not -(1 << 63) <= s < 1 << 63 for s in wide):
            raise OverflowError("a score does not fit a long: scale the components down")
        return np.array(wide, np.int64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of rows that hold the k best others of the block, ties to the smaller id."""
        terms = [(shift, sign, value) for q, value in zip(query.tolist(), self.slices) for shift, sign in signed_digits(q)]
        largest = sum(abs(int(q)) << len(v) for q, v in zip(query.tolist(), self.slices))
        sums = add_all(terms, max(2, largest.bit_length() + 1), self.words)
        # The low bits of attribute d add between 0 and 2**low - 1 times its weight.
        span = sum(map(abs, query.tolist())) * ((1 << self.low) - 1)
        rows = best_rows(sums, self.others(query_id), k, -(-span >> self.low) + 1 if self.low else 0)
        score = self.scores(rows, query)
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][order], score[order]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, low: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 32_768, query_rows: int = 2_048
) -> DataFrame:
    """(query_id, rank int, id, score long): the k largest integer inner products of each query, exactly.

    A row is no candidate for the query of its own id. Ties go to the smaller id. Null vectors and
    vectors with null or non-finite components take no part, nor do null ids; an empty
    vector takes no part either, and a vector of another length than the query's is no candidate.
    Scores are exact whatever the size of the components; one of a row looked at exactly that does not fit a long is an error. Repeated ids are separate candidates. Fewer rows
    than k give fewer ranks, empty tables none.

    ``low`` bits of each attribute are left to the exact step. Rows are dealt by hash to blocks of
    about ``block_rows``; queries come in blocks of ``query_rows``, and every pair of blocks is one
    piece of work.
    """
    spark = vectors.sparkSession
    bound_arrow(spark)
    data = vectors.select(F.col(id_col).cast("long").alias("id_"), quantised(vec_col, scale).alias("v_")).where("id_ is not null and v_ is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id_"), quantised(vec_col, scale).alias("v_")).where("id_ is not null and v_ is not null")
    n, q = data.count(), asked.count()
    if not n or not q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").withColumnRenamed("vec_id", id_col)
    blocks, query_blocks = max(1, -(-n // block_rows), min(spark.sparkContext.defaultParallelism, n // 8_192)), max(1, -(-q // query_rows))

    pair = "block_ int, part_ int, id_ long, v_ array<long>"
    rows = data.withColumn("block_", F.pmod(F.xxhash64("id_", "v_"), F.lit(blocks)).cast("int")).withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    sent = asked.withColumn("part_", F.pmod(F.xxhash64("id_"), F.lit(query_blocks)).cast("int")).withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block = BitSlicedBlock(left["id_"].to_numpy(np.int64), np.stack(left["v_"].to_numpy()).astype(np.int64), low)
            for qid, v in zip(right["id_"].tolist(), right["v_"]):
                ids, scores = block.search(qid, np.asarray(v, np.int64), k)
                out.append(pd.DataFrame({"query_id": qid, "id_": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id_": [], "score": []}, dtype="int64")

    names = [*(c.split()[0] for c in pair.split(", ")), F.size("v_").alias("size_")]
    keys = ("block_", "part_", "size_")
    found = rows.select(*names).groupBy(*keys).cogroup(sent.select(*names).groupBy(*keys)).applyInPandas(search, "query_id long, id_ long, score long")
    return ranked(found, k, id_col)


def ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best of the blocks' best; at most blocks * k rows a query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id_")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id_").alias(id_col), "score")
