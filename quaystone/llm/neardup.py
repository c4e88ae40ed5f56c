"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over whole texts: the set of word shingles as 64-bit hashes, a digest of the set, and
   its signature: 32 bands of four 16-bit MinHash values. Equal sets collapse to their smallest id.
2. Rows with an equal band are candidates. Each row is first paired with the smallest id of its
   bucket only (linear in the bucket). The pairs meet with their two signatures and nothing else,
   which are compared in batches: a pair goes as soon as the posterior probability that its
   similarity reaches the threshold is under ``miss``. Survivors are verified exactly on the full
   sets of the two texts.
3. The confirmed links make groups, and a bucket whose rows are all of one group is settled. In
   every other bucket all candidate pairs of different groups are compared and pruned in the same
   way (large buckets in pairs of blocks, so that no task holds one whole). Rows that survivors
   connect make a cluster, told by one edge a row. The texts of a cluster meet, again in pairs of
   blocks if it is large, and its pairs of different groups that survive are verified there. No pair
   that could join two groups is left out, nothing is capped, and no table has a row for each pair.
4. The components of all confirmed links are the duplicate groups.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quaystone.llm.common import Memo, bound_arrow, held, map_text
from quaystone.operators.components import connected_components
from quaystone.plans.storage import drop_table, materialise

ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes() -> Memo:
    return held("word_hashes", lambda: Memo(xxhash.xxh64_intdigest, 200_000, 48))


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes.

    A-Z are lower-cased and words are runs of other than ASCII white space. Fewer words than
    ``width`` make one shingle of the whole sequence; no words make none.
    """
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, n)
    k = min(n, width)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _MIX + w[i : n - k + 1 + i]
    return np.unique(_scramble(h))


_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """16-bit MinHash values of a non-empty set, a bounded block at a time.

    Each is the lower half of a 32-bit minimum. Two unequal minima agree in it by chance once in
    65,536, which can only let a pair through to the exact check.
    """
    best = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(best, ((s[i : i + 1024, None] * _FACTORS) >> np.uint64(32)).min(axis=0), out=best)
    return best.astype(np.uint16)


def _describe(width: int):
    def work(texts):
        out = []
        for t in texts:
            s = shingles(t, width)
            out.append((len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), signature(s).view(np.int64)) if len(s) else (0, None, None))
        return out

    return work


def least_matches(threshold: float, miss: float, batch: int) -> list[int]:
    """For each batch of compared values the fewest matches with which a pair stays.

    With a uniform prior and m of n values equal, the similarity's posterior is Beta(m+1, n-m+1), so
    P(similarity >= t) = P(Binomial(n+1, t) <= m). A pair goes when that is under ``miss``.
    """
    out = []
    for n in range(batch, HASHES + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


class _Groups:
    """Union-find over labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, i: int) -> int:
        up = self.up
        while (j := up.get(i, i)) != i:
            up[i] = i = up.get(j, j)
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def survivors(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(places, equal values) of the pairs of signatures that pass all batches; one row of each side a pair."""
    at = np.flatnonzero(100 * np.minimum(n_left, n_right) >= percent * np.maximum(n_left, n_right))  # else even containment falls short
    same, batch = np.zeros(len(at), np.int64), HASHES // len(least)
    for k, need in enumerate(least):
        part = slice(k * batch, k * batch + batch)
        same = same + (left[at, part] == right[at, part]).sum(axis=1)
        at, same = at[same >= need], same[same >= need]
    return at, same


def _signatures(column) -> np.ndarray:
    """One row of 16-bit values for each signature of an Arrow list column."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, HASHES)


def _prune(pairs: DataFrame, signed: DataFrame, percent: int, least: list[int]) -> DataFrame:
    """(a, b, same) of the pairs (a, b) that survive the comparison of their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, same = survivors(_signatures(b.column(2)), _signatures(b.column(3)), b.column(4).to_numpy(), b.column(5).to_numpy(), percent, least)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(same)], names=["a", "b", "same"])

    one = signed.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    two = signed.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long, same long")


def _rivals(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, own: np.ndarray, whole: bool, percent: int, least: list[int], skip: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, later rows, equal values) of the surviving pairs of different groups: of all rows, or unless ``whole`` of different blocks."""
    for i in range(len(n) - 1):
        right = comp[i + 1 :] != comp[i]
        if not whole:
            right &= own[i + 1 :] != own[i]
        if skip is not None:
            if skip[i]:
                continue
            right &= ~skip[i + 1 :]
        j = i + 1 + np.flatnonzero(right)
        if len(j):
            at, same = survivors(np.broadcast_to(sig[i], (len(j), HASHES)), sig[j], np.broadcast_to(n[i], len(j)), n[j], percent, least)
            if len(at):
                yield i, j[at], same


def _clusters(percent: int, least: list[int]):
    """Within each bucket (or pair of blocks of one): edges that connect the rows that survivors connect, a row at most. Pairs with the bucket's first row were compared before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, x, y), part in pdf.groupby(["band", "x", "y"], sort=False):
            if len(part) < 2:
                continue
            ids, comp, n, own = (part[c].to_numpy(np.int64) for c in ("id", "comp", "n_shingles", "own"))
            sig = np.stack(part["sig"].to_numpy()).astype(np.int64).view(np.uint16)
            groups = _Groups()
            for i, j, _ in _rivals(sig, n, comp, own, x == y, percent, least, ids == part["first"].iat[0]):
                for k in j.tolist():
                    groups.join(i, k)
            found += [(ids[i], ids[r]) for i in range(len(ids)) if (r := groups.find(i)) != i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _links_within(percent: int, width: int, least: list[int]):
    """The links between different groups of each cluster (or pair of blocks of one), best estimate first; groups that are joined already are not compared again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, x, y), part in pdf.groupby(["cluster", "x", "y"], sort=False):
            part = part.sort_values(["id"], kind="stable")
            sets = [shingles(t, width) for t in part["text"]]
            some = np.array([len(t) > 0 for t in sets])
            part, sets = part[some], [t for t in sets if len(t)]
            if len(sets) < 2:
                continue
            ids, comp, own = (part[c].to_numpy(np.int64) for c in ("id", "comp", "own"))
            groups, near = _Groups(), []

            def settle(near: list[np.ndarray]) -> None:
                pairs = np.concatenate(near)
                for _, i, j in pairs[np.lexsort((pairs[:, 2], pairs[:, 1], -pairs[:, 0]))].tolist():
                    if groups.find(int(comp[i])) != groups.find(int(comp[j])) and _alike(sets[i], sets[j], percent):
                        groups.join(int(comp[i]), int(comp[j]))
                        found.append((int(ids[i]), int(ids[j])))

            waiting = 0
            for i, j, same in _rivals(np.stack([signature(t) for t in sets]), np.array([len(t) for t in sets]), comp, own, x == y, percent, least):
                near.append(np.stack([same, np.full(len(j), i), j], axis=1))
                waiting += len(j)
                if waiting > 200_000:  # bounded memory: settle what there is
                    settle(near)
                    near, waiting = [], 0
            if near:
                settle(near)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _in_blocks(rows: DataFrame, key: str, blocks: DataFrame) -> DataFrame:
    """Deals the rows of each key to its pairs of blocks: adds own, x and y, x = y being a block alone."""
    dealt = rows.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "blocks")


def _verify(pairs: DataFrame, docs: DataFrame, percent: int, width: int, pair_rows: int, block_bytes: int, broadcast_rows: int) -> DataFrame:
    """(a, b) of the pairs (a, b, same) whose full sets reach the threshold, but those that other links of the same task have connected already.

    ``docs`` has id and text. Pairs are dealt by b, those of a very frequent b also by a; a task
    gets each of its texts once. About ``pair_rows`` pairs or ``block_bytes`` bytes meet in a task.
    """
    often = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > pair_rows)
    needed = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
    few = needed.count() <= broadcast_rows
    texts = materialise(docs.join(F.broadcast(needed) if few else needed, "id"), "texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, pairs.count() // pair_rows, 2 * size // block_bytes)
    dealt = materialise(
        pairs.join(often, "b", "left").withColumn("share", F.when(F.col("m").isNotNull(), F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / pair_rows))).otherwise(F.lit(0)))
        .select("a", "b", "same", F.pmod(F.xxhash64("b", "share"), F.lit(parts)).cast("int").alias("deal")),
        "dealt",
    )
    sent = dealt.select(F.col("deal").alias("sent"), F.explode(F.array("a", "b")).alias("id")).distinct().join(texts, "id").select("sent", "id", "text")

    def check(todo: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        sets, groups, found = defaultdict(list), _Groups(), []
        for i, t in zip(known["id"].tolist(), known["text"]):
            sets[i].append(shingles(t, width))
        todo = todo.sort_values(["same", "a", "b"], ascending=[False, True, True])
        for a, b in zip(todo["a"].tolist(), todo["b"].tolist()):
            if groups.find(a) != groups.find(b) and any(_alike(s, t, percent) for s in sets[a] for t in sets[b]):
                groups.join(a, b)
                found.append((a, b))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    found = materialise(dealt.groupBy("deal").cogroup(sent.groupBy("sent")).applyInPandas(check, "a long, b long"), "links")
    for t in (needed, texts, dealt):
        drop_table(t)
    return found


def _alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if not len(s) or not len(t):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def near_duplicates(
    docs: DataFrame, percent: int = 75, width: int = 5, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text",
    block_rows: int = 512, pair_rows: int = 512, block_bytes: int = 4 << 20, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """(id, n_shingles long, component_id long, kept boolean), one row for each row of ``docs``.

    Null and wordless texts have no shingles and are linked with nothing. Rows with a null id take
    no part: their component_id is null and they are kept. Repeated ids are one document with
    several texts. Extra columns are ignored.

    ``block_rows`` bounds what of a bucket or a cluster meets in one task, twice ``block_bytes`` the
    bytes of its texts; ``pair_rows`` are the pairs that a verifying task gets, about. ``broadcast_rows`` bounds
    the table of ids that is sent to every executor (16 bytes a row); a larger one is joined by a
    shuffle.
    """
    bound_arrow(docs.sparkSession)
    least = least_matches(percent / 100, miss, 32)
    described = materialise(
        map_text(docs, {"id": F.col(id_col).cast("long")}, F.col(text_col), "n_shingles long, set_key string, sig array<long>", ["n_shingles", "set_key", "sig"], _describe(width)), "described"
    )
    known = described.where(F.col("id").isNotNull() & F.col("set_key").isNotNull())
    reps = known.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    repeated = materialise(reps.where("copies > 1").select("set_key", "rep"), "repeated")
    few = repeated.count() <= broadcast_rows
    signed = known.join(F.broadcast(repeated) if few else repeated, "set_key", "left").where(F.col("rep").isNull() | (F.col("rep") == F.col("id"))).select("id", "n_shingles", "sig")

    # Buckets: rows with an equal band. Those of one row are gone after the first aggregate.
    member = signed.select("id", F.posexplode("sig").alias("at", "band")).select("id", F.xxhash64("at", "band").alias("band"))
    buckets = materialise(member.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("band", "first"), "buckets")
    few = buckets.count() <= broadcast_rows
    crowd = materialise(member.join(F.broadcast(buckets) if few else buckets, "band"), "crowd")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    stars = crowd.where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    # Signatures of rows with company only; all that is compared from here on is among them.
    met = materialise(crowd.select("id").distinct(), "met")
    few = met.count() <= broadcast_rows
    signed = materialise(signed.join(F.broadcast(met) if few else met, "id"), "signed")
    near = materialise(_prune(stars, signed, percent, least).groupBy("a", "b").agg(F.max("same").alias("same")), "near")
    links = _verify(near, texts, percent, width, pair_rows, block_bytes, broadcast_rows)
    groups = materialise(connected_components(links, "a", "b"), "groups")

    labelled = crowd.join(groups, F.col("id") == F.col("node"), "left").select("band", "id", "first", F.coalesce("component", "id").alias("comp"))
    labelled = materialise(labelled, "labelled")
    unsettled = labelled.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("rows")).where("low != high")
    unsettled = materialise(unsettled.select("band", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks")), "unsettled")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    deals = max(cores, (unsettled.agg(F.sum("blocks")).first()[0] or 0) // 2_000)
    rest = _in_blocks(labelled, "band", unsettled).join(signed, "id").withColumn("deal", F.pmod(F.xxhash64("band", "x", "y"), F.lit(deals)))
    edges = materialise(rest.groupBy("deal").applyInPandas(_clusters(percent, least), "a long, b long").distinct(), "suspects")

    clusters = connected_components(edges, "a", "b").withColumnsRenamed({"node": "id", "component": "cluster"}).join(groups.withColumnRenamed("node", "id"), "id", "left")
    clusters = materialise(clusters.select("id", "cluster", F.coalesce("component", "id").alias("comp")), "clusters")
    few = clusters.count() <= broadcast_rows
    full = materialise(texts.join(F.broadcast(clusters) if few else clusters, "id"), "texts")
    blocks = full.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = materialise(blocks.select("cluster", F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("blocks")), "blocks")
    deals = max(cores, (blocks.agg(F.sum(F.col("blocks") * F.col("blocks"))).first()[0] or 0) // 200)
    close = _in_blocks(full, "cluster", blocks).withColumn("deal", F.pmod(F.xxhash64("cluster", "x", "y"), F.lit(deals)))
    links = close.groupBy("deal").applyInPandas(_links_within(percent, width, least), "a long, b long")

    copies = known.join(repeated, "set_key").where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # Copies hang on their first document, so only first documents need to be in the graph, and ids
    # of several texts: these join the groups of all their texts.
    several = known.groupBy("id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low != high").select(F.col("id").alias("a"))
    links = links.unionByName(copies.join(several, "a", "left_semi").distinct()).unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
    groups = connected_components(materialise(links, "links"), "a", "b")
    for t in (buckets, crowd, labelled, met, signed, near, unsettled, edges, full):
        drop_table(t)
    final = copies.groupBy("a").agg(F.min("b").alias("b")).join(groups.withColumnsRenamed({"node": "b"}), "b", "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
    placed = materialise(groups.unionByName(final).groupBy("node").agg(F.min("component").alias("component")), "groups")
    return (
        described.select("id", "n_shingles").join(placed, F.col("id") == F.col("node"), "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"), (F.col("id").isNull() | (F.coalesce("component", "id") == F.col("id"))).alias("kept"))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group. Rows with a null id stay."""
    dropped = materialise(near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where(~F.col("kept")).select(F.col(id_col).alias("dropped_id")).distinct(), "dropped")
    few = dropped.count() <= broadcast_rows
    return docs.join(F.broadcast(dropped) if few else dropped, docs[id_col] == F.col("dropped_id"), "left_anti")
