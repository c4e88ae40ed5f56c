"""Periodic runs of words, and texts without their repetitions.

A run is a stretch of words that repeats with a period q, often enough and as far as it goes. Every
word of a run occurs in it about length / q times, so a word that occurs more rarely in a segment
belongs to no run there and splits it. Splitting goes on in the parts, where words are rarer
still, until nothing splits. Only what survives is scanned for repeats at each lag. In a segment
of m words lag q is looked at in every q-th place alone, as a run holds several such places in a
row; that is m * log(m) looks for all lags. Places that agree are followed to the ends of their run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quaystone.llm.common import bound_arrow, portions

#: What a word is, in a form that Python's and Java's patterns share.
WORD = r"[^\x20\x09-\x0D]+"


def surviving(codes: np.ndarray, least: int, shortest: int) -> list[tuple[int, int]]:
    """Segments [a, b) in which every word occurs ``least`` times or more, none shorter than ``shortest``; all runs lie in them."""
    done, open_ = [], [(0, len(codes))]
    while open_:
        a, b = open_.pop()
        if b - a < shortest:
            continue
        _, at, times = np.unique(codes[a:b], return_inverse=True, return_counts=True)
        cuts = np.flatnonzero(times[at] < least)
        if not len(cuts):
            done.append((a, b))
            continue
        edges = np.concatenate([[-1], cuts, [b - a]])
        lengths = np.diff(edges) - 1
        for i in np.flatnonzero(lengths >= shortest):
            open_.append((a + int(edges[i]) + 1, a + int(edges[i + 1])))
    return done


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading places of x and y are equal; looks at twice as many at a time."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        differ = np.flatnonzero(x[at : min(at + step, n)] != y[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def _scan(x: np.ndarray, times: int, shortest: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a segment, by lags from 1 up."""
    found: list[tuple[int, int, int]] = []
    long_ = np.empty((0, 3), np.int64)  # runs that are long enough to hide larger lags, as start, end, period
    m = len(x)
    for q in range(1, m // times + 1):
        # A run of times * q words holds that many places i * q, and each of them equals the next.
        marks = x[::q]
        same = marks[:-1] == marks[1:]
        good = same[: len(same) - times + 2].copy()
        for i in range(1, times - 1):
            good &= same[i : len(same) - times + 2 + i]
        places = np.flatnonzero(good) * q
        if not len(places):
            continue
        for o in (1, 2, 3, 5, 8, 13, 21, 34):  # a few words more, before any run is followed
            if o < q:
                places = places[(x[places + o] == x[places + o + q]) & (x[places + q - o] == x[places + 2 * q - o])]
        # What shares q words with a run whose period divides q repeats with that smaller period.
        long_ = long_[long_[:, 1] - long_[:, 0] >= times * q]
        hiding = long_[q % long_[:, 2] == 0].tolist()
        for a, b, _ in hiding:
            places = places[(places < a) | (places + 2 * q > b)]
        end = -1
        for c in places.tolist():
            if c < end:
                continue
            right = _agreeing(x[c:], x[c + q :])
            if any(a <= c and c + right + q <= b for a, b, _ in hiding):
                end = c + right
                continue
            left = _agreeing(x[:c][::-1], x[q : c + q][::-1])
            start, end = c - left, c + right
            if end + q - start >= max(shortest, times * q):
                found.append((start, end + q - start, q))
                long_ = np.concatenate([long_, [[start, end + q, q]]])
    return found


def find_runs(words: list[str], times: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """All maximal runs (start, length, smallest period q) of max(shortest, times * q) words or more, by start, then period.

    ``times`` is 3 or more. Work: sorting, once a level of splitting, and m * log(m) for a segment of m words.
    """
    if times < 3:
        raise ValueError("a run has to repeat three times at least")
    codes_of: dict[str, int] = {}
    codes = np.fromiter((codes_of.setdefault(w, len(codes_of)) for w in words), np.int64, len(words))
    out = []
    for a, b in surviving(codes, times, max(shortest, times)):
        out += [(a + s, n, q) for s, n, q in _scan(codes[a:b], times, shortest)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by spaces, of each run only the first period; a word goes if any run drops it."""
    if not runs:
        return " ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return " ".join(w for w, hidden in zip(words, np.cumsum(edge[:-1]).tolist()) if not hidden)


def periodic_runs(docs: DataFrame, times: int = 4, shortest: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words long, runs array<struct<start, length, period long>>, collapsed string) of every row.

    A word is what :data:`WORD` matches. A null text has no words; no words, no runs and an empty
    text come out. Whole texts are read, of any length. Repeated and null ids are rows like others,
    an empty table gives none, and other columns of ``docs`` may have any name.
    """
    bound_arrow(docs.sparkSession)
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, short = [], [], []
            for texts in portions(b.column(1).to_pylist()):
                for t in texts:
                    words = word.findall(t)
                    found = find_runs(words, times, shortest)
                    sizes.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    short.append(collapsed(words, found))
            one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(one)), pa.array(short, pa.string())], names=["id_", "n_words", "runs", "collapsed"])

    narrow = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    kind = narrow.schema["id_"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"id_ {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.select(F.col("id_").alias(id_col), "n_words", "runs", "collapsed")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): texts in which, for ids whose CRC-32 ends in 0, all words from a place on repeat a stretch of the text.

    h = crc32(id as decimal text), g = floor(h / 10). If h % 10 = 0 and there are n > 0 words, each
    word i >= a becomes word a + (i - a) % p, for a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = F.when(n > 0, g % F.greatest(n, F.lit(1))).otherwise(0)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        block, left = F.slice(words, (a + 1).cast("int"), p.cast("int")), (n - a) % p
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(block, F.floor((n - a) / p).cast("int"))), F.slice(block, F.lit(1), left.cast("int"))), " ")

    # transform over one element: the words are found once.
    changed = F.transform(F.array(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0))), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))[0]
    return docs.select(F.col(id_col).alias(id_col), F.when((h % 10 == 0) & F.col(text_col).isNotNull(), changed).otherwise(F.col(text_col)).alias(text_col))


def report(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each of :func:`periodic_runs`: n_runs, the run that repeats most often, and digests of runs and text.

    The best run has the greatest length / period; ties go to the smaller start, then period. Without
    runs its columns are null.
    """
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("o"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return runs.withColumn("best_", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best_.start").alias("start"), F.col("best_.length").alias("length"), F.col("best_.period").alias("period"),
        F.floor(F.col("best_.length") * 1000 / F.col("best_.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
