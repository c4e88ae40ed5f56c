"""Word-first language identification.

Known words score by their log frequency in each language. An unseen word falls back to its
character n-grams, the longest first: the first order of which any n-gram is known decides. The
model is fitted on a sample of labelled rows of documented size, in one pass of counts by Spark. A
word or an n-gram is known when the sample has it ``least`` times. The model is sparse: each known
item holds only the languages it was seen in, so it has at most 5 * languages * ``sample_bytes`` /
``least`` entries of 12 bytes, whatever the corpus, and in practice a hundredth of that.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from quaystone.llm.common import Chunks, Lexicon, bound_arrow, held, map_text, portions
from quaystone.plans.storage import drop_table, materialise

#: Orders of items: 0 is a whole word, the others are n-grams of a word between two spaces.
ORDERS = (4, 3, 2, 1)
#: A word: letters of any script. The same in fitting and in scoring.
LETTERS = r"\p{L}+"
_WORD = regex.compile(LETTERS)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3. Rows with 1 are held out; a null id has none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def _items(word: Column) -> Column:
    """array<struct<order, item>> of a word: itself and its n-grams."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))

    def cut(k: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.char_length(padded) - (k - 1), F.lit(1)))
        made = F.transform(at, lambda i: F.struct(F.lit(k).alias("order"), F.substring(padded, i, F.lit(k)).alias("item")))
        return F.when(F.char_length(padded) >= k, made).otherwise(F.array().cast("array<struct<order:int,item:string>>"))

    grams = map(cut, ORDERS)
    return F.concat(F.array(F.struct(F.lit(0).alias("order"), word.alias("item"))), *grams)


def fit(docs: DataFrame, sample_bytes: int = 4 << 20, least: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: log frequencies of known words and n-grams in the languages that have them.

    ``sample_bytes`` is the size of the texts of each language that are expected to be learned from:
    rows are taken by a hash of their id at the rate sample_bytes / bytes of the language (all, if
    there are fewer). Held-out rows, null ids, null languages and null texts are not learned from.
    An item that a language lacks counts there as seen no time (add-one smoothing over the
    language's items of that order). A table without usable rows gives an empty model.
    """
    labelled = docs.where((fold(id_col) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(lang_col).alias("lang_"), F.col(text_col).alias("text_"))
    sizes = {r["lang_"]: r["n"] for r in labelled.groupBy("lang_").agg(F.sum(F.octet_length("text_")).alias("n")).collect()}
    langs = sorted(sizes)
    model = {"id": uuid.uuid4().hex, "langs": langs, "orders": {}}
    if not langs:
        return model
    rate = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_bytes / max(n, 1)))))
    taken = labelled.where(F.pmod(F.xxhash64("id_"), F.lit(1 << 30)) < rate[F.col("lang_")] * (1 << 30))
    words = taken.select("lang_", F.explode(F.regexp_extract_all(F.lower("text_"), F.lit(LETTERS), F.lit(0))).alias("word_")).groupBy("lang_", "word_").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(words.select("lang_", "n", F.explode(_items(F.col("word_"))).alias("x")).groupBy("lang_", "x.order", "x.item").agg(F.sum("n").alias("n")), "lang-counts")
    at = {k: i for i, k in enumerate(langs)}
    totals = {(r["order"], r["lang_"]): r["n"] + r["kinds"] + 1 for r in counts.groupBy("order", "lang_").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()}
    known = counts.groupBy("order", "item").agg(F.collect_list(F.struct("lang_", "n")).alias("seen"), F.sum("n").alias("all_n")).where(F.col("all_n") >= least)
    by_order: dict[int, tuple[list, list, list, list]] = {k: ([], [], [], []) for k in (0, *ORDERS)}
    for r in known.select("order", "item", "seen").toLocalIterator():  # a bounded sample's items
        items, ends, where, values = by_order[r["order"]]
        items.append(r["item"])
        for x in r["seen"]:
            where.append(at[x["lang_"]])
            values.append(math.log(x["n"] + 1))  # over log(1), that of the language's floor
        ends.append(len(where))
    drop_table(counts)
    for k, (items, ends, where, values) in by_order.items():
        keys = pa.array(items, pa.string()) if k == 0 else pa.array([x.encode("utf-32-le") for x in items], pa.binary(4 * k))
        floor = np.array([-math.log(totals.get((k, g), 1)) for g in langs])
        model["orders"][k] = (keys, np.array([0, *ends], np.int64), np.array(where, np.int32), np.array(values, np.float64), floor)
    return model


class Scorer:
    """Scores of whole texts; those of distinct chunks between spaces are remembered for a while."""

    def __init__(self, model: dict):
        self.langs, self.orders = model["langs"], model["orders"]
        self.memo = Lexicon(self._rows, "f8")

    def _gather(self, order: int, owner: np.ndarray, keys: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, found): for each of n owners the mean over its known keys, and how many are known."""
        known, offsets, where, values, floor = self.orders[order]
        at = pc.index_in(keys, known).fill_null(-1).to_numpy()
        owner, at = owner[at >= 0], at[at >= 0]
        found = np.bincount(owner, minlength=n)
        sizes = offsets[at + 1] - offsets[at]
        end = np.cumsum(sizes)
        take = np.repeat(offsets[at] - (end - sizes), sizes) + np.arange(int(end[-1]) if len(end) else 0)
        width = len(self.langs)
        total = np.bincount(np.repeat(owner, sizes) * width + where[take], weights=values[take], minlength=n * width).reshape(n, width)
        return floor + total / np.maximum(found, 1)[:, None], found

    def words(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of words in each language; a word without any known n-gram says nothing."""
        n = len(words)
        out = np.zeros((n, len(self.langs)))
        scores, found = self._gather(0, np.arange(n), pa.array(words, pa.string()), n)
        out[found > 0] = scores[found > 0]
        left = np.flatnonzero(found == 0)
        for k in ORDERS:
            if not len(left):
                break
            padded = "".join(f" {words[i]} " for i in left)
            points = np.frombuffer(padded.encode("utf-32-le"), "<u4")
            lengths = np.fromiter((len(words[i]) + 2 for i in left), np.int64, len(left))
            owner, end = np.repeat(np.arange(len(left)), lengths), np.cumsum(lengths)
            starts = np.flatnonzero(np.arange(len(points)) + k <= end[owner])
            grams = np.lib.stride_tricks.sliding_window_view(points, k)[starts] if len(points) >= k else np.empty((0, k), "<u4")
            keys = pa.Array.from_buffers(pa.binary(4 * k), len(starts), [None, pa.py_buffer(np.ascontiguousarray(grams))])
            scores, found = self._gather(k, owner[starts], keys, len(left))
            out[left[found > 0]] = scores[found > 0]
            left = left[found == 0]
        return out

    def _rows(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each chunk the sums of its words' scores and the number of its words."""
        cut = [[c] if c.isascii() and c.isalpha() else _WORD.findall(c) for c in chunks.to_pylist()]
        distinct = list(dict.fromkeys(w for c in cut for w in c))
        at = {w: i for i, w in enumerate(distinct)}
        n, width = len(cut), len(self.langs) + 1
        rows = np.zeros((n, width))
        if distinct:
            owner = np.repeat(np.arange(n), [len(c) for c in cut])
            word = np.fromiter((at[w] for c in cut for w in c), np.int64, len(owner))
            scores = np.concatenate([self.words(distinct), np.ones((len(distinct), 1))], axis=1)
            for k in range(width):
                rows[:, k] = np.bincount(owner, weights=scores[word, k], minlength=n)
        return np.arange(n) * width, np.full(n, width, np.int64), rows.ravel()

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, its posterior probability) of each text; ``und`` and 0 without a letter or a model. Of equal languages the first by name."""
        if not self.langs or not texts:
            return [("und", 0.0)] * len(texts)
        chunks = Chunks([t.lower() for t in texts])
        first, _, flat = self.memo.look_up(chunks.distinct)
        sums = np.stack([chunks.sums(flat[first + k]) for k in range(len(self.langs) + 1)], axis=1)
        s = sums[:, :-1]
        p = np.exp(s - s.max(axis=1, keepdims=True))
        best = np.argmax(s, axis=1)
        score = p[np.arange(len(best)), best] / p.sum(axis=1)
        return [(self.langs[b], float(q)) if n else ("und", 0.0) for b, q, n in zip(best.tolist(), score, sums[:, -1])]


def scorer(model: dict) -> Scorer:
    """The scorer of the model that this worker used last."""
    return held(("scorer", model["id"]), lambda: Scorer(model))


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out boolean, lang_pred, score double) of every row, from the text alone.

    A text that is null or has no letter (of Unicode's classes L) is ``und`` with score 0. Of
    languages with equal scores the first by name is taken. Rows are independent; a null id is not
    held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(
        docs, {id_col: F.col(id_col), "held_out": F.coalesce(fold(id_col) == 1, F.lit(False))}, F.col(text_col), "lang_pred string, score double", ["lang_pred", "score"], lambda texts: scorer(sent.value).predict(texts)
    )


def keep_identified(docs: DataFrame, model: dict, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is identified with at least ``least``; others go. Columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    bound_arrow(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                judged = [x for texts in portions([t or "" for t in b.column(at).to_pylist()]) for x in scorer(sent.value).predict(texts)]
                yield b.filter(pa.array([p != "und" and q >= least for p, q in judged]))

    return docs.mapInArrow(run, docs.schema)
