"""What the text operators share: Arrow settings, one-pass mappers, distinct chunks and bounded memos."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes that go to a Python worker at once, so that very long texts do not pile up.
ARROW_ROWS, ARROW_BYTES = "2000", "4m"


#: Arrow types of the fields that mappers return.
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def bound_arrow(spark: SparkSession) -> None:
    """Bound each Arrow batch by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def map_text(
    docs: DataFrame, keys: dict[str, Column], text: Column, schema: str, fields: list[str], work: Callable[[list[str]], list[tuple | list[tuple]]], many: bool = False
) -> DataFrame:
    """One narrow pass over texts: the key columns, then what ``work`` makes of a batch of texts.

    ``work`` returns one tuple a text (``many``: one list of tuples a text). A null text is empty.
    Only the named columns reach Python, so other columns of ``docs`` may have any name.
    """
    bound_arrow(docs.sparkSession)
    names, out = [f"key_{k}" for k in keys], [*keys, *fields]
    kinds = [ARROW[f.split(" ", 1)[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            made = []
            for texts in portions(b.column(len(names)).to_pylist()):
                made.extend(work(texts))
            if many:
                at = [i for i, rows in enumerate(made) for _ in rows]
                made = [row for rows in made for row in rows]
                kept = [b.column(i).take(pa.array(at, pa.int64())) for i in range(len(names))]
            else:
                kept = [b.column(i) for i in range(len(names))]
            columns = list(zip(*made)) if made else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=out)

    narrow = docs.select(*(c.alias(a) for c, a in zip(keys.values(), names)), F.coalesce(text, F.lit("")).alias("text_"))
    types = ", ".join(f"`{k}` {narrow.schema[a].dataType.simpleString()}" for k, a in zip(keys, names))
    return narrow.mapInArrow(run, f"{types}, {schema}")


def portions(texts: list[str], most: int = 2 << 20) -> Iterator[list[str]]:
    """Stretches of texts of about ``most`` characters, or of one longer text."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


class Chunks:
    """Texts split at single spaces, each distinct chunk once, without a Python object for any.

    ``distinct`` has the chunks, ``codes`` the place there of every chunk of every text, and
    ``bounds`` where each text begins in ``codes``. No text is without a chunk.
    """

    def __init__(self, texts: list[str]):
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        self.distinct, self.codes, self.bounds = coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy()

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of its chunks' values."""
        return np.add.reduceat(values[self.codes], self.bounds[:-1])

    def spread(self, first: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> list[np.ndarray]:
        """For each text the numbers of all its chunks, one after another."""
        n = sizes[self.codes]
        end = np.cumsum(n)
        at = np.repeat(first[self.codes] - (end - n), n)
        at += np.arange(len(at))
        out, cuts = flat[at], np.concatenate([[0], end])[self.bounds]
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]


class Lexicon:
    """A bounded memo from chunks to numbers: Arrow strings beside flat arrays, a few dozen bytes an entry.

    ``make`` takes an Arrow array of new chunks and returns (first, sizes, flat): the numbers of
    chunk i are flat[first[i] : first[i] + sizes[i]]. When over ``most_bytes`` are held, only what
    the last call asked for stays, and nothing if that is too large itself.
    """

    def __init__(self, make: Callable, kind: str, most_bytes: int = 24 << 20):
        self.make, self.kind, self.most_bytes = make, kind, most_bytes
        self._forget()

    def _forget(self) -> None:
        self.keys = pa.array([], pa.large_string())
        self.first, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.kind)

    def look_up(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, sizes, flat) of distinct chunks."""
        at = pc.index_in(distinct, self.keys).fill_null(-1).to_numpy().astype(np.int64)
        new = at < 0
        if new.any():
            fresh = distinct.filter(pa.array(new))
            first, sizes, flat = self.make(fresh)
            at[new] = len(self.keys) + np.arange(len(fresh))
            self.keys = pa.concat_arrays([self.keys, fresh])
            self.first = np.concatenate([self.first, first + len(self.flat)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
        first, sizes, flat = self.first[at], self.sizes[at], self.flat
        if self.keys.nbytes + self.flat.nbytes + 16 * len(self.keys) > self.most_bytes:
            self._forget()
            end = np.cumsum(sizes)
            n = int(end[-1]) if len(end) else 0
            if distinct.nbytes + n * flat.itemsize + 16 * len(distinct) <= self.most_bytes:
                take = np.repeat(first - (end - sizes), sizes) + np.arange(n)
                self.keys, self.first, self.sizes, self.flat = distinct, end - sizes, sizes, flat[take]
        return first, sizes, flat


_HELD: list = [None, None]


def held(key: object, make: Callable):
    """What this worker keeps from task to task: one operator's memos at a time.

    Workers outlive their stages, so without this the memos of all operators of a pipeline would
    pile up. What the last operator held goes back to the system before the next one begins.
    """
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim is not None:
            trim(0)
        _HELD[:] = [key, make()]
    return _HELD[1]


class Irregular(Exception):
    """A chunk that cannot be tokenised apart from its neighbours."""


class Memo(dict):
    """A bounded memo: ``make`` fills it, and it starts anew when full. Long keys are not kept."""

    def __init__(self, make: Callable, most: int = 900_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Words(Memo):
    """What each chunk after a single space adds, in a text that is split at spaces.

    Cutting there is safe only between characters other than white space; elsewhere Irregular is
    raised. Words of letters are kept; one with a full stop or a comma is put together from both.
    """

    def __init__(self, word: Callable, other: Callable, most: int = 1_100_000):
        super().__init__(word, most)
        self.other = other
        self.marks: dict[str, object] = {}

    def __missing__(self, chunk):
        if chunk.isalpha():
            return super().__missing__(chunk)
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Irregular
        if chunk[-1] in ".," and (stem := chunk[:-1]).isalpha():
            end = self.marks.get(chunk[-1])
            if end is None:  # the mark alone, without a space before it
                whole, stem_only = self.other("a" + chunk[-1]), self[("a")]
                end = self.marks[chunk[-1]] = whole - stem_only if isinstance(whole, int) else whole[len(stem_only) :]
            return self[stem] + end
        value = self.other(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = value
        return value


#: White space as the tokenizer libraries see it, in a pattern that means the same everywhere.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def plain_space(pattern: str) -> str:
    r"""The pattern with ``\s`` and ``\S`` spelt out, as engines differ on control characters."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
