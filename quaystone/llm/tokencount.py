"""Token counts by byte-pair merging over a heap and a linked list.

The symbols of a pre-token form a doubly linked list; a heap holds the ranks of adjacent pairs. The
lowest is popped and merged until none is left: the count is the number of initial symbols less the
number of merges. No identifiers are made.
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame, functions as F

from quaystone.llm.common import Irregular, Memo, Words, held, map_text, plain_space

#: How byte-level vocabularies split text before the merges (fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    out.update((b, chr(256 + i)) for i, b in enumerate(x for x in range(256) if x not in out))
    return [out[b] for b in range(256)]


def merges_left(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """How many symbols remain after all merges. O(n log n) in the length of the list."""
    n = count = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = a + b, ""
        after[i] = k = after[j]
        count -= 1
        if k < n:
            before[k] = i
            if (r := rank.get((a + b, symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, symbols[k]))
        if (h := before[i]) >= 0 and (r := rank.get((symbols[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], a + b))
    return count


class Counter:
    """Counts the tokens of whole texts by a byte-level ``tokenizer.json``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a normalizer or a prefix space is counted")
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.rank = {p: i for i, p in enumerate(pairs)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.symbols = byte_symbols()
        self.pattern = regex.compile(plain_space(BYTE_LEVEL))
        self.pieces = Memo(self._piece, 200_000)
        self.chunks = Words(lambda word: self._piece(" " + word), self._chunk)

    def _piece(self, piece: str) -> int:
        return merges_left([self.symbols[b] for b in piece.encode()], self.rank)

    def _chunk(self, chunk: str) -> int:
        return sum(map(self.pieces.__getitem__, self.pattern.findall(" " + chunk)))

    def _plain(self, text: str) -> int:
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise Irregular
            return sum(map(self.pieces.__getitem__, self.pattern.findall(first))) + sum(map(self.chunks.__getitem__, rest))
        except Irregular:
            return sum(self.pieces[m.group()] for m in self.pattern.finditer(text))

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one token, as in the library's default."""
        if self.special is None:
            return self._plain(text)
        total = at = 0
        for m in self.special.finditer(text):
            total, at = total + self._plain(text[at : m.start()]) + 1, m.end()
        return total + self._plain(text[at:] if at else text)


def counter(path: str) -> Counter:
    """One counter in each worker."""
    return held(("counter", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long, over_limit boolean) of every row, in one pass without a shuffle.

    A null text counts as empty: no bytes, no tokens. Rows are independent, so repeated rows and
    null ids come back as they are.
    """

    def work(texts):
        c = counter(path)
        out = []
        for t in texts:
            n = c.count(t)
            out.append((len(t.encode()), n, n > limit))
        return out

    return map_text(docs, {id_col: F.col(id_col)}, F.col(text_col), "n_bytes long, n_tokens long, over_limit boolean", ["n_bytes", "n_tokens", "over_limit"], work)
