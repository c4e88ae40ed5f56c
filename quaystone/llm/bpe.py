"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A merge table is compiled into a finite-state transducer over bytes. The encoding of every prefix
ends in exactly one token, and that token is found from the one before it: a token may follow
another if the merges, run over the two together, leave the border between them alone. A state
holds the bytes whose tokens are not certain yet and the token before them; a transition reads one
byte, and emits the tokens on which every continuation that the vocabulary allows agrees. States are
made when met again (and forgotten when there are too many), so the lookahead is as short as the
vocabulary permits and work is linear in the length of the text, however long a run without
spaces is.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import regex
from pyspark.sql import DataFrame, functions as F

from quaystone.llm.common import Irregular, Memo, Words, held, map_text, plain_space


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeTransducer:
    """Encodes one pre-token at a time. ``most_states`` bounds the states held."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 200_000):
        self.ranks, self.most_states = ranks, most_states
        self.text = {r: b for b, r in ranks.items()}
        self.size = {r: len(b) for b, r in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        # The vocabulary as a trie: child of (node, byte); the node's token or -1; whether it has children.
        self.child: dict[int, int] = {}
        self.token, self.grows = [-1], [False]
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                if (after := self.child.setdefault(node << 8 | byte, len(self.token))) == len(self.token):
                    self.token.append(-1)
                    self.grows.append(False)
                    self.grows[node] = True
                node = after
            self.token[node] = rank
        self.apart: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple] = {}
        self.met: set[int] = set()
        self.ends: dict[int, list[int]] = {}
        self._state(None, b"", (None,), (0,))

    def _state(self, before, pending: bytes, last: tuple, live: tuple) -> int:
        """last: for each position the last token of the bytes up to it. live: where a longer token may yet begin, and its node below it in one number."""
        s = self.ids.setdefault((before, pending), len(self.states))
        if s == len(self.states):
            self.states.append((before, pending, last, live))
        return s

    def _path(self, last: tuple, at: int) -> list[int]:
        """Tokens of the pending bytes up to ``at``."""
        out = []
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        return out[::-1]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a single byte."""
        if token not in self.parts:
            word = self.text[token]
            pieces = [word[i : i + 1] for i in range(len(word))]
            while len(pieces) > 2:
                rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])))
                if rank == 1 << 60:
                    break
                pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
            self.parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return self.parts[token]

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between two tokens alone.

        Both are taken apart from the latest merge back. At each step a merge across the border
        would have come first if its rank is under that of the merge taken back last; of equal
        ranks the leftmost comes first.
        """
        key = left << 32 | right
        if (known := self.apart.get(key)) is not None:
            return known
        if len(self.apart) >= self.most_states:
            self.apart.clear()
        bound, fits = 1 << 60, True
        while True:
            across = self.ranks.get(self.text[left] + self.text[right])
            if across is not None and across < bound:
                fits = False
                break
            a = self.parts[left] if left in self.parts else self._halves(left)
            b = self.parts[right] if right in self.parts else self._halves(right)
            if a is None and b is None:
                break
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]
        self.apart[key] = fits
        return fits

    def _step(self, s: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, pending, last, live = self.states[s]
        token, stay, child, size = -1, [], self.child, self.size
        for both in live:
            j = both >> 32
            if (node := child.get((both & 0xFFFFFFFF) << 8 | byte)) is None:
                continue
            if token < 0 and (rank := self.token[node]) >= 0:
                left = last[j] if j else before
                if left is None or self._may_follow(left, rank):
                    token = rank
            if self.grows[node]:
                stay.append(j << 32 | node)
        if token < 0:
            raise ValueError("the vocabulary lacks a byte")
        cut = n = len(last)
        last += (token,)
        for both in stay:  # the last position that all paths from live positions share
            j = both >> 32
            while cut != j:
                if cut > j:
                    cut -= size[last[cut]]
                else:
                    j -= size[last[j]]
        pending += bytes((byte,))
        stay.append(n << 32)
        if cut:
            out = tuple(self._path(last, cut))
            return self._state(out[-1], pending[cut:], (None, *last[cut + 1 :]), tuple([both - (cut << 32) for both in stay])), out
        return self._state(before, pending, last, tuple(stay)), ()

    def _finish(self, s: int, rest: bytes) -> list[int]:
        """Tokens from a state on to the end of the piece, without making states: for paths that are met once."""
        before, _, last, live = self.states[s]
        last, child, apart = list(last), self.child, self.apart
        for byte in rest:
            token, stay = -1, []
            for both in live:
                if (node := child.get((both & 0xFFFFFFFF) << 8 | byte)) is None:
                    continue
                if token < 0 and (rank := self.token[node]) >= 0:
                    left = last[both >> 32] if both >> 32 else before
                    if left is None or ((known := apart.get(left << 32 | rank)) is None and self._may_follow(left, rank)) or known:
                        token = rank
                if self.grows[node]:
                    stay.append((both >> 32) << 32 | node)
            if token < 0:
                raise ValueError("the vocabulary lacks a byte")
            stay.append(len(last) << 32)
            last.append(token)
            live = stay
        return self._path(last, len(last) - 1)

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token.

        A transition is determinised when it is met for the second time; before that the rest of
        the piece is followed without making states.
        """
        out: list[int] = []
        s, moves, met = 0, self.moves, self.met
        for i, byte in enumerate(piece):
            key = s << 8 | byte
            move = moves.get(key)
            if move is None:
                if key not in met and len(piece) - i <= 64:
                    met.add(key)
                    out += self._finish(s, piece[i:])
                    return out
                met.discard(key)
                if len(self.states) > self.most_states or len(met) > 2 * self.most_states:
                    kept = self.states[s]
                    self._forget()
                    s, moves, met = self._state(*kept), self.moves, self.met
                    key = s << 8 | byte
                move = moves[key] = self._step(s, byte)
            s, tokens = move
            if tokens:
                out += tokens
        if (end := self.ends.get(s)) is None:
            _, pending, last, _ = self.states[s]
            end = self.ends[s] = self._path(last, len(pending))
        out += end
        return out


#: Continuation bytes that each leading byte of UTF-8 asks for.
_NEEDS = [0] * 0xC2 + [1] * (0xE0 - 0xC2) + [2] * (0xF0 - 0xE0) + [3] * (0xF5 - 0xF0) + [0] * (0x100 - 0xF5)


class Utf8Stream:
    """Incremental UTF-8: holds the bytes of a character that is not complete yet.

    Malformed bytes become U+FFFD, as in ``bytes.decode(errors="replace")``.
    """

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if _NEEDS[byte] >= back:
                    cut -= back
                break
        data, self.held = data[:cut], data[cut:]
        return data.decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts: pre-tokens by the pattern, each through the transducer, with bounded memos."""

    def __init__(self, path: str, pattern: str):
        self.machine = MergeTransducer(read_ranks(path))
        self.pattern = regex.compile(plain_space(pattern))
        self.pieces = Memo(lambda p: tuple(self.machine.encode(p.encode())), 100_000)
        self.chunks = Words(self._spaced, self._chunk, 800_000)
        self.decimal = {r: str(r) for r in self.machine.text}

    def _spaced(self, word: str) -> tuple[int, ...]:
        return tuple(self.machine.encode((" " + word).encode()))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(" " + chunk))))

    def encode(self, text: str) -> list[int]:
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise Irregular
            out = list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(first))))
            out.extend(chain.from_iterable(map(self.chunks.__getitem__, rest)))
        except Irregular:
            out = list(chain.from_iterable(self.pieces[m.group()] for m in self.pattern.finditer(text)))
        return out

    def decode(self, ids: list[int], step: int = 65_536):
        """Pieces of the decoded text, a bounded number of tokens at a time."""
        stream, table = Utf8Stream(), self.machine.text
        for i in range(0, len(ids), step):
            yield stream.feed(b"".join(map(table.__getitem__, ids[i : i + step])))
        yield stream.close()


def codec(path: str, pattern: str) -> Codec:
    """One codec in each worker."""
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row. A null or empty text has no ids."""

    def work(texts):
        c = codec(path, pattern)
        return [(c.encode(t),) for t in texts]

    return map_text(docs, {id_col: F.col(id_col)}, F.col(text_col), "ids array<int>", ["ids"], work)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids, decoded as a stream. Null ids give an empty text."""
    joined = encoded.select(F.col(id_col), F.concat_ws(",", F.col(ids_col).cast("array<string>")).alias("joined_ids"))

    def work(texts):
        c = codec(path, pattern)
        return [("".join(c.decode([int(x) for x in t.split(",")] if t else [])),) for t in texts]

    return map_text(joined, {id_col: F.col(id_col)}, F.col("joined_ids"), "text string", ["text"], work)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again, and return what identifies both: no shuffle, one pass.

    (id, n_tokens long, ids_sha256, decoded_sha256). Null texts count as empty: no tokens and the
    digests of nothing. Rows are independent, so repeated rows and null ids come back as they are.
    """

    def work(texts):
        c = codec(path, pattern)
        out = []
        for t in texts:
            ids = c.encode(t)
            digest = hashlib.sha256()
            for piece in c.decode(ids):
                digest.update(piece.encode())
            out.append((len(ids), hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest(), digest.hexdigest()))
        return out

    return map_text(docs, {id_col: F.col(id_col)}, F.col(text_col), "n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"], work)
