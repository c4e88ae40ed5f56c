"""Best-fit packing of tokenised documents with certified repacking.

Documents become pieces of at most ``capacity`` tokens in one pass. Pieces are dealt by hash to
partitions of bounded size and packed there best-fit decreasing. Dual-feasible functions give each
partition a lower bound of its bins: a partition that meets its bound is certified and never
touched again. The loosely filled bins of the others are dissolved, their documents are exchanged
(dealt anew by another hash, so they meet those of other partitions) and packed again; the new
bins replace the old where they are fewer. Only ids and lengths are shuffled, never tokens.
"""

from __future__ import annotations

import json
import zlib
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quaystone.llm.common import Chunks, Lexicon, held, map_text
from quaystone.llm.tokencount import byte_symbols
from quaystone.plans.storage import drop_table, materialise


#: White space among the characters of Latin-1, inside a class of characters.
LATIN_SPACE = r"\t-\r \x{85}\x{a0}"


class WordIds:
    """Ids of whole texts for a tokenizer that drops white space, as unsigned 32-bit numbers.

    Between spaces and line feeds nothing merges, so each distinct chunk is encoded once a batch and
    remembered for a while. Chunks of Latin-1 characters, where lower case and the normal form are
    character-wise, are cut by the tokenizer's own pattern, and all their pieces are merged in a few
    calls without its normaliser; tokens that end a word show where they part. Other chunks go
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        suffix = spec["model"]["end_of_word_suffix"]
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or level["type"] != "ByteLevel" or not suffix:
            raise ValueError("only lower-casing BPE with word ends that drops white space is encoded")
        self.tool = Tokenizer.from_file(path)
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer, self.merger.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.piece = f"({split['pattern']['Regex']})".replace(r"[^\s", "[^" + LATIN_SPACE)
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        # The symbol of each byte; a line feed ends a piece and stays a space.
        self.symbols = np.array([ord(s) for s in byte_symbols()], "<u2")
        self.symbols[[ord(" "), ord("\n")]] = ord(" ")
        self.marks = tuple({t["content"][:2] for t in spec["added_tokens"]})
        self.memo = Lexicon(self._encode, "<u4")

    def _whole(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) by the whole tokenizer."""
        made = [e.ids for e in self.tool.encode_batch_fast(chunks, add_special_tokens=False)] if chunks else []
        return np.fromiter(map(len, made), np.int64, len(made)), np.fromiter(chain.from_iterable(made), "<u4")

    def _merged(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of chunks of Latin-1 characters."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(chunks), f"[{LATIN_SPACE}]+", " ")
        cut = pc.replace_substring_regex(spaced, self.piece, "\\1\n")
        pieces = pc.count_substring(cut, "\n").to_numpy()
        if not len(cut):
            return np.empty(0, np.int64), np.empty(0, "<u4")
        _, offsets, data = cut.buffers()  # all chunks one after another
        begin, end = np.frombuffer(offsets, np.int64)[[cut.offset, cut.offset + len(cut)]]
        said = self.symbols[np.frombuffer(data or b"", np.uint8)[begin:end]].tobytes().decode("utf-16-le")
        parts, at = [], 0
        while at < len(said):
            end = said.find(" ", at + 50_000)
            end = len(said) if end < 0 else end
            parts.append(np.array(self.merger.encode_batch_fast([said[at:end]], add_special_tokens=False)[0].ids, "<u4"))
            at = end
        ids = np.concatenate([np.empty(0, "<u4"), *parts])
        ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(ends) != pieces.sum() + 1:
            return self._whole(chunks.to_pylist())
        return np.diff(ends[np.concatenate([[0], np.cumsum(pieces)])]), ids

    def _encode(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(chunks, "^[\\x{00}-\\x{ff}]*$")
        for m in self.marks:
            plain = pc.and_not(plain, pc.match_substring(chunks, m))
        mask = plain.to_numpy(zero_copy_only=False)
        sizes = np.empty(len(chunks), np.int64)
        first = np.empty(len(chunks), np.int64)
        merged, ids = self._merged(chunks.filter(plain))
        whole, more = self._whole(chunks.filter(pc.invert(plain)).to_pylist())
        sizes[mask], sizes[~mask] = merged, whole
        first[mask], first[~mask] = np.cumsum(merged) - merged, np.cumsum(whole) - whole + len(ids)
        return first, sizes, np.concatenate([ids, more])

    def prepare(self, text: str) -> str:
        """White space as spaces, and lower case where that is a character-wise step of the tokenizer itself."""
        text = text.replace("\n", " ")
        if any(m in text for m in self.marks):
            return text
        return text.lower() if text.isascii() or max(text, default="") < "\u0100" else text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        chunks = Chunks([self.prepare(t) for t in texts])
        return chunks.spread(*self.memo.look_up(chunks.distinct))


def word_ids(path: str) -> WordIds:
    """One in each worker."""
    return held(("word_ids", path), lambda: WordIds(path))


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece int, start long, length long, ids_crc32 long): every document's ids and the end id, cut at ``capacity``.

    A null or empty text has the end id alone. One pass, no shuffle.
    """

    def work(texts):
        end, out = np.array([end_id], "<u4"), []
        for ids in word_ids(path).encode(texts):
            ids = np.concatenate([ids, end])
            out.append([(k, a, len(part := ids[a : a + capacity]), zlib.crc32(part)) for k, a in enumerate(range(0, len(ids), capacity))])
        return out

    return map_text(docs, {id_col: F.col(id_col)}, F.col(text_col), "piece int, start long, length long, ids_crc32 long", ["piece", "start", "length", "ids_crc32"], work, many=True)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound over a family of dual-feasible functions.

    For each threshold e up to half the capacity: lengths over capacity - e count as a whole bin,
    lengths under e as nothing, others as themselves (e = 0 is the sum of lengths). And for each k:
    a length x counts as floor((k+1)x)/k, or as itself where (k+1)x is whole (x in bins).
    """
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    size = np.arange(capacity + 1)
    below, mass = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(0, capacity // 2 + 1)
    big = below[-1] - below[capacity - e]
    middle = mass[capacity - e] - np.where(e > 0, mass[np.maximum(e - 1, 0)], 0)
    best = int(np.max(big + -(-middle // capacity)))
    for k in range(1, 65):
        scaled = (k + 1) * size
        # in units of 1 / (k * capacity)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece, and the number of bins. Open bins are kept by the room they have left."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    has_room, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = has_room >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                has_room &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - room
        if room > n:
            by_room[room - n].append(b)
            has_room |= 1 << (room - n)
    return where, offset, bins


_PACKED = "id_ {id}, piece int, start long, length long, ids_crc32 long, deal long, bin long, offset long, fill long, bins long, bound long"


def _pack(items: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    """Deal by hash, then best-fit decreasing with the partition's bound."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id_", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        b, offset, n = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(b, weights=lengths, minlength=n).astype(np.int64)
        return pdf.assign(bin=b, offset=offset, fill=fill[b], bins=n, bound=lower_bound(lengths, capacity))

    kind = items.schema["id_"].dataType.simpleString()
    dealt = items.select("id_", "piece", "start", "length", "ids_crc32", (F.pmod(F.xxhash64("id_", "piece", "ids_crc32", F.lit(salt)), F.lit(parts)) + F.lit(salt << 32)).alias("deal"))
    return dealt.groupBy("deal").applyInPandas(pack, _PACKED.format(id=kind))


def pack(items: DataFrame, capacity: int = 4096, id_col: str = "doc_id", per_part: int = 40_000) -> DataFrame:
    """Pack the rows of :func:`pieces`: adds sequence_id long and offset long.

    ``per_part`` bounds the pieces that meet in one task (a hash deals them, so no key can be hot).
    Exchange goes on for as long as a round saves a bin. Every piece comes back once; repeated rows
    are separate pieces. An empty table gives none.
    """
    now = materialise(items.withColumnRenamed(id_col, "id_"), "pieces")
    total = now.count()
    packed = materialise(_pack(now, max(1, -(-total // per_part)), 0, capacity), "packed")
    drop_table(now)
    done: list[DataFrame] = []
    for salt in count(1):
        # A partition with a gap gives up its bins that are not full, if that can save one.
        gaps = packed.select("deal", "bins", "bound").distinct().agg(F.sum(F.col("bins") - F.col("bound")), F.count(F.when(F.col("bins") > F.col("bound"), 1))).first()
        if not gaps[0] or gaps[1] < (2 if salt > 1 else 1):
            break
        loose = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
        pool = packed.where(loose)
        size, before = pool.agg(F.count(F.lit(1)), F.count_distinct("deal", "bin")).first()
        again = materialise(_pack(pool.select("id_", "piece", "start", "length", "ids_crc32"), max(1, -(-size // per_part)), salt, capacity), "packed")
        after = again.select("deal", "bin").distinct().count()
        if after >= before:
            drop_table(again)
            break
        done.append(packed.where(~loose))
        packed = again
    out = packed
    for d in done:
        out = out.unionByName(d)
    return out.select(F.col("id_").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("deal") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
