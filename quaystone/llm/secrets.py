"""Secret scans with DataFrame functions only: pattern spans, and entropy spans of sliding windows.

Base spans come from three patterns. The entropy scan looks at candidate runs of characters of one
class; a window slides over each run and its Shannon entropy is kept up by counts: one character
enters, one leaves, and only their two terms of the sum change. Runs that an allow-list names add
no span. Base spans are never suppressed.

Positions are code points. They are found by splitting the text at the matches: a match starts
where the lengths of the gaps and matches before it end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: The patterns of base spans, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class CharClass:
    """A class of characters, the window over its runs and the entropy (bits) at which a window is hot."""

    kind: str
    alphabet: str
    pattern: str
    window: int
    bits: float


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", _DIGITS + "abcdefABCDEF", r"(?<![A-Za-z0-9+/_-])[0-9a-fA-F]{24,}(?![A-Za-z0-9+/_-])", 24, 3.0),
    CharClass("entropy_base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", r"[A-Za-z0-9+/_-]{24,}", 24, 3.9),
)

#: Candidate runs that add no span: one class of characters only, UUIDs, paths of words, examples, one repeated character.
ALLOW = (
    r"^[0-9]+$",
    r"^[A-Za-z]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]*([/_-]+[A-Za-z]*)*$",
    r"(?i)example|dummy|placeholder",
    r"^(.)\1*$",
)

#: For redaction, where a secret that stays costs more than a mark too many. Hex runs end only at other than hex digits,
#: so that those behind 'sk-', 'key_' or '/' count. A part between delimiters that is named an example ends a base64 run
#: and hides nothing but itself; of the delimiters beside it one on each side goes with it.
_NAMED = r"(?![A-Za-z0-9]*(?i:example|dummy|placeholder))"
REDACTED = (
    CharClass("entropy_hex", CLASSES[0].alphabet, r"[0-9a-fA-F]{24,}", 24, 3.0),
    CharClass("entropy_base64", CLASSES[1].alphabet, rf"(?<![A-Za-z0-9])(?=[A-Za-z0-9+/_-]{{24}})(?:[+/_-]{_NAMED}|(?<![A-Za-z0-9]){_NAMED}[A-Za-z0-9]++)++", 24, 3.9),
)


def _spans(text: Column, pattern: str, kind: str, order: int, keep=None) -> Column:
    """array<struct<start, order, end, kind>> of the matches; ``keep`` filters matched strings after matching."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    placed = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,word:string>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.char_length(x["g"]) + F.char_length(x["m"])).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + F.char_length(x["g"])).alias("start"), (s["at"] + F.char_length(x["g"]) + F.char_length(x["m"])).alias("end"), x["m"].alias("word")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    if keep is not None:
        placed = F.filter(placed, lambda x: keep(x["word"]))
    return F.when(text.rlike(pattern), F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["word"].alias("word")))).otherwise(
        F.array().cast("array<struct<start:int,order:int,end:int,kind:string,word:string>>")
    )


def hot_range(word: Column, c: CharClass) -> Column:
    """struct<first, last>: the first and the last character (from 0, inclusive) of the run's hot windows; first is -1 if none is hot.

    The state holds a count for each character of the class and the sum of n * log2(n) over them.
    A window's entropy is log2(window) less that sum over the window's length.
    """
    w = c.window
    term = F.array(*(F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(w + 2)))
    codes = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.instr(F.lit(c.alphabet), F.substring(word, i, F.lit(1))))
    limit = w * (math.log2(w) - c.bits) + 1e-9

    def step(s: Column, i: Column) -> Column:
        enter, leave = F.element_at(s["codes"], i), F.when(i > w, F.element_at(s["codes"], F.when(i > w, i - w).otherwise(F.lit(1)))).otherwise(F.lit(0))
        n_in = F.element_at(s["counts"], enter)
        n_out = F.when(leave > 0, F.element_at(s["counts"], F.greatest(leave, F.lit(1)))).otherwise(F.lit(0))
        moved = F.when(leave == enter, F.lit(0.0)).otherwise(
            F.element_at(term, n_in + 2) - F.element_at(term, n_in + 1) + F.when(leave > 0, F.element_at(term, F.greatest(n_out, F.lit(1))) - F.element_at(term, n_out + 1)).otherwise(F.lit(0.0))
        )
        total = s["sum"] + moved
        hot = (i >= w) & (total <= limit)
        return F.struct(
            s["codes"].alias("codes"),
            F.transform(s["counts"], lambda n, k: n + F.when(k + 1 == enter, 1).otherwise(0) - F.when(k + 1 == leave, 1).otherwise(0)).alias("counts"),
            total.alias("sum"),
            F.when(hot & (s["first"] < 0), i - w).otherwise(s["first"]).alias("first"),
            F.when(hot, i - 1).otherwise(s["last"]).alias("last"),
        )

    start = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(word)), start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _entropy_spans(text: Column, c: CharClass, order: int, allow: tuple[str, ...]) -> Column:
    def suspicious(word: Column) -> Column:
        ok = word.rlike("[0-9]")
        for a in allow:
            ok = ok & ~word.rlike(a)
        return ok

    runs = _spans(text, c.pattern, c.kind, order, suspicious)
    scored = F.filter(F.transform(runs, lambda x: F.struct(x.alias("run"), hot_range(x["word"], c).alias("hot"))), lambda y: y["hot"]["first"] >= 0)
    return F.transform(
        scored,
        lambda y: F.struct(
            (y["run"]["start"] + y["hot"]["first"]).alias("start"), y["run"]["order"].alias("order"), (y["run"]["start"] + y["hot"]["last"] + 1).alias("end"), y["run"]["kind"].alias("kind"), y["run"]["word"].alias("word")
        ),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(id, assign, access, hex, entropy): arrays of struct<start, order, end, kind, word> for each row, in one pass.

    A null text counts as empty. Rows are independent: repeated rows and null ids come back as they
    are, and other columns of ``docs`` are not read.
    """
    text = F.col("scan_text")
    narrow = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("scan_text"))
    return narrow.select(
        F.col(id_col),
        _spans(text, ASSIGN, "assign", 0, lambda w: F.char_length(F.regexp_extract(w, ASSIGN, 2)) >= 6).alias("assign"),
        _spans(text, ACCESS, "access", 1).alias("access"),
        _spans(text, HEX, "hex", 2).alias("hex"),
        F.flatten(F.array(*(_entropy_spans(text, c, 3 + i, allow) for i, c in enumerate(classes)))).alias("entropy"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest of :func:`scan`: counts, the digest of the base spans and all spans, by start and then kind."""
    base = F.concat("assign", "access", "hex")
    return found.select(
        id_col,
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, F.col("entropy"))).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", classes: tuple[CharClass, ...] = REDACTED, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with every span that :func:`scan` finds, and those of the wider classes, replaced by ``mark``; overlapping spans become one mark.

    Null texts stay null, texts without a span stay as they are; other columns are untouched.
    """
    text = F.col(f"`{text_col}`")
    spans = F.array_sort(
        F.concat(
            _spans(text, ASSIGN, "assign", 0, lambda w: F.char_length(F.regexp_extract(w, ASSIGN, 2)) >= 6),
            _spans(text, ACCESS, "access", 1),
            _spans(text, HEX, "hex", 2),
            *(_entropy_spans(text, c, 3 + i, allow) for i, c in enumerate(classes)),
        )
    )
    name = "spans_"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    found = F.col(name)
    rebuilt = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))),
    )
    clean = F.when(text.isNotNull() & (F.size(found) > 0), rebuilt).otherwise(text)
    return docs.withColumn(name, F.when(text.isNotNull(), spans)).withColumn(text_col, clean).drop(name)
