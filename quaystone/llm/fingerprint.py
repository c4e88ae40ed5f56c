"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document is its words, each weighted by how often it occurs. For each sample k and term there are
r and c, both Gamma(2, 1), and b, uniform; all come from hashes of term and k. A term of weight w has
the level t = floor(ln(w) / r + b) and the rank c * exp(-r * (t - b + 1)); the sample is the
(term, t) of least rank. Two documents agree in a sample with the probability that is their
generalised Jaccard similarity, sum(min(v, w)) / sum(max(v, w)).

These are made of exponential draws that cost little for words that occur once, as most do. With e and f
exponential, c = e + f and x = e / c are independent, and x is uniform; with y uniform too, r =
-ln(x * y) and b = ln(y) / ln(x * y) are independent as r * (1 - b) and r * b are exponential. So
exp(-r * (1 - b)) is x, and where w * x < 1 the level is 0 and the rank is e: no more than one hash is
needed to compare it. Otherwise the rank is e * (x * y) ** t.

A sample is one long, 1 - exp(-rank) in its upper and bits of the term in its lower part, so that a
plain minimum finds it; a hash of it is kept. Samples are computed in rows of a few at a time, inside
generated code.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaystone.plans.storage import materialise

#: Samples that one row computes.
WIDTH = 4


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number in (0, 1) from ``width`` bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(0.5)) * F.lit(2.0**-width)


def _packed(term: str, weight: str, v: str, e: str, x: str, r: str) -> Column:
    """Rank, to 36 bits, and term of the sample that a term offers; null where it offers none. The rank tells the levels apart."""
    w, x, r = F.col(weight), F.col(x), F.col(r)
    further = -F.expm1(-F.col(e) * F.exp(-r * (F.floor(F.ln(w * x) / r) + 1)))
    least = F.when(w == 1, F.col(v)).when(w * x < 1, F.col(v)).otherwise(further)
    return F.when(w > 0, F.shiftleft((least * F.lit(2.0**36)).cast("long"), 27) + F.col(term).bitwiseAND(F.lit((1 << 27) - 1)))


def sampled(terms: DataFrame, keys: list[str], weights: list[str], samples: int) -> DataFrame:
    """keys and for each of ``weights`` an array<int> of samples under its name; null for a group without terms.

    ``terms`` has one row for each group and term: the keys, ``term_`` long (null: no term) and the
    weights. It is grouped by the keys twice and by nothing else, so a frame dealt by one of them stays so.
    """
    if samples % WIDTH:
        raise ValueError(f"the number of samples must be a multiple of {WIDTH}")
    block = terms.withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(samples // WIDTH - 1))))
    numbers = {i: (F.col("block_") * WIDTH + i).cast("long") for i in range(WIDTH)}
    # What a term that occurs more than once needs besides is computed step by step, and for no other.
    often = F.greatest(*weights) > 1 if len(weights) > 1 else F.col(weights[0]) > 1
    drawn = block.select("*", *(F.xxhash64("term_", k).alias(f"h{i}") for i, k in numbers.items()))
    drawn = drawn.select("*", *(_uniform(F.col(f"h{i}"), 28, 36).alias(f"v{i}") for i in numbers), *(F.when(often, F.xxhash64(f"h{i}", k)).alias(f"g{i}") for i, k in numbers.items()))
    drawn = drawn.select("*", *(F.when(often, -F.log1p(-F.col(f"v{i}"))).alias(f"e{i}") for i in numbers), *(F.when(often, -F.ln(_uniform(F.col(f"g{i}"), 0, 32))).alias(f"f{i}") for i in numbers))
    drawn = drawn.select("*", *((F.col(f"e{i}") / (F.col(f"e{i}") + F.col(f"f{i}"))).alias(f"x{i}") for i in numbers))
    drawn = drawn.select("*", *(F.when(often, -F.ln(F.col(f"x{i}") * _uniform(F.col(f"g{i}"), 32, 32))).alias(f"r{i}") for i in numbers))
    least = drawn.groupBy(*keys, "block_").agg(*(F.min(_packed("term_", w, f"v{i}", f"e{i}", f"x{i}", f"r{i}")).alias(f"{w}{i}") for w in weights for i in numbers))

    def short(x: Column) -> Column:
        return F.shiftright(F.xxhash64(x), 32).cast("int")

    parts = F.sort_array(F.collect_list(F.struct("block_", *(F.when(F.col(f"{w}0").isNotNull(), F.array(*(short(F.col(f"{w}{i}")) for i in range(WIDTH)))).alias(w) for w in weights))))
    together = least.groupBy(*keys).agg(parts.alias("parts_"))
    return together.select(*keys, *(F.flatten(F.transform("parts_", lambda p: p[w])).alias(w) for w in weights))


def likeness(a: str, b: str, samples: int) -> Column:
    """The share of samples that agree; two texts without words are alike, one without is like no other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(samples))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(same)


def shown(samples: str) -> Column:
    """Samples as a string, eight hexadecimal digits each; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""), F.lit(""))


def _terms(texts: DataFrame, keys: list[str], versions: list[str]) -> DataFrame:
    """keys, term_ and how often each version of a text has it, under the version's name."""
    which = texts.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(v).alias("t")) for i, v in enumerate(versions)))).alias("v_"))
    word = which.select(*keys, F.col("v_.i").alias("version_"), F.explode(F.split(F.lower("v_.t"), r"[\x20\x09-\x0D]+")).alias("word_"))
    term = word.withColumn("term_", F.when(F.col("word_") != "", F.xxhash64("word_")))
    return term.groupBy(*keys, "term_").agg(*(F.sum(F.when(F.col("version_") == i, 1).otherwise(0)).alias(v) for i, v in enumerate(versions)))


def fingerprints(docs: DataFrame, samples: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint string) of every row; equal texts have equal fingerprints, on any cluster.

    Words are what white space (the six ASCII characters) leaves between, in lower case. A text that is
    null or has no words has the empty fingerprint. Null and repeated ids are rows like others; an
    empty table has none.
    """
    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"), F.monotonically_increasing_id().alias("row_"))
    made = sampled(_terms(rows, ["id_", "row_"], ["text_"]), ["id_", "row_"], ["text_"], samples)
    return made.select(F.col("id_").alias(id_col), shown("text_").alias("fingerprint"))


def _stretches(rows: DataFrame, parts: int) -> tuple[Column, Column, int]:
    """(stretch, last, number): for rows in the order of (order_, row_) the stretch a row is in, and whether it is its last.

    Stretches are those of a range partitioning of these two columns alone. Their ends, one a stretch, go
    into the plan; a row finds its own by looking at every 64th end and then at 64.
    """
    dealt = rows.select("order_", "row_").repartitionByRange(parts, "order_", "row_")
    ends = sorted(tuple(r["e"]) for r in dealt.groupBy(F.spark_partition_id()).agg(F.max(F.struct("order_", "row_")).alias("e")).collect())
    kind = "array<struct<order_: long, row_: long>>"

    def fixed(values: list) -> Column:
        return F.from_json(F.lit(json.dumps([{"order_": o, "row_": r} for o, r in values])), kind)

    key = F.struct("order_", "row_")
    coarse = F.size(F.filter(fixed(ends[63::64]), lambda e: e < key)) * 64
    at = F.transform(F.array(coarse), lambda c: c + F.size(F.filter(F.slice(fixed(ends), c + 1, F.lit(64)), lambda e: e < key)))[0]
    return at, F.element_at(fixed(ends), at + 1) == key, len(ends)


def compare_edits(docs: DataFrame, samples: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document of a row is that of the next smaller id, and of the smallest id the one of the
    largest. In the edited text the last floor(n_chars / 3) code points are replaced by as many of the
    next document's first (all, if it has fewer). near_edited and near_next are the likeness of the
    row's fingerprint to that of its edited text and to that of the next document.

    Texts are as in :func:`fingerprints`. Rows of one id come one after another, in no other order
    than that they are read in; null ids are the smallest. The only row of a table is its own next.
    Ids have to be whole numbers.

    Texts are shuffled once, in stretches of the order; the last row of each goes to the following
    stretch too, where it is the neighbour of the first.
    """
    spark = docs.sparkSession
    shuffle = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    # A written table fixes the numbers of rows, which break ties.
    rows = materialise(docs.select(F.col(id_col).cast("long").alias("id_"), order.alias("order_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"), F.monotonically_increasing_id().alias("row_")), "texts")
    at, last, stretches = _stretches(rows, max(shuffle, min(32 * shuffle, 8192)))
    placed = rows.withColumn("at_", at).withColumn("last_", last)
    copies = F.array(F.struct(F.col("at_").alias("part_"), F.lit(False).alias("guest_")))
    guest = F.array(F.struct(((F.col("at_") + 1) % max(1, stretches)).alias("part_"), F.lit(True).alias("guest_")))
    dealt = placed.withColumn("c_", F.explode(F.when(F.col("last_"), F.concat(copies, guest)).otherwise(copies))).select("id_", "row_", "text_", "c_.part_", "c_.guest_")
    # Small tasks, so that what occurs in the texts of one is counted in memory.
    dealt = dealt.repartition(4 * shuffle, "part_")
    along = Window.partitionBy("part_").orderBy(F.desc("guest_"), F.col("id_").asc_nulls_first(), "row_")
    n, cut = F.char_length("text_"), F.floor(F.char_length("text_") / 3).cast("int")
    beside = dealt.withColumn("next_", F.lag("text_").over(along)).withColumn("edited_", F.when(~F.col("guest_"), F.concat(F.substring("text_", F.lit(1), n - cut), F.substring("next_", F.lit(1), cut))))
    keys = ["part_", "guest_", "row_", "id_", "n_chars", "sha_"]
    texts = beside.select("part_", "guest_", "row_", "id_", n.cast("long").alias("n_chars"), F.unhex(F.sha2("edited_", 256)).alias("sha_"), "text_", "edited_")
    made = sampled(_terms(texts, keys, ["text_", "edited_"]), keys, ["text_", "edited_"], samples)
    pairs = made.withColumn("next_", F.lag("text_").over(along)).where(~F.col("guest_"))
    return pairs.select(
        F.col("id_").alias(id_col), "n_chars", F.lower(F.hex("sha_")).alias("edited_sha256"), shown("text_").alias("fingerprint"), shown("edited_").alias("edited_fingerprint"),
        likeness("text_", "edited_", samples).alias("near_edited"), likeness("text_", "next_", samples).alias("near_next"),
    )
