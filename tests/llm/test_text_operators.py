"""Byte-level BPE, token counts, secrets, language ID and packing, on cases that are easily got wrong."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quaystone.llm import bpe, langid, packing, secrets, tokencount

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, key_ string, spans__ string, lang string"


def texts():
    rnd = random.Random(11)
    out = [
        "", " ", "  ", "a  b\n\n c\t", "\x1c a\x1d", "don't <|endoftext|> x<|ENDOFTEXT|>", "日本語テスト 漢字", "é" * 70, "aaaa" * 900, "ΣΑΣ Σ. İstanbul ǅ ſ", "\u0085x", "éa. ́b ½ ᾳ", "‿⁣ a ⁣b", "A. B, c., d.,. ,e",
        "🙂🙃 x", "ab" * 20_000, "password = hunter22 and token:abc AKIA" + "Z9" * 12 + " deadbeef" * 4, "0123456789abcdef" * 3,
    ]
    alphabet = "abcdeéÉ ñ日 1.,\n\t'sS🙂Σ \x1c <|"
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 50))) for _ in range(300)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(i, x, "x", None, None, None) for i, x in enumerate(t)] + [(None, "the null id", None, None, None, None), (5000, None, None, None, None, None), (1, t[1], None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_round_trip(spark, docs):
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts()) + 3
    for r in got:
        t = text[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_encode_and_decode(docs):
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text or "") for r in docs.collect()}


def test_state_tables_may_be_forgotten():
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    small = bpe.MergeTransducer(ranks, most_states=20)
    for w in ("international", " tokenisation", "aaaaaaaaaaaaaaaaaaaaaaaaab", "Übergröße"):
        assert enc.encode_ordinary(w) == small.encode(w.encode())


def test_utf8_stream():
    data = "aé日🙂z".encode()
    for cut in range(1, 5):
        s = bpe.Utf8Stream()
        assert "".join(s.feed(data[i : i + cut]) for i in range(0, len(data), cut)) + s.close() == "aé日🙂z"
    for bad in (b"\xff\xe6\x97a\xc3", b"\xe6\x97", b"\xf0\x9f\x99"):
        s = bpe.Utf8Stream()
        assert "".join(s.feed(bad[i : i + 1]) for i in range(len(bad))) + s.close() == bad.decode("utf-8", "replace")


def test_token_counts(docs):
    tool = Tokenizer.from_file(BYTES)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in tokencount.count_tokens(docs, BYTES).collect():
        t = text[r.doc_id] or ""
        n = len(tool.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)


ASSIGN = re.compile(secrets.ASSIGN.replace("(?i:", "(?:"), re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def hot_brute(word, c):
    hot = []
    for i in range(len(word) - c.window + 1):
        w = word[i : i + c.window]
        p = np.array([w.count(x) for x in set(w)]) / c.window
        if -(p * np.log2(p)).sum() >= c.bits - 1e-9:
            hot.append(i)
    return (hot[0], hot[-1] + c.window - 1) if hot else (-1, -1)


def test_secrets(spark, docs):
    extra = ["x token: abcdef", "password: token: abcdefgh", "API_KEY='Zm9vYmFy' 🙂 secret=a", "id 123e4567-e89b-12d3-a456-426614174000 ok", "q9X2mK7pLw4ZtR8vBn3YsD6fGh1JcA5e end", "ſecret=abcdefgh toKen=abcdefgh"]
    d = docs.select("doc_id", "text", "spans__").unionByName(spark.createDataFrame([(9000 + i, x, None) for i, x in enumerate(extra)], "doc_id long, text string, spans__ string"))
    text = {r.doc_id: r.text or "" for r in d.collect()}
    for r in secrets.report(secrets.scan(d)).collect():
        base = base_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), text[r.doc_id][:80]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert r.n_assign == base.count("assign") and r.n_hex == base.count("hex")
    spans = {r.doc_id: r.spans for r in secrets.report(secrets.scan(d)).collect()}
    assert spans[9003] == ""  # a UUID is on the allow-list
    assert spans[9004].startswith("entropy_base64:0:")


def test_entropy_is_that_of_each_window(spark):
    rnd = random.Random(3)
    c = secrets.CLASSES[1]
    words = ["".join(rnd.choice(c.alphabet[: rnd.choice((4, 20, 65))]) for _ in range(rnd.randrange(24, 70))) for _ in range(40)] + ["a" * 30]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.hot_range(F.col("w"), c).alias("h")).collect()
    assert [(r.h["first"], r.h["last"]) for r in rows] == [hot_brute(r.w, c) for r in rows]


def test_redaction(spark):
    d = spark.createDataFrame([(1, "a password = hunter22 b", 7), (2, None, 7), (3, "clean 🙂 text", 7), (4, "🙂 0123456789abcdef0123456789abcdef z", 7)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    assert got == {1: "a [SECRET] b", 2: None, 3: "clean 🙂 text", 4: "🙂 [SECRET] z"}
    clash = secrets.redact(d.withColumn("spans_", F.lit("own")).withColumn("SPANS__", F.lit(1)))
    assert clash.columns == ["doc_id", "text", "n_chars", "spans_", "SPANS__"] and {(r.text, r["spans_"], r["SPANS__"]) for r in clash.collect()} == {(t, "own", 1) for t in got.values()}
    assert secrets.redact(d.limit(0)).count() == 0


def test_redaction_inside_longer_runs(spark):
    rnd = random.Random(5)
    hexes = ["".join(rnd.choice("0123456789ABCDEF") for _ in range(40)) for _ in range(30)] + ["".join(rnd.choice("0123456789abcdefABCDEF") for _ in range(32)) for _ in range(10)]
    key = "q9X2mK7pLw4ZtR8vBn3YsD6fGh1JcA5e"
    left = ["sk-", "key_", "files/v1/", "xyz"]
    rows = [f"a {left[i % 4]}{h} z" for i, h in enumerate(hexes)] + [f"see com/example/{key} z", f"{key}/EXAMPLE/{key[::-1]}", f"dummy_files//{key}"]
    quiet = ["id com/example/123e4567-e89b-12d3-a456-426614174000 ok", "123e4567-e89b-12d3-a456-426614174000/example", f"sk-example{key}", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "path/of/long/words/and/more/words", "x" * 5000, "a/" * 5000]
    d = spark.createDataFrame(list(enumerate(rows + quiet)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    for i, h in enumerate(hexes):
        assert "[SECRET]" in got[i] and h not in got[i] and not re.search("[0-9a-fA-F]{8}", got[i]), rows[i]
    assert got[40] == "see com/example/[SECRET] z" and got[41] == "[SECRET]/EXAMPLE/[SECRET]" and got[42].endswith("[SECRET]") and key not in got[42]
    assert [got[len(rows) + i] for i in range(len(quiet))] == quiet


def test_redaction_covers_what_the_scan_finds(spark):
    rnd = random.Random(6)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF/_-", secrets.CLASSES[1].alphabet]
    word = lambda: rnd.choice(["example", "DUMMY", "/", "-", "_", "sk-", " ", "🙂", "".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randrange(1, 60)))])
    d = spark.createDataFrame([(i, "".join(word() for _ in range(12))) for i in range(300)], "doc_id long, text string")
    spans = [F.flatten(F.array(*(secrets._entropy_spans(F.col("text"), c, 3, secrets.ALLOW) for c in classes))) for classes in (secrets.CLASSES, secrets.REDACTED)]
    got = d.select(spans[0].alias("old"), spans[1].alias("new")).collect()
    assert sum(len(r.old) for r in got) > 50 and sum(len(r.new) for r in got) > sum(len(r.old) for r in got)
    assert all(any(x.start <= o.start and o.end <= x.end for x in r.new) for r in got for o in r.old)


def test_language_id(spark):
    rnd = random.Random(7)
    words = {"en": "the of and house tree water with from".split(), "de": "der und das haus baum wasser mit von".split()}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(12)), k) for i in range(200) for k in [("en", "de")[i % 2]]]
    rows += [(900, None, "en"), (901, "123 !?", "de"), (902, "", None), (None, "das haus", "de"), (903, "wasserbaum " * 5000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))
    got = {r.doc_id: r for r in langid.predict(d, langid.fit(d)).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] and 0.5 < got[i].score <= 1 for i in range(200))
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[903].lang_pred == "de"
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(200)) and got[None].held_out is False
    none = langid.fit(d.limit(0))
    assert langid.predict(d.limit(3), none).where("lang_pred <> 'und'").count() == 0


def test_language_id_counts_letters_only():
    model = {"id": "x", "langs": ["de", "en"], "orders": {}}
    import pyarrow as pa

    for k in (0, *langid.ORDERS):
        item = ["haus"] if k == 0 else [" haus "[1 : 1 + k].encode("utf-32-le")]
        model["orders"][k] = (pa.array(item, pa.string() if k == 0 else pa.binary(4 * k)), np.array([0, 1]), np.array([0], np.int32), np.array([2.0]), np.array([-3.0, -3.0]))
    got = langid.Scorer(model).predict(["½", "² Ⅷ", "\u0301 \u0300", "", " \n", "漢字", "½haus", "x"])
    assert [p for p, _ in got] == ["und"] * 5 + ["de", "de", "de"]  # equal scores: the first by name
    assert got[0][1] == 0 and got[5][1] == 0.5 and got[6][1] > 0.5


def test_language_id_backs_off_as_brute_force_does(spark):
    """Words first, then the longest order with a known n-gram, computed again with dictionaries."""
    import math
    import zlib
    from collections import Counter, defaultdict

    import regex

    rnd = random.Random(8)
    stems = {k: ["".join(rnd.choice(a) for _ in range(rnd.randrange(1, 7))) for _ in range(60)] for k, a in (("aa", "abcdeé"), ("bb", "bcdefñ"), ("cc", "xyzab日"))}
    rows = [(i, " ".join(rnd.choice(stems[k]) for _ in range(15)), k) for i in range(240) for k in [("aa", "bb", "cc")[i % 3]]]
    rows += [(500 + i, " ".join("".join(rnd.choice("abcdxyzéñ日q1½ ") for _ in range(9)) for _ in range(8)), None) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    word = regex.compile(r"\p{L}+")
    counts = {k: defaultdict(Counter) for k in range(5)}
    for i, t, k in rows:
        if k and zlib.crc32(str(i).encode()) % 3 != 1:
            for w in word.findall(t.lower()):
                counts[0][w][k] += 1
                for n in (1, 2, 3, 4):
                    for j in range(len(w) + 3 - n):
                        counts[n][f" {w} "[j : j + n]][k] += 1
    langs = ["aa", "bb", "cc"]
    total = {(n, k): sum(c[k] for c in t.values()) + sum(c[k] > 0 for c in t.values()) + 1 for n, t in counts.items() for k in langs}

    def score(w):
        for n in (0, 4, 3, 2, 1):
            items = [w] if n == 0 else [f" {w} "[j : j + n] for j in range(len(w) + 3 - n)]
            found = [c for x in items if sum((c := counts[n].get(x, Counter())).values()) >= 4]
            if found:
                return [sum(math.log((c[k] + 1) / total[n, k]) for c in found) / len(found) for k in langs]
        return [0.0] * 3

    got = {r.doc_id: r for r in langid.predict(d, langid.fit(d)).collect()}
    for i, t, _ in rows:
        words = word.findall(t.lower())
        s = [sum(x) for x in zip(*map(score, words))] if words else None
        if s is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        p = np.exp(np.array(s) - max(s))
        assert abs(got[i].score - float(p.max() / p.sum())) < 1e-9 and s[langs.index(got[i].lang_pred)] >= max(s) - 1e-9


def test_pieces_are_those_of_the_library(docs):
    tool = Tokenizer.from_file(WORDS)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = packing.pieces(docs, WORDS, capacity=16).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    import zlib

    for k, rows in by.items():
        ids = tool.encode(text[k] or "", add_special_tokens=False).ids + [1]
        want = {(i, a, len(ids[a : a + 16]), zlib.crc32(np.array(ids[a : a + 16], "<u4").tobytes())) for i, a in enumerate(range(0, len(ids), 16))}
        assert {(r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), 0, 0, int(n), 1) for i, n in enumerate(rng.integers(1, 101, 3000))] + [(7, 0, 0, 50, 1)] * 3 + [(None, 0, 0, 5, 2)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    lengths = np.array([r[3] for r in rows])
    whole = packing.pack(items, capacity=100).collect()
    assert len(whole) == len(rows) and packing.lower_bound(lengths, 100) <= check_packing(whole, 100) <= 1.005 * packing.lower_bound(lengths, 100)
    # Small partitions see less of the whole, so that their certified bins are a little more.
    got = packing.pack(items, capacity=100, per_part=400).collect()
    assert len(got) == len(rows) and check_packing(got, 100) <= 1.03 * check_packing(whole, 100)
    assert packing.pack(items.limit(0)).count() == 0


def test_lower_bound_is_sound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 13, rng.integers(1, 9))
        best = len(lengths)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(lengths):
                best = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= lengths[i]:
                    place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, 12 - lengths[i]])

        place(0, [])
        where, offset, bins = packing.best_fit_decreasing(lengths, 12)
        assert packing.lower_bound(lengths, 12) <= best <= bins
