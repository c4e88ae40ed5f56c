"""Periodic runs against a scan of all stretches, planted runs and digests."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings, strategies as st

from quaystone.llm import runs


def all_runs(words, times=4, shortest=6):
    """Maximal stretches of each period; those that have a smaller period too are left out."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(shortest, times * q) and not any(all(words[j] == words[j + p] for j in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def dropped(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rnd, size, letters):
    words = []
    while len(words) < size:
        part = [rnd.choice(letters) for _ in range(rnd.randrange(1, 9))]
        words += part * rnd.randrange(1, 9) + part[: rnd.randrange(len(part) + 1)]
        words += [rnd.choice(letters + "xyzuvw") for _ in range(rnd.randrange(3))]
    return words


def test_runs_against_all_stretches():
    rnd = random.Random(3)
    for i in range(400):
        words = made(rnd, rnd.randrange(0, 120), "ab" if i % 3 else "abcdef")
        assert runs.find_runs(words) == all_runs(words)
        assert runs.find_runs(words, 3, 2) == all_runs(words, 3, 2)
        assert runs.collapsed(words, all_runs(words)) == dropped(words, all_runs(words))
    for words in ([], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 500, list("abab" * 50), list("aab" * 4), list("abcd" * 4), list("abcd" * 4)[:-1]):
        assert runs.find_runs(words) == all_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_runs_of_two_words(words):
    assert runs.find_runs(words) == all_runs(words)


def test_long_texts():
    assert runs.find_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    block = [str(i) for i in range(20_000)]
    assert runs.find_runs(["x"] + block * 5 + ["y"]) == [(1, 100_000, 20_000)]
    rnd = random.Random(1)
    words = [rnd.choice("ab") for _ in range(20_000)]
    found = runs.find_runs(words)
    assert found and all(n >= max(6, 4 * q) for _, n, q in found)


def test_segments_keep_all_runs():
    rnd = random.Random(8)
    words = made(rnd, 4_000, "abcdefghij")
    codes = np.unique(words, return_inverse=True)[1]
    segments = runs.surviving(codes, 4, 6)
    for s, n, _ in all_runs(words):
        assert any(a <= s and s + n <= b for a, b in segments)
    for a, b in segments:
        assert min(np.unique(codes[a:b], return_counts=True)[1]) >= 4
    assert runs.surviving(np.array([1, 2, 3] * 3), 4, 6) == []


def test_query_of_runs(spark):
    rnd = random.Random(5)
    texts = [" \t".join(made(rnd, rnd.randrange(0, 60), "abcde")) for _ in range(150)] + [None, "", " \n", "a b " * 9, "b\x0bc " * 8, " ".join("ab" * 9 + "cd" * 9)]
    rows = [(i, t, "r", 7, None) for i, t in enumerate(texts)] + [(None, "q " * 7, None, None, None), (3, texts[3], None, None, None), (3, texts[4], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, id_ int, collapsed string").repartition(3)
    got = sorted(runs.report(runs.periodic_runs(runs.with_planted_runs(docs))).collect(), key=repr)
    want, hit = [], 0
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (j - a) % p] if j >= a else w for j, w in enumerate(words)]
            hit += 1
        found = all_runs(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want.append((i, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(dropped(words, found).encode()).hexdigest()))
    assert hit > 5
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert runs.report(runs.periodic_runs(docs.limit(0))).count() == 0
