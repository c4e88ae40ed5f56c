"""Top-k, near-duplicates, shards, WARC bundles, neighbours and the pipeline, against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaystone.llm import ann, neardup, shard, topk, warc

VEC = "vec_id long, embedding array<float>, block_ int, rank int"


def vectors(n=400, d=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v], 1, 1) for i, v in enumerate(rng.normal(size=(n, d)).astype(np.float32))]
    rows += [(n + i, rows[3][1], 1, 1) for i in range(20)]  # equal vectors: ties
    rows += [(n + 50, None, 1, 1), (n + 51, [float("nan")] * d, 1, 1), (n + 52, [None] + [1.0] * (d - 1), 1, 1), (n + 53, [float("inf")] * d, 1, 1), (None, [1.0] * d, 1, 1), (5, rows[5][1], 1, 1)]
    return rows + [(n + 60, [0.0] * d, 1, 1)]


def test_exact_top_k(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VEC)
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=5, block_rows=100, query_rows=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    use = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q, v in use:
        if q % 50 == 0:
            best = sorted((-int(w @ v), i) for i, w in use if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), df).count() == 0
    one = df.where("vec_id in (0, 1)")
    assert topk.top_k(one, one).count() == 2


def test_exact_top_k_with_copies_of_a_queried_row(spark):
    rows = vectors()
    rows += [rows[50]] * 3 + [rows[100]] * 7 + [rows[150]] * 40
    df = spark.createDataFrame(rows, VEC)
    use = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for block_rows in (100, 100_000):
        got = {}
        for r in topk.top_k(df, df.where("vec_id in (50, 100, 150)").distinct(), k=5, block_rows=block_rows).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in (50, 100, 150):
            v = dict(use)[q]
            best = sorted((-int(w @ v), i) for i, w in use if i != q)[:5]
            assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_a_block_of_the_queried_id_alone_has_no_rows():
    block = topk.BitSlicedBlock(np.full(70, 2**63 - 1), np.ones((70, 3), np.int64), 2)
    ids, scores = block.search(2**63 - 1, np.ones(3, np.int64), 5)
    assert len(ids) == len(scores) == 0
    assert len(block.search(1, np.ones(3, np.int64), 5)[0]) == 5


def test_large_components():
    """Scores beyond 2**63 in parts are right if the sum fits, and an error if it does not."""
    values = np.array([[2**39, 2**38, 256], [2**38, 2**38, 256], [2**39, -(2**39), 5], [0, 0, 1]], np.int64)
    block = topk.BitSlicedBlock(np.arange(4), values, 2)
    query = np.array([2**39, 2**39, 1], np.int64)
    with pytest.raises(OverflowError):
        block.search(9, query, 1)
    ids, scores = topk.BitSlicedBlock(np.arange(2, 4), values[2:], 2).search(9, query, 2)
    assert (ids.tolist(), scores.tolist()) == ([2, 3], [5, 1])


def test_bitmap_sums():
    rng = np.random.default_rng(3)
    values = rng.integers(-300, 300, (128, 5))
    for low in (0, 2):
        block = topk.BitSlicedBlock(np.arange(128), values, low)
        for q in rng.integers(-300, 300, (10, 5)):
            terms = [(s, g, v) for w, v in zip(q.tolist(), block.slices) for s, g in topk.signed_digits(w)]
            sums = topk.add_all(terms, 24, block.words)
            bits = [np.unpackbits(x.view(np.uint8), bitorder="little").astype(np.int64) for x in sums]
            total = sum(b << i for i, b in enumerate(bits[:-1])) - (bits[-1] << 23)
            assert (total == (values >> low) @ q).all()


def test_neighbours(spark):
    rows = vectors(2500)
    df = spark.createDataFrame(rows, VEC)
    use = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), block_rows=800, query_rows=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, v in use:
        if q % 50 == 0:
            exact = {i: float(w @ v / np.sqrt(w @ w) / np.sqrt(v @ v)) for i, w in use if i != q}
            best = [i for _, i in sorted((-s, i) for i, s in exact.items())[:5]]
            mine = sorted(got[q])
            assert [k for k, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(exact[i] - s) < 1e-12 for _, i, s in mine)
            assert mine == sorted(mine, key=lambda x: (-round(x[2], 12), x[1]))
            hit, total = hit + len(set(best) & {i for _, i, _ in mine}), total + 5
    assert hit / total >= 0.9
    assert ann.nearest(df.limit(0), df).count() == 0
    ragged = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (50, [1.0, 0.0, 0.0]), (2, [0.5, 0.5, 0.0]), (3, []), (100, [])], "vec_id long, embedding array<float>")
    for tool in (ann.nearest, topk.top_k):
        assert {(r.query_id, r.vec_id) for r in tool(ragged, ragged.where("vec_id % 50 = 0")).collect()} == {(0, 1), (50, 2)}


def test_search_ends_where_no_nearer_row_is_left():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    unit = np.repeat(centres, 50, axis=0) + 0.02 * rng.normal(size=(2000, 32))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    forest = ann.Forest(unit, 16, 64, 7)
    share, hit = [], 0
    for i in range(0, 2000, 50):
        found, _ = forest.candidates(unit[i], 6, 2000)
        share.append(len(found) / 2000)
        hit += len(set(np.argsort(-(unit @ unit[i]))[:6]) & set(found.tolist()))
    assert hit == 6 * 40 and np.mean(share) < 0.25, np.mean(share)


def test_leaf_costs_of_all_trees():
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(300, 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    forest = ann.Forest(unit, 4, 8, 7)
    queries = rng.normal(size=(5, 8))
    for query, margins in zip(queries, forest.margins(queries, 2)):
        want = np.full(300, np.inf)
        todo = [(root, 0.0) for root in forest.roots]
        while todo:
            at, cost = todo.pop()
            if at < 0:
                want[forest.leaves[-1 - at]] = np.minimum(want[forest.leaves[-1 - at]], cost)
            else:
                m = float(query @ forest.planes[at]) - forest.offsets[at]
                todo += [(forest.high[at], max(cost, -m)), (forest.low[at], max(cost, m))]
        assert np.allclose(forest.reached(margins), want, atol=1e-5)
        found, _ = forest.candidates(query, 6, 165, margins)
        assert len(found) >= 128 and want[found].max() <= np.sort(want)[len(found) - 1] + 1e-5


def brute_groups(rows):
    sets, up = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = sets.get(i, set()) | ({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_texts():
    rnd = random.Random(2)
    words = ["w%d" % i for i in range(500)]
    out = []
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randrange(8, 120))]
        for _ in range(rnd.randrange(1, 14)):
            v = list(base)
            for _ in range(rnd.randrange(0, 5)):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            out.append(" ".join(v))
    out += ["", None, " \t\n", "one two", "ONE\x0btwo", "one two three four five", "one two three four five", "É é", "é é", "w1 " * 3000]
    return out


@pytest.mark.parametrize("block_rows", [1024, 3])
def test_near_duplicates(spark, block_rows):
    rows = list(enumerate(near_texts()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, id int").repartition(3)
    df = df.unionByName(spark.createDataFrame([(None, "one two three four five", None, None)], df.schema))
    got = neardup.near_duplicates(df, block_rows=block_rows, pair_rows=block_rows // 2, block_bytes=block_rows << 10).collect()
    assert len(got) == len(rows) + 1
    want = brute_groups(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_pruning_keeps_what_the_threshold_asks_for():
    least = neardup.least_matches(0.75, 1e-6, 32)
    assert len(least) == 4 and least == sorted(least) and 8 <= least[0] <= 16 and least[-1] < 96


def test_shards(spark):
    rnd = random.Random(4)
    rows = [(i, "x" * rnd.randrange(0, 300), 1) for i in range(700)] + [(3, "é", 1)] * 200 + [(None, "n", 1), (900, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    got = shard.shard_by_bytes(df, parts=7).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    total = sum(r["size"] for r in got)
    assert sorted(by) == list(range(40))
    for s, part in by.items():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 40) <= 320
    text = {r[0]: r[1] for r in rows if r[0] != 3}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r["size"] == len((text[r.doc_id] or "").encode()) + 16 for r in got if r.doc_id != 3)
    # The law again by brute force: prefix sums in id order, cut at equal targets.
    at, slots, want, mixed = 0, {}, [], {r.shard for r in got if r.doc_id == 3}
    for i, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        size = len((t or "").encode()) + 16
        want.append((i, at, size))
        at += size
    for i, first, size in want:
        shard_no = first * 40 // at
        slots[shard_no] = slots.get(shard_no, -1) + 1
        if i != 3:  # the 201 rows of 3 are of several sizes, in the order in which they are read
            assert [(r.shard, None if r.shard in mixed else r.slot) for r in got if r.doc_id == i] == [(shard_no, None if shard_no in mixed else slots[shard_no])]
    nothing = shard.shard_by_bytes(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"), overhead=0).collect()
    assert sorted((r.shard, r.slot) for r in nothing) == [(0, 0), (0, 1)]
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert order == sorted(order)
    assert shard.shard_by_bytes(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}\r\n", "same" if i % 3 == 0 else f"page {i} é\r\n\r\nWARC/1.1", "z") for i in range(60)] + [(100, None, None, "z"), (101, "u", "", "z"), (2**60 + 1, "u", "same", "z"), (None, "u", "alone", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, bundle string").repartition(3)
    folder = f"file://{tmp_path}/w"
    index = warc.write(df, folder, frame_bytes=600, bundle_bytes=4000)
    assert index.select("bundle").distinct().count() > 3
    got = {r.page_id: r for r in warc.read(index, folder).collect()}
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    assert len(got) == len(rows)
    for i, _, h, _ in rows:
        data = (h or "").encode()
        r = got[i]
        refers = first[h or ""] if i is not None and first[h or ""] != i else None
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == ("revisit" if refers is not None else "response", refers)
    assert warc.archive(df.limit(0)).count() == 0


def test_bundle_is_plain_zstandard(tmp_path):
    import io

    import zstandard

    with open(tmp_path / "b", "wb") as f:
        w = warc.BundleWriter(f, 50)
        places = [w.add(b"record %d " % i) for i in range(20)]
        w.close()
    data = (tmp_path / "b").read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(b"record %d " % i for i in range(20))
    with open(tmp_path / "b", "rb") as f:
        r = warc.BundleReader(f, len(data))
        assert all(r.frame(n)[at:].startswith(b"record %d " % i) for i, (n, at) in enumerate(places))


def test_pipeline(spark, tmp_path):
    rnd = random.Random(9)
    words = {"en": "the of and house tree water with from where".split(), "de": "der und das haus baum wasser mit von nicht".split()}
    rows = []
    for i in range(60):
        k = ("en", "de")[i % 2]
        rows.append((i, " ".join(rnd.choice(words[k]) + rnd.choice(["", "s", "en"]) for _ in range(40)), k, "s", 1))
    rows += [(100, rows[0][1], "en", "s", 1), (101, rows[1][1] + " zusatz", "de", "s", 1), (102, None, "en", "s", 1), (103, "123 456", "en", "s", 1), (104, rows[2][1] + " password = hunter22xyz", "en", "s", 1), (105, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "best_fit_packing"]
    one = stages["language_id"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {r[0] for r in rows} - {102, 103, 105}
    two = stages["near_dedup"](spark, one, str(tmp_path))
    want = brute_groups([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id for r in two.collect()} == {i for i, (_, c) in want.items() if i == c} and two.columns == docs.columns
    three = stages["secret_scan"](spark, one, str(tmp_path))
    t = {r.doc_id: r.text for r in three.collect()}
    assert "hunter22" not in t[104] and t[5] == rows[5][1] and three.columns == docs.columns
    assert dict(three.dtypes) == dict(docs.dtypes)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in two.collect()}


def test_components_of_copies(spark):
    rows = [(i, "a b c d e f g") for i in range(300)] + [(300 + i, "a b c d e f g h") for i in range(3)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where(F.col("component_id") == 0).count() == 303


def test_an_id_of_several_texts_joins_the_groups_of_all(spark):
    one, two, three, four = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(1, one), (2, two), (3, one), (3, two), (4, two + " more")]  # 3 copies 1 and 2
    rows += [(10, three), (11, three), (11, four), (12, four), (13, four + " more")]  # 11 is the first of one text and copies another
    rows += [(20, "x y z"), (20, "x y z"), (21, "p q r")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10), (12, 10), (13, 10), (20, 20), (21, 21)}
