"""Rules, ties and null cases on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from quaystone.functions import rules, text, urls
from quaystone.operators import cluster, demand, graph, history, html, matching, quality, review, sets, terms
from quaystone.sources import readers, writers
from quaystone.streaming import streams


def one(spark, column, *values):
    kind = {str: "string", int: "long", float: "double"}[type(next(v for v in values if v is not None))]
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {kind}").select(column).collect()]


def test_urls(spark):
    u = ("HTTPS://WWW.Shop.example/A/?b=2&utm_source=x&a=1#f", "http://h.example", "http://h.example/", "not a url", None, "https://h.example/p/?gclid=1")
    assert one(spark, urls.canonical_serp_url(F.col("c")), *u) == ["https://www.shop.example/A?a=1&b=2", "http://h.example/", "http://h.example/", None, None, "https://h.example/p"]
    assert one(spark, urls.canonical_url(F.col("c")), *u)[0] == "https://www.shop.example/A/?b=2&a=1"
    assert one(spark, urls.page_key(F.col("c")), *u)[0] == "https://www.shop.example/A"
    assert one(spark, urls.host(F.col("c")), *u)[:2] == ["shop.example", "h.example"]
    assert one(spark, urls.is_redacted(F.col("c")), "https://x/<redacted-1>", "https://x/%3Credacted%3E", "https://x/redacted", None) == [True, True, False, False]


def test_text(spark):
    assert one(spark, text.normalize_keyword(F.col("c")), "  ＡＢＣ　ｄ ", "x\t\ny", None) == ["abc d", "x y", None]
    assert one(spark, text.evidence_key(F.col("c")), "A-b (c)！") == ["abc"]
    assert one(spark, F.array_join(text.grams(F.col("c")), "|"), "abab", "a", "") == ["ab|ba", "", ""]
    assert one(spark, text.mention(F.col("c"), F.lit("ring")), "a Ring!", "string", "none") == ["word_boundary", "substring_only", "absent"]
    assert one(spark, text.sort_number(F.col("c")), "1,200 pcs", "¥-3.5", "none") == [1200.0, -3.5, None]


def test_rules(spark):
    assert one(spark, rules.difficulty_band(F.col("c")), None, 0, 33, 34, 66, 67, 100) == ["missing", "zero_observed", "low", "medium", "medium", "high", "high"]
    with pytest.raises(Exception, match="out of range"):
        one(spark, rules.difficulty_band(F.col("c")), 101)


def test_page_types(spark):
    cases = [
        ("https://h/a.PDF/", "", "pdf"), ("https://www.youtube.com/x", "", "video"), ("https://m.x.com/a", "", "social"), ("https://note.com/", "", "social"), ("https://teratail.com/q", "", "qa_forum"), ("https://h/a", "就活の質問", "qa_forum"),
        ("https://h/", "株式会社A", "corporate_home"), ("https://h", "Acme Inc", "service_top"), ("https://h/jobs/1", "", "database"), ("https://h/%E5%8F%A3%E3%82%B3%E3%83%9F", "", "database"), ("https://h/x/page/2", "", "category"),
        ("https://h/x", "企業一覧", "database"), ("https://h/x", "一覧", "category"), ("https://h/x", "Skill Checker", "tool"), ("https://www3.nhk.or.jp/x", "", "news"), ("https://h/blog", "", "article"), ("https://h/Blog/a", "", "other"), ("https://h/x", "面接とは", "article"),
        ("https://h:80/x", "", "other"), ("no address", "面接とは", "other"), (None, None, "other"),
    ]
    rows = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(cases)], "i int, u string, t string")
    got = [r[0] for r in rows.orderBy("i").select(rules.page_type(F.col("u"), F.col("t"))).collect()]
    assert got == [c[2] for c in cases]


def test_questions_and_claims(spark):
    topics = ("A社との違い", "面接 おすすめ？", "締切はいつ", "面接の対策", "辞める理由", "履歴書", None)
    assert one(spark, rules.derive_question(F.col("c"), F.lit(False)), *topics) == ["A社との違いを比較すると何が違う？", "面接 おすすめは何を基準に選ぶ？", "締切はいつはいつ確認・準備する？", "面接の対策はどう進める？", "辞める理由はなぜ重要？", "履歴書について押さえるべきポイントは？", None]
    assert one(spark, rules.derive_question(F.col("c"), F.lit(True)), "何？?", "違い") == ["何？", "違い？"]
    assert one(spark, rules.claim_class(F.col("c")), "年収", "３社", "業界とは", "志望動機", "会社の費用") == ["P0", "P0", "P1", "P2", "P0"]


def test_new_article_routes(spark):
    c = spark.createDataFrame([(i, i) for i in range(1, 6)], "keyword_id long, group_id long")
    t = spark.createDataFrame([(1, 10, "depth_sensitive_hold"), (10, 2, "sibling_article_link_review"), (3, 11, "depth_sensitive_hold"), (4, 4, "retain_group_review"), (1, 11, "retain_separate")], "left_group long, right_group long, decision string")
    g = spark.createDataFrame([(10, 7), (11, None)], "group_id long, article_id long")
    got = {r.keyword_id: (r.review_action, r.existing_articles, r.planned_groups) for r in review.new_article_gate(c, t, g).collect()}
    assert got == {1: ("existing_article_boundary_review", 1, 1), 2: ("new_article_with_internal_link_review", 1, 0), 3: ("planned_group_topology_review", 0, 1), 4: ("ready_new_article_review", 0, 0), 5: ("ready_new_article_review", 0, 0)}


def test_related_proposals(spark):
    g = spark.createDataFrame([(1, 1, "red ring", "Red Ring")], "group_id long, site_id long, seed string, comparison string")
    k = [(1, None, 1, "red hat", 99), (2, None, 1, "red ring", 99), (3, None, 1, "blue stone", None), (4, None, 1, "blue sea", 9), (5, None, 2, "red hat", 9), (6, 1, 1, "hat red", 9), (7, None, 1, "方法", 9)]
    k = spark.createDataFrame([(*r, "unacquired") for r in k] + [(8, None, 1, "red cap", 9, "acquired")], "source_keyword_id long, representative_id long, site_id long, raw_keyword string, volume long, state string")
    a = spark.createDataFrame([("ring", "stone", 0.2), ("red", "sea", 0.1), ("ring", "hat", 0.05)], "term string, associated_term string, cosine double")
    got = [(r.source_keyword_id, r.score, r.position) for r in matching.related_proposals(g, k, a).orderBy("position").collect()]
    assert got == [(1, 50 + 1.5 + 10, 1), (3, 6.0, 2)]


def test_candidate_review(spark):
    schema = "candidate_id long, group_id string, main_keyword string, content_type string, heading_level int, text string, evidence_type string, evidence_ids array<string>, axes int"
    long = "就活面接の準備で押さえるべき順番と当日の持ち物まとめ"
    rows = [
        (1, "g", "就活", "title", None, long, "serp_demand", ["t1"], 2),
        (2, "g", "就活", "heading", 2, "面接の持ち物", "serp_demand", ["t1", "lost"], None),
        (3, "h", "就活", "heading", 3, "面接の持ち物", None, None, None),
        (4, "h", "営業", "title", None, "短い|短い長い題名|長い題名", "competitor_term", ["p1"], 4),
        (5, "k", "x", "heading", 2, "abcdefghijklmnop", "competitor_term", ["p1"], None),
        (6, "k", "x", "heading", 2, None, "serp_feature_item", ["f1"], None),
        (7, "k", "x", "heading", 2, "old old! old heading", "competitor_term", ["p1"], None),
    ]
    rivals = spark.createDataFrame([("k", "ABCDEFGHIJKLMNOP"), ("k", "abcdefghijklmnopqr"), ("g", None), ("h", "abcdefghijklmnop")], "group_id string, text string")
    known = spark.createDataFrame([("serp_demand", "t1", "面接 持ち物"), ("competitor_term", "p1", None), ("serp_feature_item", "f1", None)], "evidence_type string, evidence_id string, topic string")
    old = spark.createDataFrame([("OLD, old old heading.",), (None,)], "text string")
    got = {r.candidate_id: (set(filter(None, r.issues.split(","))), r.score, r.state, r.similarity) for r in review.review_candidates(spark.createDataFrame(rows, schema), rivals, old, known).collect()}
    assert got == {
        1: (set(), 100, "ready", None),
        2: ({"evidence_reference_unresolved", "cross_group_candidate_duplicate"}, 45, "blocked", None),
        3: ({"evidence_missing", "orphan_h3", "cross_group_candidate_duplicate"}, 15, "blocked", None),
        4: ({"main_keyword_missing", "title_length_review", "title_segment_redundancy", "title_axis_overload"}, 5, "blocked", None),
        5: ({"competitor_copy_risk"}, 70, "blocked", 1.0),
        6: ({"serp_feature_observation_review", "heading_length_review"}, 65, "needs_review", None),
        7: ({"existing_content_collision", "term_repetition_review"}, 60, "blocked", None),
    }


def test_close_rivals_lose_none(spark):
    import random

    rng = random.Random(5)
    sets_ = [sorted(set(rng.choices("abcdefghijkl", k=rng.randint(1, 9)))) for _ in range(160)]
    c = spark.createDataFrame([(i, i % 2, s) for i, s in enumerate(sets_[:80])], "candidate_id long, group_id int, g array<string>")
    r = spark.createDataFrame([(i % 2, s) for i, s in enumerate(sets_[80:])], "group_id int, g array<string>")
    best = {}
    for i, x in enumerate(sets_[:80]):
        v = max(len(set(x) & set(y)) / len(set(x) | set(y)) for j, y in enumerate(sets_[80:]) if j % 2 == i % 2)
        if v >= 0.75:
            best[i] = round(v, 9)
    assert best and {x.candidate_id: round(x.similarity, 9) for x in review.close_rivals(c, r).collect()} == best


def test_plan_coherence(spark):
    g = spark.createDataFrame([("a", "outline_ready"), ("b", "outline_ready"), ("c", None)], "group_id string, outline_status string")
    schema = "group_id string, candidate_id long, text string, quality double, state string, evidence_ids array<string>"
    t = [("a", 1, "red ring", 95.0, "ready", ["e1"]), ("a", 2, "red hat", 92.0, "ready", ["e1"]), ("a", 3, "x", 99.0, "blocked", ["e1"]), ("a", 4, "red hat", 89.0, "ready", ["e1"]), ("b", 5, "zzz", None, "needs_review", None), ("c", 6, "q", 90.0, "ready", ["e9"])]
    h = [("a", 1, "red hat", 80.0, "ready", ["e1"]), ("a", 2, "blue", 90.0, "needs_review", None)]
    got = {r.group_id: (r.title_id, r.baseline_id, r.score, r.state, r.issues) for r in review.plan_coherence(g, spark.createDataFrame(t, schema), spark.createDataFrame(h, schema)).collect()}
    assert got == {
        "a": (2, 1, 87, "needs_review", "selected_heading_review_required"),  # 36.8 + 29.75 + 15 + 10 - 5
        "b": (5, 5, 0, "needs_review", "title_outline_lexical_gap"),
        "c": (6, 6, 36, "blocked", "outline_unavailable,title_evidence_weakly_represented,title_outline_lexical_gap"),
    }


def test_action_bands(spark):
    s = [("g", "unreviewed", "P1", 5, ["c1", "c2"], None, 1), ("g", "unreviewed", "P3", 5, ["c1"], "unique_path_supported_sense", 2), ("g", "resolved", "P0", 9, ["c3"], None, 9), ("h", "unreviewed", "P3", 1, None, "unique_path_supported_sense", 0)]
    senses = spark.createDataFrame(s, "group_id string, state string, priority_band string, priority_score int, candidate_ids array<string>, readiness string, samples int")
    features = spark.createDataFrame([(1, 9), (1, 3), (2, 4), (3, None)], "task_id int, rank int")
    got = [(r.action_id, r.band, r.impact) for r in matching.action_queue({"semantic_sense_review": matching.sense_actions(senses), "serp_format_review": matching.format_actions(features)}).collect()]
    assert got == [("semantic-sense:g", "P1", 58.0), ("serp-format:1", "P1", 0.0), ("semantic-sense:h", "P2", 1.0), ("serp-format:2", "P2", 0.0), ("serp-format:3", "P2", 0.0)]


def test_co_ranking_and_best_rank(spark):
    e = spark.createDataFrame([(1, "u", 3, 0), (1, "u", 1, 0), (2, "u", 2, 0), (2, "v", 11, 0), (1, "v", 4, 0)], "task_id long, url string, rank int, group_id int")
    r = graph.co_ranked(e).collect()
    assert [(x.left_id, x.right_id, x.shared, x.score) for x in r] == [(1, 2, 1, 1.5)]


def test_complete_link(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7), (3, 4, 0.95), (5, 6, 0.6)], "l long, r long, ratio double")
    got = {r.node: r.cluster for r in cluster.complete_link(e, "l", "r", "ratio").collect()}
    assert got == {3: 3, 4: 3, 1: 1, 2: 1, 5: 5, 6: 5}
    shuffled = cluster.complete_link(e.orderBy(F.rand(3)), "r", "l", "ratio")
    assert {r.node: r.cluster for r in shuffled.collect()} == got
    assert {r.node: r.cluster for r in cluster.complete_link(e, "l", "r", "ratio", local=0).collect()} == got


def test_modifiers(spark):
    n, alone, parent = cluster.modifier(F.split("c", " "), ["price", "cheap"])
    assert [tuple(x) for x in one(spark, F.struct(n, alone, parent), "tie price cheap", "price", "cheap tie", "tie")] == [(2, False, "tie price"), (1, True, None), (0, False, None), (0, False, None)]


def test_greedy(spark):
    p = spark.createDataFrame([("g", 1, 1, 0.9), ("g", 1, 2, 0.95), ("g", 2, 2, 0.9), ("g", 2, 1, 0.5), ("g", 3, 3, 0.3)], "g string, l int, r int, s double")
    assert {(x.l, x.r) for x in cluster.greedy_one_to_one(p, "g", "l", "r", "s").collect()} == {(1, 2), (2, 1)}
    e = spark.createDataFrame([("s", 3, 1), ("s", 2, 1)], "story string, a int, b int")
    assert [(r.step, r.position) for r in cluster.dependency_order(e, "story", "a", "b").orderBy("position").collect()] == [(2, 1), (3, 2), (1, 3)]
    with pytest.raises(Exception, match="cycle"):
        cluster.dependency_order(e.union(spark.createDataFrame([("s", 1, 3)], e.schema)), "story", "a", "b").collect()
    q = spark.createDataFrame([("b", 1, 6.0), ("b", 2, 6.0), ("b", 3, 4.0)], "b string, i int, c double")
    assert [r.selected for r in demand.greedy_budget(q, "b", ["i"], "c", 10).orderBy("i").collect()] == [True, False, True]


def test_history(spark):
    a = spark.createDataFrame([("k", "u1", 1, "t"), ("k", "u2", 2, "t")], "k string, url string, rank int, title string")
    b = spark.createDataFrame([("k", "u2", 1, "T"), ("k", "u3", 2, "t")], a.schema)
    d = {r.url: (r.state, r.rank_delta, r.title_changed) for r in history.snapshot_diff(a, b, ["k"]).collect()}
    assert d == {"u1": ("exited", None, None), "u2": ("retained", 1, True), "u3": ("entered", None, None)}
    f = spark.createDataFrame([("t", "2024-01-10 00:00:00", 1, "2024-01-01 00:00:00"), ("t", "2024-01-10 00:00:00", 2, "bad"), ("t", "2024-01-10 00:00:00", 3, "2030-01-01 00:00:00"), ("t", "2024-01-10 00:00:00", 11, "2024-01-01 00:00:00"), ("t", "2024-01-10 00:00:00", 4, None)], "task string, o string, rank int, p string")
    r = history.freshness(f, "task", "o", "p").first()
    assert (r.results, r.unavailable, r.invalid, r.dated, r.state) == (4, 2, 1, 1, "insufficient")


def test_null_is_not_zero(spark):
    a = spark.createDataFrame([(1, "u"), (2, "u")], "pair long, url string")
    b = spark.createDataFrame([(1, "v"), (3, "u")], a.schema)
    assert {r.pair: r.jaccard for r in sets.compare_urls(a, b, "pair", "url").collect()} == {1: 0.0, 2: None, 3: None}


def test_prefix_tree(spark):
    k = spark.createDataFrame([(1, "tie"), (2, "tie red"), (3, "red tie"), (4, "tie red silk"), (5, "hat")], "id long, kw string")
    got = {r.id: (r.path, r.parent_path, r.relation) for r in terms.prefix_tree(k, "id", "kw").collect()}
    assert got == {1: ("tie", None, "root"), 2: ("tie/red", "tie", "child"), 3: ("tie/red", "tie", "reordered_alias"), 4: ("tie/red/silk", "tie/red", "child"), 5: ("hat", None, "root")}


def test_html(spark):
    page = "<html><head><title>A &amp; B</title><meta name='robots' content='noindex'><link rel='canonical' href='https://h/x'><style>h1{}</style></head><body><nav><h2>Menu</h2><a href='/in'>in</a></nav><main><h1>Top <b>x</b></h1><p>t<p>u<a href='https://o/y'>out</a></main><script>'<h1>no</h1>'</script></body>"
    p = html.parse(spark.createDataFrame([(1, "https://h/p", page), (2, None, None)], "page_id long, url string, html string"))
    assert [(r.level, r.text, r.role) for r in html.headings(p).orderBy("position").collect()] == [(2, "Menu", "excluded_structural"), (1, "Top x", "content_candidate")]
    assert {(r.url, r.kind, r.region) for r in html.links(p).collect()} == {("https://h/in", "internal", "nav"), ("https://o/y", "external", "main")}
    m = html.metadata(p).where("page_id = 1").first()
    assert (m.title, m.robots, m.canonical) == ("A & B", "noindex", "https://h/x")
    assert html.structure(p).where("page_id = 2").first().n_links == 0


def test_heading_context(spark):
    rows = [(1, 1, 1, "a"), (1, 2, 2, "b"), (1, 3, 3, "c"), (1, 4, 1, "d"), (1, 5, 3, "e")]
    got = {r.text: r.context for r in html.heading_context(spark.createDataFrame(rows, "page_id int, position int, level int, text string")).collect()}
    assert got == {"b": "a", "c": "a > b", "e": "d"}


def test_snapshots(spark, tmp_path):
    raw = tmp_path / "root" / "set" / "raw"
    raw.mkdir(parents=True)
    items = [{"type": "organic", "rank_group": 1, "rank_absolute": 2, "url": "https://h/a/?utm_x=1", "title": "t"}, {"type": "organic"}, {"type": "people_also_ask", "items": [{"title": "Q?"}]}, {"type": "related_searches", "items": ["r"]}]
    (raw / "a.json").write_text(json.dumps({"tasks": [{"id": "1", "status_code": 20000, "data": {"keyword": "k"}, "result": [{"items": items}]}]}))
    (raw / "b.json").write_text(json.dumps({"tasks": [{"id": "2"}]}))
    s = readers.raw_snapshots(spark, str(tmp_path / "root"))
    assert [(r.task_id, r.dataset) for r in s.collect()] == [("1", "set")]
    assert readers.duplicate_tasks(s.union(s)).count() == 1
    assert [r.canonical_url for r in readers.organic(s).collect()] == ["https://h/a"]
    assert {(r.demand_type, r.value) for r in readers.demand_occurrences(s).collect()} == {("people_also_ask", "Q?"), ("related_searches", "r")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('﻿a,b\n"x ""y""","1,234"\n,\nz,5%\n')
    rows = readers.quoted_csv(spark, str(tmp_path / "q.csv"), "a string, b string")
    assert [(r.a, r.b) for r in rows.collect()] == [('x "y"', "1,234"), ("z", "5%")]
    assert [r[0] for r in rows.select(readers.export_number(F.col("b"))).collect()] == [1234.0, 0.05]
    root = str(tmp_path / "pub")
    for run in ("r1", "r2"):
        writers.publish({"t": spark.createDataFrame([(run,)], "v string")}, root, run)
    assert writers.published(spark, root, "t").first().v == "r2"


def test_quality_and_review(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, None), (2, -1.0)], "k int, v double")
    assert quality.check_violations(rows, {"positive": F.col("v") > 0}).first().positive == 1
    assert [r.k for r in quality.unique_violations(rows, ["k"]).collect()] == [1]
    d = spark.createDataFrame([(1, "not_supported", "weird")], "claim_id int, decision string, reason string")
    with pytest.raises(Exception, match="no rule"):
        review.reframes(d, [("absent", "x", "y")]).collect()
    sc = spark.createDataFrame([("g", 1, 5), ("g", 2, 5), ("h", 3, 7)], "g string, c int, score int")
    assert {r.g: (r.c, r.state) for r in matching.unique_winners(sc, "g", "c").collect()} == {"g": (None, "ambiguous"), "h": (3, "matched")}


def test_late_and_future_stamps_stay(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, None), (3, "2031-01-01 00:00:00")], "i int, t string").withColumn("at", F.col("t").cast("timestamp"))
    good, bad = streams.split_stamps(rows, "at", "2024-06-01 00:00:00")
    assert [r.i for r in good.collect()] == [1] and sorted(r.i for r in bad.collect()) == [2, 3]


def test_boundary_decisions(spark):
    overlap = spark.createDataFrame([(1, 2, 0.7, False), (1, 3, 0.7, False), (1, 4, 0.4, False), (1, 5, 0.1, True), (1, 6, 0.9, True), (2, 3, 0.4, False)], "left_id long, right_id long, overlap double, same_group boolean")
    intent = spark.createDataFrame([(2, 1, 0.7, False), (1, 4, 0.62, False), (1, 5, 0.37, True), (2, 4, 0.9, False), (2, 5, 0.4, False), (2, 9, 0.9, False), (3, 1, 0.5, False)], "left_id long, right_id long, score double, same_group boolean")
    edges = spark.createDataFrame([(i,) for i in range(1, 7)], "task_id long")
    got = {(r.left_id, r.right_id): (r.decision, r.url_overlap) for r in graph.boundary_consensus(overlap, intent, edges).collect()}
    assert {k: d for k, (d, _) in got.items()} == {
        (1, 2): "merge_consensus_review", (1, 3): "url_only_merge_review", (1, 4): "merge_signal_conflict_review", (1, 5): "split_consensus_review", (1, 6): "current_group_boundary_review",
        (2, 3): "internal_link_boundary_review", (2, 4): "semantic_adjacency_review", (2, 5): "internal_link_boundary_review", (2, 9): "insufficient_url_evidence_review",
    }
    assert got[2, 4][1] == 0.0 and got[2, 9][1] is None


def test_topology_decisions(spark):
    rows = [(1, 2, "stable_merge", True), (2, 1, "threshold_flip", False), (1, 3, "threshold_flip", False), (3, 1, "stable_related", None), (2, 3, "stable_related", False), (4, 4, "stable_related", False)]
    rows += [(5, 5, "stable_separate", False), (5, 6, "stable_separate", False), (6, 7, "stable_merge", False), (7, 6, "stable_related", False)]
    got = {(r.left_group, r.right_group): r.topology for r in graph.topology(spark.createDataFrame(rows, "left_group long, right_group long, state string, robust_merge boolean")).collect()}
    assert got == {
        (1, 2): "consolidation_review", (1, 3): "depth_sensitive_hold", (2, 3): "sibling_article_link_review", (4, 4): "retain_group_review", (5, 5): "split_group_review", (5, 6): "retain_separate", (6, 7): "mixed_stability_review",
    }


def test_ranked_branches(spark):
    paths = spark.createDataFrame([(["a", f"b{i % 40}"], None if i % 3 else i) for i in range(500)] + [(["a"], 1), (["a", None], 1), (None, 1)], "path array<string>, volume long")
    got = demand.ranked_branches(paths).collect()
    assert [r.branch for r in sorted(got, key=lambda r: r.position)] == [r.branch for r in sorted(got, key=lambda r: (-r.n, -r.volume, r.branch))]
    assert sorted(r.position for r in got) == list(range(1, 41)) and sum(r.n for r in got) == 500
    assert demand.ranked_branches(paths.limit(0)).count() == 0


def test_reviewed_boundaries(spark):
    overlap = spark.createDataFrame([(1, 2, 0.6, False, True), (1, 3, 0.1, False, False), (2, 3, 0.2, True, False)], "left_id long, right_id long, overlap double, same_group boolean, review_required boolean")
    intent = spark.createDataFrame([(3, 2, 0.2, True, True), (1, 2, 0.7, False, False), (4, 5, 0.9, False, True), (4, 6, 0.5, False, False)], "left_id long, right_id long, score double, same_group boolean, review_required boolean")
    edges = spark.createDataFrame([(4, 1), (5, 11), (5, 0)], "task_id long, rank long")
    got = {(r.left_id, r.right_id): (r.decision, r.url_overlap) for r in graph.boundary_consensus(overlap, intent, edges).collect()}
    assert got == {(1, 2): ("merge_consensus_review", 0.6), (2, 3): ("split_consensus_review", 0.2), (4, 5): ("insufficient_url_evidence_review", None)}


def test_depth_stability_of_boundaries(spark):
    rows = [(t, f"u{i}", i) for t in (1, 2) for i in range(1, 11)] + [(t, "u1", 2) for t in (1, 2)] + [(3, "u1", 1), (3, "u1", 1), (3, "v", 4)]
    edges = spark.createDataFrame(rows, "task_id long, url string, rank long")
    got = {(r.left_id, r.right_id): (r.ratio_3, r.ratio_10, r.state) for r in graph.depth_stability(edges).collect()}
    assert got[1, 2] == (1.0, 1.0, "stable_merge") and got[1, 3] == (1 / 3, 0.1, "threshold_flip")
    boundary = spark.createDataFrame([(1, 2, "merge_consensus_review"), (1, 3, "merge_consensus_review"), (2, 9, "url_only_merge_review")], "left_id long, right_id long, decision string")
    rows = {(r.left_id, r.right_id): (r.state, r.robust_merge, r.least_ratio, r.greatest_ratio) for r in graph.boundary_stability(boundary, edges).collect()}
    assert rows == {(1, 2): ("stable_merge", True, 1.0, 1.0), (1, 3): ("threshold_flip", False, 0.1, 1 / 3), (2, 9): ("stable_separate", False, 0.0, 0.0)}


def test_source_keys(spark):
    cases = {"https://A.example?b=2&a=1#x": "https://a.example/?a=1&b=2", "https://a.example/?a=1&b=2": "https://a.example/?a=1&b=2", "https://a.example/": "https://a.example", "https://a.example/p/?a=2&a=1": "https://a.example/p/?a=2&a=1", "no url/": "no url"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, "")], "url string, want string")
    assert all(r.got == r.want for r in df.select("want", review.source_key(F.col("url")).alias("got")).collect())


def test_keyword_associations(spark):
    docs = {i: ["東京", "大阪", "it"] for i in range(1, 31)} | {i: ["東京", "latin", "方"] for i in range(40, 60)} | {60: ["ai", "大阪"], 61: ["ai", "大阪"], 62: ["ai", "大阪", "東京"], 63: ["web"], None: ["ai", "大阪"]}
    df = spark.createDataFrame([(i, t) for i, ts in docs.items() for t in ts] + [(1, "東京"), (1, None)], "id long, term string")
    got = {(r.term, r.other): (r.support, r.df_term, r.df_other, r.cosine, r.rank, r.evidence) for r in terms.keyword_associations(df, "id").collect()}
    cities = round(31 / (31 * 33) ** 0.5, 6)
    assert got[("東京", "大阪")] == (31, 31, 33, cities, 1, list(range(1, 21)))
    assert got[("ai", "大阪")] == (3, 3, 33, round(3 / 99**0.5, 6), 1, [60, 61, 62])
    assert set(got) == {("東京", "大阪"), ("大阪", "東京"), ("ai", "大阪"), ("大阪", "ai")}
