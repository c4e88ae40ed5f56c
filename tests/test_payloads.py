"""Feature items, links and provider responses of differing shapes."""

import json

from quaystone.sources import payloads


def test_feature_items(spark):
    items = ["plain", {"type": "link_element", "title": "T", "url": "u", "links": [{"title": "a", "url": "x", "domain": "d"}, {"url": 5}, "odd"]}, {"text": "no type", "timestamp": "2024", "alt": 7}, None, 3, {"type": "images", "image_url": "i", "links": "none"}]
    rows = [("f1", "t", "g", "images", json.dumps({"items": items})), ("f2", "t", "g", "video", json.dumps({"items": None})), ("f3", "t", None, "video", "no json"), ("f4", "t", None, "video", None), ("f5", "t", None, "x", json.dumps({"items": ["plain", "plain"]}))]
    got, links = payloads.feature_payload_items(spark.createDataFrame(rows, "feature_id string, task_id string, group_id string, feature_type string, payload string"))
    rows = {(r.feature_id, r.item_order): r for r in got.collect()}
    assert {k: (r.item_type, r.text, r.title, r.alt, r.url, r.image_url, r.published_at) for k, r in rows.items()} == {
        ("f1", 0): ("text", "plain", None, None, None, None, None), ("f1", 1): ("link_element", None, "T", None, "u", None, None), ("f1", 2): ("unknown", "no type", None, "7", None, None, "2024"),
        ("f1", 3): ("unknown", None, None, None, None, None, None), ("f1", 4): ("unknown", None, None, None, None, None, None), ("f1", 5): ("images", None, None, None, None, "i", None),
        ("f5", 0): ("text", "plain", None, None, None, None, None), ("f5", 1): ("text", "plain", None, None, None, None, None),
    }
    assert len({r.feature_item_id for r in rows.values()}) == 8
    assert sorted((r.link_order, r.title, r.url, r.domain) for r in links.collect()) == [(0, "a", "x", "d"), (1, None, "5", None), (2, None, None, None)]
    assert {r.feature_item_id for r in links.collect()} == {rows["f1", 1].feature_item_id}


def test_provider_responses(spark):
    metrics = {"tasks": [{"status_code": 20000, "result": [
        {"keyword": " Ａ b ", "location_code": 1, "language_code": "ja", "search_volume": 10, "cpc": 1.5, "competition": "LOW", "monthly_searches": [{"year": 2024, "month": 1, "search_volume": 5}, {"year": 2024, "month": 2}]},
        {"keyword": "c", "search_volume": None, "search_partners": True, "monthly_searches": None}]}, {"status_code": 40501, "result": [{"keyword": "lost"}]}, {"status_code": 20000, "result": None}]}
    difficulty = {"tasks": [{"status_code": 20000, "result": [{"se_type": "s", "location_code": 2, "items": [{"keyword": "c", "keyword_difficulty": 7}, {"keyword": "d", "se_type": "own"}]}, {"items": None}]}]}
    ranked = {"tasks": [{"status_code": 20000, "result": [{"target": "t.example", "total_count": 9, "location_code": 3, "language_code": "ja", "metrics": {"organic": {"n": 1}}, "items": [
        {"keyword_data": {"keyword": "k", "keyword_info": {"search_volume": 4, "competition": 0.5}, "search_intent_info": {"main_intent": "m", "foreign_intent": ["x", "y"]}}, "ranked_serp_element": {"serp_item": {"type": "organic", "rank_group": 2, "etv": 1.25, "rank_changes": {"is_new": True}}}},
        {"keyword_data": {"keyword": "l", "location_code": 8}}, {}]}]}]}
    rows = [(1, "j1", "keyword_metrics", "d1", json.dumps(metrics)), (1, "j2", "keyword_difficulty", "d2", json.dumps(difficulty)), (1, "j3", "ranked_keywords", "d3", json.dumps(ranked)), (1, "j4", "keyword_metrics", "d4", "broken"), (1, "j5", "ranked_keywords", "d5", None)]
    tables = payloads.enrichment_tables(spark.createDataFrame(rows, "site_id long, job_id string, kind string, raw_digest string, body string"))
    got = {n: t.collect() for n, t in tables.items()}
    assert [(r.keyword, r.normalized_keyword, r.location_code, r.search_partners, r.competition_level, r.search_volume, r.cpc, r.source_job_id) for r in got["keyword_metrics"]] == [(" Ａ b ", "a b", 1, False, "LOW", 10, 1.5, "j1"), ("c", "c", None, True, None, None, None, "j1")]
    assert [(r.normalized_keyword, r.year, r.month, r.search_volume) for r in got["monthly_searches"]] == [("a b", 2024, 1, 5), ("a b", 2024, 2, None)]
    assert [(r.keyword, r.keyword_difficulty, r.se_type, r.location_code) for r in got["difficulties"]] == [("c", 7, "s", 2), ("d", None, "own", 2)]
    assert [(r.target, r.total_count, r.items_count, r.metrics) for r in got["ranked_summaries"]] == [("t.example", 9, 3, '{"organic":{"n":1}}')]
    assert [(r.keyword, r.location_code, r.language_code, r.search_volume, r.competition, r.main_intent, r.foreign_intents, r.serp_type, r.rank_group, r.etv, r.rank_changes) for r in got["ranked_keywords"]] == [
        ("k", 3, "ja", 4, 0.5, "m", ["x", "y"], "organic", 2, 1.25, '{"is_new":true}'), ("l", 8, "ja", None, None, None, [], None, None, None, None), (None, 3, "ja", None, None, None, [], None, None, None, None)]
    asked = spark.createDataFrame([("keyword_metrics", "a  B"), ("keyword_metrics", "lost"), ("keyword_difficulty", "C"), ("keyword_difficulty", "e"), ("ranked_keywords", "k")], "kind string, keyword string")
    assert sorted(map(tuple, payloads.enrichment_coverage(asked, tables).select("kind", "requested", "returned", "missing").collect())) == [("keyword_difficulty", 2, 2, 1), ("keyword_metrics", 2, 2, 1)]
