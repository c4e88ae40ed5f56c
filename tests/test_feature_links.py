"""Links have their feature without a join."""

from quaystone.sources import payloads


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_carry_their_feature(spark):
    rows = [(f, "t", "g", "images", '{"items":[{"links":[{"title":"a"}]}]}') for f in ("f1", "f2")]
    links = payloads.feature_payload_items(spark.createDataFrame(rows, "feature_id string, task_id string, group_id string, feature_type string, payload string"))[1]
    assert sorted((r.feature_id, r.title) for r in links.collect()) == [("f1", "a"), ("f2", "a")]
    from quaystone.plans import every

    assert "Join" not in plan(every.queries()["X3_feature_links"](spark, "/root/testdata/sf0.001"))
