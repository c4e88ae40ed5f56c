"""X11: terms of pages are counted within their rows."""

import re
from collections import Counter

from quaystone.operators import terms
from quaystone.plans import every


def test_page_terms(spark):
    rows = [(1, "Red ring, red RING; bolt"), (2, ""), (3, None), (4, "..."), (5, "a b a"), (5, "b c"), (5, None), (None, "x y x"), (None, "y"), (6, "one")]
    want = Counter()
    for i, t in rows:
        for w in re.findall(r"\w+", (t or "").lower()):
            want[i, w] += 1
    for some in (rows, [r for r in rows if r[0] not in (5, None)]):
        got = terms.page_terms(spark.createDataFrame(some, "id long, text string"), "id", "text").collect()
        assert len(got) == len({(r.id, r.term) for r in got})
        assert {(r.id, r.term): r["count"] for r in got} == {k: n for k, n in want.items() if k[0] in {i for i, _ in some}}


def test_no_shuffle_by_page_and_term(spark):
    plan = every.queries()["X11_X12_A10_term_weights"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(page_id" not in plan
