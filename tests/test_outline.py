"""Small outlines by hand, and random groups against the plain walk through the children."""

import random

import pytest

from quaystone.operators import outline

COLUMNS = "group_id string, candidate_id long, text string, heading_level int, evidence_type string, evidence_ids array<string>, state string, resolved boolean, quality double, evidence_count long, strength long"


def test_children_choose_in_their_order(spark):
    rows = [
        ("g", 1, "Salary guide", 2, "paa", ["e1"], "ready", True, 90.0, 1, 1), ("g", 2, "Salary table", 2, "paa", ["e2"], "ready", True, 80.0, 1, 1), ("g", 3, "Blocked", 2, "paa", ["e1"], "blocked", True, 99.0, 9, 9),
        # 4 is before 5 and takes the place that 5 would score higher for
        ("g", 4, "Salary", 3, "paa", [], "ready", True, 70.0, 1, 1), ("g", 5, "Guide", 3, "paa", ["e1"], "needs_review", None, 99.0, 1, 1), ("g", 6, "Other", 3, None, None, "ready", True, None, None, None),
        ("g", 7, "Salary guide", 3, "paa", ["e1"], "ready", False, 99.0, 1, 1), ("h", 8, "Alone", 3, "paa", ["e1"], "ready", True, 1.0, 1, 1), ("h2", 9, None, 2, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r.candidate_id, r.parent_id, r.position, r.child_position) for r in outline.evidence_outlines(df, max_h3=1).collect()}
    assert got == {(1, None, 1, None), (2, None, 2, None), (9, None, 1, None), (4, 1, 1, 1)}
    got = {(r.candidate_id, r.parent_id, r.child_position) for r in outline.evidence_outlines(df, max_h2=1).collect()}
    assert got == {(1, None, None), (4, 1, 1), (5, 1, 2), (9, None, None)}
    assert outline.evidence_outlines(df.limit(0)).count() == 0


def tri(s):
    return {s} if 0 < len(s) < 3 else {s[i : i + 3] for i in range(len(s) - 2)}


def plain(rows, max_h2, max_h3):
    out, groups = set(), {}
    for r in rows:
        if r[6] != "blocked" and r[7]:
            groups.setdefault(r[0], []).append(r)
    for g, all_ in groups.items():
        all_.sort(key=lambda r: (r[6] != "ready", -r[8], -r[9], -r[10], r[1]))
        h2 = [r for r in all_ if r[3] == 2][:max_h2]
        load = [0] * len(h2)
        out |= {(g, r[1], None) for r in h2}
        for c in (r for r in all_ if r[3] == 3):
            ranked = []
            for i, p in enumerate(h2):
                shared, a, b = len(set(c[5]) & set(p[5])), tri(c[2]), tri(p[2])
                near = len(a & b) / len(a | b) if a | b else 0
                inside = c[2] in p[2] or p[2] in c[2]
                if shared or near or inside:
                    ranked.append((-(100 * shared + 10 * near + (c[4] == p[4]) + inside), i))
            for _, i in sorted(ranked):
                if load[i] < max_h3:
                    load[i] += 1
                    out.add((g, c[1], h2[i][1]))
                    break
    return out


@pytest.mark.parametrize("seed", [2, 7])
def test_against_the_plain_walk(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice("gh"), i, "".join(rng.choices("abc", k=rng.randint(1, 6))), rng.choice([2, 3, 3, 3]), rng.choice("xy"), rng.sample("pqrst", rng.randint(0, 2)), rng.choice(["ready", "needs_review", "blocked"]), rng.random() < 0.9, float(rng.randint(0, 3)), rng.randint(0, 2), rng.randint(0, 2))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    assert {(r.group_id, r.candidate_id, r.parent_id) for r in outline.evidence_outlines(df, 5, 3).collect()} == plain(rows, 5, 3)
