from quaystone.operators.components import connected_components


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 8), (None, 5), (2, 1)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert {r.component for r in connected_components(chain, "a", "b").collect()} == {0}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
