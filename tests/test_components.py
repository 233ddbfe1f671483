import random

from lexiforge.operators.components import connected_components


def test_components_equal_union_find(spark):
    random.seed(4)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7), (None, 3)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
