import random

from tidepool.llm import shared


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5000, 5001 + i) for i in range(300)] + [(rng.randint(-400, -1), rng.randint(-400, -1)) for _ in range(250)] + [(7, 7)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clear(spark):
    mark = shared.made()
    a, b = shared.written(spark.range(5), "a"), shared.written(spark.range(6), "b")
    assert shared.made() == mark + 2
    shared.clear(mark, but=b)
    assert shared.made() == mark + 1 and b.count() == 6
    shared.dropped(b)
    assert shared.made() == mark
