"""Components against union by hand."""

import random

from listings_spark.llm.components import components


def test_random_chains_and_hubs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    wanted = {(x, find(x)) for x in root if find(x) != x}
    df = spark.createDataFrame([*edges, (None, 4), (5, None), (6, 6)], "a long, b long")
    assert {tuple(r) for r in components(df).collect()} == wanted


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
