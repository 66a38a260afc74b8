import random

from lectern.operators.graph import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_random_graphs_chains_and_stars(spark):
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    star = [(5000, k) for k in range(5001, 5300)]
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + chain + star + [(9, 9), (7000, 7000)]
    rng.shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["id"]: r["component"] for r in got} == brute(edges)


def test_no_edges_and_nulls(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert connected_components(spark.createDataFrame([(None, 1), (2, None)], "src long, dst long")).count() == 0
