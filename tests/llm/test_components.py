import random

from watchloom.llm.components import components


def plain(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(parent)}


def check(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for e in [plain([x for x in edges if x[0] != x[1]])] for k, v in e.items()}


def test_chain_and_random(spark):
    r = random.Random(1)
    chain = [(k, k + 1) for k in range(40)]
    r.shuffle(chain)
    check(spark, chain + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(50)])


def test_no_edges_and_loops(spark):
    check(spark, [(1, 1)])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
