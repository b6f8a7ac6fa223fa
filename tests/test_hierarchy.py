"""Closures against breadth-first search; lookups on repeated keys."""

import random
from collections import deque

from sqlstrata.operators import relational as R


def brute(edges):
    up = {}
    for n, p in edges:
        if n is not None and p is not None:
            up.setdefault(n, set()).add(p)
    out = {}
    for n in up:
        todo, seen = deque([(n, 0)]), {}
        while todo:
            x, d = todo.popleft()
            for p in up.get(x, ()):
                if p not in seen:
                    seen[p] = d + 1
                    todo.append((p, d + 1))
        out.update({(a, n): d for a, d in seen.items()})
    return out


def closure(spark, edges, **kw):
    df = spark.createDataFrame(edges, "node long, parent long").repartition(3)
    return R.hierarchy_closure(df, **kw).collect()


def test_closure_of_graphs_with_cycles(spark):
    r = random.Random(3)
    edges = [(i, r.randrange(40)) for i in range(40) for _ in range(r.choice([0, 1, 1, 2]))]
    edges += [(50, None), (None, 3), (51, 50), (51, 50), (60, 60), (70, 71), (71, 72), (72, 70)]
    got = closure(spark, edges, with_path=True)
    want = brute(edges)
    assert {(x.ancestor, x.descendant): x.distance for x in got} == want and len(got) == len(want)
    have = {(n, p) for n, p in edges}
    for x in got:
        assert x.cycle == (x.ancestor == x.descendant)
        assert len(x.path) == x.distance + 1 and x.path[0] == x.ancestor and x.path[-1] == x.descendant
        assert all((low, high) in have for high, low in zip(x.path, x.path[1:]))


def test_closure_of_a_thousand_levels(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1000)], "node long, parent long")
    c = R.hierarchy_closure(df)
    assert c.count() == 999 * 1000 // 2
    assert c.filter("distance <> descendant - ancestor or cycle").count() == 0


def test_closure_of_nothing(spark):
    assert closure(spark, []) == [] and closure(spark, [(1, None)]) == []


def test_lookup_of_repeated_keys_is_defined(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (1, "w")], "k int, v string")
    dim = spark.createDataFrame([(1, "b", 1), (1, "a", 9), (2, None, 3), (2, "c", 4), (None, "n", 0)], "k int, name string, rank int").repartition(4)
    for _ in range(3):
        got = sorted(map(tuple, R.lookup_join(left, dim.repartition(3, "name"), ["k"], ["name", "rank"]).collect()))
        assert got == [(1, "w", "a", 9), (1, "x", "a", 9), (2, "y", None, 3), (3, "z", None, None)]
