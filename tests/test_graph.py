import random

import pytest

from plumbline.operators import graph, metrics
from plumbline.schemas import EDGES, FILE_STATS, MODULES


def edges_of(spark, text, project="p"):
    """Edges written 'a>b b>c'."""
    return spark.createDataFrame([(project, *e.split(">")) for e in text.split()], EDGES)


def nodes_of(spark, edges, modules="", stats=()):
    m = spark.createDataFrame([("p", x) for x in modules.split()], MODULES)
    s = spark.createDataFrame([("p", path, float(loc), float(c), i) for i, (path, loc, c) in enumerate(stats)], FILE_STATS)
    return graph.build_nodes(m, edges, s)


CASES = {
    "chain": ("a>b b>c c>d", {"a": ("a", 1), "b": ("b", 2), "c": ("c", 3), "d": ("d", 4)}),
    "deep-flat": ("r>a r>x1 x1>x2 x2>x3 x3>x4", {"r": ("r", 1), "a": ("a", 2), "x1": ("x1", 2), "x2": ("x2", 3), "x3": ("x3", 4), "x4": ("x4", 5)}),
    "diamond": ("a>b a>c b>d c>d", {"a": ("a", 1), "b": ("b", 2), "c": ("c", 2), "d": ("d", 3)}),
    "cycle": ("a>b b>c c>a", {x: ("a", 1) for x in "abc"}),
    "two cycles": ("a>b b>a x>y y>x", {"a": ("a", 1), "b": ("a", 1), "x": ("x", 1), "y": ("x", 1)}),
    "self-loop": ("a>a", {"a": ("a", 1)}),
    "cycle and tail": ("a>b b>a b>c", {"a": ("a", 1), "b": ("a", 1), "c": ("c", 2)}),
    "mixed": ("a>b b>a c>d d>e e>f f>c", {"a": ("a", 1), "b": ("a", 1), **{x: ("c", 1) for x in "cdef"}}),
}


@pytest.mark.parametrize("limit", [10**6, 0], ids=["one task a project", "over all tasks"])
@pytest.mark.parametrize("name", ["chain", "diamond", "mixed", "cycle and tail", "self-loop"])
def test_structure(spark, name, limit):
    text, expected = CASES[name]
    got = graph.structure(edges_of(spark, text), grouped_edges=limit).collect()
    assert {r.node: (r.comp, r.depth) for r in got} == expected


@pytest.mark.parametrize("name", CASES)
def test_structure_of_each_toy_graph(spark, name):
    text, expected = CASES[name]
    assert {r.node: (r.comp, r.depth) for r in graph.grouped_structure(edges_of(spark, text)).collect()} == expected


def test_each_project_goes_its_own_way(spark):
    large, small = edges_of(spark, "a>b b>a b>c c>d", "large"), edges_of(spark, "a>b b>c", "small")
    both = large.unionByName(small)
    rows = lambda limit: sorted(map(tuple, graph.structure(both, grouped_edges=limit).collect()))
    assert rows(3) == rows(10**6) == rows(0)
    assert {tuple(r) for r in graph.depth_range(graph.structure(both, grouped_edges=3)).collect()} == {("large", 3, 3), ("small", 3, 3)}


def test_no_edges(spark):
    empty = spark.createDataFrame([], EDGES)
    assert graph.structure(empty).collect() == []
    assert graph.scc_distributed(empty).collect() == []
    nodes = nodes_of(spark, empty, "a b c")
    assert {(r.node, r.comp, r.depth) for r in graph.structure(empty, nodes).collect()} == {(x, x, 1) for x in "abc"}


def brute(pairs):
    """Components by mutual reachability, depths by relaxing as often as there are nodes."""
    nodes = {x for e in pairs for x in e}
    reach = {a: {b for x, b in pairs if x == a} for a in nodes}
    for k in nodes:
        for a in nodes:
            if k in reach[a]:
                reach[a] |= reach[k]
    comp = {a: min([a, *[b for b in reach[a] if a in reach[b]]]) for a in nodes}
    depth = dict.fromkeys(comp.values(), 1)
    for _ in nodes:
        for a, b in pairs:
            if comp[a] != comp[b]:
                depth[comp[b]] = max(depth[comp[b]], depth[comp[a]] + 1)
    return {a: (comp[a], depth[comp[a]]) for a in nodes}


def test_random_graphs_both_ways(spark):
    rnd, pairs, expected = random.Random(3), [], {}
    for p in range(12):
        n = rnd.randint(2, 12)
        own = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(rnd.randint(1, 2 * n))]
        pairs += [(f"p{p}", a, b) for a, b in own]
        expected |= {(f"p{p}", a): v for a, v in brute(own).items()}
    df = spark.createDataFrame(pairs, EDGES)
    for limit in (10**6, 0):
        assert {(r.project, r.node): (r.comp, r.depth) for r in graph.structure(df, grouped_edges=limit).collect()} == expected


def test_long_chain_needs_no_recursion():
    out = {str(i): [str(i + 1)] for i in range(20_000)} | {"20000": []}
    comp = graph.components(out)
    assert len(set(comp.values())) == 20_001
    assert max(graph.depths(out, comp).values()) == 20_001


def test_degrees_count_distinct_neighbours(spark):
    nodes = {r.node: (r.fan_in, r.fan_out) for r in nodes_of(spark, edges_of(spark, "a>b a>b a>b h>a x>h s>s")).collect()}
    assert nodes == {"a": (1, 1), "b": (1, 0), "h": (1, 1), "x": (0, 1), "s": (1, 1)}


def test_nodes_and_stats(spark):
    e = edges_of(spark, "a>c")
    got = nodes_of(spark, e, "a b", [("a", 1, 1), ("a", 10, 3), ("orphan", 99, 9)]).collect()
    assert {r.node: (r.loc, r.complexity) for r in got} == {"a": (10, 3), "b": (0, 0), "c": (0, 0)}


METRICS = [
    ("", "a", [("a", 42, 7)], (42, 1, 0, 7, 0)),
    ("h>a h>b h>c h>d", "", [], (0, 2, 0, 0, 1)),
    ("a>b b>c c>d", "", [], (0, 3.25, 0, 0, 2)),
    ("a>b b>a c>d d>c e>f f>e", "", [], (0, 1, 2, 0, 2)),
    ("a>b b>a c>d d>e e>f f>c", "", [], (0, 1, 3.5, 0, 2)),
    ("", "a b c d e", [("a", 10, 1), ("b", 20, 2), ("c", 30, 3), ("d", 40, 4), ("e", 0, 0)], (32.5, 1, 0, 3.25, 0)),
    ("", "a", [("a", 0, 0)], (0, 1, 0, 0, 0)),
    ("a>b b>c", "", [("a", 100, 5), ("b", 200, 10), ("c", 300, 15)], (250, 2.5, 0, 12.5, 1.5)),
]


@pytest.mark.parametrize("text,modules,stats,expected", METRICS)
def test_metrics(spark, text, modules, stats, expected):
    e = edges_of(spark, text)
    nodes = nodes_of(spark, e, modules, stats)
    r = metrics.compute_metrics(nodes, graph.structure(e, nodes)).first()
    assert (r.locPerModule, r.depDepth, r.circularDeps, r.complexity, r.fanInOut) == expected
