"""Descendants, neighbours and dependencies as rows, against walks over small graphs."""

import random
from collections import Counter

from quarry.operators import graph
from quarry.operators import hierarchy as H

EDGES = "source_id long, target_id long, kind string, weight double"


def test_descendants_of_trees_and_cycles(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(1, i), i) for i in range(2, 60)] + [(i, i + 1) for i in range(100, 112)]
    pairs += [(200, 201), (201, 202), (202, 200), (200, 203), (203, 204), (202, 205), (300, 300), (300, 301)]
    edges = spark.createDataFrame([(a, b, "CONTAINS", 1.0) for a, b in pairs], EDGES)
    nodes = spark.createDataFrame([(i,) for i in range(1, 320)], "id long")
    children = {}
    for a, b in pairs:
        children.setdefault(a, set()).add(b)
    want = set()
    for a in {x for p in pairs for x in p}:
        front, seen = [a], set()
        while front:
            new = children.get(front.pop(), set()) - seen
            seen |= new
            front += new
        want |= {(a, x) for x in seen - {a}}
    got = [(r.node_id, r.descendant_id) for r in H.descendants(edges, nodes).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {r.node_id: r.descendants for r in H.descendant_totals(edges, nodes).collect()}
    assert counts == {x: 0 for p in pairs for x in p} | Counter(a for a, _ in want)
    assert H.descendants(edges.limit(0), nodes).count() == 0


def test_neighbours_and_dependencies_as_rows(spark):
    edges = spark.createDataFrame([(1, 2, "CALLS", 1.0), (2, 1, "CALLS", 1.0), (1, 2, "IMPORTS", 1.0), (3, 3, "CALLS", 1.0), (3, 1, "IMPORTS", 1.0)], EDGES)
    rows = {tuple(r) for r in graph.neighbour_pairs(edges).collect()}
    assert rows == {
        (1, 2, "CALLS", True, True), (2, 1, "CALLS", True, True), (1, 2, "IMPORTS", True, False), (2, 1, "IMPORTS", False, True),
        (3, 3, "CALLS", True, True), (3, 1, "IMPORTS", True, False), (1, 3, "IMPORTS", False, True),
    }
    nodes = spark.createDataFrame([(1, "FILE"), (2, "PACKAGE"), (3, "FILE")], "id long, kind string")
    assert sorted(tuple(r) for r in graph.dependency_pairs(nodes, edges).collect()) == [(1, 2, "dependency"), (1, 3, "dependent"), (3, 1, "dependency")]
