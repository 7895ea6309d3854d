"""Hierarchies against a walk up every node, and the tours' invariants."""

import random

from quarry.operators import hierarchy as H

EDGES = "source_id long, target_id long, kind string, weight double"


def brute(pairs, ids):
    parent, nodes = {}, set()
    for kind, s, t in pairs:
        if kind is None or s is None or t is None:
            continue
        k = kind.strip().upper()
        if k not in ("CONTAINS", "INHERITS") or s not in ids or t not in ids:
            continue
        p, c = (s, t) if k == "CONTAINS" else (t, s)
        nodes |= {(k, p), (k, c)}
        parent[k, c] = min(p, parent.get((k, c), p))
    out = {}
    for k, v in nodes:
        seen, x = [], v
        while (k, x) in parent and x not in seen:
            seen.append(x)
            x = parent[k, x]
        if x in seen:
            ring = seen[seen.index(x) :]
            out[k, v] = (min(ring), -1 if v in ring else -2)
        else:
            out[k, v] = (x, len(seen))
    return out


def run(spark, pairs, ids):
    edges = spark.createDataFrame([(s, t, k, 1.0) for k, s, t in pairs], EDGES)
    nodes = spark.createDataFrame([(i, "extra") for i in ids], "id long, kind string")
    return edges, nodes


def test_forest_with_cycles_dirt_and_a_deep_chain(spark):
    rng = random.Random(3)
    pairs = []
    for i in range(2, 150):  # a bushy tree with one hot parent
        pairs.append((rng.choice(["CONTAINS", "contains", " Contains "]), 1 if rng.random() < 0.4 else rng.randrange(1, i), i))
    pairs += [("CONTAINS", i, i + 1) for i in range(200, 290)]  # deeper than the peeling
    pairs += [("INHERITS", a, b) for a, b in ((300, 301), (301, 302), (302, 300), (303, 300), (304, 303), (305, 305), (306, 305), (307, 308))]
    pairs += pairs[:20] + [("CONTAINS", 1, 9999), (None, 1, 2), ("CALLS", 1, 2), ("CONTAINS", None, 3)]
    ids = [*range(1, 320), 5, None]
    edges, nodes = run(spark, pairs, ids)
    want = brute(pairs, set(ids) - {None})
    found = H.forest(edges, nodes).toPandas()
    got = {(r.kind, r.node_id): (r.root_id, r.depth) for r in H.hierarchy(edges, nodes).collect()}
    assert got == want and len(found) == len(want)
    place = {(r.kind, r.node_id): r for r in found.itertuples()}
    for (_, _), tree in found.groupby(["kind", "tree_id"]):
        assert sorted([*tree["entry"], *tree["exit"]]) == list(range(2 * len(tree)))
    for r in found.itertuples():
        if r.parent_id == r.parent_id and not r.on_cycle:
            up = place[r.kind, int(r.parent_id)]
            assert up.entry < r.entry < r.exit < up.exit


def test_paths_and_descendants(spark):
    pairs = [("CONTAINS", 1, 2), ("CONTAINS", 2, 3), ("CONTAINS", 1, 4), ("INHERITS", 8, 9), ("INHERITS", 9, 8), ("INHERITS", 7, 8)]
    edges, nodes = run(spark, pairs, range(1, 10))
    assert {(r.kind, r.node_id): list(r.path) for r in H.paths(edges, nodes).collect()} == {
        ("CONTAINS", 1): [1], ("CONTAINS", 2): [1, 2], ("CONTAINS", 3): [1, 2, 3], ("CONTAINS", 4): [1, 4], ("INHERITS", 8): [8], ("INHERITS", 9): [9], ("INHERITS", 7): [8, 7],
    }
    counts = {(r.kind, r.node_id): r.descendants for r in H.descendant_counts(edges, nodes).collect()}
    assert counts["CONTAINS", 1] == 3 and counts["CONTAINS", 2] == 1 and counts["INHERITS", 8] == 1


def test_several_parents_take_the_smallest_and_empty_tables_give_nothing(spark):
    edges, nodes = run(spark, [("CONTAINS", 5, 2), ("CONTAINS", 3, 2), ("CONTAINS", 1, 3)], range(1, 6))
    got = {r.node_id: (r.root_id, r.depth) for r in H.hierarchy(edges, nodes).collect()}
    assert got == {1: (1, 0), 3: (1, 1), 2: (1, 2), 5: (5, 0)}
    assert H.hierarchy(edges.limit(0), nodes).count() == 0
    assert H.hierarchy(edges, nodes.limit(0)).count() == 0
