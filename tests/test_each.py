"""Traversals from each seed on its own, against a breadth-first walk from every seed."""

import random

from quarry.operators import context, traverse

EDGES = "source_id long, target_id long, kind string, weight double"


def walk(links, seed, hops, later=None):
    depth, front = {seed: 0}, {seed}
    for hop in range(1, hops + 1):
        front = {b for a, b, k in links if a in front and b not in depth and (hop == 1 or later is None or k in later)}
        depth |= dict.fromkeys(front, hop)
    return depth


def graph(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(60), rng.randrange(60), rng.choice(["CALLS", "CALLS", "CONTAINS", "IMPORTS"])) for _ in range(120)}
    pairs |= {(i, 7, "CALLS") for i in range(20, 60)}  # a hub
    return pairs, spark.createDataFrame([(*p, 1.0) for p in sorted(pairs)], EDGES)


def got(frame):
    out = [tuple(r) for r in frame.select("seed", "id", "depth").collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_each_seed_has_its_own_answer(spark, monkeypatch):
    monkeypatch.setattr(traverse, "HUB", 10)  # the hub is salted
    pairs, edges = graph(spark)
    asked = [0, 7, 20, 33, 33, 59, 999]
    seeds = spark.createDataFrame([(i,) for i in asked], "id long")
    both = pairs | {(b, a, k) for a, b, k in pairs}
    assert got(traverse.ego_each(edges, seeds)) == {(s, i, d) for s in asked for i, d in walk(both, s, 2).items()}
    calls = {x for x in both if x[2] == "CALLS"}
    layers = traverse.flow_layers(edges, seeds, each=True)
    flows = {s: walk(calls, s, 4) for s in asked}
    assert got(layers) == {(s, i, d) for s in asked for i, d in flows[s].items()}
    want = {(s, a, b, k, min(f[a], f[b])) for s, f in flows.items() for a, b, k in pairs if a in f and b in f and abs(f[a] - f[b]) == 1}
    assert {tuple(r) for r in traverse.flow_edges(edges, layers).collect()} == want
    nodes = spark.createDataFrame([(i, "FILE" if i % 9 == 4 else "FUNCTION") for i in range(60)], "id long, kind string")
    inner = {x for x in pairs if x[1] % 9 != 4}
    forth = got(traverse.sliced(nodes, edges, seeds, backward=False, each=True))
    assert forth == {(s, i, d) for s in asked for i, d in walk(inner, s, 4, traverse.FORWARD).items()}
    back = {(b, a, k) for a, b, k in pairs if a % 9 != 4}
    assert got(traverse.sliced(nodes, edges, seeds, each=True)) == {(s, i, d) for s in asked for i, d in walk(back, s, 4, traverse.BACKWARD).items()}
    assert traverse.ego_each(edges, seeds.limit(0)).count() == 0


def hubs(spark):
    """Three hubs, two of them next to each other and one apart, with chains on their leaves."""
    pairs = {(1, i) for i in range(100, 160)} | {(2, i) for i in range(150, 200)} | {(3, i) for i in range(300, 340)} | {(1, 2), (1, 1)}
    pairs |= {(i, i + 1) for i in range(100, 110)} | {(i + 1000 * j, i + 1000 * (j + 1)) for i in (100, 101, 190, 300) for j in range(5)} | {(400, 401), (401, 402)}
    kinds = ["CALLS", "CALLS", "CALLS", "IMPORTS"]
    pairs = {(a, b, kinds[(a * 7 + b) % 4]) for a, b in pairs} | {(110, 310, "IMPORTS"), (150, 151, "IMPORTS"), (1100, 2190, "CONTAINS")}
    return pairs, spark.createDataFrame([(*p, 1.0) for p in sorted(pairs)], EDGES)


def rows_cut(monkeypatch):
    """The rows of every table that is written to disk during a traversal."""
    taken, cut = [], traverse.cut

    def counted(df, **settings):
        out = cut(df, **settings)
        taken.append(out.count())
        return out

    monkeypatch.setattr(traverse, "cut", counted)
    return taken


def test_neighbours_of_hubs_for_each_centre(spark, monkeypatch):
    monkeypatch.setattr(traverse, "HUB", 10)
    monkeypatch.setattr(traverse, "SEEDS", 7)
    pairs, edges = hubs(spark)
    both = pairs | {(b, a, k) for a, b, k in pairs}
    asked = [1, 2, 3, 100, 101, 105, 155, 190, 300, 1100, 2190, 5300, 339, 400, 999]
    seeds = spark.createDataFrame([(i,) for i in asked], "id long")
    for hops in (1, 2, 3, 4):
        assert got(traverse.ego_each(edges, seeds, hops)) == {(s, i, d) for s in asked for i, d in walk(both, s, hops).items()}


def test_answers_of_each_centre_are_not_written_in_between(spark, monkeypatch):
    monkeypatch.setattr(traverse, "HUB", 50)
    edges = spark.createDataFrame([(0, i, "CALLS", 1.0) for i in range(1, 401)], EDGES)
    taken = rows_cut(monkeypatch)
    seeds = spark.range(1, 201).select("id")
    assert traverse.ego_each(edges, seeds).count() == 200 * 401
    assert sum(taken) < 20_000  # before, more than the answer


def test_layers_of_each_seed_are_not_written_in_between(spark, monkeypatch):
    monkeypatch.setattr(traverse, "HUB", 10)
    pairs, edges = hubs(spark)
    calls = {x for x in pairs | {(b, a, k) for a, b, k in pairs} if x[2] == "CALLS"}
    asked = [1, 3, 100, 101, 155, 190, 300, 1100, 5300, 339, 400, 999]
    seeds = spark.createDataFrame([(i,) for i in asked], "id long")
    assert got(traverse.flow_layers(edges, seeds, each=True)) == {(s, i, d) for s in asked for i, d in walk(calls, s, 4).items()}
    edges = spark.createDataFrame([(0, i, "CALLS", 1.0) for i in range(1, 401)], EDGES)
    taken = rows_cut(monkeypatch)
    assert traverse.flow_layers(edges, spark.range(1, 201).select("id"), each=True).count() == 200 * 401
    assert sum(taken) < 30_000  # before, more than the answer


def test_flow_edges_of_each_seed_are_not_written_in_between(spark, monkeypatch):
    monkeypatch.setattr(traverse, "HUB", 10)
    pairs, edges = hubs(spark)
    calls = {x for x in pairs | {(b, a, k) for a, b, k in pairs} if x[2] == "CALLS"}
    asked = [1, 3, 100, 101, 155, 190, 300, 1100, 5300, 339, 400, 999]
    seeds = spark.createDataFrame([(i,) for i in asked], "id long")
    flows = {s: walk(calls, s, 4) for s in asked}
    want = {(s, a, b, k, min(f[a], f[b])) for s, f in flows.items() for a, b, k in pairs if a in f and b in f and abs(f[a] - f[b]) == 1}
    out = [tuple(r) for r in traverse.flow_edges_each(edges, seeds).collect()]
    assert len(out) == len(want) and set(out) == want
    edges = spark.createDataFrame([(0, i, "CALLS", 1.0) for i in range(1, 401)], EDGES)
    taken = rows_cut(monkeypatch)
    assert traverse.flow_edges_each(edges, spark.range(1, 201).select("id")).count() == 200 * 400
    assert sum(taken) < 40_000  # half the answer


def test_seeds_are_not_written_for_each_part_of_the_edges(spark, monkeypatch):
    monkeypatch.setattr(traverse, "HUB", 5)  # 80 parts
    monkeypatch.setattr(traverse, "SEEDS", 20)
    pairs = {(0, i, "CALLS") for i in range(1, 401)} | {(5, 6, "CALLS"), (5, 6, "IMPORTS"), (6, 7, "CONTAINS")}
    flows = {s: walk({x for x in pairs | {(b, a, k) for a, b, k in pairs} if x[2] == "CALLS"}, s, 4) for s in range(1, 201)}
    want = {(s, a, b, k, min(f[a], f[b])) for s, f in flows.items() for a, b, k in pairs if abs(f[a] - f[b]) == 1}
    taken = rows_cut(monkeypatch)
    frame = traverse.flow_edges_each(spark.createDataFrame([(*p, 1.0) for p in sorted(pairs)], EDGES), spark.range(1, 201).select("id"))
    written = sum(taken)
    out = [tuple(r) for r in frame.collect()]
    assert len(out) == len(want) and set(out) == want
    assert written < 12_000  # before, the seeds times the parts as well


def test_lines_and_cuts_of_each_slice(spark, make_nodes):
    nodes = make_nodes([{"id": i, "repo": "r", "file_path": "a.py", "start_line": 10 * i, "full_body": "x\ny" * i} for i in (1, 2)])
    found = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 2, 0)], "seed long, id long, depth int")
    lines = traverse.slice_lines(nodes, found)
    assert sorted((r.seed, r.line) for r in lines.collect()) == [(1, 10), (1, 11), (1, 20), (1, 21), (1, 22), (2, 20), (2, 21), (2, 22)]
    assert sorted((r.seed, r.kept) for r in context.cut_slices(lines).collect()) == [(1, 5), (2, 3)]
