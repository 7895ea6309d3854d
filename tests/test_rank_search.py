"""Invariants of ranking and search, and their edge cases."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import graph, metrics, rank, search, traverse

EDGES = "source_id long, target_id long, kind string, weight double"


def small(spark):
    nodes = spark.createDataFrame([(i, "FUNCTION", f"f{i}") for i in range(1, 7)], "id long, kind string, name string")
    edges = spark.createDataFrame([(1, 2, "CALLS", 1.0), (2, 3, "CALLS", 2.0), (3, 1, "CALLS", None), (4, 3, "CALLS", 1.0), (1, 3, "REFERENCES", 1.0), (5, 5, "CALLS", 1.0)], EDGES)
    return nodes, edges


def test_pagerank_keeps_its_mass_and_follows_seeds(spark):
    nodes, edges = small(spark)
    for seeds in (None, nodes.where("id = 4")):
        scores = {r.id: r.score for r in rank.pagerank(nodes, edges, seeds).collect()}
        assert abs(sum(scores.values()) - 1) < 1e-6 and len(scores) == 6
    assert scores[6] == 0 and scores[4] > 0


def test_percentiles_share_ties(spark):
    scores = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 0.5), (4, 0.7)], "id long, score double")
    nodes = spark.createDataFrame([(i, "FUNCTION") for i in range(1, 5)], "id long, kind string")
    assert {r.id: r.percentile for r in rank.percentiles(nodes, scores).collect()} == {1: 0.25, 2: 0.25, 3: 0.75, 4: 1.0}


def test_greedy_fit_skips_what_does_not_fit(spark):
    frame = spark.sql("select transform(array(6L, 7L, 3L, 1L), (c, i) -> named_struct('id', i + 1L, 'cost', c)) as items")
    assert frame.select(rank.greedy_fit(F.col("items"), 10)).first()[0] == [1, 3, 4]
    assert spark.sql("select cast(array() as array<struct<id:bigint,cost:bigint>>) as items").select(rank.greedy_fit(F.col("items"), 10)).first()[0] == []


def test_reach_is_monotone_and_bounded(spark):
    _, edges = small(spark)
    seeds = spark.createDataFrame([(1,)], "id long")
    links = traverse.steps(edges, "out")
    one = {r.id for r in traverse.reach(links, seeds, 1).collect()}
    three = {r.id: r.depth for r in traverse.reach(links, seeds, 3).collect()}
    assert one <= set(three) and three == {1: 0, 2: 1, 3: 1}
    assert traverse.reach(links, seeds.limit(0), 3).count() == 0


def test_edges_are_cleaned(spark):
    nodes, _ = small(spark)
    raw = spark.createDataFrame([(1, 2, " calls", None), (1, 2, "CALLS", 3.0), (1, 99, "CALLS", 1.0), (None, 1, "CALLS", 1.0)], EDGES)
    assert [tuple(r) for r in graph.edges_of(raw, nodes).collect()] == [(1, 2, "CALLS", 3.0)]
    counts = {(r.what, r.kind): r.n for r in metrics.counts(nodes, graph.edges_of(raw, nodes)).collect()}
    assert counts["nodes", "*"] == 6 and counts["edges", "CALLS"] == 1


def test_bm25_prefers_rare_words_and_ignores_nulls(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, "alpha delta"), (4, None), (5, "")], "doc long, text string")
    asked = spark.createDataFrame([(1, "gamma alpha"), (2, None), (3, "nothing here")], "query long, text string")
    found = search.bm25(texts, asked).collect()
    assert found[0].doc == 2 and {r.query for r in found} == {1}


def test_cosine_matches_numpy_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 8))
    data[7] = 0
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "doc long, vector array<double>")
    monkeypatch.setattr(search, "HELD", 24)
    found = search.cosine(vectors, vectors.where("doc < 8").withColumnRenamed("doc", "query"), 5)
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-10)
    for q in range(8):
        scores = np.round(unit @ unit[q], 6)
        want = sorted(range(60), key=lambda i: (-scores[i], i))[:5]
        assert [r.doc for r in found.where(f"query = {q}").orderBy("place").collect()] == want


def test_scores_that_cannot_be_best_are_dropped_and_ties_never():
    keep = search.Best(1, 2, -2.0)
    first = keep.take(0, np.array([[0.5, 0.9, 0.5, 0.1]]))
    assert first[1].tolist() == [0, 1, 2]
    assert keep.take(0, np.array([[0.4, 0.5]]))[1].tolist() == [1]


def test_word_vectors(spark):
    rows = spark.createDataFrame([(1, "loadUserName"), (2, "load_user_name x"), (3, "brew tea"), (4, None), (5, "")], "doc long, text string")
    made = {r.doc: r.vector for r in search.word_vectors(rows).collect()}
    assert made[4] is None and made[5] is None and len(made[1]) == search.DIMENSIONS and any(made[1])
    near = lambda a, b: float(np.dot(made[a], made[b]) / np.linalg.norm(made[a]) / np.linalg.norm(made[b]))
    assert near(1, 2) > near(1, 3)


def test_lookups_of_one_node(spark):
    nodes, edges = small(spark)
    ids = lambda frame: {r.id for r in frame.collect()}
    assert ids(graph.neighbours_of(nodes, edges, 3)) == {1, 2, 4} and ids(graph.neighbours_of(nodes, edges, 1, "CALLS", "outgoing")) == {2}
    assert ids(graph.neighbours_of(nodes, edges, 5)) == {5} and ids(graph.neighbours_of(nodes, edges, 99)) == set()
    assert graph.edges_between(edges, 1).count() == 2 and graph.edges_between(edges, 1, 3).count() == 1 and graph.edges_between(edges).count() == 6
    assert ids(graph.node(nodes, 4)) == {4}
