"""Traversals: breadth-first from a set of nodes, slices, impact and flow."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import CALLABLE, SYMBOLS
from quarry.runtime import cut

# Edges that a slice follows beyond its first hop, and hops of slices and flows.
BACKWARD, FORWARD = ("CALLS", "REFERENCES", "CONTAINS"), ("CALLS", "CALLED_BY", "DEF_USE", "REFERENCES")
SLICE_HOPS, FLOW_HOPS = 4, 4
# Links of one node that are joined in one part; a node with more is split by salt.
HUB = 5000
# Seeds in one list, of which each row of a part makes its answers, and rows that a task should give.
SEEDS, TASK_ROWS = 2000, 4_000_000


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(id, other, kind) along, against or both ways."""
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "kind")
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "kind")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def reach(links: DataFrame, seeds: DataFrame, hops: int, allowed: Callable[[int], F.Column | None] = lambda hop: None) -> DataFrame:
    """(id, depth) of every node within ``hops`` of the nearest seed. The frontier is a table; a
    hop joins it with the links, drops what was seen, and is cut, so the plan stays short. The
    work is that of the edges met, since each node enters the frontier once."""
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for hop in range(1, hops + 1):
        rule = allowed(hop)
        usable = links if rule is None else links.where(rule)
        found = front.select("id").join(usable, "id").select(F.col("other").alias("id")).distinct()
        front = cut(found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(hop)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def reach_each(links: DataFrame, seeds: DataFrame, hops: int, allowed: Callable[[int], F.Column | None] = lambda hop: None) -> DataFrame:
    """(seed, id, depth) of every node within ``hops`` of each seed: as many searches as seeds, side
    by side. Frontier and seen are keyed by (seed, id), so the rows are those of all answers
    together; where many seeds are near a hub, each has the hub's neighbours in its own answer."""
    hubs = cut(links.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("id", F.ceil(F.col("n") / HUB).alias("ways")))
    ways = F.coalesce("ways", F.lit(1))
    spread = cut(links.join(F.broadcast(hubs), "id", "left").select(*links.columns, F.pmod(F.xxhash64("other"), ways).alias("salt")), packed=True)  # at most links / HUB rows are broadcast
    seen = front = cut(seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("depth", F.lit(0)))
    for hop in range(1, hops + 1):
        rule = allowed(hop)
        usable = spread if rule is None else spread.where(rule)
        salted = front.join(F.broadcast(hubs), "id", "left").select("seed", "id", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)).alias("salt"))
        found = salted.join(usable, ["id", "salt"]).select("seed", F.col("other").alias("id")).distinct()
        front = cut(found.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # a few checkpoints side by side, none written again
    return seen


def ego(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(id, depth) around a set of nodes, over edges of any kind both ways."""
    return reach(cut(steps(edges, "both")), seeds, hops)


class Balls(NamedTuple):
    """What each seed reaches over links both ways, without a row for each of its nodes.

    A shortest path avoids all hubs or goes through one, so a depth is the lesser of the one without
    hubs and the least sum of both distances to a hub. Nodes with the same distances to the same hubs
    are a class: of those a depth is that of two classes. ``close`` has the rows that are nearer
    without hubs, which are few where hubs are near."""

    close: DataFrame  #: (seed, id, depth) that the hubs don't give
    asked: DataFrame | None  #: (seed, from): class of each seed that has one; None where no node is a hub
    near: DataFrame | None  #: (from, klass, depth) of classes
    members: DataFrame | None  #: (id, klass, nearer) of nodes that have a class or are close to seeds; nearer: those (seed, depth), or null


def balls(links: DataFrame, seeds: DataFrame, hops: int) -> Balls:
    """The ``hops`` around each seed over links that go both ways. Hubs are at most links / HUB; the
    distances to each are a search of its own."""
    links = cut(links.select("id", "other").distinct(), packed=True)
    hubs = cut(links.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("id"))
    seeds = seeds.select("id").distinct()
    if hubs.isEmpty():
        return Balls(reach_each(links, seeds, hops), None, None, None)
    label = reach_each(links, hubs, hops).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("seed").alias("hub"), "depth"))).alias("hubs"))
    label = cut(label.select("id", F.md5(F.to_json("hubs").cast("binary")).alias("klass"), "hubs"), packed=True)
    members = label.select("id", "klass")
    asked = cut(members.join(seeds, "id").select(F.col("id").alias("seed"), F.col("klass").alias("from")))
    far = cut(label.groupBy("klass").agg(F.first("hubs").alias("hubs")).select("klass", F.inline("hubs")))
    start = far.join(asked.select(F.col("from").alias("klass")).distinct(), "klass").select(F.col("klass").alias("from"), "hub", F.col("depth").alias("before"))
    through = start.join(far, "hub").where(F.col("before") + F.col("depth") <= hops)
    near = cut(through.groupBy("from", "klass").agg(F.min(F.col("before") + F.col("depth")).alias("depth")))
    few = F.broadcast(hubs)  # at most links / HUB rows are broadcast
    inner = links.join(few, "id", "left_anti").join(few.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "other")
    alone = reach_each(inner, seeds.join(few, "id", "left_anti"), hops)
    known = alone.join(asked, "seed", "left").join(members, "id", "left").join(near.withColumnRenamed("depth", "via"), ["from", "klass"], "left")
    close = cut(known.where("via is null or depth < via").select("seed", "id", "depth"))
    nearer = close.groupBy("id").agg(F.collect_list(F.struct("seed", "depth")).alias("nearer"))
    return Balls(close, asked, near, cut(members.join(nearer, "id", "full"), packed=True))


def answers(asked: DataFrame, cells: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """For each seed (seed, from) and each cell of (from, cell, ...) all ``items`` (cell, but, ...) in it
    whose ``but``, a list of seeds or null, lacks the seed. Cells are cut into parts by the items' columns
    ``by``. What is exchanged is each item once, and for each part the seeds of its cell in lists; the
    rows of the answer arise in the tasks that return them, those of one item together."""
    sizes = cut(items.groupBy("cell").agg(F.count("*").alias("n")).withColumn("ways", F.ceil(F.col("n") / HUB)))
    turns = max(1, -(-asked.count() // SEEDS))
    many = F.broadcast(sizes.where("ways > 1").select("cell", "ways"))  # at most items / HUB rows are broadcast
    items = items.join(many, "cell", "left").withColumn("part", F.pmod(F.xxhash64(*by), F.coalesce("ways", F.lit(1)))).drop("ways")
    same = [c for c in cells.columns if c != "from"]
    lists = asked.join(cells, "from").groupBy(*same, F.pmod(F.xxhash64("seed"), F.lit(turns)).alias("turn")).agg(F.sort_array(F.collect_list("seed")).alias("seeds"))
    lists = cut(lists.drop("turn"))
    rows, parts = lists.join(sizes, "cell").agg(F.sum(F.size("seeds") * F.col("n")), F.sum("ways")).first()
    tasks = max(2 * asked.sparkSession.sparkContext.defaultParallelism, min((rows or 0) // TASK_ROWS, parts or 0))  # numbered parts, since AQE would judge them by what they read
    lists = lists.join(sizes.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)).alias("part")), "cell")
    every = items.repartition(tasks, "cell", "part").join(lists.repartition(tasks, "cell", "part").hint("shuffle_hash"), ["cell", "part"])
    left = F.when(F.col("but").isNull(), F.col("seeds")).otherwise(F.array_except("seeds", "but"))
    return every.withColumn("seed", F.explode(left)).drop("cell", "part", "seeds", "but")


def each_of(found: Balls) -> DataFrame:
    """(seed, id, depth) of every node that each seed reaches."""
    if found.members is None:
        return found.close
    cells = found.near.withColumnRenamed("klass", "cell")
    items = found.members.where("klass is not null").select("id", F.col("klass").alias("cell"), F.col("nearer.seed").alias("but"))
    return found.close.unionByName(answers(found.asked, cells, items, ["id"]).select("seed", "id", "depth"))


def ego_each(edges: DataFrame, centres: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, id, depth): the ego graph of each centre on its own. The neighbours of a hub are in the
    answer of every centre next to it; they are exchanged once."""
    return each_of(balls(steps(edges, "both"), centres, hops))


def sliced(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, backward: bool = True, each: bool = False) -> DataFrame:
    """(id, depth) of a program slice from a set of symbols: any edge on the first hop, then calls,
    references and (backward) containment, up to four hops; files are never entered. With ``each``
    (seed, id, depth), a slice of every symbol on its own."""
    kinds = BACKWARD if backward else FORWARD
    inside = nodes.where("kind <> 'FILE'").select(F.col("id").alias("other"))
    links = cut(steps(edges, "in" if backward else "out").join(inside, "other", "left_semi"))
    return (reach_each if each else reach)(links, seeds, SLICE_HOPS, lambda hop: None if hop == 1 else F.col("kind").isin(*kinds))


def slice_lines(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, file_path, line, text) of a slice: the lines of its nodes' bodies, each line of a
    file once, from the node nearest to the seeds. Bodies may be of any length. Slices with a seed
    give (seed, repo, file_path, line, text), each its own lines."""
    keys = ["seed"] * ("seed" in found.columns) + ["repo", "file_path"]
    parts = found.join(nodes.where("full_body is not null and start_line is not null").select("id", "repo", "file_path", "start_line", "full_body"), "id")
    lines = parts.select(*keys, "depth", "id", "start_line", F.posexplode(F.split("full_body", "\n", -1)).alias("at", "text")).withColumn("line", F.col("start_line") + F.col("at"))
    return lines.groupBy(*keys, "line").agg(F.min(F.struct("depth", "id", "text")).alias("first")).select(*keys, "line", F.col("first.text").alias("text"))


def changed_symbols(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Functions, classes and methods of the changed files (repo, file_path); where the files come with
    line ranges (first_line, last_line), those that such a range touches."""
    symbols = nodes.where(F.col("kind").isin(*SYMBOLS))
    if "first_line" not in changed.columns:
        return symbols.join(changed, ["repo", "file_path"], "left_semi")
    a, b = symbols.alias("a"), changed.alias("b")
    same = (F.col("a.repo") == F.col("b.repo")) & (F.col("a.file_path") == F.col("b.file_path"))
    return a.join(b, same & (F.col("a.start_line") <= F.col("b.last_line")) & (F.col("a.end_line") >= F.col("b.first_line")), "left_semi")


def impacted(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, depth) of the transitive callers, up to four hops, of what changed files hold; depth 0
    are the changed symbols themselves."""
    return reach(cut(steps(edges.where("kind = 'CALLS'"), "in")), changed_symbols(nodes, changed), SLICE_HOPS)


def importing_files(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(repo, file_path) of files that import a changed file and have not changed."""
    files = nodes.where("kind = 'FILE'").select("id", "repo", "file_path")
    hit = files.join(changed, ["repo", "file_path"], "left_semi").select(F.col("id").alias("target_id"))
    sources = edges.where("kind = 'IMPORTS'").join(hit, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    return files.join(sources, "id", "left_semi").select("repo", "file_path").join(changed, ["repo", "file_path"], "left_anti").distinct()


def delta_callers(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes outside the changed files that call a function, method or chunk with the name of a
    changed symbol."""
    names = changed_symbols(nodes, changed).select("name").distinct()
    targets = nodes.where(F.col("kind").isin(*CALLABLE)).join(names, "name", "left_semi").select(F.col("id").alias("target_id"))
    calling = edges.where("kind = 'CALLS'").join(targets, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    return nodes.join(calling, "id", "left_semi").join(changed, ["repo", "file_path"], "left_anti")


def flow_layers(edges: DataFrame, seeds: DataFrame, each: bool = False) -> DataFrame:
    """(id, depth) over calls both ways, up to four layers; with ``each`` (seed, id, depth), where what
    a hub calls is in the answer of every seed near it and is exchanged once."""
    calls = steps(edges.where("kind = 'CALLS'"), "both")
    return each_of(balls(calls, seeds, FLOW_HOPS)) if each else reach(cut(calls), seeds, FLOW_HOPS)


def flow_edges(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(source_id, target_id, kind, layer): edges of any kind between consecutive layers; layers
    with a seed give (seed, source_id, target_id, kind, layer)."""
    seed = ["seed"] * ("seed" in layers.columns)
    a = layers.select(*seed, F.col("id").alias("source_id"), F.col("depth").alias("from_layer"))
    b = layers.select(*seed, F.col("id").alias("target_id"), F.col("depth").alias("to_layer"))
    joined = edges.join(a, "source_id").join(b, [*seed, "target_id"]).where(F.abs(F.col("from_layer") - F.col("to_layer")) == 1)
    return joined.select(*seed, "source_id", "target_id", "kind", F.least("from_layer", "to_layer").alias("layer"))


def flow_edges_each(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, source_id, target_id, kind, layer): the edges of any kind between consecutive layers of
    each seed. Edges between nodes of the same two classes have the same layer; only those at a node
    that is nearer without hubs are looked at for each seed."""
    edges = cut(edges.select("source_id", "target_id", "kind"), packed=True)
    found = balls(steps(edges.where("kind = 'CALLS'"), "both"), seeds, FLOW_HOPS)
    if found.members is None:
        return flow_edges(edges, found.close)
    close, near, side = found.close, found.near, found.members
    ends = edges.join(side.toDF("source_id", "a", "near_a"), "source_id", "left").join(side.toDF("target_id", "b", "near_b"), "target_id", "left")
    ends = cut(ends.where("a is not null and b is not null or near_a is not null or near_b is not null"), packed=True)
    step = F.abs(F.col("from_layer") - F.col("to_layer")) == 1
    of_a, of_b = near.toDF("from", "a", "from_layer"), near.toDF("from", "b", "to_layer")
    cells = ends.select("a", "b").distinct().join(of_a, "a").join(of_b, ["from", "b"]).where(step)
    cells = cut(cells.select("from", "a", "b", F.least("from_layer", "to_layer").alias("layer")), packed=True)
    cell = F.concat("a", "b").alias("cell")
    whole = ends.join(cells.select("a", "b").distinct(), ["a", "b"], "left_semi")
    but = F.coalesce(F.array_union("near_a.seed", "near_b.seed"), "near_a.seed", "near_b.seed").alias("but")
    whole = whole.select("source_id", "target_id", "kind", cell, but)

    met = ["source_id", "target_id", "kind", "a", "b"]
    ahead = ends.select(*met, F.inline("near_a").alias("seed", "x")).join(close.toDF("seed", "target_id", "y"), ["seed", "target_id"], "left")
    behind = ends.select(*met, F.inline("near_b").alias("seed", "y")).join(close.toDF("seed", "source_id", "x"), ["seed", "source_id"], "left").where("x is null")
    sided = ahead.unionByName(behind).join(found.asked, "seed", "left")
    sided = sided.join(of_a, ["from", "a"], "left").join(of_b, ["from", "b"], "left").withColumn("from_layer", F.coalesce("x", "from_layer")).withColumn("to_layer", F.coalesce("y", "to_layer"))
    columns = ["seed", "source_id", "target_id", "kind", "layer"]
    apart = sided.where(step).withColumn("layer", F.least("from_layer", "to_layer")).select(*columns)
    return apart.unionByName(answers(found.asked, cells.select("from", cell, "layer"), whole, ["source_id", "target_id"]).select(*columns))


def first_of(frame: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key in an order."""
    return frame.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
