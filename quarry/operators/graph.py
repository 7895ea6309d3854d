"""The code graph as DataFrames: canonical tables, lookups by column and one-hop joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import filled, folder, tokens

SYMBOLS = ("FUNCTION", "CLASS", "METHOD")
CALLABLE = ("FUNCTION", "METHOD", "CHUNK")
NODE_COLUMNS = (
    "id", "kind", "name", "repo", "file_path", "start_line", "end_line", "signature", "skeleton", "full_body", "docstring", "enclosing_scope",
    "token_count_skeleton", "token_count_full",
)


def nodes_of(raw: DataFrame, *columns: str) -> DataFrame:
    """Each node once. Rows with the same id are taken to be the same; only the columns that are
    needed are read and shuffled. Null ids are left out."""
    return raw.where("id is not null").select(*(columns or NODE_COLUMNS)).dropDuplicates(["id"])


def edges_of(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, kind, weight) with clean kinds, both ends among the nodes, each edge
    once with its greatest weight (1 where none is known)."""
    ids = nodes.select(F.col("id")).where("id is not null").distinct()
    clean = raw.select("source_id", "target_id", F.upper(F.trim("kind")).alias("kind"), "weight").groupBy("source_id", "target_id", "kind").agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("weight"))
    return clean.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "kind", "weight")


def upserted(raw: DataFrame) -> DataFrame:
    """Edges keyed on (source, target, kind), of several the one with the greatest weight."""
    return raw.where("source_id is not null and target_id is not null").groupBy("source_id", "target_id", F.upper(F.trim("kind")).alias("kind")).agg(F.max("weight").alias("weight"))


def skeleton_tokens() -> F.Column:
    """Recorded tokens of the skeleton, or the estimate where none are recorded."""
    known = F.when(F.col("token_count_skeleton") > 0, F.col("token_count_skeleton"))
    return F.coalesce(known.cast("long"), tokens(filled("skeleton", "name")), F.lit(1).cast("long"))


def full_tokens() -> F.Column:
    """Recorded tokens of the body, or the estimate where none are recorded."""
    known = F.when(F.col("token_count_full") > 0, F.col("token_count_full"))
    return F.coalesce(known.cast("long"), tokens(filled("full_body", "name")), F.lit(1).cast("long"))


def kind_rank() -> F.Column:
    """Order in which kinds are tried for a name."""
    return F.when(F.col("kind") == "FUNCTION", 0).when(F.col("kind") == "CLASS", 1).when(F.col("kind") == "METHOD", 2).otherwise(3)


def node(nodes: DataFrame, key: int) -> DataFrame:
    """The node of an id, or none."""
    return nodes.where(F.col("id") == key)


def edges_between(edges: DataFrame, source: int | None = None, target: int | None = None) -> DataFrame:
    """Edges that leave one node, reach one, or both; all where neither is given."""
    out = edges if source is None else edges.where(F.col("source_id") == source)
    return out if target is None else out.where(F.col("target_id") == target)


def neighbours_of(nodes: DataFrame, edges: DataFrame, key: int, kind: str | None = None, direction: str = "both") -> DataFrame:
    """The distinct nodes next to one node over edges of a kind or of any, ``outgoing``, ``incoming`` or
    both ways. A node that points to itself is its own neighbour; an unknown id has none."""
    usable = edges if kind is None else edges.where(F.col("kind") == kind)
    ways = {"outgoing": [("source_id", "target_id")], "incoming": [("target_id", "source_id")]}.get(direction, [("source_id", "target_id"), ("target_id", "source_id")])
    ids = reduce(DataFrame.unionByName, [usable.where(F.col(a) == key).select(F.col(b).alias("id")) for a, b in ways]).distinct()
    return nodes.join(ids, "id", "left_semi")


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, outgoing, incoming, neighbours): distinct nodes over edges of any kind, each way and
    both ways; a node that points to itself is its own neighbour."""
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    pairs = out.unionByName(back).groupBy("id", "other").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    return pairs.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.count("*").alias("neighbours"))


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """(id, other, kind, outgoing, incoming): the neighbours themselves, one row for each kind of
    edge that leads to (outgoing) or comes from them (incoming). Distinct ``other`` over any choice
    of kinds and ways are a node's neighbours; one that points to itself is its own."""
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "kind", F.lit(True).alias("o"), F.lit(False).alias("i"))
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "kind", F.lit(False).alias("o"), F.lit(True).alias("i"))
    return out.unionByName(back).groupBy("id", "other", "kind").agg(F.max("o").alias("outgoing"), F.max("i").alias("incoming"))


def resolved_symbols(nodes: DataFrame) -> DataFrame:
    """(name, id, kind) that a bare name stands for: functions before classes before methods, then
    the smallest id. Aggregation rather than a window, so a common name is combined map-side."""
    best = F.min(F.struct(kind_rank().alias("rank"), F.col("id"), F.col("kind"))).alias("best")
    return nodes.where(F.col("kind").isin(*SYMBOLS) & F.col("name").isNotNull()).groupBy("name").agg(best).select("name", F.col("best.id").alias("id"), F.col("best.kind").alias("kind"))


def nodes_at(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id) for targets (target, repo, file_path, line): the symbol of the file around the
    line that begins nearest to it, else the nearest symbol of the file. Ties go by kind, then id."""
    found = targets.join(nodes.where(F.col("kind").isin(*SYMBOLS, "CHUNK")).select("repo", "file_path", "id", "kind", "start_line", "end_line"), ["repo", "file_path"])
    around = F.col("line").between(F.col("start_line"), F.col("end_line"))
    rank = F.struct((~around).alias("outside"), F.abs(F.col("start_line") - F.col("line")).alias("far"), kind_rank().alias("kind_rank"), F.col("id"))
    return found.where(around | (F.col("kind") != "CHUNK")).where("start_line is not null").groupBy("target").agg(F.min(rank).alias("best")).select("target", F.col("best.id").alias("id"))


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, caller_id): distinct callers of every function, method or chunk of a name."""
    called = nodes.where(F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("target_id"), "name")
    return edges.where("kind = 'CALLS'").join(called, "target_id").select("name", F.col("source_id").alias("caller_id")).distinct()


def callees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, callee_id): distinct callees of every function, method or chunk of a name."""
    calling = nodes.where(F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("source_id"), "name")
    return edges.where("kind = 'CALLS'").join(calling, "source_id").select("name", F.col("target_id").alias("callee_id")).distinct()


def file_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, dependencies, dependents): files that a file imports and that import it."""
    links = edges.where("kind = 'IMPORTS'")
    out = links.groupBy(F.col("source_id").alias("id")).agg(F.countDistinct("target_id").alias("dependencies"))
    back = links.groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("dependents"))
    files = nodes.where("kind = 'FILE'").select("id")
    return files.join(out, "id", "left").join(back, "id", "left").select("id", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), F.coalesce("dependents", F.lit(0)).alias("dependents"))


def dependency_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, other, way): what each file imports (way ``dependency``) and what imports it (way
    ``dependent``), each once."""
    links = edges.where("kind = 'IMPORTS'").select("source_id", "target_id").distinct()
    out = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit("dependency").alias("way"))
    back = links.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), F.lit("dependent").alias("way"))
    return out.unionByName(back).join(nodes.where("kind = 'FILE'").select("id"), "id", "left_semi")


def class_hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, bases, subclasses): names one INHERITS edge up and down, sorted and joined."""
    links = edges.where("kind = 'INHERITS'")
    names = nodes.select("id", "name")
    up = links.join(names.withColumnsRenamed({"id": "target_id", "name": "other"}), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("bases"))
    down = links.join(names.withColumnsRenamed({"id": "source_id", "name": "other"}), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("subclasses"))
    return nodes.where("kind = 'CLASS'").select("id").join(up, "id", "left").join(down, "id", "left").select("id", F.coalesce("bases", F.lit("")).alias("bases"), F.coalesce("subclasses", F.lit("")).alias("subclasses"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree); edges of different kinds each count."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    sums = ends.groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def cluster_name(path: F.Column, top: str = "core") -> F.Column:
    """Last folder of a path, or ``top`` for files in none."""
    place = folder(path)
    return F.when(place == ".", F.lit(top)).otherwise(F.element_at(F.split(place, "/"), -1))


def clusters(nodes: DataFrame) -> DataFrame:
    """(cluster, cluster_id, member_count, top_symbols, lead_files): nodes grouped by their last
    folder; at most six class and function names in id order and four files, sorted."""
    members = nodes.where(F.col("kind").isin("FILE", *SYMBOLS, "CHUNK") & F.col("file_path").isNotNull()).withColumn("cluster", cluster_name(F.col("file_path"), "root"))
    firsts = Window.partitionBy("cluster").orderBy("id")
    named = members.where(F.col("kind").isin("CLASS", "FUNCTION")).withColumn("n", F.row_number().over(firsts)).where("n <= 6")
    tops = named.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ",").alias("top_symbols"))
    paths = members.select("cluster", "file_path").distinct().withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy("file_path"))).where("n <= 4")
    leads = paths.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ",").alias("lead_files"))
    counts = members.groupBy("cluster").agg(F.count("*").alias("member_count"))
    # Names are numbered within their first two letters, after all names with smaller ones.
    letters = counts.select("cluster", F.substring("cluster", 1, 2).alias("letters"))
    before = F.sum("n").over(Window.orderBy("letters").rowsBetween(Window.unboundedPreceding, -1))  # one row for two letters
    starts = letters.groupBy("letters").agg(F.count("*").alias("n")).select("letters", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("letters").orderBy("cluster"))
    ids = letters.withColumn("place", place).join(starts, "letters").select("cluster", (F.col("start") + F.col("place")).cast("long").alias("cluster_id"))
    return counts.join(ids, "cluster").join(tops, "cluster", "left").join(leads, "cluster", "left").select("cluster", "cluster_id", "member_count", F.coalesce("top_symbols", F.lit("")).alias("top_symbols"), F.coalesce("lead_files", F.lit("")).alias("lead_files"))
