"""PageRank, distributed ranks, fingerprints and budgeted expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import SYMBOLS, cluster_name, degrees, skeleton_tokens
from quarry.runtime import cut, partitions

# Share of a score that follows links, change a node at which scores count as settled, most rounds.
ALPHA, TOLERANCE, MOST = 0.85, 1e-6, 100
#: Change of all scores together, whose sum is 1, at which they count as settled however many nodes there are.
SETTLED = 1e-3
#: Rounds between two looks at the change; each look cuts the lineage.
LOOK = 6


def rounds(n: int, alpha: float) -> str:
    """``n`` rounds as one statement, so that they are planned together. The sides of the joins are laid
    out by node already; merging them costs neither an exchange nor a broadcast."""
    steps = ["s0 AS (SELECT id, x FROM {state})"]
    for i in range(1, n + 1):
        steps.append(f"c{i} AS (SELECT /*+ MERGE(s{i - 1}) */ l.target_id AS id, sum(x * w) AS came FROM {{links}} l JOIN s{i - 1} ON l.source_id = s{i - 1}.id GROUP BY l.target_id)")
        steps.append(f"s{i} AS (SELECT /*+ MERGE(c{i}) */ b.id, {alpha}D * coalesce(came, 0D) + {1 - alpha!r}D * p AS x FROM {{base}} b LEFT JOIN c{i} ON b.id = c{i}.id)")
    return f"WITH {', '.join(steps)} SELECT id, x FROM s{n}"


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, alpha: float = ALPHA, tolerance: float = TOLERANCE, most: int = MOST) -> DataFrame:
    """(id, score), teleporting everywhere or, with seeds, to them alone, until ``LOOK`` rounds change
    a score by less than ``tolerance`` on average and all together by less than ``SETTLED``, at most
    ``most`` rounds.

    Edges of different kinds each carry a share. What reaches nodes without links would go where
    teleports go; at the fixpoint that is the same as leaving it out and scaling the scores to one
    in the end, which spares every round a total. Scores are rounded to six places of a mean score,
    whatever the number of nodes. Links stay partitioned by source and scores by node, so a round
    exchanges nothing but sums by target. Seeds that are no nodes are left out; without any, all
    scores are 0."""
    spark = nodes.sparkSession
    parts = partitions(spark)
    ids = nodes.select("id").distinct()
    total = ids.count()
    if seeds is None:
        jump = ids.withColumn("p", F.lit(1.0 / max(1, total)))
    else:
        chosen = cut(ids.join(seeds.select("id").distinct(), "id", "left_semi"))
        jump = ids.join(chosen.withColumn("p", F.lit(1.0 / max(1, chosen.count()))), "id", "left").fillna(0.0, ["p"])
    base = jump.repartition(parts, "id").sortWithinPartitions("id").persist()
    plain = cut(edges.select("source_id", "target_id"))
    out = plain.groupBy("source_id").agg((F.lit(1.0) / F.count("*")).alias("w"))
    links = plain.join(out, "source_id").repartition(parts, "source_id").sortWithinPartitions("source_id").persist()
    state = seen = base.select("id", F.col("p").alias("x"))
    for turn in range(LOOK, most + LOOK, LOOK):
        state = cut(spark.sql(rounds(min(LOOK, most - turn + LOOK), alpha), links=links, base=base, state=state), fixed=True)
        moved = state.join(seen.withColumnRenamed("x", "was"), "id").agg(F.sum(F.abs(F.col("x") - F.col("was")))).first()[0]
        if moved is None or moved < min(tolerance * total, SETTLED):
            break
        seen = state
    base.unpersist()
    links.unpersist()
    mass = state.agg(F.sum("x").alias("mass"))
    scaled = state.crossJoin(F.broadcast(mass)).select("id", F.when(F.col("mass") > 0, F.col("x") / F.col("mass")).otherwise(0.0).alias("x"))  # one row is broadcast
    return scaled.select("id", (F.round(F.col("x") * total, 6) / F.lit(float(max(1, total)))).alias("score"))


def lower_count(scores: DataFrame, value: str) -> DataFrame:
    """(value, lower, total): how many rows have a lower value, for each distinct value. Values are
    counted first, then summed within steps of their logarithm and over the steps, so no task
    sorts all rows."""
    counts = scores.groupBy(value).agg(F.count("*").alias("n")).withColumn("step", F.floor(F.log(F.greatest(F.col(value), F.lit(1e-300))) * 64))
    inside = Window.partitionBy("step").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("step").agg(F.sum("n").alias("m"))
    across = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # a few thousand steps at most
    steps = sums.select("step", F.coalesce(F.sum("m").over(across), F.lit(0)).alias("earlier"), F.sum("m").over(Window.partitionBy()).alias("total"))
    return counts.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(steps), "step").select(value, (F.col("earlier") + F.col("within")).alias("lower"), "total")


def percentiles(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, percentile) of functions, classes and methods: the place of the first node with the
    same score among all nodes, over their number."""
    place = lower_count(scores, "score")
    ranked = scores.join(place, "score").select("id", F.round((F.col("lower") + 1) / F.col("total"), 6).alias("percentile"))
    return ranked.join(nodes.where(F.col("kind").isin(*SYMBOLS)).select("id"), "id", "left_semi")


def fingerprints(nodes: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, cluster, percentile, fingerprint): kind, name, signature, degrees and rank in a line."""
    known = nodes.select("id", "kind", "name", "signature", "file_path")
    joined = percentiles(nodes, scores).join(known, "id").join(degrees(nodes, edges), "id")
    signature = F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit(" ["), F.col("signature"), F.lit("]"))).otherwise(F.lit(""))
    percent = F.bround(F.col("percentile") * 100, 0).cast("int")
    line = F.concat(F.col("kind"), F.lit(" "), F.col("name"), signature, F.lit(" [in:"), F.col("in_degree"), F.lit(" out:"), F.col("out_degree"), F.lit(" rank:"), percent, F.lit("%]"))
    return joined.select("id", cluster_name(F.col("file_path")).alias("cluster"), "percentile", line.alias("fingerprint"))


def greedy_fit(items: F.Column, budget: int) -> F.Column:
    """Of an ordered array of structs with ``id`` and ``cost``, those taken when each is taken if
    it still fits: an array of ids. A fold, so an item that does not fit is skipped, not the end."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("taken"))

    def take(acc: F.Column, x: F.Column) -> F.Column:
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["taken"], x["id"])).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(items, start, take, lambda acc: acc["taken"])


def expanded(nodes: DataFrame, scores: DataFrame, budget: int = 2048, most: int = 20) -> DataFrame:
    """(place, id, score, cost) of the best nodes that are not files, within a token budget."""
    best = scores.join(nodes.where("kind <> 'FILE'").select("id", skeleton_tokens().alias("cost")), "id").orderBy(F.desc("score"), "id").limit(most)
    packed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "cost"))).alias("items"))  # at most `most` rows
    taken = packed.select(F.posexplode(greedy_fit(F.col("items"), budget)).alias("place", "id"))
    return taken.join(best, "id").select(F.col("place").cast("long").alias("place"), "id", "score", "cost")
