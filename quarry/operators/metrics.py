"""Counts and token metrics of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import suffix
from quarry.operators.graph import SYMBOLS, full_tokens, kind_rank, skeleton_tokens

# Colour and size of kinds in an export, and the edges that leave each kind there.
COLOURS = {"FILE": "#4a9eff", "CLASS": "#ff6b6b", "FUNCTION": "#6bcb77", "METHOD": "#4ecdc4"}
SIZES = {"FILE": 3.0, "CLASS": 2.5, "FUNCTION": 1.5, "METHOD": 1.2}
SHOWN_EDGES = ("DECLARES", "CALLS", "CONTAINS", "INHERITS")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n) of nodes and edges, by kind and in all."""

    def side(frame: DataFrame, what: str) -> DataFrame:
        grouped = frame.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
        return grouped.unionByName(frame.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit("*").alias("kind"), "n"))

    return side(nodes, "nodes").unionByName(side(edges, "edges"))


def extensions(files: DataFrame) -> DataFrame:
    """(extension, n) of files by lower-case suffix; files without one count as ``(no ext)``."""
    found = F.when(suffix("relative_path") == "", "(no ext)").otherwise(suffix("relative_path"))
    return files.select("repo", "relative_path").distinct().groupBy(found.alias("extension")).agg(F.count("*").alias("n"))


def token_savings(nodes: DataFrame) -> DataFrame:
    """(kind, skeleton_tokens, full_tokens, saved_percent) of classes, functions and methods."""
    sums = nodes.where(F.col("kind").isin(*SYMBOLS)).groupBy("kind").agg(F.sum(skeleton_tokens()).alias("skeleton_tokens"), F.sum(full_tokens()).alias("full_tokens"))
    return sums.withColumn("saved_percent", F.when(F.col("full_tokens") > 0, F.floor((1 - F.col("skeleton_tokens") / F.col("full_tokens")) * 100)).cast("long"))


def largest_symbols(nodes: DataFrame, k: int = 5) -> DataFrame:
    """(id, kind, name, full_tokens) of the ``k`` largest symbols: a top-k report."""
    sized = nodes.where(F.col("kind").isin(*SYMBOLS)).select("id", "kind", "name", full_tokens().alias("full_tokens"), kind_rank().alias("rank"))
    return sized.orderBy(F.desc("full_tokens"), "rank", "id").limit(k).drop("rank")


def zoom_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(files, symbols, total_implementation_tokens, l2_average, l3_average), integers."""
    symbol = F.col("kind").isin(*SYMBOLS)
    made = nodes.agg(
        F.sum(F.when(F.col("kind") == "FILE", 1).otherwise(0)).alias("files"), F.sum(F.when(symbol, 1).otherwise(0)).alias("symbols"),
        F.sum(F.when(symbol, skeleton_tokens()).otherwise(0)).alias("skeleton"), F.sum(F.when(symbol, full_tokens()).otherwise(0)).alias("full"),
    )
    n = F.greatest(F.lit(1), F.col("symbols"))
    return made.select("files", "symbols", F.col("full").alias("total_implementation_tokens"), F.floor(F.col("skeleton") / n).alias("l2_average"), F.floor(F.col("full") / n).alias("l3_average"))


def export_nodes(nodes: DataFrame) -> DataFrame:
    """(id, name, kind, color, size, tokens, file_path, line) of what an export draws."""
    pick = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col("kind")]
    return nodes.where(F.col("kind").isin(*COLOURS)).select(
        "id", "name", "kind", pick(COLOURS).alias("color"), pick(SIZES).alias("size"), full_tokens().alias("tokens"), F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.when(F.col("kind") == "FILE", 0).otherwise(F.coalesce("start_line", F.lit(0))).alias("line"),
    )


def export_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id, kind) of what an export draws; imports leave files only."""
    kinds = nodes.where(F.col("kind").isin(*COLOURS)).select(F.col("id").alias("source_id"), F.col("kind").alias("source_kind"))
    allowed = F.col("kind").isin(*SHOWN_EDGES) | ((F.col("kind") == "IMPORTS") & (F.col("source_kind") == "FILE"))
    return edges.join(kinds, "source_id").where(allowed).select("source_id", "target_id", "kind")


def reading_cost(nodes: DataFrame) -> DataFrame:
    """(repo, read_tokens, outline_tokens, saved_percent): reading every Python file of a repository
    against reading the skeletons of their symbols."""
    python = F.lower("file_path").endswith(".py")
    read = F.sum(F.when((F.col("kind") == "FILE") & python, F.length("full_body")).otherwise(0))
    outline = F.sum(F.when(F.col("kind").isin(*SYMBOLS) & python, F.length(F.coalesce("skeleton", F.lit("")))).otherwise(0))
    sums = nodes.where("repo is not null").groupBy("repo").agg(F.greatest(F.lit(1), F.floor(read / 4)).alias("read_tokens"), F.floor(outline / 4).alias("outline_tokens"))
    return sums.withColumn("saved_percent", F.round((F.col("read_tokens") - F.col("outline_tokens")) / F.col("read_tokens") * 100, 3))
