"""Text and vector search: BM25, cosine, rank fusion and boosts. Queries are tables, too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from quarry.functions.text import code_tokens
from quarry.operators.graph import SYMBOLS
from quarry.runtime import cut, spread

# BM25's parameters and the constant of rank fusion.
K1, B, EPSILON, FUSION = 1.5, 0.75, 0.25, 60
#: Numbers of query vectors, or words of queries, that one pass over the table holds in a task, and
#: queries and rows that are compared at once.
HELD, QUERIES, ROWS = 4_000_000, 1000, 2000
#: Length of vectors that are made from words.
DIMENSIONS = 64

SCORED = "query long, doc long, score double"


def word_vectors(texts: DataFrame) -> DataFrame:
    """The rows (..., text) with a vector of each text's code tokens that needs no model: each token
    adds or takes one at a place, both told by its digest. Alike texts have near vectors; null texts
    and texts without tokens have none."""
    digit = lambda t, i: F.instr(F.lit("0123456789abcdef"), F.substring(t, i, 1)) - 1
    place = lambda t: F.when(digit(t, 3) < 8, 1).otherwise(-1) * ((digit(t, 1) * 16 + digit(t, 2)) % DIMENSIONS + 1)
    count = lambda i: F.size(F.filter("_places", lambda x: x == i)) - F.size(F.filter("_places", lambda x: x == -i))
    digests = texts.withColumn("_digests", F.transform(code_tokens("text"), lambda t: F.substring(F.md5(t), 1, 3)))
    placed = digests.withColumn("_places", F.transform("_digests", place))
    made = F.transform(F.sequence(F.lit(1), F.lit(DIMENSIONS)), lambda i: count(i).cast("double"))
    return placed.withColumn("vector", F.when(F.size("_places") > 0, made)).drop("_digests", "_places", "text")


class Best:
    """Of scores by query and row, batch after batch, those that may be among the best ``k``; whatever
    lies below ``k`` rows seen before is dropped, ties never are."""

    def __init__(self, queries: int, k: int, least: float) -> None:
        self.k, self.floor = k, np.full(queries, least)

    def take(self, first: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (query from 0, row) of the scores (queries from ``first`` on, rows) to keep."""
        floor = self.floor[first : first + len(scores)]
        if scores.shape[1] >= self.k:
            np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k], out=floor)
        return np.nonzero(scores >= floor[:, None])


def blocks(queries: DataFrame, numbers: int) -> Iterator[list[Row]]:
    """The queries in as few parts of about ``HELD`` numbers as hold them, one after another: each is
    one pass over the table that is searched."""
    parts = max(1, -(-numbers // HELD))
    for part in range(parts):
        yield queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).orderBy("query").collect()


def bm25(texts: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, doc, score, place): for each query (query, text) the best ``k`` texts (doc, text).

    Terms count once in a text. Terms in more than half of the texts get a quarter of the mean
    weight instead of a negative one. Scores are rounded to six places, ties go by doc, and only
    positive scores remain; null texts have no terms. A text is tokenized once and scored where it
    lies against a block of queries; a task shuffles only what may be among a query's best."""
    spark = texts.sparkSession
    index = cut(spread(texts).where("doc is not null and text is not null").select(F.col("doc").cast("long").alias("doc"), code_tokens("text").alias("terms")))  # read by the counts and each pass
    terms = cut(index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")))
    docs = texts.count()
    length = (index.agg(F.sum(F.size("terms"))).first()[0] or 0) / max(1, docs)
    raw = terms.select("term", (F.log(docs - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    weight = F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw"))
    words = queries.where("query is not null and text is not null").select(F.col("query").cast("long").alias("query"), F.explode(code_tokens("text")).alias("term"))
    asked = cut(words.join(raw.select("term", weight.alias("idf")), "term").groupBy("query").agg(F.collect_list(F.struct("term", "idf")).alias("terms")))
    out = spark.createDataFrame([], SCORED)
    for rows in blocks(asked, asked.agg(F.sum(F.size("terms"))).first()[0] or 0):
        ids = np.array([r["query"] for r in rows], np.int64)
        by_term: dict[str, list[int]] = {}
        idf: dict[str, float] = {}
        for i, r in enumerate(rows):
            for t in r["terms"]:
                by_term.setdefault(t["term"], []).append(i)
                idf[t["term"]] = t["idf"]
        shared = spark.sparkContext.broadcast((ids, {t: np.array(x) for t, x in by_term.items()}, idf))  # a block of HELD words

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, by_term, idf = shared.value
            keep = Best(len(ids), k, 5e-7)
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    docs, lists = batch["doc"].to_numpy()[at : at + ROWS], batch["terms"].tolist()[at : at + ROWS]
                    size = np.array([len(x) for x in lists])
                    part = (K1 + 1) / (1 + K1 * (1 - B + B * size / max(length, 1e-9)))
                    where: dict[str, list[int]] = {}
                    for i, x in enumerate(lists):
                        for t in x:
                            if t in by_term:
                                where.setdefault(t, []).append(i)
                    for first in range(0, len(ids), QUERIES):
                        scores = np.zeros((min(QUERIES, len(ids) - first), len(docs)))
                        for t in sorted(where):
                            mine = by_term[t]
                            mine = mine[np.searchsorted(mine, first) : np.searchsorted(mine, first + QUERIES)] - first
                            if len(mine):
                                scores[np.ix_(mine, where[t])] += idf[t] * part[where[t]]
                        scores = np.round(scores, 6)
                        q, d = keep.take(first, scores)
                        yield pd.DataFrame({"query": ids[first + q], "doc": docs[d], "score": scores[q, d]})

        out = out.unionByName(index.mapInPandas(score, SCORED))
    return best(out, k).where("score > 0")


def best(scored: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, place): the ``k`` highest scores of each query, ties by doc."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).select("query", "doc", "score", "place")


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, doc, score, place): for each query vector (query, vector) the nearest ``k`` of
    (doc, vector) by cosine, rounded to six places. A pass compares all rows with a block of queries
    that fills a fixed memory; a task shuffles only what may be among a query's best. A vector of
    zeros is as near as nothing; null vectors and ids are left out."""
    spark = vectors.sparkSession
    asked = queries.where("query is not null and vector is not null").select(F.col("query").cast("long").alias("query"), "vector")
    rows_in = vectors.where("doc is not null and vector is not null").select(F.col("doc").cast("long").alias("doc"), "vector")
    out = spark.createDataFrame([], SCORED)
    for rows in blocks(asked, asked.agg(F.sum(F.size("vector"))).first()[0] or 0):
        ids = np.array([r["query"] for r in rows], np.int64)
        matrix = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-10)
        shared = spark.sparkContext.broadcast((ids, matrix))  # a block of HELD numbers

        def compare(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            keep = Best(len(ids), k, -2.0)
            for batch in batches if len(ids) else ():
                for at in range(0, len(batch), ROWS):
                    docs = batch["doc"].to_numpy()[at : at + ROWS]
                    own = np.stack(batch["vector"].to_numpy()[at : at + ROWS]).astype(np.float64)
                    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-10)
                    for first in range(0, len(ids), QUERIES):
                        scores = np.round(matrix[first : first + QUERIES] @ own.T, 6)
                        q, d = keep.take(first, scores)
                        yield pd.DataFrame({"query": ids[first + q], "doc": docs[d], "score": scores[q, d]})

        out = out.unionByName(rows_in.mapInPandas(compare, SCORED))
    return best(out, k)


def fused(lists: list[DataFrame], k: int = 10) -> DataFrame:
    """(query, doc, score, place) of several ranked lists by reciprocal ranks."""
    parts = [x.select("query", "doc", (F.lit(1.0) / (FUSION + F.col("place"))).alias("part")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return best(out.groupBy("query", "doc").agg(F.round(F.sum("part"), 9).alias("score")), k)


def boosted(scored: DataFrame, queries: DataFrame, nodes: DataFrame, degrees: DataFrame, k: int = 10) -> DataFrame:
    """(query, doc, score, place) after boosts: three times for a symbol whose name holds a word of
    the query, and a twentieth more for each outgoing edge up to ten."""
    joined = scored.select("query", "doc", "score").join(queries.select("query", F.split(F.lower("text"), r"\s+").alias("words")), "query")
    joined = joined.join(nodes.select(F.col("id").alias("doc"), "kind", F.lower("name").alias("low")), "doc").join(degrees.select(F.col("id").alias("doc"), "out_degree"), "doc")
    named = F.col("kind").isin(*SYMBOLS) & F.exists("words", lambda w: (w != "") & F.col("low").contains(w))
    score = F.col("score") * F.when(named, 3.0).otherwise(1.0) * (1 + F.least("out_degree", F.lit(10)) * 0.05)
    return best(joined.select("query", "doc", F.round(score, 9).alias("score")), k)
