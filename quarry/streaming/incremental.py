"""Continuous re-indexing: batches of scanned files refresh a graph on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.parse import chunks_of
from quarry.plans.build import edges_from, node_table
from quarry.runtime import cut
from quarry.sources.scan import GraphStore


def apply_batch(store: GraphStore, files: DataFrame) -> None:
    """Replace what the store holds of the files in a batch; of rows of one file the last scanned
    counts. Applying a batch twice changes nothing, so a replayed batch is harmless."""
    last = files.groupBy("repo", "relative_path").agg(F.max(F.struct("scanned_at", "language", "size", "content_hash", "content")).alias("x")).select("repo", "relative_path", "x.*")
    old = store.nodes().join(last.select("repo", F.col("relative_path").alias("file_path")), ["repo", "file_path"], "left_anti")
    nodes = cut(old.unionByName(node_table(last, chunks_of(last)).select(old.columns)))
    texts = nodes.where("kind = 'FILE'").select("repo", F.col("file_path").alias("relative_path"), "language", F.col("full_body").alias("content"))
    edges = cut(edges_from(nodes, texts).withColumn("metadata", F.lit(None).cast("map<string,string>")))
    store.write(nodes, edges)


def changed_files(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Of a stream of scans (repo, relative_path, content_hash, scanned_at, ...) each text of a
    file once while its scans are at most ``watermark`` apart."""
    return stream.withWatermark("scanned_at", watermark).dropDuplicatesWithinWatermark(["repo", "relative_path", "content_hash"])


def keep_indexed(stream: DataFrame, store: GraphStore, checkpoint: str) -> StreamingQuery:
    """Run until the stream has no more: every micro-batch goes through :func:`apply_batch`."""
    return stream.writeStream.foreachBatch(lambda frame, _: apply_batch(store, frame)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
