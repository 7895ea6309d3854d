"""Scanning a source tree, snapshots of it, and the graph's tables on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import ignored, language
from quarry.runtime import ship

NODE_SCHEMA = (
    "id long, kind string, name string, repo string, file_path string, start_line int, end_line int, signature string, skeleton string, full_body string, docstring string, "
    "language string, enclosing_scope string, symbol_kind string, token_count_skeleton int, token_count_full int, metadata map<string,string>"
)
EDGE_SCHEMA = "source_id long, target_id long, kind string, weight double, metadata map<string,string>"


def scanned(spark: SparkSession, root: str, repo: str = "", extra_ignores: tuple[str, ...] = ()) -> DataFrame:
    """(repo, path, relative_path, language, size, content_hash, content) of the files below a
    folder. Malformed UTF-8 is replaced. Ignored folders and names are left out; unreadable files
    are skipped, and so are files without a byte, which Spark's file sources never open. Lines of the
    folder's .gitignore count as ignored names, too."""
    ship(spark)
    try:
        own = tuple(r[0].strip() for r in spark.read.text(f"{root.rstrip('/')}/.gitignore").collect())  # one file of the tree
    except AnalysisException:
        own = ()
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    bare = F.regexp_replace("path", "^file:(//)?", "")
    relative = F.substring(bare, len(base) + 2, 1 << 30)
    named = raw.withColumn("relative_path", relative).where(~ignored("relative_path", (*own, *extra_ignores)))
    return named.select(
        F.lit(repo).alias("repo"), bare.alias("path"), "relative_path", language("relative_path").alias("language"), F.col("length").alias("size"),
        F.sha2("content", 256).alias("content_hash"), F.expr("make_valid_utf8(cast(content as string))").alias("content"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, relative_path, status) of two snapshots (repo, relative_path, content_hash): new,
    changed, deleted or unchanged. One full outer join on the key."""
    a = old.select("repo", "relative_path", F.col("content_hash").alias("old_hash"), F.lit(True).alias("was"))
    b = new.select("repo", "relative_path", F.col("content_hash").alias("new_hash"), F.lit(True).alias("now"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed").otherwise("unchanged")
    return a.join(b, ["repo", "relative_path"], "full_outer").select("repo", "relative_path", status.alias("status"))


def latest(files: DataFrame) -> DataFrame:
    """(repo, relative_path, content_hash) of each file's last scan; of scans at the same time the
    greatest hash. Aggregation, since one repository may hold most rows."""
    last = F.max(F.struct("scanned_at", "content_hash")).alias("last")
    return files.where("repo is not null and relative_path is not null").groupBy("repo", "relative_path").agg(last).select("repo", "relative_path", F.col("last.content_hash").alias("content_hash"))


def save_snapshot(files: DataFrame, folder: str) -> None:
    """Keep a snapshot (repo, relative_path, content_hash) for the next difference."""
    files.select("repo", "relative_path", "content_hash").write.mode("overwrite").parquet(folder)


def load_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot kept in a folder; none where it is missing or can't be read."""
    schema = "repo string, relative_path string, content_hash string"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], schema)


class GraphStore:
    """Nodes and edges as Parquet, partitioned by kind so that a lookup by kind reads its files.

    There are two places for them. A write fills the one that is not in use and then appends a row to
    ``versions``, which readers follow: one that fails half-way changes nothing."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def version(self) -> int:
        """The number of the last write that was finished, 0 before the first."""
        return self._read("versions", "version long").agg(F.max("version")).first()[0] or 0

    def nodes(self) -> DataFrame:
        """The nodes, or none where nothing was written."""
        return self._read(f"nodes_{self.version() % 2}", NODE_SCHEMA)

    def edges(self) -> DataFrame:
        """The edges whose ends are both among the nodes."""
        ids = self.nodes().select("id")
        raw = self._read(f"edges_{self.version() % 2}", EDGE_SCHEMA)
        return raw.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "kind", "weight", "metadata")

    def write(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Replace both tables. Rows are gathered by kind; a kind too large for one task is split."""
        version = self.version() + 1
        nodes.hint("rebalance", "kind").sortWithinPartitions("kind", "name").write.mode("overwrite").partitionBy("kind").parquet(f"{self.folder}/nodes_{version % 2}")
        edges.hint("rebalance", "kind").sortWithinPartitions("kind", "source_id").write.mode("overwrite").partitionBy("kind").parquet(f"{self.folder}/edges_{version % 2}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")

    def clear(self) -> None:
        """Empty both tables."""
        self.write(self.spark.createDataFrame([], NODE_SCHEMA), self.spark.createDataFrame([], EDGE_SCHEMA))
