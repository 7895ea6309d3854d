"""Session defaults, table reading and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine expects; a running one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, in case it isn't installed there. The
    archive is the driver's own file; the driver serves it, so executors need no shared folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="quarry-code-")) / "quarry.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, f"quarry/{path.relative_to(package)}")
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer parts than there are cores, as a small table
    in one file does; larger tables are left as they are read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> None:
    """Set the checkpoint folder to ``spark.checkpoint.dir``. Only on a local master, where that
    setting may be absent as in tests, a temporary folder is as good; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame, fixed: bool = False, packed: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that its lineage ends
    and a lost executor costs nothing that came before. Size and partitioning stay known.

    A checkpoint would keep the constraints that its plan implied, and over rounds of self-joins the
    optimizer would multiply them, so none are derived while it is taken. ``fixed`` runs a plan whose
    partitioning is laid out already as one job, without planning each of its stages anew. ``packed``
    writes compressed columns into the same folder, for large tables whose partitioning is of no use
    later; like checkpoints that no cleaner removes, they stay there when the application ends."""
    spark = df.sparkSession
    shared_folder(spark)
    settings = {"spark.sql.constraintPropagation.enabled": "false"} | ({"spark.sql.adaptive.enabled": "false"} if fixed else {})
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        if packed:
            place = f"{spark.sparkContext.getCheckpointDir()}/packed-{uuid.uuid4().hex}"
            df.write.parquet(place)
            return spark.read.schema(df.schema).parquet(place)
        return df.checkpoint(eager=True)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def partitions(spark: SparkSession) -> int:
    """How many parts the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_dir(scale: str = "0.001") -> str:
    """Folder of the generated test tables."""
    return os.environ.get("QUARRY_DATA", f"/root/testdata/sf{scale}")
