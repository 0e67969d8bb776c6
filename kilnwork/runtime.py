"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(name: str = "kilnwork", cores: str = "8", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local session that
    leaves it unset gets a folder of its own; a cluster that does so is refused."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        configured = tempfile.mkdtemp(prefix="kilnwork-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut lineage with a table in the shared folder: (its rows, its path). Unlike a checkpoint
    it carries no constraints along, which a loop of many steps would pile up."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


WRITTEN: set[str] = set()


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that this session has written to cut lineage and that are still there; for a session's
    end, when no frame reads them any more. Checkpoints go by spark.cleaner.referenceTracking.cleanCheckpoints."""
    for path in list(WRITTEN):
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    WRITTEN.discard(path)


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """Deliveries of one key count once. Repeats carry the same values, so any stands for all."""
    return df.dropDuplicates(list(keys))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before costly work on each, if the scan has fewer tasks than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if tasks >= cores else df.repartition(cores)


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if df has at most `rows` rows; stops reading once there are more."""
    return df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n")).first()["n"] <= rows
