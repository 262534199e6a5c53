"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodeweave", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # The one JVM of a local session is driver and executor.
            builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: drops the lineage and keeps the partitioning, for tables that a
    loop joins again and again on the same key.

    An adaptive plan does not say how its rows lie, and the checkpoint would be shuffled
    again by each reader, so this one statement is planned without it.
    """
    spark = df.sparkSession
    shared_root(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def unpin(df: DataFrame) -> None:
    """Delete the files of a pinned table that nothing reads any more."""
    found = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if found.isDefined():
        _delete(df.sparkSession, found.get())


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table that ``stored`` or ``cut`` wrote for ``df``, when nothing reads it any more."""
    path = getattr(df, "stored_at", None)
    if path is None:
        return
    _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of a loop's state with a written table.

    A checkpoint would carry the size estimate and the constraints of the plan behind it
    into the next round, where they grow until planning takes longer than the work.
    A table has neither, and Spark sees its real size when it picks a join.
    """
    return stored(df, "round")
