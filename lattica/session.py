"""Session settings and the shared folder in which long jobs cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("lattica")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``: all executors must see it. Only a session that is one
    process (tests, one machine) may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        folder = f"file://{tempfile.gettempdir()}/{spark.sparkContext.applicationId}"
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir, a folder that all executors share, before the session starts")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/lattica-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: cuts lineage, survives lost executors.
    ``replaces``: a frame that this function made and that nothing reads any more; its files are deleted afterwards."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if replaces is not None:
        drop_written(replaces)
    return out


def drop_written(*frames: DataFrame) -> None:
    """Deletes the files behind frames made by :func:`written` that nothing reads any more; other frames stay."""
    for df in frames:
        where = getattr(df, "_written_at", None)
        if where:
            jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
