"""Session settings, table access and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "geolathe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine's semantics need (UTC, adaptive execution, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    one, deleted at its end; on a cluster it's an error, as no other machine would see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        made = tempfile.mkdtemp(prefix="geolathe-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        context.setCheckpointDir(made)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: computed once, with its partitions and their order kept."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder once and read back: cuts lineage and survives lost executors.

    ``by``: a text column that the table has a folder for each value of. The table goes when the session ends: results
    that read it are lazy, so it can't go before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if not _WRITTEN:
        atexit.register(cleared)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


_WRITTEN: list[tuple[SparkSession, str]] = []


def cleared() -> None:
    """Deletes the tables that ``written`` left; runs by itself at the end of the driver."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended before
            return
