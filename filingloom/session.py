"""Session construction and the shared settings every entry point relies on."""

from __future__ import annotations

import atexit
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Settings that only shape execution; results do not depend on them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "filingloom", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the engine's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for tables that cut lineage.

    It is read from ``spark.checkpoint.dir``. Only a local session without that setting (a laptop)
    gets a folder below its warehouse; a cluster without it is an error, as no folder of one machine
    will do.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def _folder(spark: SparkSession) -> str:
    """The session's folder below the shared one; it is deleted when the Python process ends."""
    root = ensure_checkpoint_dir(spark)
    if root not in _FOLDERS:
        _FOLDERS[root] = f"{root}/tables-{uuid4().hex}"
        atexit.register(_delete, spark, _FOLDERS[root])
    return _FOLDERS[root]


_FOLDERS: dict[str, str] = {}


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended before; the folder is left to its owner
        pass


def materialise(df: DataFrame) -> DataFrame:
    """Write a table once to the cluster's shared folder and return it as a scan.

    Cuts the lineage like a reliable checkpoint and survives lost executors, but compressed and
    column by column, so that later steps read only what they use.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
