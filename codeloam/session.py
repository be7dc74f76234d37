"""Session building, table access and the shared folder that survives executors."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def build_session(app: str = "codeloam", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew-join handling, Arrow and UTC set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(table_path(sf_dir, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, taken from the session.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master is
    local does this fall back to a folder of this machine; on a cluster it raises instead.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(_CHECKPOINT, None) or spark.conf.get(_CHECKPOINT, None) or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError(f"{_CHECKPOINT} must name a folder that all executors share")
        named = Path(tempfile.mkdtemp(prefix="codeloam-")).as_uri()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there, and the
    result is not computed again when it is used twice. The table is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/codeloam-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)

