"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "emberlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` overrides the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, name: str, sweep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    ``sweep``: the shuffle files of the write are deleted when it is done, not when the driver happens to collect its garbage.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/emberlake-{uuid.uuid4().hex}/{name}"
    conf = df.sparkSession.conf
    before = conf.get(SWEEP, "false")
    if sweep:
        conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SWEEP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a table of ``stage`` that nothing reads any more, results still to be computed among it."""
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if "/emberlake-" not in folder:
            raise ValueError(f"{folder} is not staged")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
