"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (the
# only broadcast of a data-sized side is AQE's own, behind its size check)
# and splits skewed join partitions such as a hot start position.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT-compile methods above 8,000 bytes of bytecode; a
    # whole-stage method that large runs interpreted and is several times
    # slower than plain expression codegen, so fall back above that size
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rollout_tables", extra: dict | None = None) -> SparkSession:
    """Session for local runs and tests. On a cluster, pass no master and let
    spark-submit decide; shuffle partitions then come from the cluster conf."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# compression of written rollout tables: ids and texts take half the bytes of
# Spark's default, in no more time
TABLE_CODEC = "zstd"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the cluster and must be a shared file system
    (an unset value is an error there); it is only filled in here for local
    masters (local runs and tests), with a fresh folder under the temp dir.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="rollout-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d



def compiled(spark: SparkSession) -> None:
    """Keeps generated code within HotSpot's limit in a session that was not
    made by ``build_session``: above it a stage runs interpreted."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > int(DEFAULT_CONF[limit]):
        spark.conf.set(limit, DEFAULT_CONF[limit])


def materialise(df, name: str = "table", codec: str | None = None):
    """Writes ``df`` as parquet under the shared checkpoint folder and reads
    it back: cuts lineage (nothing is recomputed when an executor is lost or
    when the result is consumed twice) and keeps columnar scans. The folder is
    deleted when the driver's JVM ends. ``codec`` is the compression of the
    files, that of the session by default."""
    import uuid

    spark = df.sparkSession
    compiled(spark)
    path = os.path.join(checkpoint_dir(spark), "materialised", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=codec)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)
