"""Session helpers: the shared folder and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANED: set[str] = set()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quarry")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Only a local session may lack the
    setting (tests); there a temporary folder stands in. On a cluster a missing
    setting is an error, since a machine-local folder would lose rows.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder under the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(_remove, spark, path)
    return path


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may already be gone at exit
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str, replaces: DataFrame | None = None, codec: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The rows survive lost executors, the lineage is cut, and later plans see
    the table's real size. ``replaces`` is an earlier table that nothing reads
    any more once this one is written: it is deleted, so that a loop does not
    fill the disk.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path, compression=codec)
    found = spark.read.schema(df.schema).parquet(path)
    found._quarry_path = path
    discard(replaces)
    return found


def discard(df: DataFrame | None) -> None:
    """Delete a materialized table that nothing reads any more; other frames stay."""
    path = getattr(df, "_quarry_path", None)
    if path:
        remove(df.sparkSession, path)
