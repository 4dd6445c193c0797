"""Session helpers: tests and the bench build one; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_STORED: list[str] = []
_SHIPPED: set[str] = set()


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def named_folder(master: str, named: str | None) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where one machine is all there is."""
    if not named and not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named_folder(spark.sparkContext.master, spark.conf.get("spark.checkpoint.dir", None)))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, which outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder; ``forget_stored`` removes what lies there."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, but a compressed table in the shared folder; ``forget_stored`` removes these."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_stored(path: str) -> bool:
    return path in _STORED


def forget_stored(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` wrote in this session; call it when results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    if spark.sparkContext.applicationId not in _SHIPPED:
        _SHIPPED.add(spark.sparkContext.applicationId)
        root = Path(__file__).resolve().parent
        zipped = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(zipped)
