"""Session, table reading and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own: dict[str, str | None] = {}
_stages: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def local_session(cores: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a fresh temporary folder takes its place if the master is local, so
    that driver and executors are one process; on a cluster it has to be set.
    """
    where = spark.sparkContext.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} has to name a folder that driver and executors share")
        where = _own.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="lectern-")
        _own[spark.sparkContext.applicationId] = where
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody uses yet in the shared folder."""
    return f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as its kind of object."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def until_exit(spark: SparkSession, path: str) -> None:
    """Have the files at ``path`` deleted when the session's process ends."""
    files, where = file_system(spark, path)
    files.deleteOnExit(where)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files last until the session's process ends, or until discard().
    """
    spark = df.sparkSession
    path = fresh_path(spark, "stage")
    df.write.parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _stages[out] = path
    return out


def discard(*stages: DataFrame) -> None:
    """Delete the files of materialised frames that nothing will read again."""
    for df in stages:
        if path := _stages.pop(df, None):
            files, where = file_system(df.sparkSession, path)
            files.delete(where, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, each with underscores added until no column has it (names differ in more than case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Limit an Arrow batch in rows and bytes, so that long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
