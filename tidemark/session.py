"""Sessions and the shared folder in which intermediate tables live.

Intermediate results that several later steps read are written as Parquet to
the folder named by ``spark.checkpoint.dir`` (shared by every executor), so a
lost executor costs a re-read and never a lost block.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; its own only where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/tidemark-{os.getpid()}/{label}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage_table(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written.

    Cuts the lineage like ``checkpoint()`` does, but the files are columnar:
    later readers prune columns and push filters into them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fill_cores(table: DataFrame) -> DataFrame:
    """A scanned table for work in Python: dealt out where its files are too few and small to give each core a task.

    What counts are the tasks of the scan itself. Spark cuts files into one for
    each core as soon as they hold 4 MB a core in more than a row group, and such
    tables stay as their scan reads them: nothing is shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    tasks = table._jdf.queryExecution().toRdd().getNumPartitions()
    return table.repartition(cores) if tasks < cores else table


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, however the driver found it; once per session."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tidemark", os.path.relpath(full, root)))
    context.addPyFile(archive)
    context._tidemark_shipped = True


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, Hadoop path) of ``path``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def release_staged() -> None:
    """Delete every staged table; frames that still read them become invalid."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            fs, target = hadoop_fs(spark, path)
            fs.delete(target, True)
        except Exception:  # the session is already gone
            pass


atexit.register(release_staged)
