"""Session for tests and the benchmark, and the shared folder for staged tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", name: str = "panelwright") -> SparkSession:
    """A single-machine session. On a cluster the submitted configuration is used."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for staged tables, below ``spark.checkpoint.dir``.

    Without that setting it lies in the warehouse folder, which every executor
    reaches as well. The folder goes when the application ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    root = f"{base}/panelwright-{spark.sparkContext.applicationId}"
    if root not in _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders[root] = str(files.makeQualified(path).toString())
    return _folders[root]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged folder whose readers are done."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Iterative fits scan a table many times. Staging cuts its lineage, so a lost
    executor costs a re-read of one file and not the whole upstream plan, and
    later scans read only the columns they need.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_modules(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, so that tasks import it by name."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted([*root.rglob("*.py"), *root.rglob("*.java")]):
            archive.write(path, path.relative_to(root.parent))
    name = f"{shared_folder(spark)}/modules/{root.name}-modules.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(name)
    _shipped.add(spark.sparkContext.applicationId)
