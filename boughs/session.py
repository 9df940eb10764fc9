"""Session helpers: the shared folder, and tables that cut lineage.

Long iterative plans (level rounds, merge rounds, contraction rounds) are cut by writing an
intermediate table to the folder named by ``spark.checkpoint.dir``. A written table survives lost
executors, keeps column pruning and row-group statistics, and gives Catalyst a real size to choose
its join strategy from.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse
import zipfile

from pyspark.sql import DataFrame, SparkSession


SCRATCH = "boughs-scratch"

_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can read: ``spark.checkpoint.dir``, or else a folder in the warehouse.

    What a local session writes to the warehouse is removed when the driver ends; on a cluster it stays, like
    checkpoint files. Raises on a cluster whose warehouse is a plain path: each executor may have its own disk there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        _scratch[app] = f"{warehouse}/{SCRATCH}/{app}"
        where = urlparse(_scratch[app])
        if where.scheme in ("", "file"):
            if spark.sparkContext.master.split("[")[0] != "local":
                del _scratch[app]
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            atexit.register(shutil.rmtree, where.path, ignore_errors=True)
    return _scratch[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/boughs-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Readers are cut by bytes, so a task may get any number of rows that compress well. ``file_rows`` bounds the rows of
    a file: each file counts for ``spark.sql.files.openCostInBytes`` at least, so few of them are read by one task.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table of ``materialize`` that nothing reads any more."""
    path = table.inputFiles()
    if not path:
        return
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path[0]).getParent()
    if not folder.getName().startswith("boughs-"):
        raise ValueError("only intermediate tables are discarded")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join(name, os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
