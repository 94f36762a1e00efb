"""Cut a lineage by writing an intermediate result to shared storage.

A settled table survives the loss of any executor, carries file statistics
for the planner, and is scanned with column pruning by every later step.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder for settled tables: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own,
    removed when the process ends; a cluster session must name one, as executors
    share no local disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/settled/{spark.sparkContext.applicationId}"


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once, in the application's own subfolder, and return a scan of it."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled._settled_path = path
    return settled


def discard(*tables: DataFrame) -> None:
    """Give back settled tables that nothing reads any more: every table made from them must have been written.

    Only what ``settle`` returned is deleted, and only below this application's
    own folder, so a lost executor never needs what is gone.
    """
    for table in tables:
        path = getattr(table, "_settled_path", None)
        if path is None:
            raise ValueError("not a table that settle returned")
        spark = table.sparkSession
        if not path.startswith(_own_folder(spark) + "/"):
            raise ValueError(f"not a table of this application: {path}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
