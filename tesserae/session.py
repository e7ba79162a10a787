"""Where jobs may put what driver and executors must both see."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where none is set, a local one of this user's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"tesserae-{os.getuid()}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that shared_path named, through Spark's own file systems."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers where the cluster doesn't provide it already."""
    root = str(Path(__file__).resolve().parents[1])
    sc = spark.sparkContext
    if getattr(sc, "_tesserae_shipped", False):
        return
    if root not in [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        to = Path(tempfile.mkdtemp(), "tesserae.zip")
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(Path(root, "tesserae").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(str(to))
    sc._tesserae_shipped = True
