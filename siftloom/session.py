"""Session helpers: shipping the package, the shared checkpoint folder, table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_MADE: list[tuple[SparkSession, str]] = []


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow functions import there, wherever the driver was started.

    The archive lasts as long as the driver.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp(prefix="siftloom-ship-")
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    target = Path(tmp) / "siftloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def is_local(spark: SparkSession) -> bool:
    """Whether executors are threads of this machine."""
    master = spark.sparkContext.master
    return master.startswith("local") and "cluster" not in master


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and working tables: the session's spark.checkpoint.dir; only a local master gets one of its own."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not conf:
            if not is_local(spark):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            conf = tempfile.mkdtemp(prefix="siftloom-checkpoints-")
            atexit.register(shutil.rmtree, conf, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(conf)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver ends."""
    if not _MADE:
        atexit.register(delete_scratch)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def delete_scratch() -> None:
    """Delete all working tables of this driver."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back with its statistics."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
