"""Session defaults, table reading and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on or profit from; a session that already exists keeps its own values.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", app: str = "weftline", **extra: str) -> SparkSession:
    """A session with DEFAULTS and the given settings (underscores stand for dots)."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULTS, **{k.replace("_", "."): v for k, v in extra.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One test or production table by its name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder named in spark.checkpoint.dir is used as it is; only where none is set on a local master (tests, laptops) a
    temporary one is made and set. A cluster without one is refused, as its machines don't share their temporary folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = held or tempfile.mkdtemp(prefix="weftline-")
        if not held:
            spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/weftline/{label}-{uuid.uuid4().hex}"


def through_table(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing df to shared scratch space and reading it back; survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system it lives on."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
