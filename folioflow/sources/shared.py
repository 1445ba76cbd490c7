"""Tables written to the folder that all executors share.

The folder is the one named in spark.checkpoint.dir. Where a local session has none (tests), one is made and set; on a
cluster that would be a folder of one machine, so there it is an error.
Reading a written table cuts the lineage: a lost executor costs no more than its running tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark settings by which a finished write removes its shuffle files at once, and not at some later collection.
CLEANUP = ("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in CLEANUP}
    try:
        for k in CLEANUP:
            spark.conf.set(k, "true")
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioflow_path = path
    return out


def remove(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables made by written(), or paths, once nothing reads them any more."""
    jvm = spark._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._folioflow_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
