"""Where intermediate tables go so that a lost executor costs a task, not the job.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, the folder that all
executors share. Only where that setting is absent and the master is local (tests, notebooks) a
local folder is used; on a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; set to a fresh local one only if unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df once and returns a scan of what was written: computed once, lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """materialize() for tables that grow with the graph: no join takes them for small by their files.

    A column of ids may take a hundredth of its rows' bytes in a file. Plans that go by files send
    such tables through the driver; who knows the number of rows asks for that with F.broadcast.
    """
    return materialize(df, name).hint("merge")


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by materialize() that no later plan reads."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/weftgraph/"
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split("://")[-1] in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
