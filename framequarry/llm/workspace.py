"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, removed when the application ends.

    Where the setting is absent a temporary folder is used, which is only right
    for a local master; on a cluster that is an error rather than a guess.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="framequarry-")
        atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written once as a table in the shared folder and read back, and a function that deletes the table.

    Delete only once every result that reads the table is itself written.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)

    def delete() -> None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    return spark.read.schema(df.schema).parquet(path), delete


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Later stages restart from the files, so a lost executor costs a re-read and
    not the whole history.
    """
    return written(df, name)[0]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """An equi-join on ``key`` whose hot keys Spark can split, where a side is an aggregate by the same key.

    Spark splits a skewed partition only where both sides are shuffled for the
    join itself; an aggregate's own shuffle is not.  A second, derived key makes
    it shuffle the (small) aggregate once more.
    """
    also = fresh(left, "split_key")
    derived = F.xxhash64(F.col(key))
    return left.withColumn(also, derived).join(right.withColumn(also, derived), [key, also], how).drop(also)
