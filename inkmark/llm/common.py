"""What the operators share: reading tables, the shared scratch folder, stored intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Tables of up to this many rows of a few numbers are broadcast, larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of this machine if
    Spark runs in this process alone, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base or os.path.join(tempfile.gettempdir(), "inkmark-checkpoints")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again.

    The files outlive any executor, and a lost task rereads them instead of computing its ancestors.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def let(value, body):
    """body(value) with value computed once a row: a lambda variable isn't inlined as a column would be."""
    return F.transform(F.array(value), body)[0]
