"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 64


def root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it back: later steps survive lost executors and never recompute it.

    The files stay until drop() or the owner of the shared folder removes them.
    """
    path = f"{root(df.sparkSession)}/spanloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame, but: DataFrame | None = None) -> None:
    """Deletes the files behind a table(), or those of all tables that df reads and `but` doesn't, which nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders = lambda x: {f.rsplit("/", 1)[0] for f in x.inputFiles()}
    for folder in folders(df) - (folders(but) if but is not None else set()):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if "/spanloom/" in folder:
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of tables already written: it does so when the driver's JVM collects what refers to them."""
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt(*columns: str) -> Column:
    """A number below SALTS, by which the rows of one key are dealt where one key may hold a third of all rows.

    The side of a join that has one row a key has a copy for each number that occurs with the key: salts() gathers these in one
    long, each_salt() lists them, and both sides meet by key and number.
    """
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salts(*columns: str) -> Column:
    """Aggregate: the set of salt(), as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt(*columns)))


def each_salt(bits: str) -> Column:
    """A row for each number in salts()."""
    held = lambda i: F.call_function("shiftright", F.col(bits), i).bitwiseAND(F.lit(1)) == 1
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), held))
