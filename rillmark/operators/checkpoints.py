"""Lineage is cut by tables written to the shared folder that the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints/rillmark"
    return where.rstrip("/")


def shared(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{_shared(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once and read again. `forget` removes them when nothing reads them any more."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows by a hash of columns in as many partitions as shuffles have, however few bytes they are:
    for rows that a later step of the same stage makes many of."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *columns)


def spread_few(df: DataFrame, *columns: str) -> DataFrame:
    """`spread` where the rows come in fewer partitions than there are cores; else they stay where they are, and
    nothing is shuffled."""
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return spread(df, *columns) if few else df


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """The same rows, written once into as many buckets of a column as shuffles have partitions, so that
    joins on it read them in place. `forget` removes files and table."""
    spark = df.sparkSession
    name = f"rillmark_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).option("path", f"{_shared(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out._written_to, out._table = f"{_shared(spark)}/{name}", name
    return out


def forget(*tables: DataFrame) -> None:
    """Removes the files of tables that `cut` or `bucketed` made; rounds call it for states that newer ones replace."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
