"""The folder that driver and executors share, and tables in it that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster's has to name it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallybook-"))
        found = context.getCheckpointDir()
    return f"{found.rstrip('/')}/{context.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which survives lost executors; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def parted(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df, written, with `part`: ranges of rows in (by, order), each before the next; rows that tie share one."""
    return written(df.repartitionByRange(*map(F.col, by), *order).withColumn("part", F.spark_partition_id()), "parts")


def ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df, written, with nth: its place from 0 in order within `by` (columns without nulls).

    Rows are dealt by ranges of (by, order) and numbered as they are written, so that one `by` with most of the rows is
    many tasks' work. What is added to a row's number is where its range starts within `by`, less where `by` starts in
    its range: one row for each `by` and range, written as well, so that its join is planned by its real size.
    """
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a row's place in its partition
    sorted_ = df.repartitionByRange(*map(F.col, by), *order).sortWithinPartitions(*map(F.col, by), *order)
    parts = written(sorted_.withColumn("part", F.spark_partition_id()).withColumn("nth", own), "parts")
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = parts.groupBy(*by, "part").agg(F.count("*").alias("c"), F.min("nth").alias("first"))
    starts = written(spans.select(*by, "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("start")), "starts")
    return parts.join(starts, [*by, "part"]).withColumn("nth", F.col("start") + F.col("nth")).drop("start", "part")
