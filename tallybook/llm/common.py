"""What the operators of this subpackage share: tables, shared-folder cuts, hold-outs and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders written since the innermost `tidied` began.
_made: ContextVar[list | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where a local session names none, as in tests, a temporary folder of this process is set. A cluster's session must
    name one, since its executors write where the driver reads. What is written there goes when the application ends.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallybook-"))
        found = context.getCheckpointDir()
    return f"{found.rstrip('/')}/{context.applicationId}"


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, keeps columns prunable.

    The folder is deleted when the application ends, or by `dropped` before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _folder(spark, path)
    files.deleteOnExit(at)
    if (made := _made.get()) is not None:
        made.append(at)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what `written` makes within it; a result that is to stay is written by `saved`."""
    made: list = []
    before = _made.set(made)
    try:
        yield
    finally:
        _made.reset(before)
        for at in made:
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """`written`, and kept beyond `tidied`."""
    before = _made.set(None)
    try:
        return written(df, name)
    finally:
        _made.reset(before)


def dropped(table: DataFrame) -> None:
    """Deletes a table that `written` gave and that nothing reads any more."""
    path = table.inputFiles()[0].rsplit("/", 1)[0] if table.inputFiles() else None
    if path:
        files, at = _folder(table.sparkSession, path)
        files.delete(at, True)


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df, written, with `part`: every row of a part comes before those of the next in `order`; rows that tie share a part."""
    return written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with `part` and `nth`, from 0 in `order` within `by` (columns without nulls).

    Ranges of rows are numbered each by itself and start where the counts of those before end, so a group that holds
    most rows is many tasks' work.
    """
    parts = in_ranges(df, [*map(F.col, by), *order])
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(*by, "part").agg(F.count("*").alias("c")).select(*by, "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(*by, "part").orderBy(*order)
    return parts.join(starts, [*by, "part"]).withColumn("nth", F.col("start") + F.row_number().over(within) - 1).drop("start")


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod modulus: the split between learning and held-out rows. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % F.lit(modulus)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most max_rows labelled rows of docs, the same rows for the same ids at every run.

    Only ids are ordered and cut; their texts follow by a join with those at most max_rows ids.
    Rows whose label is null are left out; of an id with several labels the smallest counts, of one with several texts the first by order.
    """
    there = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
        .join(there, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # max_rows bounds the broadcast side: a documented parameter of each caller, some 20 bytes a row
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def joined(rows: DataFrame, ones: DataFrame, on: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows joined with ones, which has one row for each value of `on`; the table to drop once the join is written).

    ones is written first. Were it an aggregate in the join's own stage, Spark could not split a value that most rows
    have; with two plain shuffles AQE does, and rows is to be a written table too.
    """
    held = written(ones, "ones")
    return rows.join(held, on), held


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Alternates large-star and small-star rounds over the edge table until it no longer changes. Each round is
    two min-aggregations (combined before the shuffle) and two joins on a node (`joined`), which split where one node
    has most of the edges; its result is written to the shared folder. Self links count as nodes of their own.
    """
    def linked(e: DataFrame) -> DataFrame:
        return e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = written(linked(edges), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met, least = joined(both, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "a")
        large = written(linked(met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "edges")
        met, low = joined(large, large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        before, now = now, written(linked(small), "edges")
        last, seen = seen, mark(now)
        for gone in (before, least, large, low):
            dropped(gone)
        if last == seen:
            break
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
