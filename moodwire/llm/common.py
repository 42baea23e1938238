"""Helpers the operators of this folder share: landed tables, packages on workers, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodwire.session import ship_package

#: Rows of one Arrow batch: with texts of a megabyte a batch stays in the hundreds of megabytes.
ARROW_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Batches of bounded size, and this package on the Python workers of every executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``; a local master may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: survives the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a landed table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the component's smallest node.

    Alternating stars: each round points every node and its neighbours to the smallest node it
    knows. Rows stay linear in the edges, minima are combined before the shuffle, and no list of
    neighbours is ever built, so a node with millions of edges is an ordinary skewed join key.
    Each round is landed; rounds grow with the logarithm of the longest chain.
    """
    now = landed(_stars(edges.where("a <> b").select("a", "b").distinct()), "stars")
    state = _state(now)
    while state[0]:
        after = landed(_stars(now), "stars")
        reached = _state(after)
        forget(now)
        now = after
        if reached == state:
            break
        state = reached
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    )  # every larger neighbour points to the smallest node around
    large = large.where("a <> b")
    small = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(small, "a")
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    found = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return found[0], found[1]
