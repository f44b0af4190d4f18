"""Cut lineage in storage that every executor can read, so that a lost executor costs a re-read only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or else the folder given by setCheckpointDir().

    Only a local session without either, as in tests, gets a new local folder; elsewhere that is an error.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(path)
    # A local folder comes back as file:/..., which is no URI for other readers.
    return path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; for wide rows or rows made in Python.

    The files stay until the owner of that folder clears it: the result is read lazily.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; for narrow rows of loops. Spark's cleaner may remove its files."""
    folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """Mark a checkpointed list of keys for broadcast if it is counted to be short; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= most else df


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of the links (a, b) can reach.

    Every node hooks to its smallest smaller neighbour, the parent map is joined with itself until all paths end at
    their roots, and the links are renamed by it; links inside one root vanish. Of the nodes with a link
    left at most half are roots, so the rounds grow with the logarithm of their number. All groupings
    are partial sums of a minimum; no component is gathered.
    """
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = cut(links.distinct())
    result = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    result = result.select("id", F.col("id").alias("component"))
    while not links.isEmpty():
        parent = cut(links.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent")))
        while True:  # to the roots: paths halve
            up = parent.select(F.col("child").alias("parent"), F.col("parent").alias("up"))
            parent = cut(parent.join(up, "parent", "left").select("child", F.coalesce("up", "parent").alias("parent"), "up"))
            if parent.where("up is not null").isEmpty():
                break
            parent = parent.drop("up")
        parent = parent.drop("up")
        for end in ("a", "b"):
            renamed = parent.select(F.col("child").alias(end), "parent")
            links = links.join(renamed, end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = cut(links.distinct())
        renamed = parent.select(F.col("child").alias("component"), "parent")
        result = result.join(renamed, "component", "left").select("id", F.coalesce("parent", "component").alias("component"))
    return result
