"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashrisk.session import scratch_path


#: Whether the shuffle files of a query go when it ends; what was written does not need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read again, which cuts the lineage; the shuffle files behind it go at once.

    With ``by`` each value of that column gets a folder of its own, so that a filter on it reads no others.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.select("*").write  # planned anew, under the setting
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    # folders by value may be none at all, and then tell no columns
    table = (spark.read.schema(df.schema) if by else spark.read).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Remove stored tables that nothing reads any more."""
    for table in tables:
        if table is not None:
            java = table.sparkSession._jvm
            path = java.org.apache.hadoop.fs.Path(table.stored_at)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of links as stars round its smallest nodes: fewer links, same components."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right = ends[:len(a)], ends[len(a):]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[left], root[right])
            new = root.copy()
            np.minimum.at(new, root[left], low)
            np.minimum.at(new, root[right], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        off = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.record_batch([pa.array(nodes[off]), pa.array(nodes[root[off]])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """A stored table (node, label) of every node of the links (a, b), label being the component's smallest node.

    Both are 64-bit integers; nulls and self-links are ignored. Every round is two
    joins of equal keys; links only ever shrink towards stars, and no component is
    held in one task.
    """
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = stored(edges.mapInArrow(_forests, "a long, b long").distinct(), "links")
    table, before = edges, None
    while True:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        edges = both.where("b > a").join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        shorter = stored(
            edges.join(low, "a").select(F.expr("inline(array(struct(b AS a, low AS b), struct(a AS a, low AS b)))"))
            .where("a <> b").distinct(), "links")
        discard(table)
        table = edges = shorter
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if tuple(state) == before:
            labels = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), "labels")
            discard(table)
            return labels
        before = tuple(state)
