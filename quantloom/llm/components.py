"""Connected components of a graph given as edges, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id of the edges (a, b). Each round takes the
    smallest of an id's label, its neighbours' labels and its label's label, so that long chains halve; it
    ends when no label changes. Nothing is gathered: neighbours meet in a partial minimum."""
    one = written(edges.filter("a is not null and b is not null and a <> b").select("a", "b"), "edges")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    table = labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels", light=True)
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        own = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = labels.join(near, "id", "left").join(own, "component", "left")
        new = new.select("id", F.col("component").alias("old"), F.least("component", "m", "further").alias("component"))  # nulls are skipped
        new = written(new, "labels", light=True)
        discard(table)
        table, labels = new, new.select("id", "component")
        if new.filter("old <> component").isEmpty():
            discard(one)
            return labels
