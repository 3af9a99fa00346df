"""Connected components by alternating large and small stars, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import join_groups
from millrace.storage import drop_path, materialize, tidy


def _starred(edges: DataFrame, name: str) -> DataFrame:
    """Edges (u, v) with u's least neighbour m and its number of edges."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-least")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_groups(edges, least, ["u"], "n", total)


@tidy
def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) of longs in any order. Returns (node, label) for every node of an edge; label is the least node it is linked with.

    A round halves the distance to the least node at least, so rounds grow with the logarithm of a component's width.
    Hubs are joined by broadcast of one row each, so no task gets all edges of a node.
    """
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
        if state == before or not state[0]:
            break
        before = state
        both = materialize(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges-both")
        large = materialize(_starred(both, "large").withColumn("m", F.least("u", "m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges-large")
        small = _starred(large, "small")
        last = now
        now = materialize(small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")
        for old in (both, large, last):
            if files := old.inputFiles():
                drop_path(now.sparkSession, files[0].rsplit("/", 1)[0])
    stars = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return materialize(stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "components")
