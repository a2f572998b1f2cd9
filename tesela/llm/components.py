"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import join_counted, materialize, remove, work_path


def _star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """One step: neighbours are linked to the least node around; large takes greater neighbours, small the others.

    A hub's edges are never brought together: what is known of hubs is broadcast to them.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = join_counted(both, least, "a", "n", 2 * rows)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b: long); root is the component's least node.

    Each step is written to the shared folder, so that plans stay short and lost executors cost one step at most.
    Loops and repeated edges change nothing; without edges there are no nodes.
    """
    spark = edges.sparkSession
    path = work_path(spark, "components")
    current = materialize(edges.where("a != b").select("a", "b").distinct(), path)
    rows, sign = current.count(), None
    while rows:
        for large in (True, False):
            new_path = work_path(spark, "components")
            current = materialize(_star(current, rows, large), new_path)
            remove(spark, path)
            path = new_path
            now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            rows = now[0]
        if now == sign:
            break
        sign = now
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
