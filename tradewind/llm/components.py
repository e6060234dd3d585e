"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the links (a, b: long); root is the smallest node of the component.

    Large-star and small-star rounds: each hangs neighbours on the smallest neighbour, so that the links shrink to a star per
    component in few rounds. Each round is written, so lineage stays short. Null ends and loops are ignored.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    # A node keeps its smallest neighbour and links the others to each other in order: many of these links are the same.
    before = F.lag("b").over(Window.partitionBy("a").orderBy("b"))
    edges = edges.withColumn("p", before).select(F.when(F.col("p").isNull(), F.col("a")).otherwise(F.col("b")).alias("a"), F.coalesce("p", "b").alias("b"))
    edges = materialize(edges.distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(edges.join(least, "a").select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = materialize(small.filter("a > b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
