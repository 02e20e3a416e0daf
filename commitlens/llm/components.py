"""Connected components of a graph of long ids, by alternating stars.

Each round links every vertex to the least vertex near it; chains halve, so the number
of rounds grows with the logarithm of a component's size.  Rounds are written to the
shared folder, which cuts lineage; the round before is deleted.  A hub is a key with many rows but a minimum is
partially aggregated, and joins with it are equi-joins that Spark can split.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.session import Rounds


def _large_star(edges):
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges):
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _clean(edges):
    return edges.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of ``edges(u, v)``; the root is the least vertex.

    Nulls and loops link nothing; repeated edges count once; no edges give no rows.  Other columns are left behind.
    """
    rounds = Rounds("edges")
    edges = rounds.put(_clean(edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull()).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    before = None
    while True:
        edges = rounds.put(_clean(_small_star(_clean(_large_star(edges)))))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    )
