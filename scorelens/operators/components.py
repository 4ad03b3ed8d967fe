"""Connected components of an edge table by large-star / small-star contraction.

Each round replaces edges by edges to the smallest known neighbour (large
stars for the larger neighbours, small stars for the smaller ones) until
nothing changes; the number of rounds is logarithmic in practice, for paths
too, and there is no bound on it.  Every step is a group-by with map-side
minimum and a join, so no component is ever gathered in one task; the edges of
a hub are spread over salts for the join as well.  Rounds are
written under the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorelens.session import scratch_path

MIN_SALTS = 32


def _stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, "edges")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _with_least(edges: DataFrame, salts: int) -> DataFrame:
    """(a, b, m): each edge with the smallest ``b`` of its ``a``.

    The edges of a node are dealt over salts, so a hub's edges meet its minimum in as many
    tasks; what goes to one task is one row for each (node, salt).
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    part = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = part.select("a", "salt").join(part.groupBy("a").agg(F.min("m").alias("m")), "a")
    return salted.join(least, ["a", "salt"]).select("a", "b", "m")


def _large_star(edges: DataFrame, salts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (_with_least(both, salts).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .where("a != b").distinct())


def _small_star(edges: DataFrame, salts: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = _with_least(down, salts)
    return found.select(F.inline(F.array(F.struct(F.when(F.col("b") != F.col("m"), F.col("b")).alias("a"), F.col("m").alias("b")),
                                         F.struct(F.col("a"), F.col("m").alias("b"))))).where("a IS NOT NULL").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_labels(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): the smallest node of its component, for every node of an edge.

    Direction, repeats and loops do not matter; edges with a null end are
    ignored.  Nodes are of any one orderable type.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    all_ends = _stored(ends.distinct())
    now = all_ends.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    salts = max(MIN_SALTS, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    state = None
    while True:
        now = _stored(_small_star(_large_star(now, salts), salts))
        before, state = state, _state(now)
        if state == before or state[0] == 0:
            break
    nodes = all_ends.select(F.col("a").alias("node")).union(all_ends.select("b")).distinct()
    return (nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))
