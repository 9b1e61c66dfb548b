"""Connected components of an edge table, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.sources.workdir import materialize


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest node among u and its partners in v. Partially aggregated, and stored,
    so that the join with it has both sides dealt for it alone and a hub's edges can be split."""
    near = edges.groupBy("u").agg(F.min("v").alias("m"))
    return materialize(near.select(F.col("u").alias("mu"), F.least("u", "m").alias("m")), "near")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _smallest(both)
    return (
        both.where("v > u")
        .join(near, F.col("u") == F.col("mu"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _smallest(down)
    tied = down.join(near, F.col("u") == F.col("mu")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    heads = near.select(F.col("mu").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(heads).where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node it reaches.

    edges: columns u and v of one orderable type, in any direction, repeated or not; an edge
    with a null end or with twice the same node says nothing and is left out. A hub is never
    gathered: each step is a partial aggregate and a join that adaptive execution can split.
    Rounds grow with the logarithm of a component's size. Each is written to the shared
    folder, which cuts the lineage; one count and one sum per round reach the driver.
    """
    now = edges.where("u is not null and v is not null and u <> v")
    now = materialize(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        digest = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if digest[0] == 0 or digest == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = digest
        now = materialize(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
