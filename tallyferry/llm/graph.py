"""Connected components of an edge table by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyferry.llm.store import stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0L)")).first()
    return row[0], row[1]


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """Each neighbour of u is linked to the least of u's neighbourhood.

    The least comes from a plain aggregate, joined back: a hub's rows are never gathered in one place, and
    the adaptive skew join splits them.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if larger:
        joined = joined.where("v > u")
        links = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        links = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return links.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the edges; component is the least node reachable.

    Empty edges give no rows. Every round is written to the shared folder; the number of rounds grows with
    the logarithm of the longest chain.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        down = _stars(both, True)  # different pairs with u > v, as the least is below every v that is above u
        now = stored(_stars(down, False), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    leaves = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return leaves.unionByName(roots)
