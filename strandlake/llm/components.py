"""Connected components of a graph of links, in rounds of joins and minima."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.lookup import BROADCAST_ROWS, lookup
from strandlake.sources.store import materialize

EDGES_A_TASK = 10_000  # of a graph that is small enough to be broadcast


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``: the smallest node that it is connected with.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then its smaller ones, to the smallest
    node it sees. The number of rounds grows with the logarithm of the longest chain. A node with a large share of all links
    is only ever a key of minima and of salted joins. Once few edges are left they are worked on in few tasks and written to few
    files, as rounds over a file for each shuffle partition take longer than their rows.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before, few = state, state["n"] <= BROADCAST_ROWS  # minima are at most two to an edge

        def gathered(rows: DataFrame) -> DataFrame:
            return rows.coalesce(1 + state["n"] // EDGES_A_TASK) if few else rows

        def hand(rows: DataFrame) -> DataFrame:
            rows = gathered(rows)
            low = gathered(rows.groupBy("a").agg(F.min("b").alias("low"))).select("a", F.least("a", "low").alias("low"))
            return rows.join(F.broadcast(low), "a") if few else lookup(rows, low, "a", "b")

        large = hand(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b")
        small = hand(large if few else materialize(large.distinct(), "links"))
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b")))
        edges = materialize(gathered(gathered(small.filter("a != b")).distinct()), "links")
    root = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.unionByName(gathered(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
