"""Connected components of a link table by alternating star contractions.

Each round is a handful of joins and aggregates on the remaining edges; the number
of rounds grows with the logarithm of the longest chain. Nodes with very many
links are reduced by partial aggregates and split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm._shared import durable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``id, root`` (smallest reachable id) for every non-smallest node of the links (a, b)."""
    pair = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = durable(pair.filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        state, last = _state(edges), state
        if state == last:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
