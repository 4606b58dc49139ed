"""Connected components of a table of links, by large-star and small-star steps.

Each step joins no two large tables: the smallest neighbour of every node is a grouped minimum with map-side
combination, and links are rewritten towards it. After few steps every node is linked to the smallest of its
component alone. Links are written to the shared folder after each step, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.rows import shared_table


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a`` and ``b``, bigint): the smallest node reachable.

    Null ends and links of a node to itself are dropped. Repeated links are one.
    """
    edges = shared_table(oriented(links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))))
    while True:
        before = state(edges)
        edges = shared_table(small_star(large_star(edges)))
        if state(edges) == before:
            break
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()


def oriented(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def state(edges: DataFrame) -> tuple:
    """Count and digest of the set of links, independent of their order."""
    mark = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def with_least(pairs: DataFrame) -> DataFrame:
    """Pairs ``(node, other)`` with the least of each node and its others.

    The least is a grouped minimum, written before it is joined back: with a table on that side, and not an
    aggregate that already has the join's distribution, the rows of a node with very many others can be split.
    """
    least = pairs.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    return pairs.join(shared_table(least), "node")


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the least of the node's neighbourhood."""
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    )
    return with_least(both).filter("other > node").select(F.col("other").alias("hi"), F.col("m").alias("lo")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of these."""
    linked = with_least(edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")))
    moved = linked.filter("other > m").select(F.col("other").alias("hi"), F.col("m").alias("lo"))
    own = linked.filter("other = m").select(F.col("node").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(own).distinct()
