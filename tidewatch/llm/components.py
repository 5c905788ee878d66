"""Connected components by alternating stars, with a table written per step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_settled, settle


def _least(edges: DataFrame) -> DataFrame:
    """(node, least) over a node's neighbours and itself, of edges (node, other). Combined before the shuffle."""
    own = edges.groupBy(F.col("node").alias("centre")).agg(F.min("other").alias("least"))
    return settle(own.select("centre", F.least("centre", "least").alias("least")), "stars")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node, other))").alias("x")).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that links (a, b) name; the component is its smallest node.

    Each step hangs a node's larger neighbours on its smallest one (large star), then its smaller neighbours (small star),
    until nothing changes; long chains take a logarithmic number of steps. A node with very many links is
    one row in the table of smallest neighbours; the links themselves are joined to it by sort-merge joins that adaptive
    execution may split. Links to itself, repeated links and null ends count for nothing. The table returned is settled.
    """
    plain = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    edges = settle(plain.where("node IS NOT NULL AND other IS NOT NULL AND node <> other").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        least = _least(both)
        large = both.join(least.hint("merge"), F.col("node") == F.col("centre")).where("other > node")
        large = settle(large.select(F.col("other").alias("node"), F.col("least").alias("other")).where("node <> other").distinct(), "large")
        drop_settled(edges)
        below = _least(large)
        small = large.join(below.hint("merge"), F.col("node") == F.col("centre")).select("node", "other", "least")
        hung = small.select(F.col("other").alias("node"), F.col("least").alias("other")).union(
            below.select(F.col("centre").alias("node"), F.col("least").alias("other"))
        )
        edges = settle(hung.where("node <> other").distinct(), "links")
        for used in (least, large, below):
            drop_settled(used)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    out = edges.select("node", F.col("other").alias("component")).union(
        edges.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct()
    )
    done = settle(out, "components")
    drop_settled(edges)
    return done
