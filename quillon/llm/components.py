"""Connected components of an undirected graph, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long and not null; nodes of one component share a root.

    Each round hooks every node to the neighbour of least priority (itself included) and contracts
    the edges to the hooks. In even rounds the node's own number is its priority, so stars around
    their least node end at once; in odd rounds it is a hash that changes from round to round, so
    chains shrink as well and the number of rounds grows with the logarithm of the nodes. No edges
    give no rows; loops and repeated edges do no harm.
    """
    hooks: list[DataFrame] = []
    edges = edges.where("a <> b")
    while True:
        n = len(hooks)
        priority = lambda c, n=n: F.struct((F.xxhash64(c, F.lit(n)) if n % 2 else c).alias("p"), c.alias("id"))
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        least = both.groupBy("node").agg(F.min(priority(F.col("other"))).alias("m"))
        hook = cut(least.select("node", F.least(priority(F.col("node")), F.col("m"))["id"].alias("root")))
        hooks.append(hook)
        smaller = cut(_contracted(edges, hook))
        if n:
            release(edges)
        edges = smaller
        if edges.isEmpty():
            break
    found = hooks.pop()
    while hooks:  # from the smallest round back to the first
        h = hooks.pop()
        found = cut(found) if len(hooks) % 4 == 3 else found  # plans of many joins take long to optimise
        found = h.alias("h").join(found.alias("f"), F.col("h.root") == F.col("f.node"), "left").select("h.node", F.coalesce("f.root", "h.root").alias("root"))
    return found


def _contracted(edges: DataFrame, hook: DataFrame) -> DataFrame:
    def root(df: DataFrame, c: str) -> DataFrame:
        return df.join(hook.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c)

    a, b = F.col("a_root"), F.col("b_root")
    return root(root(edges, "a"), "b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def star(members: Column, low: Column) -> Column:
    """Edges (a, b) from the least of a small set to its other members."""
    return F.transform(F.filter(members, lambda m: m != low), lambda m: F.struct(low.alias("a"), m.alias("b")))
