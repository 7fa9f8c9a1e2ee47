"""Connected components of a table of links, by repeated contraction in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.shared import drop_stored, stored, stored_rows


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """``links``: two columns a, b (long, not null). Returns node, root: one row per node that is in a link.

    Nodes have the same root if and only if links join them; which node is the root is arbitrary. Each round every node
    takes the node of the least seeded hash within two links of it (itself included), links are rewritten to what their
    ends took, and loops and repeats go. A star ends in one round. A random order makes a constant share of the nodes
    disappear each round whatever the shape, a long chain too, so the rounds grow with the logarithm of the input. The
    least neighbours are partially aggregated minima and the joins have stored sides, which Spark may split, so a node
    with very many links is no single task. Only the counts of written rows reach the driver. An empty table gives no
    rows; loops add nothing; repeated links are allowed. ``most``: a bound of the links' number, if one is known.
    """
    now = stored(links.select("a", "b").where("a != b").distinct(), most=most)
    trail = []
    while left := stored_rows(now):
        key = lambda c: F.struct(F.xxhash64(F.lit(1 + len(trail)), c).alias("h"), F.col(c).alias("x"))
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        one = stored(both.groupBy("a").agg(F.min(key("b")).alias("m")).select(F.col("a").alias("b"), F.least("m", key("a")).alias("m")), most=2 * left)
        near = stored(both.join(one, "b").groupBy("a").agg(F.min("m")["x"].alias("to")).select(F.col("a").alias("node"), "to"), most=2 * left)
        trail.append(near)
        a, b = near.toDF("a", "ta"), near.toDF("b", "tb")
        then = now.join(a, "a").join(b, "b").where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        then = stored(then.distinct(), most=left)
        drop_stored(one)
        drop_stored(now)
        now = then
    if not trail:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).where("false")
    out = trail[-1].toDF("node", "root")
    for near in reversed(trail[:-1]):  # a node took "to"; that node's own root is known, or it is a root itself
        step = near.join(out.toDF("to", "root"), "to", "left")
        out = step.select("node", F.coalesce("root", "to").alias("root"))
    return stored(out, most=stored_rows(trail[0]))
