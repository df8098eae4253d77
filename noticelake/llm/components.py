"""Connected components of a link table, by hooking roots and contracting what was joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import discard, stored


def _both(links: DataFrame) -> DataFrame:
    """Each link from either of its ends."""
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hooked(links: DataFrame, turn: int) -> DataFrame:
    """(node, up): each node's neighbour of the best rank where that is better than its own, else itself.

    Many links make a good rank, so that a hub takes its whole star at once;
    among equals a hash that is drawn anew each round decides, so that at least
    every second node can be expected to find a better one, whatever the ids.
    """
    rank = _both(links).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    rank = stored(rank.select("node", F.struct((-F.col("links")).alias("few"), F.xxhash64("node", F.lit(turn)).alias("draw"), "node").alias("rank")))
    near = _both(links).join(rank.select(F.col("node").alias("b"), "rank"), "b").groupBy(F.col("a").alias("node")).agg(F.min("rank").alias("best"))
    up = stored(rank.join(near, "node").select("node", F.least("rank", "best")["node"].alias("up")))
    discard(rank)
    return up


def _jumped(up: DataFrame) -> DataFrame:
    """(node, up) with every node's root instead of its parent: each step follows twice as many parents."""
    while True:
        far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        new = stored(up.join(far, "up").select("node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")))
        discard(up)
        up = new
        if up.where("moved").isEmpty():
            return up


def _distinct(links: DataFrame) -> DataFrame:
    """Each link once, from its smaller end; loops go."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, component): the smallest node reachable, for every node with a link.

    A round hooks the roots that are left to neighbouring ones, finds each
    tree's root by pointer jumping, and keeps only links between different roots,
    each once; links fall by a constant share each round, so chains of any
    length need rounds in proportion to the logarithm of theirs.  Rounds pre-aggregate
    before they shuffle, which keeps nodes with very many links apart, and
    remove the tables of the round before.  Empty links give no rows; loops and
    repeated links do no harm.
    """
    whole = links.where("a is not null and b is not null").select("a", "b")
    nodes = stored(_both(whole).select(F.col("a").alias("node")).distinct())
    left, steps = stored(_distinct(whole)), []
    while not left.isEmpty():
        up = _jumped(_hooked(left, len(steps)))
        root = lambda end: up.select(F.col("node").alias(end), F.col("up").alias(f"{end}_root"))  # noqa: E731, B023
        apart = left.join(root("a"), "a").join(root("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        steps.append(up.select("node", "up"))
        done, left = left, stored(_distinct(apart))
        discard(done)
    # a node's last root, from the last round back: each table holds the roots that its round still had
    last = None
    for up in reversed(steps):
        last = up if last is None else up.join(last.select(F.col("node").alias("up"), F.col("up").alias("last")), "up", "left").select("node", F.coalesce("last", "up").alias("up"))
        last = stored(last)
    if last is None:
        return nodes.select("node", F.col("node").alias("component"))
    least = last.groupBy("up").agg(F.min("node").alias("component"))
    named = last.join(least, "up").select("node", "component")
    return stored(nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def extended(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components of what ``known`` (node, component) came from and further links: only links between different components are looked at, as links of these."""
    whole = links.where("a is not null and b is not null").select("a", "b")
    of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    between = whole.distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    joined = components(stored(_distinct(between))).select(F.col("node").alias("component"), F.col("component").alias("lowest"))
    new = _both(whole).select(F.col("a").alias("node")).distinct().join(known.select("node"), "node", "left_anti")
    every = known.select("node", "component").unionByName(new.select("node", F.col("node").alias("component")))
    return stored(every.join(joined, "component", "left").select("node", F.coalesce("lowest", "component").alias("component")))
