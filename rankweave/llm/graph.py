"""Joins on keys that a large share of all rows may have, and connected components.

Components come by alternating large-star and small-star steps: each step is linear work on the
link table, and the number of steps grows with the logarithm of the longest chain.  Labels are
written after every round, so a lost executor never restarts the iteration, and nothing is
collected but totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store

#: A key is hot with more than HOT_ROWS rows and more than 1 / HOT of all; there are fewer than HOT such keys, whatever the data.
HOT, HOT_ROWS = 1024, 1000


def shuffled(small: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it shuffles also where it is small enough to be sent, so that small inputs take the path of large ones."""
    return small.hint("merge")


def attach(store: Store, big: DataFrame, small: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``big`` inner join ``small`` on ``key``, where ``small`` has each key once, with ``size``, its number of rows in ``big``.

    ``total`` is the number of rows of ``big``.  ``small`` is written first.  Its hot keys meet ``big``
    where that lies, by broadcast, and the others shuffle, so no task gets more than a few
    thousandths of the rows for one key.
    """
    small = store.put(small, "small")
    is_hot = (F.col(size) > HOT_ROWS) & (F.col(size) * HOT > total)
    hot = small.filter(is_hot).drop(size)
    if hot.isEmpty():
        return big.join(shuffled(small.drop(size)), key)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(shuffled(small.filter(~is_hot).drop(size)), key)
    return big.join(F.broadcast(hot), key).unionByName(rest)


def _are_stars(links: DataFrame) -> bool:
    larger = links.groupBy("a").agg(F.count("*").alias("n"))
    inner = larger.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return larger.filter("n > 1").union(inner).isEmpty()


def components(store: Store, links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node it reaches.

    An empty link table gives an empty result; loops (a = b) and repeated links change nothing.
    Any orderable type serves as a node.  The iteration ends when the links are stars around
    smallest nodes: every larger end has one link, and no smaller end is a larger one of another.
    """
    cur = store.put(links.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    count = cur.count()
    while not _are_stars(cur):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = attach(store, both, low, "a", "n", 2 * count).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = store.put(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = attach(store, large, low, "a", "n", large.count()).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # the node itself hangs on its smallest neighbour, its other neighbours do too
        nxt = store.put(small.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "star")
        for done in (cur, large):
            store.drop(done)
        cur, count = nxt, nxt.count()
    return store.put(cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()), "comps")
