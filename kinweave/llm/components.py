"""Connected components of a graph that no single machine need hold, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Edges beyond which an id is a hub, and the number of hubs that there may be: a hub has more than one in HUBS edges.
HOT_EDGES, HUBS = 1_000, 100_000


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges with a > b, each once; loops go."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _round(edges: DataFrame, hot: int) -> DataFrame:
    """A large star, then a small one. Minima are combined before the shuffle, and the neighbours of hubs (ids with more
    than `hot`) learn theirs by broadcast, so that a hub is no hot key."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = F.broadcast(low.filter(F.col("n") > hot).select("u", "m"))
    above = both.filter("v > u")
    met = above.join(hubs, "u").unionByName(above.join(hubs.select("u"), "u", "left_anti").join(low.select("u", "m"), "u"))
    large = _ordered(met.select(F.col("v").alias("a"), F.col("m").alias("b")))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(small.unionByName(low.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every id that has an edge, as a materialized table. edges: a, b of one integer
    type, any order. Stars meet in a number of rounds that grows with the logarithm of the ids; it ends when nothing moves."""
    now = materialize(_ordered(edges), "edges")
    state = _state(now)
    while state[0]:
        after = materialize(_round(now, max(HOT_EDGES, state[0] // HUBS)), "edges")
        new = _state(after)
        discard(now)
        now = after
        if new == state:
            break
        state = new
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = materialize(found.unionByName(found.select(F.col("component").alias("id"), "component").distinct()), "components")
    discard(now)
    return found


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("b", "a")).alias("x")).first()
    return r["n"], r["h"], r["x"]
