"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage


def star_step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b) with a > b; what was connected stays connected.

    The large star has at most a row an edge, so only the result is made distinct.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("n")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("n").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("n > u").join(least, "u").select(F.col("n").alias("a"), F.col("m").alias("b"))
    small = large.groupBy("a").agg(F.min("b").alias("m"))
    hooked = large.join(small, "a").select("m", F.explode(F.array("a", "b")).alias("a"))
    return hooked.where("a != m").select("a", F.col("m").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Columns (node, component) for every node with a link; the component is its smallest node.

    ``links`` has columns (a, b) of type long. Alternating star steps turn each
    component into a star around its smallest node, in about as many rounds as the
    logarithm of its diameter. A round is joins and aggregates with partial sums
    before the shuffle; its result is written to the shared folder, so a lost
    executor costs one round. A node with many links is a hot join key, which the
    adaptive skew join splits.
    """
    return star_components(stage(
        links.where("a != b and a is not null and b is not null")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    ))


def star_components(edges: DataFrame) -> DataFrame:
    """The same for written, distinct edges (a, b) with a > b, as ``star_step`` gives them."""
    mark = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark = tuple(found)
        edges = stage(star_step(edges), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
