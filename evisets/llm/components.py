"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisets.llm.common import stored


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node but the roots, and the smallest node of its component.

    ``links`` has two columns of one orderable type; direction, repeats and self links don't matter, rows with a null are ignored; an empty
    table gives an empty one. Each round replaces the links by stars around ever smaller nodes and ends when nothing changes; links are only
    grouped and joined, never gathered. A node with very many links is a skewed join key, which adaptive execution splits.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    e = stored(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    while before != (now := fingerprint(e)):
        before = now
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
