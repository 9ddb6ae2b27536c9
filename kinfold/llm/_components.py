"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.graph import star_roots


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of ``edges`` (a, b) that has a link.

    Links, nodes and roots stay in tables; only a count and a checksum reach the driver.
    """
    roots = star_roots(edges)
    tops = roots.select(F.col("root").alias("node")).distinct()
    return roots.unionByName(tops.select("node", F.col("node").alias("root")))
