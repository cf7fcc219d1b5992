"""Import and link graphs: edges, nodes, degrees, neighbours, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T

HREF = 'href="([^"]+)"'


def links(pages: DataFrame) -> DataFrame:
    """(source, target): distinct link targets of each page."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))
    return pages.select(F.col("url").alias("source"), F.explode(found).alias("target"))


def edges(found: DataFrame) -> DataFrame:
    """A simple graph: each pair once."""
    return found.select("source", "target").distinct()


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("source").alias("node")).union(e.select(F.col("target").alias("node"))).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) by one aggregation over both ends."""
    ends = e.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def neighbours(e: DataFrame, node: str, direction: str = "inbound") -> DataFrame:
    """Targets of a node's edges for `outbound`; for anything else the sources of the edges into it."""
    out = e.where(F.col("source") == node).select(F.col("target").alias("neighbour")) if direction == "outbound" else e.where(F.col("target") == node).select(F.col("source").alias("neighbour"))
    return out.distinct()


def layered(e: DataFrame) -> DataFrame:
    """Edges with the layers of their ends."""
    return e.select("source", "target", T.layer(F.col("source")).alias("source_layer"), T.layer(F.col("target")).alias("target_layer"))


def path_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, parent, name, kind, depth): every folder above a path once, and the files."""
    parts = paths.select(F.split(path, "/").alias("p")).select("p", F.posexplode("p").alias("i", "name"))
    full = F.array_join(F.slice("p", F.lit(1), F.col("i") + 1), "/")
    parent = F.array_join(F.slice("p", F.lit(1), F.col("i")), "/")
    kind = F.when(F.col("i") == F.size("p") - 1, "file").otherwise("folder")
    return parts.select(full.alias("path"), parent.alias("parent"), "name", kind.alias("kind"), F.col("i").cast("long").alias("depth")).distinct()
