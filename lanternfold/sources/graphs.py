"""Graphs and large JSON reports on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The part of a report that holds the rankings; a reader that names it alone leaves the traces unparsed.
SOLUTIONS = "query_solutions array<struct<question: string, doc_indices: array<bigint>, doc_scores: array<double>>>"


def save_graph(edges: DataFrame, path: str, nodes: DataFrame | None = None) -> None:
    """Edges (src, dst, ...) and, if given, nodes as Parquet under ``path``, in place of what was there."""
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    if nodes is not None:
        nodes.write.mode("overwrite").parquet(f"{path}/nodes")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a saved graph; without saved nodes, the ends of the edges (id)."""
    edges = spark.read.parquet(f"{path}/edges")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/nodes")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.parquet(f"{path}/nodes"), edges
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges


def read_solutions(spark: SparkSession, path: str) -> DataFrame:
    """The rankings of reports in JSON (one to a file): question, place, doc, score, rank. Other fields are skipped by the reader."""
    rows = spark.read.schema(SOLUTIONS).option("multiLine", True).json(path).select(F.posexplode("query_solutions").alias("place", "s"))
    pairs = rows.select("place", "s.question", F.posexplode(F.arrays_zip("s.doc_indices", "s.doc_scores")).alias("rank0", "d"))
    return pairs.select("question", F.col("place").cast("long").alias("place"), F.col("d.doc_indices").alias("doc"), F.col("d.doc_scores").alias("score"), (F.col("rank0") + 1).cast("long").alias("rank"))
