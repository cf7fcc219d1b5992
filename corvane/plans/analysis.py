"""Analysing repositories: from source files to files, functions, edges and vectors, published as whole versions.

A version's tables are written to folders of their own; only when all are there, one row in `published` makes it the
repository's. Readers take the newest published version, so a run that fails, or is still going on, changes nothing for
them, and versions being read stay. A repository whose files haven't changed keeps its version. Of one that has, only
files with new content are parsed; rows of the others are taken from the version before.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import embedding, extraction
from corvane.scratch import stored
from corvane.sources import repository, vector_store

PUBLISHED = "repo_id string, version string, number long, name string, url string, root_path string, file_count long, function_count long, dependency_edges long"
TABLES = ("files", "functions", "edges", "vectors")


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The newest published version of every repository."""
    try:
        rows = spark.read.schema(PUBLISHED).parquet(f"{folder}/published")
    except AnalysisException:
        rows = spark.createDataFrame([], PUBLISHED)
    fields = [c.split()[0] for c in PUBLISHED.split(", ")]
    return rows.groupBy("repo_id").agg(F.max_by(F.struct(*fields), "number").alias("p")).select("p.*")


def current(spark: SparkSession, folder: str, repo_id: str) -> dict | None:
    row = published(spark, folder).where(F.col("repo_id") == repo_id).first()
    return row.asDict() if row else None


def read(spark: SparkSession, folder: str, repo_id: str, name: str) -> DataFrame | None:
    """A table of the repository's published version; None if it has none."""
    at = current(spark, folder, repo_id)
    return at and spark.read.parquet(f"{folder}/versions/{at['version']}/{name}")


def records(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(record_id, text) of every file, and of every function's lines; a place named twice is one record."""
    lines = F.split("content", "\n")
    own = functions.join(files.select(F.col("path").alias("file_path"), "content"), "file_path")
    part = own.select(F.concat("file_path", F.lit(":"), "start_line", F.lit("-"), "end_line").alias("record_id"), F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("text"))
    return files.select(F.col("path").alias("record_id"), F.col("content").alias("text")).unionByName(part.dropDuplicates(["record_id"]))


def analyse(spark: SparkSession, folder: str, repo: dict, provider: str = "hash", providers: dict | None = None) -> dict:
    """Analyses the files below repo["root_path"] and publishes them; the published row, with `parsed`, the files parsed anew."""
    repo_id, before = repo["repo_id"], current(spark, folder, repo["repo_id"])
    files = stored(repository.scan(spark, repo["root_path"], repo_id).withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256)), "scanned")
    at = f"{folder}/versions/{uuid.uuid4().hex}"
    if before:
        old = f"{folder}/versions/{before['version']}"
        known = spark.read.parquet(f"{old}/files").select("path", "hash")
        same = stored(files.join(known, ["path", "hash"], "left_semi").select("path"), "unchanged")
        new = files.join(same, "path", "left_anti")
        parsed = new.count()
        if not parsed and known.count() == same.count():
            return before | {"parsed": 0}
        keep = lambda name, path: spark.read.parquet(f"{old}/{name}").join(same.withColumnRenamed("path", path), path, "left_semi")
        functions = extraction.functions(new).unionByName(keep("functions", "file_path"))
        edges = extraction.import_edges(new).unionByName(keep("edges", "source"))
    else:
        parsed, functions, edges = files.count(), extraction.functions(files), extraction.import_edges(files)
    files.write.parquet(f"{at}/files")
    functions.write.parquet(f"{at}/functions")
    edges.write.parquet(f"{at}/edges")
    written = {name: spark.read.parquet(f"{at}/{name}") for name in ("files", "functions", "edges")}
    embedded = embedding.embedded(records(written["files"], written["functions"]), provider=provider, providers=providers).drop("text")
    vector_store.blocks(embedded, "record_id").write.parquet(f"{at}/vectors")
    counts = [written[name].count() for name in ("files", "functions", "edges")]
    row = {"repo_id": repo_id, "version": at.rsplit("/", 1)[1], "number": (before["number"] if before else 0) + 1, "name": repo.get("name", ""), "url": repo.get("url", ""), "root_path": repo["root_path"], "file_count": counts[0], "function_count": counts[1], "dependency_edges": counts[2]}
    spark.createDataFrame([row], PUBLISHED).coalesce(1).write.mode("append").parquet(f"{folder}/published")
    return row | {"parsed": parsed}


def follow(requests: DataFrame, folder: str, checkpoint: str, **options):
    """Analyses in the background: every repository named in a stream of (repo_id, root_path, name, url), batch by batch.

    A batch that is run again finds its repositories unchanged and publishes nothing new.
    """

    def batch(rows: DataFrame, _: int) -> None:
        latest = rows.groupBy("repo_id").agg(F.max_by(F.struct("repo_id", "root_path", "name", "url"), "root_path").alias("r")).select("r.*")
        for r in latest.toLocalIterator():  # one request after another; each is a job of its own
            analyse(rows.sparkSession, folder, r.asDict(), **options)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
