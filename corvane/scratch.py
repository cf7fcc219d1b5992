"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_ROWS, MOST_ROWS = 100_000, 1_000_000  # narrow rows that a task writes; tables of more are written by as many tasks as made them


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a folder of our own, which is then set, in local mode only."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/corvane/{tag}-{uuid.uuid4().hex}"


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most so many narrow rows, in no more tasks (and files) than TASK_ROWS ask for."""
    return df if rows > MOST_ROWS else df.coalesce(max(1, -(-rows // TASK_ROWS)))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: the plan behind it never runs again."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_parts(parts: Iterable[DataFrame], tag: str) -> DataFrame:
    """All rows of `parts` (one at least, of one schema), each written in turn, read back as one table: the plan stays one scan."""
    path = None
    for k, df in enumerate(parts):
        path = path or fresh(df.sparkSession, tag)
        df.write.parquet(f"{path}/part{k}")
    return df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a written table of our own that no plan reads any more."""
    own = f"{shared_dir(df.sparkSession)}/corvane/"
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(own).toUri().getPath().rstrip("/") + "/"):
            path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, tag: str, most: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """df as written, to be broadcast if it has at most `most` rows and its texts at most `most_bytes`."""
    df = stored(df, tag)
    texts = [F.octet_length(f"`{c}`") for c, kind in df.dtypes if kind in ("string", "binary")]
    if not texts:
        return F.broadcast(df) if df.count() <= most else df
    rows, size = df.agg(F.count("*"), F.sum(sum((F.coalesce(t, F.lit(0)).cast("long") for t in texts), F.lit(0).cast("long")))).first()
    return F.broadcast(df) if rows <= most and (size or 0) <= most_bytes else df
