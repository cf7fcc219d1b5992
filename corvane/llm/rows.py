"""Row-wise text operators: Arrow batches in, the rows they belong to and computed columns out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES, BATCH_BYTES = 4 << 20, 8 << 20


def slices(batch: pa.RecordBatch, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about `limit` bytes (one row at least): what a worker handles at once."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if n and not pa.types.is_null(texts.type) else np.zeros(n)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def bounded(spark: SparkSession) -> None:
    """From now on Arrow batches between the JVM and its workers hold BATCH_BYTES at most; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


Make = Callable[[], Callable[[list], Sequence]]


def name(c: str) -> Column:
    """The column of just this name, dots included."""
    return F.col("`" + c.replace("`", "``") + "`")


def map_text(df: DataFrame, make: Make, fields: str, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """A struct `row` of the carried columns (all, unless named) and the computed `fields` (DDL), for each input row.

    make() runs once per task and returns the function that turns a list of texts (UTF-8 bytes or None) into one
    sequence per field. Input columns stay inside `row`, so their names can't clash with those of the fields.
    """
    bounded(df.sparkSession)
    carry = list(df.columns if carry is None else carry)
    inside = text in carry
    rows = df.select(F.struct(*[name(c) for c in carry]).alias("row"), *([] if inside else [name(text).cast("string").alias("text")]))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType, True), *T._parse_datatype_string(fields).fields])
    types = [f.dataType for f in schema.fields[1:]]
    at = carry.index(text) if inside else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        fn, arrow = make(), [to_arrow_type(t) for t in types]
        for whole in batches:
            for batch in slices(whole, whole.column(0).field(at) if inside else whole.column(1)):
                row = batch.column(0)
                col = row.field(at) if inside else batch.column(1)
                if pa.types.is_null(col.type):
                    col = col.cast(pa.string())
                got = fn(col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist())
                cols = [g if isinstance(g, pa.Array) else pa.array(g, type=t) for g, t in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([row, *cols], names=["row", *[f.name for f in schema.fields[1:]]])

    return rows.mapInArrow(run, schema)
