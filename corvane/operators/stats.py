"""Analytics over a query log: (repo_id, agents, latency_ms, citations, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.scratch import small

# Upper bounds of the latency histogram, in seconds.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
SKETCH = 100_000  # a quantile sketch errs by at most one part in so many


def session(log: DataFrame) -> DataFrame:
    """One row: number of queries, mean latency and mean citations to one place; zeros if there are none."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 1), F.lit(0.0))
    return log.agg(F.count("*").alias("total_queries"), mean("latency_ms").alias("avg_latency_ms"), mean("citations").alias("avg_citations"))


def p95(log: DataFrame, by: str, whole: int = 200_000) -> DataFrame:
    """The latency at place min(floor(0.95 n), n - 1), counted from 0, in each group's ascending order.

    Exact, and without sorting a group of over `whole` rows: quantile sketches, which tasks merge, bound the value from
    both sides; rows below the bounds are only counted, and the few between them are ordered. Null latencies don't
    count; a null group is a group.
    """
    some = log.where("latency_ms is not null")
    around = F.percentile_approx("latency_ms", [0.95 - 3 / SKETCH, 0.95 + 3 / SKETCH], SKETCH)
    ends = small(some.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n"), around.alias("e")), "ends")
    near = some.join(ends, F.col(by).eqNullSafe(F.col("_by")))
    all_ = F.col("n") <= whole
    near = near.where(all_ | (F.col("latency_ms") <= F.col("e")[1])).withColumn("v", F.when(all_ | (F.col("latency_ms") >= F.col("e")[0]), F.col("latency_ms")))
    counts = near.groupBy(by, "n", "v").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(by).orderBy("v"))  # what lies below comes first, as one row without value
    at = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    return counts.withColumn("upto", upto).where(F.col("upto") > at).groupBy(by).agg(F.min("v").alias("p95_ms"), F.first("n").alias("n"))


def agent_usage(log: DataFrame) -> DataFrame:
    """Per agent: invocations and the mean of the latency share each query gives it."""
    each = log.select(F.explode("agents").alias("agent"), (F.col("latency_ms") / F.greatest(F.size("agents"), F.lit(1))).alias("share"))
    return each.groupBy("agent").agg(F.count("*").alias("invocations"), F.round(F.sum("share") / F.count("*"), 1).alias("avg_ms"))


def histogram(log: DataFrame, by: str, seconds: str) -> DataFrame:
    """Cumulative buckets: rows (by, le, count), one pass, one row a group and bound."""
    sums = log.groupBy(by).agg(*[F.sum((F.col(seconds) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(BOUNDS)], F.count("*").alias("inf"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(BOUNDS)] + [F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("count"))]
    return sums.select(by, F.inline(F.array(*pairs)))


def latest(log: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows by the given columns."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)


def _label(**columns: str) -> Column:
    """{name="value",...} with backslashes, quotes and line feeds escaped."""
    escaped = {k: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")) for k, c in columns.items()}
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), v, F.lit('"')) for k, v in escaped.items()]), F.lit("}"))


def exposition(requests: DataFrame, counter: str = "requests_total", timer: str = "request_latency_seconds") -> DataFrame:
    """(place, line): requests (method, path, status, elapsed_s) as a counter and a histogram in the text format that
    scrapers read; order by place and line. Only the counts of label sets, never requests, reach the text."""
    n = requests.groupBy("method", "path", "status").agg(F.count("*").cast("double").alias("v"))
    buckets = histogram(requests, "path", "elapsed_s").select(F.concat(F.lit(f"{timer}_bucket"), _label(path="path", le="le"), F.lit(" "), F.col("count").cast("double")).alias("line"))
    totals = requests.groupBy("path").agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum("elapsed_s"), F.lit(0.0)).alias("s"))
    sums = totals.select(F.explode(F.array(*[F.concat(F.lit(f"{timer}_{k} ".rstrip()), _label(path="path"), F.lit(" "), F.col(c)) for k, c in (("count", "n"), ("sum", "s"))])).alias("line"))
    heads = [f"# HELP {counter} Requests by method, path and status.", f"# TYPE {counter} counter", f"# HELP {timer} Seconds that requests took.", f"# TYPE {timer} histogram"]
    head = requests.sparkSession.createDataFrame([(0, heads[0]), (1, heads[1]), (3, heads[2]), (4, heads[3])], "place int, line string")
    counted = n.select(F.lit(2).alias("place"), F.concat(F.lit(counter), _label(method="method", path="path", status="status"), F.lit(" "), F.col("v")).alias("line"))
    return head.union(counted).union(buckets.select(F.lit(5), "line")).union(sums.select(F.lit(6), "line"))
