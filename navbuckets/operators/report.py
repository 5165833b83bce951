"""A5 (run summary) and A6 (progress): one global aggregation each (partial per task)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(results: DataFrame, attempts: DataFrame | None = None, status_col: str = "status") -> DataFrame:
    """Total admitted URLs, 'successful' (non-null bucket not starting with 'error' -- so the
    admission labels count, as in the reference), errors, the two admission counts, and the
    elapsed time of the attempt log (whole seconds) and its average per admitted URL (ms).

    One aggregation over the union of both inputs (no join between the two summaries)."""
    r = results.select(F.col(status_col).alias("_status"), F.col("bucket").alias("_bucket"),
                       F.col("url_norm").alias("_url"), F.lit(None).cast("timestamp").alias("_ts"))
    if attempts is not None:
        r = r.unionByName(attempts.select(F.col("ts").cast("timestamp").alias("_ts")), allowMissingColumns=True)
    b = F.col("_bucket")
    s = r.agg(
        F.count_if(F.col("_status") == "admitted").alias("total_admitted"),
        F.count_if(b.isNotNull() & ~b.startswith("error")).alias("successful"),
        F.count_if(b.startswith("error")).alias("errors"),
        F.count_if(F.col("_status") == "invalid_url").alias("invalid_urls"),
        F.count_if(F.col("_status") == "duplicate_in_input").alias("duplicates"),
        F.count_distinct("_url").alias("distinct_urls"),
        (F.max("_ts").cast("double") - F.min("_ts").cast("double")).alias("_el"),
    )
    out = [c for c in s.columns if c != "_el"]
    if attempts is None:
        return s.select(*out)
    return s.select(*out, F.floor("_el").alias("elapsed_sec"),
                    F.when(F.col("total_admitted") > 0,
                           F.floor(F.col("_el") * 1000 / F.col("total_admitted"))).alias("avg_ms_per_url"))


def progress_count(results: DataFrame) -> DataFrame:
    """Rows with a bucket so far, and all rows."""
    return results.agg(F.count("bucket").alias("completed"), F.count(F.lit(1)).alias("total"))


def observe_progress(results: DataFrame, name: str = "progress"):
    """A6 as metrics: attach ``completed`` / ``total`` to the DataFrame's own run (no extra
    job). Returns ``(observed_df, observation)``; read ``observation.get`` after an action.
    On a stream use a string name and read ``query.lastProgress['observedMetrics']``."""
    from pyspark.sql import Observation

    obs = Observation(name)
    out = results.observe(obs, F.count("bucket").alias("completed"), F.count(F.lit(1)).alias("total"))
    return out, obs
