"""P11 (error taxonomy), P12/P13 (error labels) and A7 (attempt resolution).

``attempts(page_id, attempt, outcome, error_message, ts)``: ``outcome`` is the bucket an
attempt returned (possibly an ``error: ...`` string) or null when the attempt raised
``error_message``. Resolution is one aggregation by page (partial aggregation first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navbuckets.operators.judge import url_only_verdicts

# Taxonomy markers (lower-case substrings, tested in this order) and labels.
TIMEOUT_MARKERS = ["timeout", "timed out"]
INVALID_URL_MARKERS = ["dns_probe_finished_nxdomain", "unknown_error"]
RENDERER_MARKERS = ["receiving message", "renderer"]
LABEL_TIMEOUT = "error: timeout"
LABEL_INVALID = "error: invalid_url"
LABEL_LOAD_FAILED = "error: page_load_failed"
LABEL_CRASHED = "error: driver_crashed"
LABEL_MAX_RETRIES = "error: timeout_max_retries"
LABEL_UNKNOWN = "error: unknown"
PARTIAL = "partial"
MAX_ATTEMPTS = 3
ERROR_PREFIX = "error: "
ERROR_MSG_CAP = 50


def _any(msg: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | msg.contains(w)
    return out


def error_status(message: Column, stop_failed: Column | None = None, handler_failed: Column | None = None) -> Column:
    """Status of a page-load exception: 'partial' (go on with the partial page) or an error label."""
    m = F.lower(F.coalesce(message, F.lit("")))
    stop_failed = stop_failed if stop_failed is not None else F.lit(False)
    handler_failed = handler_failed if handler_failed is not None else F.lit(False)
    return (F.when(handler_failed, F.lit(LABEL_CRASHED))
            .when(_any(m, TIMEOUT_MARKERS), F.when(stop_failed, F.lit(LABEL_TIMEOUT)).otherwise(F.lit(PARTIAL)))
            .when(_any(m, INVALID_URL_MARKERS), F.lit(LABEL_INVALID))
            .when(_any(m, RENDERER_MARKERS), F.lit(PARTIAL))
            .otherwise(F.lit(LABEL_LOAD_FAILED)))


def error_label(message: Column) -> Column:
    """P13: 'error: ' + the first 50 characters of the message; without a message 'error: unknown'."""
    return F.when(message.isNull(), F.lit(LABEL_UNKNOWN)).otherwise(
        F.concat(F.lit(ERROR_PREFIX), F.substring(message, 1, ERROR_MSG_CAP)))


def is_error(bucket: Column, worker: bool = True) -> Column:
    """P12: 'error:' prefix (worker) or 'error' prefix (summary)."""
    return bucket.startswith("error:" if worker else "error")


def resolve_attempts(attempts: DataFrame, verdicts: DataFrame | None = None, silence: str | None = None) -> DataFrame:
    """Per page the first successful outcome among the first three attempts; otherwise the
    URL-only judge verdict; otherwise 'error: timeout_max_retries' when the last attempt
    returned an error, or 'error: ' + message[:50] when it raised ('error: unknown' without one).

    ``silence`` ends a page's run after so long a time without an attempt (by ``ts``): a later attempt
    begins another run with a row of its own, told apart by ``started``, its first ``ts``.

    Output: page_id, bucket, bucket_source, n_attempts, last_error[, started].
    """
    a = attempts.filter(F.col("attempt") <= MAX_ATTEMPTS)
    ok = F.col("outcome").isNotNull() & ~is_error(F.col("outcome"))
    last_err = F.when(F.col("outcome").isNotNull(), F.col("outcome")).otherwise(F.col("error_message"))
    runs = [] if silence is None else [F.session_window("ts", silence).alias("run")]
    started = [] if silence is None else [F.col("run.start").alias("started")]
    g = a.groupBy("page_id", *runs).agg(
        F.min(F.when(ok, F.struct("attempt", "outcome")))["outcome"].alias("success"),
        F.min(F.when(ok, F.col("attempt"))).alias("success_attempt"),
        F.max(F.struct("attempt", F.col("outcome").isNull().alias("raised"), "error_message",
                       last_err.alias("err"))).alias("last"),
        F.count(F.lit(1)).cast("int").alias("n_attempts"),
    )
    if verdicts is not None:
        g = g.join(url_only_verdicts(verdicts).select("page_id", "judge_bucket", "judge_source"), "page_id", "left")
    else:
        g = g.select("*", F.lit(None).cast("string").alias("judge_bucket"),
                     F.lit(None).cast("string").alias("judge_source"))
    last = F.col("last")
    failed_bucket = F.when(last["raised"], error_label(last["error_message"])).otherwise(F.lit(LABEL_MAX_RETRIES))
    bucket = (F.when(F.col("success").isNotNull(), F.col("success"))
              .when(F.col("judge_bucket").isNotNull(), F.col("judge_bucket"))
              .otherwise(failed_bucket))
    source = (F.when(F.col("success").isNotNull(), F.concat(F.lit("attempt "), F.col("success_attempt").cast("string")))
              .when(F.col("judge_bucket").isNotNull(), F.col("judge_source")).otherwise(F.lit("error")))
    return g.select("page_id", bucket.alias("bucket"), source.alias("bucket_source"), "n_attempts",
                    F.when(F.col("success").isNull(), last["err"]).alias("last_error"), *started)
