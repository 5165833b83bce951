"""Structured Streaming versions.

* T1 ``dedup_stream``: each normalized URL taken once (state by URL; optionally once per window);
  ``first_rows_stream``: the winning row of each URL, as in batch, however the rows arrive.
* T2 ``classify_stream``: the batch classifier on a stream of snapshots -- the evidence is a
  per-row projection, measurements/verdicts are stream-static joins.
* T3 ``resolve_attempts_stream``: attempts resolved as they arrive by the batch operator's own
  aggregation, in update mode: a page's row is emitted anew whenever an attempt changes it, so
  pages with one or two attempts have a row too and late attempts correct it.
  ``resolve_runs_stream`` ends a page's run after a stated silence instead: its row is emitted once,
  its state is given up, and attempts that come too late are counted (``late_rows``).
* T4 ``progress_stream``: per-micro-batch bucket counts, written idempotently by batch id.
* T5: restart = the checkpoint location; ``availableNow`` runs end by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from navbuckets.functions.urls import is_blank_url, normalize_url
from navbuckets.operators import attempts as att
from navbuckets.plans.classify import classify_pages
from navbuckets.session import ensure_dir, scratch_path

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def pages_stream(spark: SparkSession, sf_dir: str, bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """The driver's pages table, one file or a folder of files, as a file stream. A micro-batch takes files
    of about ``bytes_per_trigger`` in all: each one joins the whole static inputs, so their number must
    follow the bytes of the pages and not the number of files."""
    # as a pattern: a stream takes a plain path for a folder
    return (spark.readStream.schema(PAGES_SCHEMA).option("maxBytesPerTrigger", bytes_per_trigger)
            .parquet(f"{sf_dir.rstrip('/')}/pages.parque[t]"))


def file_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to_end(query_writer, sink: str | None, checkpoint: str):
    """Start with ``trigger(availableNow=True)`` and wait, without a time limit, until all available
    input is done; a failed stream raises, so no partial result is taken for a whole one."""
    w = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.start(sink) if sink else w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def dedup_stream(stream: DataFrame, url_col: str, event_time: str | None = None,
                 delay: str = "1 hour") -> DataFrame:
    """Admitted URLs only, one row per normalized URL, as in batch: the state holds every URL
    seen for the life of the query.

    ``event_time`` bounds that state instead (``dropDuplicatesWithinWatermark``) and is NOT the
    batch rule: a URL repeated more than ``delay`` later may be admitted again, and rows older
    than the watermark are dropped as late, even a URL's first occurrence."""
    d = stream.filter(~is_blank_url(F.col(url_col))).withColumn("url_norm", normalize_url(F.col(url_col)))
    if event_time is None:
        return d.dropDuplicates(["url_norm"])
    return d.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url_norm"])


def first_rows_stream(stream: DataFrame, url_col: str, row_id: str = "row_id") -> DataFrame:
    """T1 with W1's winner: per normalized URL the smallest ``row_id``, for update mode. A URL's row is
    emitted again only when a smaller one arrives, so the newest row of each URL (``upsert_writer``,
    ``latest``) is the batch result whatever the order of arrival. The state is one row per URL."""
    d = stream.filter(~is_blank_url(F.col(url_col))).withColumn("url_norm", normalize_url(F.col(url_col)))
    return d.groupBy("url_norm").agg(F.min(row_id).alias(row_id))


def classify_stream(pages: DataFrame, observations: DataFrame | None = None,
                    verdicts: DataFrame | None = None) -> DataFrame:
    """Same operators as batch; the static inputs are joined per micro-batch."""
    return classify_pages(pages, observations=observations, verdicts=verdicts)


def resolve_attempts_stream(attempts: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """``resolve_attempts`` on a stream, for update mode. The state is one aggregation buffer
    per page (first success, last attempt, count), kept for the life of the query because an
    attempt may come at any time; restrict the input by an event-time filter to bound it. The
    order and the files in which attempts arrive do not matter."""
    return att.resolve_attempts(attempts, verdicts)


def resolve_runs_stream(attempts: DataFrame, verdicts: DataFrame | None = None, silence: str = "1 day",
                        delay: str = "1 hour") -> DataFrame:
    """T3 with an end: a page's run of attempts (``ts``) is over when ``silence`` has passed since its last
    one; then its row is emitted (append mode) and its state is dropped, so the state holds only the
    runs open within ``silence`` and ``delay`` of the newest attempt. ``delay`` is how far out of order attempts may
    come; older ones are left out and counted by ``late_rows``. Without late rows the result is that of
    ``resolve_attempts(..., silence=silence)`` for all runs that are over."""
    return att.resolve_attempts(attempts.withWatermark("ts", delay), verdicts, silence)


def late_rows(query) -> int:
    """Input rows that a finished stream left out because they came behind the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def open_state(query) -> list[int]:
    """Rows in the state after each micro-batch of a finished stream."""
    return [sum(op.numRowsTotal for op in p.stateOperators) for p in query.recentProgress]


def upsert_writer(updates: DataFrame, path: str):
    """Update-mode rows, each micro-batch in its own folder (a retried batch overwrites itself)."""

    def write_batch(bdf: DataFrame, batch_id: int) -> None:
        bdf.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return updates.writeStream.outputMode("update").foreachBatch(write_batch)


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each key of an ``upsert_writer`` folder."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c != "batch_id"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch_id").alias("r")).select("r.*")


def progress_stream(classified: DataFrame, path: str):
    """T4: per micro-batch bucket counts, each batch written to its own folder (a retried batch
    overwrites its own output, so counts are exactly-once)."""

    def write_batch(bdf: DataFrame, batch_id: int) -> None:
        (bdf.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))

    return classified.writeStream.foreachBatch(write_batch)


def stream_folder(spark: SparkSession, name: str) -> tuple[str, str]:
    base = scratch_path(spark, name)
    return ensure_dir(f"{base}/out"), ensure_dir(f"{base}/checkpoint")
