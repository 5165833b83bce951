"""URL admission (P1, P2, W1), pending / completed filters (P3, P4) and resume.

Duplicates: the first row (by ``row_id``) of each normalized URL wins. It is computed as an
aggregation (``min(row_id)`` per URL, partial aggregation before the shuffle, so a URL that
holds a third of all rows collapses map-side) joined back by URL; AQE's skew-join handling
splits a hot URL's partition on the big side. No window over a hot key, no collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navbuckets.functions.text import py_strip
from navbuckets.functions.urls import is_blank_url, normalize_url

# Admission labels and the pending pattern.
INVALID = "invalid_url"
DUPLICATE = "duplicate_in_input"
PENDING_RE = r"^(error.*|nan|)$"


def url_admission(df: DataFrame, url_col: str, row_id: str = "row_id", scheme_check: str = "http") -> DataFrame:
    """Adds ``url_norm`` and ``status`` ('admitted' | 'invalid_url' | 'duplicate_in_input')
    and ``bucket`` (the admission label, null for admitted rows). Rows are kept."""
    u = F.col(url_col)
    d = df.withColumn("_blank", is_blank_url(u)) \
          .withColumn("url_norm", F.when(~F.col("_blank"), normalize_url(u, scheme_check)))
    named = d.filter(~F.col("_blank"))
    firsts = named.groupBy("url_norm").agg(F.min(row_id).alias("_first"))
    # blank rows have no key: they go round the join instead of meeting in one partition
    j = named.join(firsts, "url_norm").unionByName(
        d.filter("_blank").withColumn("_first", F.lit(None).cast(df.schema[row_id].dataType)))
    status = (F.when(F.col("_blank"), F.lit(INVALID))
              .when(F.col(row_id) == F.col("_first"), F.lit("admitted")).otherwise(F.lit(DUPLICATE)))
    return j.withColumn("status", status) \
            .withColumn("bucket", F.when(F.col("status") != "admitted", F.col("status"))) \
            .drop("_blank", "_first")


def flow_state(flow_col: str = "flow"):
    """Lower-cased, stripped flow; a null cell reads as 'nan' (pandas ``str(NaN)``)."""
    return F.lower(py_strip(F.coalesce(F.col(flow_col), F.lit("nan"))))


def pending_rows(df: DataFrame, url_col: str, flow_col: str = "flow", force: bool = False) -> DataFrame:
    """P3 + A10: rows to (re)process: flow empty, 'nan' or starting with 'error' (or all, forced).
    Blank URLs are skipped; URLs get the strict scheme rule. ``is_retry`` marks A10 rows."""
    st = flow_state(flow_col)
    is_err = st.rlike(PENDING_RE)
    d = df.filter(~is_blank_url(F.col(url_col)))
    if not force:
        d = d.filter(is_err)
    return d.withColumn("url_norm", normalize_url(F.col(url_col), "strict")) \
            .withColumn("is_retry", is_err & F.lit(not force))


def completed_rows(df: DataFrame, flow_col: str = "flow") -> DataFrame:
    """Rows whose flow text is non-empty (a null cell is the text 'nan', as pandas writes it)."""
    return df.filter(F.length(F.coalesce(F.col(flow_col), F.lit("nan"))) > 0)


def resume_pending(inputs: DataFrame, previous: DataFrame, url_col: str, row_id: str = "row_id",
                   flow_col: str = "flow") -> DataFrame:
    """Input rows without a finished previous result, matched by row_id AND normalized URL
    (the position-only merge of the reference becomes a key)."""
    key = lambda df: df.withColumn("_k", normalize_url(F.col(url_col), "strict"))
    done = key(previous).filter(~flow_state(flow_col).rlike(PENDING_RE)).select(row_id, "_k")
    todo = key(inputs).filter(~is_blank_url(F.col(url_col)))
    return todo.join(done, [row_id, "_k"], "left_anti").withColumnRenamed("_k", "url_norm")


def resume_merge(previous_done: DataFrame, new_results: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Finished previous rows plus the new results, one row per row_id (new wins)."""
    new_ids = new_results.select(row_id)
    keep_old = previous_done.join(new_ids, row_id, "left_anti")
    return keep_old.unionByName(new_results, allowMissingColumns=True)
