"""The batch flow of the reference CLI as one plan: URL list in, one bucket per input row out.

read list -> find the URL column (S2) -> admit (P1, P2, W1) -> classify the snapshots (D4)
-> attach each admitted row's page by normalized URL -> rows keep their input ``row_id``.
Only admitted rows (unique URLs) take part in the join, so a URL repeated in a third of the
list cannot skew it; invalid and duplicate rows keep their admission label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navbuckets.functions.urls import normalize_url
from navbuckets.operators.admission import url_admission
from navbuckets.plans.classify import classify_pages
from navbuckets.sources.io import find_url_column


def classify_url_list(urls: DataFrame, pages: DataFrame, *, url_col: str | None = None, row_id: str = "row_id",
                      observations: DataFrame | None = None, verdicts: DataFrame | None = None,
                      scheme_check: str = "http") -> DataFrame:
    """``row_id, companyUrl, url_norm, status, bucket, bucket_source, reason`` for every input row.

    ``pages(page_id, url, html)`` are the captured snapshots; a page matches an admitted row
    when its normalized URL is the row's (the first page by ``page_id`` if a URL was captured
    more than once). Admitted rows without a snapshot keep a null bucket (still pending).
    """
    col = url_col or find_url_column(urls.drop(row_id))
    adm = url_admission(urls, col, row_id, scheme_check)
    wanted = adm.filter(F.col("status") == "admitted").select("url_norm")
    # narrow columns first: only the first page of each admitted URL is read in full and classified
    chosen = (pages.select("page_id", normalize_url(F.col("url"), scheme_check).alias("url_norm"))
              .join(wanted, "url_norm", "left_semi").groupBy("url_norm").agg(F.min("page_id").alias("page_id")))
    cls = classify_pages(pages.join(chosen.select("page_id"), "page_id", "left_semi"), observations=observations, verdicts=verdicts)
    by_url = cls.join(chosen, "page_id").select("url_norm", F.struct("page_id", "bucket", "bucket_source", "reason").alias("p"))
    admitted = adm.filter(F.col("status") == "admitted").join(by_url, "url_norm", "left")
    out_cols = [F.col(row_id), F.col(col).alias("companyUrl"), "url_norm", "status"]
    matched = admitted.select(*out_cols, F.col("p.bucket").alias("bucket"),
                              F.col("p.bucket_source").alias("bucket_source"), F.col("p.reason").alias("reason"))
    others = adm.filter(F.col("status") != "admitted").select(
        *out_cols, F.col("bucket"), F.lit("admission").alias("bucket_source"), F.lit(None).cast("string").alias("reason"))
    return matched.unionByName(others)
