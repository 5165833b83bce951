"""Behavioural confirmation from before/after measurements.

``observations(page_id, phase, height, n_elements, current_url, observed_at)`` with
phase in baseline, scroll1, scroll2, click_before, click_after. One row per page comes
out of a conditional aggregation (map-side partial aggregation, then a shuffle of one
small row per page and phase) -- no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navbuckets.functions.urls import url_compare_key

# Thresholds (strict '>') and phase names.
SCROLL_HEIGHT_GAIN = 400
SCROLL_ELEMENT_GAIN = 8
CLICK_HEIGHT_GAIN = 200
CLICK_ELEMENT_GAIN = 5
PHASES = ["baseline", "scroll1", "scroll2", "click_before", "click_after"]


def measurement_summary(observations: DataFrame) -> DataFrame:
    """One row per page: height, element count and URL key per phase (latest reading)."""
    o = observations.select("page_id", "phase", "height", "n_elements", "observed_at",
                            url_compare_key(F.col("current_url")).alias("url_key"))
    aggs = []
    for p in PHASES:
        m = F.col("phase") == p
        # latest reading of the phase; ties broken by the values themselves (deterministic)
        best = F.max(F.when(m, F.struct("observed_at", "height", "n_elements", "url_key")))
        aggs.append(best.alias(p))
    g = o.groupBy("page_id").agg(*aggs)
    return g.select("page_id", *[F.col(p)[f].alias(f"{f[0]}_{p}") for p in PHASES
                                 for f in ("height", "n_elements", "url_key")])


SUMMARY_COLUMNS = [(f"{k}_{p}", t) for p in PHASES for k, t in (("h", "bigint"), ("n", "bigint"), ("u", "string"))]


def _grew(m: Column, after: str, before: str, dh: int, dn: int) -> Column:
    return ((m[f"h_{after}"] > m[f"h_{before}"] + dh) | (m[f"n_{after}"] > m[f"n_{before}"] + dn))


def scroll_try(m: Column) -> Column:
    """1 or 2 when scroll try 1/2 confirmed growth with the same URL key, else null."""
    ok1 = _grew(m, "scroll1", "baseline", SCROLL_HEIGHT_GAIN, SCROLL_ELEMENT_GAIN) & (m["u_scroll1"] == m["u_baseline"])
    ok2 = _grew(m, "scroll2", "baseline", SCROLL_HEIGHT_GAIN, SCROLL_ELEMENT_GAIN) & (m["u_scroll2"] == m["u_baseline"])
    return F.when(F.coalesce(ok1, F.lit(False)), F.lit(1)).when(F.coalesce(ok2, F.lit(False)), F.lit(2))


def click_grew(m: Column) -> Column:
    """True/False after a measured click, null when the click was not measured."""
    measured = m["h_click_before"].isNotNull() & m["h_click_after"].isNotNull()
    return F.when(measured, F.coalesce(
        _grew(m, "click_after", "click_before", CLICK_HEIGHT_GAIN, CLICK_ELEMENT_GAIN), F.lit(False)))


def measurement_struct() -> Column:
    """Pack the summary columns (from ``measurement_summary``) into STRUCT m."""
    cols = []
    for p in PHASES:
        cols += [F.col(f"h_{p}").alias(f"h_{p}"), F.col(f"n_{p}").alias(f"n_{p}"), F.col(f"u_{p}").alias(f"u_{p}")]
    return F.struct(*cols)
