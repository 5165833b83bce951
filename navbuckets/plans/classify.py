"""End-to-end classification of page snapshots.

Plan shape (see README "Plans"): evidence is one narrow projection per page (HTML is
dropped right after it); measurements and verdicts are aggregated to one small row per
page before they meet the evidence, so the only shuffles carry a few hundred bytes per
page, never the HTML. Frames, when given, are merged with one aggregation by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navbuckets.functions.dom import fence, with_dom
from navbuckets.functions.text import py_strip
from navbuckets.operators import behavior, judge
from navbuckets.operators.rules import add_evidence, add_rule_columns, signal_text

def page_evidence(pages: DataFrame, rule_set: str = "intended", keep: list[str] | None = None,
                  html_col: str = "html", links: DataFrame | None = None, partitions: int | None = None,
                  snippet: bool = False) -> DataFrame:
    """Per row (page or frame): ``ev`` evidence struct; the HTML and arrays are dropped. With ``snippet``
    also the judge's ``snippet`` of the page (P10), from the same element model.

    ``keep`` lists extra input columns to carry (default: every column but the HTML).
    ``links(page_id[, frame_idx], pos, link_type, text, href, displayed)``: precomputed tagged
    links that replace the rule-based tagging (R0). Where ``displayed`` is null, R1 decides: a link with an
    address is visible if a displayed anchor has it, one without if the first 20 characters of its
    stripped, lower-cased text stand in the first text of a displayed element (never with an apostrophe).
    """
    keep = keep if keep is not None else [c for c in pages.columns if c != html_col]
    src = spread(pages.select(*keep, html_col), partitions)
    if links is not None:
        keys = ["page_id"] + (["frame_idx"] if "frame_idx" in keep and "frame_idx" in links.columns else [])
        per_page = links.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
            F.col("pos").cast("int").alias("pos"), F.col("link_type").alias("label"),
            F.lower(py_strip(F.coalesce(F.col("text"), F.lit("")))).alias("ltxt"),
            F.col("href").alias("href"), F.col("displayed").cast("boolean").alias("visible")))).alias("_ext_links"))
        src = src.join(per_page, keys, "left")
    d = with_dom(src, html_col, raw=snippet)
    d = add_rule_columns(d)
    # fenced: a later filter on a result is evaluated here, not pushed into the DOM pipeline
    return add_evidence(d, rule_set).select(*keep, fence(F.col("ev")).alias("ev"),
                                            *([fence(judge.snippet()).alias("snippet")] if snippet else []))


def merge_frames(frame_ev: DataFrame) -> DataFrame:
    """A3: main document (frame_idx -1) alone when it has links; else OR it with the
    lowest-index frame that has links; that frame's signals get the prefix 'frame(i) '.

    One aggregation by page over small evidence rows (no HTML)."""
    f = frame_ev
    cand = (F.col("frame_idx") >= 0) & F.col("ev.has_links")
    g = f.groupBy("page_id").agg(
        F.max(F.when(F.col("frame_idx") == -1, F.struct(F.lit(1).alias("k"), F.col("ev").alias("ev"))))["ev"].alias("m"),
        F.min(F.when(cand, F.struct(F.col("frame_idx").alias("i"), F.col("ev").alias("ev")))).alias("c"),
        *[F.first(c, ignorenulls=True).alias(c) for c in f.columns if c not in ("page_id", "frame_idx", "ev")],
    )
    m, c = F.col("m"), F.col("c")
    use = ~F.coalesce(m["has_links"], F.lit(False)) & c.isNotNull()
    fsig = F.transform(c["ev"]["signals"], lambda s: s.withField(
        "message", F.concat(signal_text("frame", c["i"].cast("string")), F.lit(" "), s["message"]))
        .withField("rule_ord", s["rule_ord"] + 1000))
    ev = m.withField("has_links", F.coalesce(m["has_links"], F.lit(False)) | use) \
        .withField("next", m["next"] | (use & c["ev"]["next"])) \
        .withField("pageselect", m["pageselect"] | (use & c["ev"]["pageselect"])) \
        .withField("signals", F.when(use, F.concat(m["signals"], fsig)).otherwise(m["signals"])) \
        .withField("frame", F.when(use, c["i"]))
    return g.select("page_id", *[x for x in g.columns if x not in ("page_id", "m", "c")], ev.alias("ev"))


def decide(ev: Column, m: Column, v_struct: Column, v_behav: Column) -> Column:
    """D1 + D2 + D3: STRUCT<branch, bucket, bucket_source, signals ARRAY<STRING>, reason>."""
    structural = ev["has_links"]
    # D1
    s_valid = v_struct.isNotNull()
    s_rule = F.when(ev["next"], F.lit("next")).when(ev["pageselect"], F.lit("pageselect"))
    s_bucket = F.coalesce(s_rule, v_struct, F.lit("next"))
    s_source = F.when(s_rule.isNotNull(), "rule").when(s_valid, "judge").otherwise("fallback")
    # D3: each step is (code, outcome); a null step did not happen
    s_steps = [signal_text("branch", "structural"), signal_text("rules", F.coalesce(s_rule, F.lit("none"))),
               F.when(s_rule.isNull(), F.when(s_valid, signal_text("judge", v_struct)).otherwise(signal_text("default", "next")))]
    # D2
    st = behavior.scroll_try(m)
    cand = ev["loadmore"]
    grew = behavior.click_grew(m)
    lm_ok = cand.isNotNull() & F.coalesce(grew, F.lit(False))
    b_valid = v_behav.isNotNull()
    b_bucket = (F.when(st.isNotNull(), "scrolldown").when(lm_ok, "loadmore")
                .when(b_valid, v_behav).otherwise("scrolldown"))
    b_source = F.when(st.isNotNull() | lm_ok, "rule").when(b_valid, "judge").otherwise("fallback")
    no_scroll = st.isNull()
    b_steps = [
        signal_text("branch", "behavioral"),
        signal_text("scroll", "1", F.when(st == 1, "grew").otherwise("flat")),
        F.when(F.coalesce(st, F.lit(0)) != 1, signal_text("scroll", "2", F.when(st == 2, "grew").otherwise("flat"))),
        F.when(no_scroll, F.when(cand.isNull(), signal_text("loadmore", "none")).otherwise(
            signal_text("loadmore", cand["kind"], cand["keyword"]))),
        F.when(no_scroll & cand.isNotNull(), signal_text(
            "click", F.when(grew.isNull(), "unmeasured").when(grew, "grew").otherwise("flat"))),
        F.when(no_scroll & ~lm_ok, F.when(b_valid, signal_text("judge", v_behav)).otherwise(signal_text("default", "scrolldown"))),
    ]
    ev_msgs = F.transform(F.array_sort(ev["signals"]), lambda s: s["message"])
    steps = F.when(structural, F.array(*s_steps)).otherwise(F.array(*b_steps))
    signals = F.concat(ev_msgs, F.filter(steps, lambda x: x.isNotNull()))
    bucket = F.when(structural, s_bucket).otherwise(b_bucket)
    return F.struct(
        F.when(structural, "structural").otherwise("behavioral").alias("branch"),
        bucket.alias("bucket"),
        F.when(structural, s_source).otherwise(b_source).alias("bucket_source"),
        signals.alias("signals"),
        F.concat(bucket, F.lit(" <- "), F.array_join(signals, "; ")).alias("reason"),
    )


def spread(pages: DataFrame, partitions: int | None, key: str = "page_id") -> DataFrame:
    """Hash-partition the pages when the caller asks for it (``partitions``), which is worth a
    shuffle of the HTML only if the input has fewer splits than the cluster has cores, e.g. one
    large file in one row group. It is also the distribution that the per-page joins need."""
    return pages if partitions is None or pages.isStreaming else pages.repartition(partitions, key)


def classify_pages(pages: DataFrame, *, frames: DataFrame | None = None, observations: DataFrame | None = None,
                   verdicts: DataFrame | None = None, rule_set: str = "intended",
                   links: DataFrame | None = None, partitions: int | None = None, snippet: bool = False) -> DataFrame:
    """Classify every page: ``page_id, url, branch, bucket, bucket_source, next, pageselect,
    signals, reason`` and, if asked for, ``snippet`` (not with ``frames``).

    * ``pages(page_id, url, html)`` -- snapshots; ``frames(page_id, frame_idx, html)``
      replaces the page HTML by the main document (-1) plus its iframes when given.
    * ``observations`` -- before/after measurements (R11/R12); pages without rows fall back.
    * ``verdicts(page_id, kind, branch, attempt, answer)`` -- judge answers (J3).
    * ``links`` -- precomputed tagged links (exact tagger output) instead of rule-based R0.
    * ``partitions`` -- hash-partition the pages first (see ``spread``); the default leaves them.
    """
    base = pages.select("page_id", "url")
    if frames is None:
        ev = page_evidence(pages.select("page_id", "url", "html"), rule_set, links=links, partitions=partitions, snippet=snippet)
    else:
        fev = page_evidence(frames.select("page_id", "frame_idx", "html"), rule_set, links=links, partitions=partitions)
        ev = base.join(merge_frames(fev), "page_id", "left")
    extra = ["snippet"] if snippet and frames is None else []
    cols = [F.col("page_id"), F.col("url"), F.col("ev"), *extra]
    d = ev.select(*cols)
    if observations is not None:
        d = d.join(behavior.measurement_summary(observations), "page_id", "left")
    else:
        d = d.select("*", *[F.lit(None).cast(t).alias(c) for c, t in behavior.SUMMARY_COLUMNS])
    if verdicts is not None:
        d = d.join(judge.page_verdicts(verdicts), "page_id", "left")
    else:
        d = d.select("*", F.lit(None).cast("string").alias("verdict_structural"),
                     F.lit(None).cast("string").alias("verdict_behavioral"))
    dec = decide(F.col("ev"), behavior.measurement_struct(), F.col("verdict_structural"), F.col("verdict_behavioral"))
    out = d.select("page_id", "url", F.col("ev"), dec.alias("d"), *extra)
    return out.select(
        "page_id", "url", F.col("d.branch").alias("branch"), F.col("d.bucket").alias("bucket"),
        F.col("d.bucket_source").alias("bucket_source"),
        F.coalesce(F.col("ev.next"), F.lit(False)).alias("next"),
        F.coalesce(F.col("ev.pageselect"), F.lit(False)).alias("pageselect"),
        F.col("d.signals").alias("signals"), F.col("d.reason").alias("reason"), *extra,
    )
