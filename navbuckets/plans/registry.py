"""Registered queries: one per operator of SURVEY §2, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or fixtures Spark derives from every row of them)
and runs over whole tables and whole page texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navbuckets.functions.urls import normalize_url, url_compare_key, url_features
from navbuckets.operators import admission, attempts as att, behavior, elements as E, judge, report
from navbuckets.plans import fixtures as fx
from navbuckets.plans.classify import classify_pages, merge_frames, page_evidence, spread
from navbuckets.session import scratch_path
from navbuckets.sources import io
from navbuckets.streaming import stream as S

Q = {}


def query(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


def _parts(spark: SparkSession) -> int:
    """The test tables are one file in one row group: the queries ask for a spread over the cores."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(fx.overlay_pages(spark, sf), _parts(spark))


def _ev(spark: SparkSession, sf: str, rule_set: str = "intended") -> DataFrame:
    return page_evidence(_pages(spark, sf).select("page_id", "html"), rule_set)


@query("classify_pages")
def q_classify_pages(spark, sf):
    res = classify_pages(_pages(spark, sf), observations=fx.observations(spark, sf),
                         verdicts=fx.verdicts(spark, sf))
    return res.select("page_id", "url", "branch", "bucket", "bucket_source", "reason")


@query("classify_as_written")
def q_classify_as_written(spark, sf):
    res = classify_pages(_pages(spark, sf), observations=fx.observations(spark, sf),
                         verdicts=fx.verdicts(spark, sf), rule_set="as_written")
    return res.select("page_id", "url", "branch", "bucket", "bucket_source", "reason")


def _rule_query(field: str, alias: str):
    def fn(spark, sf):
        return _ev(spark, sf).select("page_id", F.col(f"ev.{field}").alias(alias))
    return fn


for _name, _field in [("rule_next_keyword", "r2"), ("rule_platform_selector", "r3"), ("rule_range_text", "r4"),
                      ("rule_next_symbol", "r5"), ("rule_first_last", "r6"), ("rule_double_arrow", "r7"),
                      ("rule_number_group", "r8"), ("rule_number_adjacent", "r9")]:
    Q[_name] = _rule_query(_field, _field)


@query("frame_indicators")
def q_frame_indicators(spark, sf):
    return _ev(spark, sf).select("page_id", F.col("ev.has_links").alias("has_links"),
                                 F.col("ev.next").alias("next_ind"), F.col("ev.pageselect").alias("pageselect_ind"))


@query("loadmore_candidate")
def q_loadmore_candidate(spark, sf):
    return _ev(spark, sf).select("page_id", F.col("ev.loadmore.kind").alias("lm_kind"),
                                 F.col("ev.loadmore.keyword").alias("lm_keyword"))


@query("page_signals")
def q_page_signals(spark, sf):
    """Each page's evidence signals in rule order, as one ordered text."""
    ev = _ev(spark, sf)
    ordered = F.transform(F.array_sort(F.col("ev.signals")), lambda s: s["message"])
    return ev.select("page_id", F.size("ev.signals").alias("n_signals"),
                     F.array_join(ordered, " | ").alias("signals_text"))


# --------------------------------------------------------------------------- URLs

URL_COL = "companyUrl"


def _page_of(row_id: str = "row_id"):
    return F.expr(f"{row_id} div 2").alias("page_id")


@query("url_list_scan")
def q_url_list_scan(spark, sf):
    path = scratch_path(spark, "url-list-csv")
    fx.url_list(spark, sf).repartitionByRange("row_id").sortWithinPartitions("row_id").write.option("header", True) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    df = io.read_url_list(spark, path, columns=["row_id", "companyName", "companyUrl", "flow"])
    return io.assign_row_ids(df, "line_no")


@query("url_column_content")
def q_url_column_content(spark, sf):
    df = fx.url_list(spark, sf).toDF("row_id", "name", "address", "flow")
    chosen = io.find_url_column(df)
    flags = io.url_column_flags(df)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("column_name"),
                              F.col(f"`{c}`").alias("has_http")) for i, c in enumerate(df.columns)])
    return flags.select(F.inline(rows)).withColumn("chosen", F.col("column_name") == F.lit(chosen))


@query("url_normalize")
def q_url_normalize(spark, sf):
    u = F.col(URL_COL)
    return fx.url_list(spark, sf).select("row_id", normalize_url(u, "http").alias("url_http"),
                                         normalize_url(u, "strict").alias("url_strict"))


@query("url_admission")
def q_url_admission(spark, sf):
    return admission.url_admission(fx.url_list(spark, sf), URL_COL).select("row_id", URL_COL, "url_norm", "status")


@query("pending_rows")
def q_pending_rows(spark, sf):
    return admission.pending_rows(fx.url_list(spark, sf), URL_COL).select("row_id", "url_norm", "is_retry")


@query("completed_rows")
def q_completed_rows(spark, sf):
    return admission.completed_rows(fx.url_list(spark, sf)).select("row_id", "flow")


@query("resume_pending")
def q_resume_pending(spark, sf):
    ul = fx.url_list(spark, sf)
    return admission.resume_pending(ul.drop("flow"), ul, URL_COL).select("row_id", "url_norm")


def _page_buckets(spark, sf):
    return classify_pages(_pages(spark, sf), observations=fx.observations(spark, sf),
                          verdicts=fx.verdicts(spark, sf)).select("page_id", "bucket")


@query("resume_merge")
def q_resume_merge(spark, sf):
    ul = fx.url_list(spark, sf)
    todo = admission.resume_pending(ul.drop("flow"), ul, URL_COL)
    done = ul.filter(~admission.flow_state("flow").rlike(admission.PENDING_RE)).select("row_id", "flow")
    new = todo.select("row_id", _page_of()).join(_page_buckets(spark, sf), "page_id", "left") \
              .select("row_id", F.col("bucket").alias("flow"))
    return admission.resume_merge(done, new).select("row_id", "flow")


def _results(spark, sf):
    adm = admission.url_admission(fx.url_list(spark, sf), URL_COL)
    pb = _page_buckets(spark, sf).withColumnRenamed("bucket", "page_bucket")
    j = adm.select("*", _page_of()).join(pb, "page_id", "left")
    return j.withColumn("bucket", F.coalesce(F.col("bucket"), F.col("page_bucket")))


@query("result_projection")
def q_result_projection(spark, sf):
    return io.result_projection(_results(spark, sf), URL_COL)


@query("result_sink")
def q_result_sink(spark, sf):
    """Two committed runs, one of them repeated, read back with the number of each row."""
    path = scratch_path(spark, "results")
    rows = io.result_projection(_attempt_results(spark, sf), URL_COL)
    late = F.pmod(F.col("row_id"), F.lit(3)) == 0
    io.commit_results(rows.where(~late), path, "a-first")
    io.commit_results(rows.where(late).withColumn("bucket", F.lit("pending")), path, "b-late")
    io.commit_results(rows.where(late), path, "b-late")  # replaces its own rows only
    return io.read_results(spark, path, "row_id long, companyUrl string, bucket string")


@query("result_full")
def q_result_full(spark, sf):
    return _results(spark, sf).select("row_id", "companyName", URL_COL, F.col("bucket").alias("flow"))


@query("url_features")
def q_url_features(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", *url_features(F.col("url")))


@query("url_compare_key")
def q_url_compare_key(spark, sf):
    return fx.observations(spark, sf).select("page_id", "phase", url_compare_key(F.col("current_url")).alias("url_key"))


# --------------------------------------------------------------------------- elements
@query("element_count")
def q_element_count(spark, sf):
    return E.element_count(_pages(spark, sf))


@query("element_displayed")
def q_element_displayed(spark, sf):
    return E.elements(_pages(spark, sf)).select("page_id", "pos", "tag", "displayed")


@query("interactive_elements")
def q_interactive_elements(spark, sf):
    return E.interactive_elements(_pages(spark, sf)).select(
        "page_id", "pos", "tag", "first_text", "full_text", "displayed")


@query("containers")
def q_containers(spark, sf):
    return E.containers(_pages(spark, sf))


@query("link_labels")
def q_link_labels(spark, sf):
    return E.links(_pages(spark, sf)).select("page_id", "pos", "link_type", "href", "text")


@query("link_sequence")
def q_link_sequence(spark, sf):
    """R0 by sequence: all links of a page labelled together."""
    from navbuckets.operators.tagging import tag_links

    return tag_links(_pages(spark, sf))


@query("visible_links")
def q_visible_links(spark, sf):
    return E.links(_pages(spark, sf)).select("page_id", "pos", "link_type", "visible")


# --------------------------------------------------------------------------- frames
@query("frame_scan")
def q_frame_scan(spark, sf):
    return io.frames_from_srcdoc(fx.framed_pages(spark, sf))


@query("frame_merge")
def q_frame_merge(spark, sf):
    frames = io.frames_from_srcdoc(fx.framed_pages(spark, sf))
    m = merge_frames(page_evidence(frames.select("page_id", "frame_idx", "html"), partitions=_parts(spark)))
    ordered = F.transform(F.array_sort(F.col("ev.signals")), lambda s: s["message"])
    return m.select("page_id", F.col("ev.has_links").alias("has_links"), F.col("ev.next").alias("next_ind"),
                    F.col("ev.pageselect").alias("pageselect_ind"), F.col("ev.frame").alias("frame"),
                    F.array_join(ordered, " | ").alias("signals_text"))


# --------------------------------------------------------------------------- behaviour
@query("scroll_confirm")
def q_scroll_confirm(spark, sf):
    ms = behavior.measurement_summary(fx.observations(spark, sf))
    return ms.select("page_id", behavior.scroll_try(behavior.measurement_struct()).alias("scroll_try"))


@query("loadmore_confirm")
def q_loadmore_confirm(spark, sf):
    ev = _ev(spark, sf).select("page_id", F.col("ev.loadmore.kind").alias("lm_kind"))
    ms = behavior.measurement_summary(fx.observations(spark, sf))
    ms = ms.select("page_id", behavior.click_grew(behavior.measurement_struct()).alias("click_grew"))
    j = ev.join(ms, "page_id", "left")
    return j.select("page_id", "lm_kind", "click_grew",
                    (F.col("lm_kind").isNotNull() & F.coalesce(F.col("click_grew"), F.lit(False))).alias("confirmed"))


# --------------------------------------------------------------------------- decisions
def _classified(spark, sf, with_inputs: bool = True):
    if with_inputs:
        c = classify_pages(_pages(spark, sf), observations=fx.observations(spark, sf),
                           verdicts=fx.verdicts(spark, sf))
    else:
        c = classify_pages(_pages(spark, sf))
    return c


@query("decide_structural")
def q_decide_structural(spark, sf):
    return _classified(spark, sf).filter(F.col("branch") == "structural").select(
        "page_id", "bucket", "bucket_source")


@query("decide_behavioral")
def q_decide_behavioral(spark, sf):
    return _classified(spark, sf).filter(F.col("branch") == "behavioral").select(
        "page_id", "bucket", "bucket_source")


@query("decision_reason")
def q_decision_reason(spark, sf):
    return _classified(spark, sf, with_inputs=False).select("page_id", "bucket", "reason")


# --------------------------------------------------------------------------- judge
@query("judge_queue")
def q_judge_queue(spark, sf):
    c = _classified(spark, sf, with_inputs=False).filter(F.col("bucket_source").isin("judge", "fallback"))
    return c.select("page_id", "url", "branch",
                    judge.prompt(F.col("url"), F.col("signals"), None, F.col("branch")).alias("prompt"))


@query("judge_snippet")
def q_judge_snippet(spark, sf):
    from navbuckets.functions.dom import with_dom

    d = with_dom(_pages(spark, sf).select("page_id", "html"), raw=True)
    return d.select("page_id", judge.snippet().alias("snippet"))


@query("judge_constrained")
def q_judge_constrained(spark, sf):
    return judge.page_verdicts(fx.verdicts(spark, sf))


@query("judge_url_only")
def q_judge_url_only(spark, sf):
    return judge.url_only_verdicts(fx.verdicts(spark, sf))


# --------------------------------------------------------------------------- attempts
@query("error_taxonomy")
def q_error_taxonomy(spark, sf):
    a = fx.attempts(spark, sf).filter(F.col("error_message").isNotNull())
    return a.select("page_id", "attempt", att.error_status(F.col("error_message")).alias("status"),
                    att.error_label(F.col("error_message")).alias("label"))


@query("resolve_attempts")
def q_resolve_attempts(spark, sf):
    return att.resolve_attempts(fx.attempts(spark, sf), fx.verdicts(spark, sf))


@query("judge_url_queue")
def q_judge_url_queue(spark, sf):
    log = fx.attempts(spark, sf)
    pages = log.select("page_id", F.concat(F.lit("https://jobs.example/list/"), F.col("page_id").cast("string")).alias("url")).distinct()
    return judge.url_only_queue(att.resolve_attempts(log, fx.verdicts(spark, sf)), pages)


@query("reprocess_count")
def q_reprocess_count(spark, sf):
    """A10: rows to be retried, and rows a forced run would take."""
    rows = admission.pending_rows(fx.url_list(spark, sf), URL_COL, force=True)
    return rows.agg(F.count(F.when(admission.flow_state().rlike(admission.PENDING_RE), 1)).alias("n_retry"),
                    F.count(F.lit(1)).alias("n_forced"))


# --------------------------------------------------------------------------- reports
def _attempt_results(spark, sf):
    adm = admission.url_admission(fx.url_list(spark, sf), URL_COL)
    res = att.resolve_attempts(fx.attempts(spark, sf), fx.verdicts(spark, sf)).select(
        "page_id", F.col("bucket").alias("attempt_bucket"))
    j = adm.select("*", _page_of()).join(res, "page_id", "left")
    return j.withColumn("bucket", F.coalesce(F.col("bucket"), F.col("attempt_bucket")))


@query("run_summary")
def q_run_summary(spark, sf):
    return report.run_summary(_attempt_results(spark, sf), fx.attempts(spark, sf))


@query("progress_count")
def q_progress_count(spark, sf):
    return report.progress_count(_attempt_results(spark, sf))


# --------------------------------------------------------------------------- streaming


def _stage_parquet(spark, df, name):
    """Write a derived batch input once, so a file stream can read it."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return path, df.schema


def _classified_stream(spark, sf):
    pages = S.pages_stream(spark, sf).select("page_id", "url", F.expr(fx.overlay_expr()).alias("html"))
    return S.classify_stream(pages, fx.observations(spark, sf), fx.verdicts(spark, sf))


@query("stream_dedup")
def q_stream_dedup(spark, sf):
    path, schema = _stage_parquet(spark, fx.url_list(spark, sf), "url-list")
    out, ck = S.stream_folder(spark, "stream-dedup")
    d = S.dedup_stream(S.file_stream(spark, path, schema), URL_COL)
    S.run_to_end(d.select("row_id", "url_norm").writeStream.format("parquet").outputMode("append"), out, ck)
    return spark.read.parquet(out).select("url_norm")


@query("stream_first_rows")
def q_stream_first_rows(spark, sf):
    """T1 with the winning row, on a list whose later rows are read first."""
    path = scratch_path(spark, "url-list")
    urls = fx.url_list(spark, sf)
    for part in (2, 0, 1):
        urls.where(F.pmod(F.col("row_id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(path)
    out, ck = S.stream_folder(spark, "stream-first")
    S.run_to_end(S.upsert_writer(S.first_rows_stream(S.file_stream(spark, path, urls.schema), URL_COL), out), None, ck)
    return S.latest(spark, out, "url_norm")


SILENCE = "1 day"


@query("stream_runs")
def q_stream_runs(spark, sf):
    """T3 with an end: attempts in files by time; a last row far ahead closes every run."""
    path = scratch_path(spark, "attempts")
    log = fx.attempts(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    span = log.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    cut = [span.a + (span.b - span.a) * k / 3 for k in range(4)] if span.a else []
    for k in range(len(cut) - 1):
        part = log.where((F.col("ts") >= F.lit(cut[k])) & ((F.col("ts") < F.lit(cut[k + 1])) if k < 2 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(path)
    end = log.groupBy().agg(F.lit(None).cast("long").alias("page_id"), F.lit(1).alias("attempt"), F.lit("next").alias("outcome"),
                            F.lit(None).cast("string").alias("error_message"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    end.select(log.columns).coalesce(1).write.mode("append").parquet(path)
    out, ck = S.stream_folder(spark, "stream-runs")
    runs = S.resolve_runs_stream(S.file_stream(spark, path, log.schema), fx.verdicts(spark, sf), SILENCE)
    S.run_to_end(runs.writeStream.format("parquet").outputMode("append"), out, ck)
    return spark.read.schema(runs.schema).parquet(out).where("page_id is not null")


@query("stream_classify")
def q_stream_classify(spark, sf):
    out, ck = S.stream_folder(spark, "stream-classify")
    c = _classified_stream(spark, sf).select("page_id", "url", "branch", "bucket", "bucket_source", "reason")
    S.run_to_end(c.writeStream.format("parquet").outputMode("append"), out, ck)
    return spark.read.parquet(out)


@query("stream_results")
def q_stream_results(spark, sf):
    out, ck = S.stream_folder(spark, "stream-results")
    c = _classified_stream(spark, sf).filter(F.length("bucket") > 0).select("page_id", "bucket")
    S.run_to_end(c.writeStream.format("parquet").outputMode("append"), out, ck)
    return spark.read.parquet(out)


@query("stream_attempts")
def q_stream_attempts(spark, sf):
    """T3 on a log split by attempt number, so every page's attempts span micro-batches."""
    path = scratch_path(spark, "attempts")
    log = fx.attempts(spark, sf)
    for n in (2, 3, 1):  # not in order: a later attempt may be read first
        log.where(F.col("attempt") == n).coalesce(1).write.mode("append").parquet(path)
    out, ck = S.stream_folder(spark, "stream-attempts")
    r = S.resolve_attempts_stream(S.file_stream(spark, path, log.schema), fx.verdicts(spark, sf))
    S.run_to_end(S.upsert_writer(r, out), None, ck)
    return S.latest(spark, out, "page_id")


@query("stream_progress")
def q_stream_progress(spark, sf):
    out, ck = S.stream_folder(spark, "stream-progress")
    S.run_to_end(S.progress_stream(_classified_stream(spark, sf), out), None, ck)
    return spark.read.parquet(out).groupBy("bucket").agg(F.sum("n").alias("n"))


# --------------------------------------------------------------------------- user rules (J6), first hits
@query("custom_rules")
def q_custom_rules(spark, sf):
    from navbuckets.operators.rules import LOADMORE_KEYWORDS

    rules = spark.createDataFrame([(f"LM{i}{t[0]}", t, k) for i, k in enumerate(LOADMORE_KEYWORDS)
                                   for t in ("button", "a")], "rule_id string, tag string, needle string")
    return E.custom_rules(E.elements(_pages(spark, sf)), rules)


@query("first_hit_per_rule")
def q_first_hit_per_rule(spark, sf):
    from navbuckets.functions.dom import with_dom
    from navbuckets.operators.rules import add_rule_columns, first_hits

    d = add_rule_columns(with_dom(_pages(spark, sf).select("page_id", "html")))
    return d.select("page_id", F.inline(first_hits()))


@query("classify_with_links")
def q_classify_with_links(spark, sf):
    """D4 with a tagger's own links table, partly without addresses and without display flags."""
    links = fx.links(spark, sf)
    res = classify_pages(_pages(spark, sf), observations=fx.observations(spark, sf),
                         verdicts=fx.verdicts(spark, sf), links=links)
    return res.select("page_id", "url", "branch", "bucket", "bucket_source", "reason")


@query("scroll_confirm_events")
def q_scroll_confirm_events(spark, sf):
    """R11 on measurements derived from the event log (uneven readings per key)."""
    ms = behavior.measurement_summary(fx.event_observations(spark, sf))
    return ms.select("page_id", behavior.scroll_try(behavior.measurement_struct()).alias("scroll_try"))


@query("judge_prompt")
def q_judge_prompt(spark, sf):
    """J2 + P10: the full prompt (signals and the page snippet cut at 3,000) for ambiguous pages, whose snippets
    are those of all pages of their id. Both come from one element model."""
    c = classify_pages(_pages(spark, sf).where("page_id is not null"), snippet=True)
    asked = F.when(F.col("bucket_source").isin("judge", "fallback"), F.struct("branch", "url", "signals"))
    by_id = c.groupBy("page_id").agg(F.collect_list(asked).alias("c"), F.collect_list(F.struct("snippet")).alias("s"))
    j = by_id.select("page_id", "s", F.inline("c")).select("page_id", "branch", "url", "signals", F.inline("s"))
    return j.select("page_id", "branch",
                    judge.prompt(F.col("url"), F.col("signals"), F.col("snippet"), F.col("branch")).alias("prompt"))


@query("classify_url_list")
def q_classify_url_list(spark, sf):
    """The CLI flow: URL list -> admission -> classification of the captured pages by URL."""
    from navbuckets.plans.run import classify_url_list

    return classify_url_list(fx.url_list(spark, sf).drop("flow"), _pages(spark, sf),
                             observations=fx.observations(spark, sf), verdicts=fx.verdicts(spark, sf))
