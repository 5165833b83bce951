import datetime as dt

from pyspark.sql import functions as F

from navbuckets.operators import admission, attempts, judge


def test_url_admission(spark):
    rows = [(0, None), (1, ""), (2, "  "), (3, "nan"), (4, "NaN"), (5, " https://x.com/jobs"),
            (6, "https://x.com/jobs "), (7, "x.com/jobs"), (8, "httpbin.org"), (9, "HTTP://y.com")]
    df = spark.createDataFrame(rows, "row_id long, url string")
    out = {r.row_id: (r.url_norm, r.status) for r in admission.url_admission(df, "url").collect()}
    assert [out[i][1] for i in range(5)] == ["invalid_url"] * 5
    assert out[5] == ("https://x.com/jobs", "admitted")
    assert out[6][1] == "duplicate_in_input" and out[7] == ("https://x.com/jobs", "duplicate_in_input")
    assert out[8] == ("httpbin.org", "admitted")          # 'http' prefix test keeps it bare
    assert out[9] == ("https://HTTP://y.com", "admitted")  # case-sensitive scheme test


def test_pending_and_completed(spark):
    df = spark.createDataFrame([(i, "https://a/%d" % i, f) for i, f in enumerate(
        [None, "", "next", "nan", "Error: x", " error: y "])], "row_id long, url string, flow string")
    assert sorted(r.row_id for r in admission.pending_rows(df, "url").collect()) == [0, 1, 3, 4, 5]
    assert sorted(r.row_id for r in admission.completed_rows(df).collect()) == [0, 2, 3, 4, 5]


def test_error_taxonomy(spark):
    msgs = ["Timed out receiving message from renderer", "DNS_PROBE_FINISHED_NXDOMAIN", "renderer crashed", "boom"]
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    got = [r.s for r in df.select(attempts.error_status(F.col("m")).alias("s")).collect()]
    assert got == ["partial", "error: invalid_url", "partial", "error: page_load_failed"]


def test_resolve_attempts(spark):
    t = dt.datetime(2024, 1, 1)
    long_msg = "x" * 60
    rows = [(1, 1, "error: a", None, t), (1, 2, "error: b", None, t), (1, 3, "next", None, t),
            (2, 1, "error: a", None, t), (2, 2, "error: a", None, t), (2, 3, "error: a", None, t),
            (3, 1, "error: a", None, t), (3, 2, "error: a", None, t), (3, 3, None, long_msg, t),
            (4, 1, "error: a", None, t), (4, 2, "error: a", None, t), (4, 3, "error: a", None, t)]
    a = spark.createDataFrame(rows, "page_id long, attempt int, outcome string, error_message string, ts timestamp")
    v = spark.createDataFrame([(4, "url_only", None, 1, "loadmore | modern site")],
                              "page_id long, kind string, branch string, attempt int, answer string")
    got = {r.page_id: r.bucket for r in attempts.resolve_attempts(a, v).collect()}
    assert got == {1: "next", 2: "error: timeout_max_retries", 3: "error: " + "x" * 50, 4: "loadmore"}


def test_url_only_answers(spark):
    df = spark.createDataFrame([("loadmore | modern site",), ("none | few roles",), ("free text",), ("NEXT|x|y",)],
                               "answer string")
    got = [(r.judge_bucket, r.judge_source, r.judge_reason)
           for r in df.select(*judge.parse_url_only(F.col("answer"))).collect()]
    assert got == [("loadmore", "judge_url", "modern site"), ("next", "judge_default", "few roles"),
                   ("next", "judge_default", "AI fallback classification"), ("next", "judge_url", "x|y")]


def test_hot_url_keeps_first_row_only(spark):
    # a third of all rows share one URL: one admitted row, the rest duplicates, nothing dropped
    n = 3000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("https://hot/x"))
                               .otherwise(F.concat(F.lit("https://u/"), F.col("id").cast("string"))).alias("url"))
    out = admission.url_admission(df.repartition(7), "url")
    counts = {r.status: r.n for r in out.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"admitted": 2 * n // 3 + 1, "duplicate_in_input": n // 3 - 1}
    assert out.filter("url = 'https://hot/x' AND status = 'admitted'").first().row_id == 0


def test_observe_progress(spark):
    from navbuckets.operators.report import observe_progress

    df = spark.createDataFrame([("next",), (None,), ("error: x",)], "bucket string")
    out, obs = observe_progress(df)
    out.write.format("noop").mode("overwrite").save()
    assert obs.get == {"completed": 2, "total": 3}
