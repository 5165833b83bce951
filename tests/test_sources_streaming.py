import glob
import os
import tempfile

from pyspark.sql import functions as F

from conftest import page
from navbuckets.sources import io


def _csv(text):
    d = tempfile.mkdtemp(prefix="nb-csv-")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_read_url_list_short_rows_and_blanks(spark):
    p = _csv("companyName,companyUrl,flow\nA, https://a.com/careers\nB,https://b.com/jobs, \nC,,\n")
    rows = io.read_url_list(spark, p, columns=["companyName", "companyUrl", "flow"]).collect()
    assert rows[0].companyUrl == " https://a.com/careers" and rows[0].flow is None   # short row, blank kept
    assert rows[1].flow == " "
    assert rows[2].companyUrl is None


def test_find_url_column_steps(spark):
    df = spark.createDataFrame([("x", "https://a")], "name string, Website_URL string")
    assert io.find_url_column(df) == "Website_URL"                      # content step
    df2 = spark.createDataFrame([("x", "y")], "name string, URL string")
    assert io.find_url_column(df2) == "URL"                             # case-insensitive name
    assert io.find_url_column(df2, io.URL_COLUMNS_STRICT, case_insensitive=False) == "name"  # first column


def test_frames_from_srcdoc(spark):
    html = page('<iframe srcdoc="&lt;a href=&quot;?page=2&quot;&gt;Next&lt;/a&gt;"></iframe>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    fr = {r.frame_idx: r.html for r in io.frames_from_srcdoc(df).collect()}
    assert set(fr) == {-1, 0} and fr[0] == '<a href="?page=2">Next</a>'


def test_write_results_in_row_order(spark):
    out = tempfile.mkdtemp(prefix="nb-out-") + "/r"
    df = spark.range(0, 200).select(F.col("id").alias("row_id"), F.lit("next").alias("bucket")).repartition(5)
    io.write_results(df, out, fmt="csv")
    ids = []
    for f in sorted(glob.glob(out + "/part-*.csv")):
        ids += [int(line.split(",")[0]) for line in open(f).read().splitlines()[1:]]
    assert ids == list(range(200))


def test_stream_restart_does_not_repeat_work(spark):
    from navbuckets.plans import fixtures as fx
    from navbuckets.streaming import stream as S

    sf = "/root/testdata/sf0.001"
    out, ck = S.stream_folder(spark, "t5")
    pages = S.pages_stream(spark, sf).select("page_id", "url", F.expr(fx.overlay_expr()).alias("html"))
    res = S.classify_stream(pages).select("page_id", "bucket")
    S.run_to_end(res.writeStream.format("parquet").outputMode("append"), out, ck)
    n1 = spark.read.parquet(out).count()
    S.run_to_end(res.writeStream.format("parquet").outputMode("append"), out, ck)  # restart, same checkpoint
    assert spark.read.parquet(out).count() == n1 == fx.table(spark, sf, "pages").count()


def test_assign_row_ids_dense_in_file_order(spark):
    d = tempfile.mkdtemp(prefix="nb-ids-") + "/csv"
    spark.range(0, 500).select(F.col("id").cast("string").alias("v")).repartition(4).sortWithinPartitions("v") \
        .write.option("header", True).csv(d)
    df = io.read_url_list(spark, d, columns=["v"])
    got = io.assign_row_ids(df).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(500))
    expected = [line for f in sorted(glob.glob(d + "/part-*.csv")) for line in open(f).read().splitlines()[1:]]
    assert [r.v for r in got] == expected  # file order, then position


def test_row_ids_follow_file_order_not_size(spark):
    d = tempfile.mkdtemp(prefix="nb-ids2-")
    for name, n in (("a", 2), ("b", 50), ("c", 7)):
        with open(f"{d}/{name}.csv", "w") as f:
            f.write("v\n" + "".join(f"{name}{i}\n" for i in range(n)))
    got = io.assign_row_ids(io.read_url_list(spark, d, columns=["v"])).orderBy("row_id").collect()
    assert [r.v for r in got] == [f"{x}{i}" for x, n in (("a", 2), ("b", 50), ("c", 7)) for i in range(n)]


def test_quoted_names_and_all_iframes(spark):
    p = _csv('companyName,companyUrl\n"Acme ""Best"", Inc",https://a.com\n')
    row = io.read_url_list(spark, p, columns=["companyName", "companyUrl"]).collect()[0]
    assert (row.companyName, row.companyUrl) == ('Acme "Best", Inc', "https://a.com")
    html = page("""<iframe src="/x" title="a > b"></iframe><iframe srcdoc="<b>1</b>"></iframe><iframe srcdoc='&lt;i&gt;'></iframe>""")
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    fr = {r.frame_idx: r.html for r in io.frames_from_srcdoc(df).collect()}
    assert {k: v for k, v in fr.items() if k >= 0} == {1: "<b>1</b>", 2: "<i>"}


def test_null_tokens(spark):
    p = _csv("companyName,companyUrl\nA,N/A\nB,None\nC,https://c\n")
    rows = io.read_url_list(spark, p, columns=["companyName", "companyUrl"], null_tokens=io.NULL_TOKENS).collect()
    assert [r.companyUrl for r in rows] == [None, None, "https://c"]


def test_stream_attempts_equal_batch_across_micro_batches(spark):
    """Attempts of a page in several files, out of order; pages with one or two attempts."""
    from navbuckets.operators.attempts import resolve_attempts
    from navbuckets.streaming import stream as S

    rows = [(1, 1, None, "timed out"), (1, 2, "next", None), (2, 1, "error: page_load_failed", None), (3, 1, None, None),
            (4, 1, None, "x" * 80), (4, 2, None, "x" * 80), (4, 3, "error: y", None), (5, 2, "loadmore", None), (5, 1, None, "z")]
    log = spark.createDataFrame(rows, "page_id long, attempt int, outcome string, error_message string")
    path = tempfile.mkdtemp(prefix="nb-att-") + "/log"
    for n in (2, 3, 1):
        log.where(F.col("attempt") == n).coalesce(1).write.mode("append").parquet(path)
    out, ck = S.stream_folder(spark, "t3")
    S.run_to_end(S.upsert_writer(S.resolve_attempts_stream(S.file_stream(spark, path, log.schema)), out), None, ck)
    got = sorted(map(tuple, S.latest(spark, out, "page_id").collect()))
    assert got == sorted(map(tuple, resolve_attempts(log).collect()))
    assert (3, "error: unknown", "error", 1, None) in got


def test_stream_failure_is_not_a_result(spark):
    import pytest

    from navbuckets.streaming import stream as S

    path = tempfile.mkdtemp(prefix="nb-bad-") + "/log"
    spark.range(3).write.parquet(path)
    out, ck = S.stream_folder(spark, "bad")
    bad = S.file_stream(spark, path, spark.range(1).schema).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        S.run_to_end(bad.writeStream.format("parquet").outputMode("append"), out, ck)


def test_stream_dedup_takes_each_url_once_over_hours_and_files(spark, monkeypatch):
    """Repeats more than an hour apart and a late first occurrence, one file per micro-batch."""
    from navbuckets.plans import fixtures as fx
    from navbuckets.plans import registry

    files = [[(0, "https://a"), (1, "https://b")], [(20_000, "https://c")], [(40_000, " https://a "), (40_001, "c")],
             [(2, "https://late"), (60_000, "https://b")], [(80_000, "a"), (80_001, "https://late")]]
    urls = spark.createDataFrame([(i, "n", u, None) for rows in files for i, u in rows],
                                 "row_id long, companyName string, companyUrl string, flow string")

    def staged(spark, df, name):
        path = tempfile.mkdtemp(prefix="nb-dedup-") + "/log"
        for rows in files:
            df.where(F.col("row_id").isin([i for i, _ in rows])).coalesce(1).write.mode("append").parquet(path)
        return path, df.schema

    monkeypatch.setattr(fx, "url_list", lambda *_: urls)
    monkeypatch.setattr(registry, "_stage_parquet", staged)
    got = sorted(r.url_norm for r in registry.Q["stream_dedup"](spark, "unused").collect())
    assert got == ["https://a", "https://b", "https://c", "https://late"]


def test_runs_end_after_a_silence_and_late_rows_are_counted(spark):
    from navbuckets.operators.attempts import resolve_attempts
    from navbuckets.streaming import stream as S

    import datetime as dt
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    files = [[(p, 1, None, "timed out", day(d, p % 5)) for p in range(20 * d, 20 * d + 20)] for d in range(12)]
    files[1].append((3, 2, "next", None, day(0, 20)))     # a second attempt of an open run
    files[6].append((3, 3, "loadmore", None, day(6, 1)))  # the page again: another run
    on_time = [r for f in files for r in f]
    files[8].append((5, 2, "next", None, day(0, 6)))      # far behind the watermark
    files.append([(None, 1, "next", None, day(60))])      # closes every run
    schema = "page_id long, attempt int, outcome string, error_message string, ts timestamp"
    path = tempfile.mkdtemp(prefix="nb-runs-") + "/log"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    out, ck = S.stream_folder(spark, "runs")
    runs = S.resolve_runs_stream(S.file_stream(spark, path, spark.createDataFrame([], schema).schema), None, "1 day", "1 hour")
    q = S.run_to_end(runs.writeStream.format("parquet").outputMode("append"), out, ck)
    got = sorted(map(tuple, spark.read.schema(runs.schema).parquet(out).where("page_id is not null").collect()))
    assert got == sorted(map(tuple, resolve_attempts(spark.createDataFrame(on_time, schema), silence="1 day").collect()))
    assert len(got) == 241 and [r[1:4] for r in got if r[0] == 3] == [("loadmore", "attempt 3", 1), ("next", "attempt 2", 2)]
    assert S.late_rows(q) == 1
    assert max(S.open_state(q)) <= 70  # a few days' runs, not all 241


def test_first_rows_whatever_the_order_of_arrival(spark):
    from navbuckets.operators.admission import url_admission
    from navbuckets.streaming import stream as S

    rows = [(5, "https://a"), (1, " https://a "), (3, "b"), (9, "https://b"), (0, None), (7, "c"), (2, "https://c")]
    path = tempfile.mkdtemp(prefix="nb-first-") + "/log"
    df = spark.createDataFrame(rows, "row_id long, companyUrl string")
    for part in ([5, 9, 0], [1, 7], [3, 2]):
        df.where(F.col("row_id").isin(part)).coalesce(1).write.mode("append").parquet(path)
    out, ck = S.stream_folder(spark, "first")
    S.run_to_end(S.upsert_writer(S.first_rows_stream(S.file_stream(spark, path, df.schema), "companyUrl"), out), None, ck)
    want = url_admission(df, "companyUrl").where("status = 'admitted'").select("url_norm", "row_id")
    assert sorted(map(tuple, S.latest(spark, out, "url_norm").select("url_norm", "row_id").collect())) == sorted(map(tuple, want.collect()))


def test_committed_results_replace_their_own_run_only(spark):
    import pytest

    base = tempfile.mkdtemp(prefix="nb-sink-") + "/r"
    ddl = "row_id long, bucket string"
    assert io.read_results(spark, base, ddl).collect() == []
    rows = lambda a, b, v: spark.range(a, b).select(F.col("id").alias("row_id"), F.lit(v).alias("bucket")).repartition(4)
    io.commit_results(rows(0, 100, "x"), base, "one")
    io.commit_results(rows(500, 700, "old"), base, "two")
    with pytest.raises(Exception, match="broken"):  # fails before its manifest: nothing of it is seen
        io.commit_results(rows(500, 700, "bad").withColumn("bucket", F.when(F.col("row_id") > 600, F.raise_error(F.lit("broken"))).otherwise("bad")), base, "two")
    assert io.read_results(spark, base, ddl).where("bucket = 'old'").count() == 200
    io.commit_results(rows(500, 650, "new"), base, "two")
    io.commit_results(rows(0, 0, "none"), base, "zero")
    got = sorted((r.line_no, r.run_id, r.row_id, r.bucket) for r in io.read_results(spark, base, ddl).collect())
    assert got == [(i, "one", i, "x") for i in range(100)] + [(100 + i, "two", 500 + i, "new") for i in range(150)]
    assert len(io.clean_results(spark, base)) >= 2 and io.read_results(spark, base, ddl).count() == 250
    io.commit_results(rows(0, 0, "none"), base, "one")  # an empty repetition empties its run
    assert io.read_results(spark, base, ddl).select("run_id").distinct().collect()[0][0] == "two"


def test_stream_queries_on_a_folder_of_page_files(spark):
    """The pages table may be a folder; its files were not found."""
    from navbuckets.plans.registry import Q

    sf = tempfile.mkdtemp(prefix="nb-folder-")
    rows = [(i, f"https://a.example/{i}", page('<a href="?page=2">Next</a>' if i % 2 else "<p>x</p>")) for i in range(24)] + [(None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{sf}/pages.parquet")
    want = sorted(map(tuple, Q["classify_pages"](spark, sf).collect()), key=str)
    assert sorted(map(tuple, Q["stream_classify"](spark, sf).collect()), key=str) == want and len(want) == 25
    buckets = {b: sum(r[3] == b for r in want) for b in {r[3] for r in want}}
    assert {r.bucket: r.n for r in Q["stream_progress"](spark, sf).collect()} == buckets
    assert Q["stream_results"](spark, sf).count() == len(want)
