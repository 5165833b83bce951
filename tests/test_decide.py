import datetime as dt

import pytest

from conftest import page
from navbuckets.plans.classify import classify_pages

OBS = "page_id long, phase string, height long, n_elements long, current_url string, observed_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def run(spark, rows, body="<p>x</p>", verdicts=None):
    pages = spark.createDataFrame([(1, "https://a.com/jobs", page(body))], "page_id long, url string, html string")
    obs = spark.createDataFrame([(1, p, h, n, u, T0) for p, h, n, u in rows], OBS)
    v = spark.createDataFrame(verdicts, "page_id long, kind string, branch string, attempt int, answer string") \
        if verdicts else None
    return classify_pages(pages, observations=obs, verdicts=v).collect()[0]


U = "https://a.com/jobs"


@pytest.mark.parametrize("s1,s2,expect_bucket,expect_source", [
    ((1400, 308, U), (1400, 308, U), "scrolldown", "fallback"),        # +400 / +8 exactly: not confirmed
    ((1401, 300, U), (1000, 300, U), "scrolldown", "rule"),           # +401 at try 1
    ((1000, 300, U), (1000, 309, U), "scrolldown", "rule"),           # +9 elements only at try 2
    ((1500, 300, U + "?page=2"), (1000, 300, U), "scrolldown", "fallback"),  # URL changed
    ((1500, 300, U + "/#x"), (1000, 300, U), "scrolldown", "rule"),   # '#x' and trailing '/' ignored
])
def test_scroll_thresholds(spark, s1, s2, expect_bucket, expect_source):
    r = run(spark, [("baseline", 1000, 300, U), ("scroll1",) + s1, ("scroll2",) + s2])
    assert (r.bucket, r.bucket_source) == (expect_bucket, expect_source)


@pytest.mark.parametrize("after,expect", [((1200, 305), "scrolldown"), ((1201, 300), "loadmore")])
def test_click_thresholds(spark, after, expect):
    rows = [("baseline", 1000, 300, U), ("scroll1", 1000, 300, U), ("scroll2", 1000, 300, U),
            ("click_before", 1000, 300, U), ("click_after", after[0], after[1], U)]
    assert run(spark, rows, body="<button>Load More</button>").bucket == expect


def test_structural_verdict_constrained_to_branch(spark):
    hidden = '<nav><a href="?page=2" style="display:none">2</a></nav>'
    r = run(spark, [], body=hidden, verdicts=[(1, "page", "structural", 1, "scrolldown")])
    assert (r.branch, r.bucket, r.bucket_source) == ("structural", "next", "fallback")
    r = run(spark, [], body=hidden, verdicts=[(1, "page", "structural", 1, " PageSelect ")])
    assert (r.bucket, r.bucket_source) == ("pageselect", "judge")


def test_missing_snapshot_falls_back(spark):
    pages = spark.createDataFrame([(1, "https://a.com", None)], "page_id long, url string, html string")
    r = classify_pages(pages).collect()[0]
    assert (r.branch, r.bucket, r.bucket_source) == ("behavioral", "scrolldown", "fallback")


def test_frames_path(spark):
    from navbuckets.sources.io import frames_from_srcdoc

    html = page('<iframe srcdoc="&lt;p&gt;none&lt;/p&gt;"></iframe>'
                '<iframe srcdoc="&lt;a href=&quot;?page=2&quot;&gt;Next&lt;/a&gt;"></iframe>')
    pages = spark.createDataFrame([(1, "https://a.com", html)], "page_id long, url string, html string")
    r = classify_pages(pages, frames=frames_from_srcdoc(pages)).collect()[0]
    assert (r.branch, r.bucket) == ("structural", "next")
    assert any(s.startswith("frame(1) R1(NEXT,") for s in r.signals)


def test_classify_url_list(spark):
    from navbuckets.plans.run import classify_url_list

    urls = spark.createDataFrame([(0, "A", "a.com/jobs"), (1, "B", " https://a.com/jobs"), (2, "C", None),
                                  (3, "D", "https://b.com/careers")],
                                 "row_id long, companyName string, companyUrl string")
    pages = spark.createDataFrame([(10, "https://a.com/jobs", page('<a href="?page=2">Next</a>')),
                                   (11, "https://a.com/jobs", page("<p>later copy</p>"))],
                                  "page_id long, url string, html string")
    got = {r.row_id: (r.status, r.bucket) for r in classify_url_list(urls, pages).collect()}
    assert got == {0: ("admitted", "next"), 1: ("duplicate_in_input", "duplicate_in_input"),
                   2: ("invalid_url", "invalid_url"), 3: ("admitted", None)}
