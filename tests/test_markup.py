"""Small pages on which a careless tokenizer goes wrong (each with the answer a browser gives)."""

import pytest
from conftest import page

from navbuckets.plans.classify import page_evidence


def ev(spark, body):
    df = spark.createDataFrame([(1, page(body))], "page_id long, html string")
    return page_evidence(df).collect()[0]["ev"].asDict(recursive=True)


@pytest.mark.parametrize("body,expect", [
    ('<a href="/x" title="a > b">Jobs</a>', {"next": False, "has_links": False}),
    ("<a href='/x' title='1 < 2 > \"0\"'>Jobs</a>", {"next": False}),
    ('<a-card href="/page/2">x</a-card>', {"has_links": False}),
    ('<a href="?page=2" title="no hidden fees">Next</a>', {"next": True}),
    ('<a href="?page=2" class="nav hidden md:block">Next</a>', {"next": True}),
    ('<a href="?page=2" hidden>Next</a>', {"next": False}),
    ('<a href="?page=2" style="color:red; display : none">Next</a>', {"next": False}),
    ("<button><i></i>Load More</button>", {"loadmore": {"kind": "button", "keyword": "load more"}}),
    ("<span><i></i>Next</span>", {"r2": "next"}),
    ("<span><i>Next</i></span>", {"r2": None}),
    ("<nav>Results 1 &ndash; 20 of 300</nav>", {"r4": True}),
    ('<div><p hidden>x</div><a href="?page=2">Next</a>', {"next": True, "r2": "next", "has_links": True}),
    ('<nav><span>1</span> <span style="display:none">2</span></nav>', {"r8": None, "r9": False}),
    ('<button>Next<span hidden> top</span></button><a href="?page=2">2</a>', {"r2": "next", "pageselect": True}),
    ("<button>Next<b> top</b></button>", {"r2": None}),
    ("<button>&#x203A;</button>", {"r5": "›"}),
    ("<button>&#8250</button>", {"r5": "›"}),
    ("<button>&gtx</button>", {"r2": ">"}),
    ('<textarea><a href="?page=2">Next</a></textarea>', {"has_links": False, "next": False}),
    ('<noscript><a href="?page=2">Next</a></noscript>', {"has_links": False}),
    ('<iframe><a href="?page=2">Next</a></iframe>', {"has_links": False, "r2": None}),
    ('<ul hidden><li><a href="?page=2">Next</a></ul>', {"has_links": True, "next": False}),
    ('<ul><li hidden>x<li><a href="?page=2">Next</a></ul>', {"next": True}),
    ('<table><tr><td hidden>x<td><a href="?page=2">2</a></table>', {"pageselect": True}),
    ('<style>.gone{display:none}</style><a class="gone" href="?page=2">Next</a>', {"next": False, "has_links": True}),
    ('<style>.gone{display:none}a.gone{display:inline}</style><a class="gone" href="?page=2">Next</a>', {"next": True}),
    ('<style>@media print{a{display:none}}</style><a href="?page=2">Next</a>', {"next": True}),
    ("<p>a < b and c</p><a href='?page=2'>2</a>", {"has_links": True, "pageselect": True}),
])
def test_markup(spark, body, expect):
    got = ev(spark, body)
    assert {k: got[k] for k in expect} == expect


def test_texts_found_in_a_long_text(spark):
    """the text was split again for each of its suffixes, so the time grew with its square."""
    import time

    from pyspark.sql import functions as F

    from navbuckets.functions.text import found_in

    hay = "".join(chr(97 + i * i * 7 % 26) + ("é" if i % 50 == 0 else "") for i in range(60_000))
    some = [hay[i * 1400:i * 1400 + 1 + i % 20] for i in range(40)]
    needles = [*some, "none at all", "", "é"]
    df = spark.createDataFrame([(1, hay, needles), (2, hay, needles[-5:]), (3, "", ["a"]), (4, "abc", ["abcd", "bc", None])], "id int, hay string, needles array<string>")
    t0 = time.time()
    got = {r.id: r.found for r in df.select("id", found_in(F.col("needles"), F.col("hay"), 20).alias("found")).collect()}
    assert time.time() - t0 < 30
    assert [sorted(got[i]) for i in (1, 2, 3, 4)] == [sorted(n for n in needles if n in hay), sorted(n for n in needles[-5:] if n in hay), [], ["bc"]]
