import pytest

from conftest import page
from navbuckets.plans.classify import page_evidence


def ev(spark, body, rule_set="intended"):
    df = spark.createDataFrame([(1, page(body))], "page_id long, html string")
    return page_evidence(df, rule_set).collect()[0]["ev"].asDict(recursive=True)


@pytest.mark.parametrize("body,has_links,nxt,psel", [
    ('<a href="?page=2">Next</a>', True, True, False),                          # R0 NEXT, R1, R2
    ('<nav class="pagination"><a href="?page=1">1</a> <a href="?page=2">2</a></nav>', True, False, True),
    ('<nav><a href="?page=2" style="display:none">2</a></nav>', True, False, False),  # hidden: ambiguous
    ('<button aria-label="Next results">x</button>', False, True, False),        # R2/R3 without links
    ('<a href="?p=9">&gt;&gt;</a>', True, True, True),                           # F12: '>' fires too; next wins
    ('<a href="#top">Back to top &rarr;</a>', False, False, False),              # P7 exclusion
])
def test_overlay_cases(spark, body, has_links, nxt, psel):
    e = ev(spark, body)
    assert (e["has_links"], e["next"], e["pageselect"]) == (has_links, nxt, psel)


def test_range_text_and_near_miss(spark):
    assert ev(spark, "<p>Showing page 1 of 10</p>")["r4"] is True
    assert ev(spark, "<p>Showing page one of ten</p>")["r4"] is False


def test_first_last_substring_and_double_arrow(spark):
    assert ev(spark, "<span>Blast</span>")["r6"] == "last"
    assert ev(spark, "<span>&laquo;</span>")["r7"] == "«"
    assert ev(spark, "<span>plain</span>")["r7"] is None


def test_number_group_container_and_near_miss(spark):
    e = ev(spark, '<ul class="pages"><li>1</li><li>2</li></ul>')
    assert e["r8"] == "pages"
    assert ev(spark, "<ul><li>12</li></ul>")["r8"] is None  # '12' is not '1' and '2'


def test_number_neighbourhood(spark):
    e = ev(spark, "<p><span>1</span> <span>2</span></p>")
    assert e["r8"] is None and e["r9"] is True


def test_platform_selector_case_sensitive(spark):
    assert ev(spark, '<button aria-label="NEXT">x</button>')["r3"] is None
    assert ev(spark, '<div data-automation-id="pageNext">x</div>')["r3"] == '[data-automation-id="pageNext"]'


def test_loadmore_button_before_link_and_first_node_only(spark):
    assert ev(spark, '<a href="x">Load more</a><button>Load More</button>')["loadmore"] == {
        "kind": "button", "keyword": "load more"}
    hidden_first = '<button style="display:none">Show more</button><button>Show more</button>'
    assert ev(spark, hidden_first)["loadmore"] is None  # only the first match is tested


def test_as_written_rule_set_skips_later_rules(spark):
    e = ev(spark, "<p>Showing page 1 of 10</p><span>Last</span>", rule_set="as_written")
    assert e["r4"] is False and e["r6"] is None


def test_link_visibility_counting_path(spark):
    from navbuckets.operators.elements import links

    shown = "".join(f'<a href="?page={i}">{i}</a>' for i in range(1, 71))                 # 70 PAGE links
    hidden = '<a href="?page=999" style="display:none">999</a>'                               # hidden only
    dup = '<a href="?page=5" style="display:none">5</a>'                                       # hidden twin of a shown href
    df = spark.createDataFrame([(1, page(shown + hidden + dup))], "page_id long, html string")
    vis = {(r.href, r.displayed): r.visible for r in links(df).collect()}
    assert vis[("?page=999", False)] is False
    assert vis[("?page=5", False)] is True and vis[("?page=5", True)] is True
    assert all(v for (h, shown_), v in vis.items() if shown_)
