"""Deterministic inputs derived from the driver's tables (FIXTURES.md).

Each fixture is one SQL text that both Spark (``spark.sql`` over the table's DataFrame)
and DuckDB run unchanged, so the oracle sees the very same inputs. The work grows with
the tables: every row of ``pages`` / ``events`` is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from navbuckets.operators import rules

# ---------------------------------------------------------------------------
# Markup overlay inserted before </article>, chosen by page_id modulo their number.
# The first are mixed cases and near misses; then one case per entry of every rule's list.
MIXED = [
    '<a href="?page=2">Next</a>',
    '<nav class="pagination"><a href="?page=1">1</a> <a href="?page=2">2</a></nav>',
    '<nav><a href="?page=2" style="display:none">2</a></nav>',
    '<p>Showing page 1 of 10</p><a href="/page/2">more</a>',
    '<a href="#top">Back to top &rarr;</a>',
    '<a href="?p=9">&raquo;</a>',
    '<a href="?p=9">&gt;&gt;</a>',
    '<a href="/x">Last</a><span>12</span>',
    '<a href="/x" title="a > b">Jobs</a>',
    '<a-card href="/page/2">x</a-card>',
    '<a href="?page=2" class="nav hidden md:block" title="no hidden fees">Next</a>',
    '<a href="?page=2" hidden>Next</a>',
    '<button><i></i>Load More</button>',
    '<nav>Results 1 &ndash; 20 of 300</nav>',
    '<nav><span>1</span> <span>3</span></nav>',
    '<a href="?p=3">plain</a>',
    '',
]
SELECTOR_CASES = [
    '<button aria-label="Next results">x</button>', '<button aria-label="go next">x</button>',
    '<i class="x wd-paginator-next-button">x</i>', '<i data-automation-id="pageNext">x</i>',
    '<i class="next-page-button">x</i>', '<i class="sf-pagination-next">x</i>',
]
RANGE_CASES = ["Results 1 - 20 of 300", "Page 2 of 9", "1 - 20 of 300", "Items per page", "Jump to page"]
NUMBER_CASES = ['<nav><span>1</span> <span>2</span></nav>', '<ul class="pager"><li>1</li> <li>2</li></ul>',
                '<b><span>1</span> <span>2</span></b>', '<p><i><span>1</span></i> 2</p>']
# Unclosed, hidden and text-only elements.
NESTED_CASES = [
    '<div><p hidden>x</div><a href="?page=2">Next</a>',
    '<nav><span>1</span> <span style="display:none">2</span></nav>',
    '<button>Next<span hidden> top</span></button><a href="?page=2">2</a>',
    '<button>Next<b> stop</b></button>',
    '<textarea><a href="?page=2">Next</a></textarea>',
    '<ul hidden><li>a<li><a href="?page=2">Next</a></ul><a href="/page/3">3</a>',
    '<ul><li>x<ul><li hidden>y</ul><li><a href="?page=2">Next</a></ul>',
    '<table><tr><td hidden>x<td><a href="?page=2">2</a><tr><td>1</table>',
    '<noscript><a href="?page=2">Next</a></noscript><template><button>Load more</button></template>',
    '<div><span>1</div><span> 2</span>',
    '<dl><dt hidden>1<dd>1<dd>2</dl>',
    '<select><optgroup><option>1<option hidden>2<optgroup><option>3</select>',
    '<table><tr><td></div><b>1</b> 2</table></nav>',
    '<iframe src="/ad"><a href="?page=2">Next</a></iframe><a href="?x">a<a href="?y">b</a>',
    '<div hidden><div><p>1<p>2</div></div><span><i>1</i></span>',
]
# Links and numbers hidden or shown by a page's own stylesheet.
STYLE_CASES = [
    '<style>.gone { display : none }</style><a class="x gone" href="?page=2">Next</a>',
    '<style>#go, .y{visibility:hidden}</style><div id="go"><a href="?page=2">Next</a></div>',
    '<style>a.gone{display:none}.gone{display:block}</style><a class="gone" href="?page=2">Next</a>',
    '<style>.gone{display:none!important}a.gone.on{display:inline}</style><a class="on gone" href="?page=2">2</a>',
    '<style>.gone{display:none}</style><a class="gone" style="display:inline" href="?page=2">Next</a>',
    '<style>.gone{display:none !important;color:red}</style><a class="gone" style="display:inline" href="?page=2">Next</a>',
    '<style>.show{display:block}</style><a class="show" hidden href="?page=2">Next</a>',
    '<style>@media print{.gone{display:none}} /* .gone{display:none} */ nav .gone,.gone:hover,.gone[x]{display:none}</style><a class="gone" href="?page=2">Next</a>',
    '<style>.a{display:none}.a{display:block}.b{visibility:collapse}</style><a class="a" href="?page=2">2</a><nav class="b"><i>1</i> 2</nav>',
    '<style>*{visibility:visible}i{display:none}</style><nav>1 <i>2</i></nav><!-- <style>nav{display:none}</style> -->',
]
# Character references: one case per form.
REFERENCE_CASES = ['<button>&#x203A;</button>', '<button>&#X203a;</button>', '<button>&#8250;</button>', '<button>&rsaquo;</button>',
                   '<button>&RightArrow;</button>', '<button>&rarr</button>', '<button>&gt</button>', '<button>&gtx &notit; &amp;gt;</button>',
                   '<button>&#155;</button>', '<button>&#x0;&#xD800;&#99999999;&#0062;</button>', '<a href="?page=2&gt=3&amp;x=&eacute;">&laquo</a>',
                   '<nav>Results 1 &#x2013; 20&nbsp;of 300</nav>', '<i title="&quot;">&unknown; & &#; &#x;</i>']
OVERLAY = (
    MIXED + SELECTOR_CASES + NUMBER_CASES + NESTED_CASES + STYLE_CASES + REFERENCE_CASES
    + [f"<p>{t}</p>" for t in RANGE_CASES]
    + ["<span>" + t.replace("<", "&lt;") + "</span>" for t in dict.fromkeys([*rules.NEXT_KEYWORDS, *rules.NEXT_SYMBOLS, *rules.PAGESELECT_KEYWORDS, *rules.PAGESELECT_SYMBOLS])]
    + [f"<{tag}>{t.capitalize()}</{tag}>" for t in rules.LOADMORE_KEYWORDS for tag in ("button", "a")]
)
CASES = len(OVERLAY)
# ---------------------------------------------------------------------------

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _case(expr: str, snippets: list[str], escape: bool = False) -> str:
    def lit(s: str) -> str:
        if escape:
            s = s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")
        return "'" + s.replace("'", "''") + "'"

    whens = " ".join(f"WHEN {i} THEN {lit(s)}" for i, s in enumerate(snippets))
    return f"(CASE {expr} {whens} ELSE '' END)"


def overlay_expr(page_id: str = "page_id", html: str = "html") -> str:
    return f"replace({html}, '</article>', concat({_case(f'{page_id} % {CASES}', OVERLAY)}, '</article>'))"


OVERLAY_PAGES_SQL = f"SELECT page_id, url, {overlay_expr()} AS html FROM pages"

# Pages whose article also holds iframes with a srcdoc (escaped markup):
# page_id % 3 = 1 -> a frame by src, then one (snippet (page_id+3) % CASES); = 2 -> a frame without links,
# then a frame with snippet (page_id+1) % CASES; = 0 -> none.
_IFRAME_ONE = f"concat('<iframe src=\"/ad\"></iframe><iframe srcdoc=\"', {_case(f'(page_id + 3) % {CASES}', OVERLAY, escape=True)}, '\"></iframe>')"
_IFRAME_TWO = ("concat('<iframe srcdoc=\"&lt;p&gt;frame without links&lt;/p&gt;\"></iframe>', "
               f"'<iframe srcdoc=\"', {_case(f'(page_id + 1) % {CASES}', OVERLAY, escape=True)}, '\"></iframe>')")
FRAMED_PAGES_SQL = (
    "SELECT page_id, url, replace(" + overlay_expr() + ", '</article>', concat(CASE page_id % 3 "
    f"WHEN 1 THEN {_IFRAME_ONE} WHEN 2 THEN {_IFRAME_TWO} ELSE '' END, '</article>')) AS html FROM pages"
)

# URL list: one row per page (row_id = 2*page_id) plus a second copy for page_id % 7 = 0.
URL_LIST_SQL = """
SELECT CAST(page_id * 2 AS BIGINT) AS row_id,
       concat('company ', CAST(page_id AS STRING)) AS companyName,
       CASE page_id % 10
         WHEN 0 THEN concat('  ', url)
         WHEN 1 THEN regexp_replace(url, '^https?://', '')
         WHEN 2 THEN NULL
         WHEN 3 THEN '   '
         WHEN 4 THEN 'NaN'
         WHEN 5 THEN concat(url, ' ')
         WHEN 6 THEN concat(upper(substr(url, 1, 4)), substr(url, 5))
         ELSE url END AS companyUrl,
       CASE page_id % 8
         WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'next' WHEN 3 THEN 'nan'
         WHEN 4 THEN 'Error: x' WHEN 5 THEN ' error: y ' WHEN 6 THEN 'pageselect' ELSE 'scrolldown' END AS flow
FROM pages
UNION ALL
SELECT CAST(page_id * 2 + 1 AS BIGINT) AS row_id,
       concat('copy ', CAST(page_id AS STRING)) AS companyName,
       CASE page_id % 4
         WHEN 0 THEN url
         WHEN 1 THEN concat(' ', url, ' ')
         WHEN 2 THEN regexp_replace(url, '^https://', '')
         ELSE NULL END AS companyUrl,
       CASE page_id % 3 WHEN 0 THEN 'loadmore' WHEN 1 THEN NULL ELSE 'error: page_load_failed' END AS flow
FROM pages WHERE page_id % 7 = 0
"""

_BASE_H = "(1000 + (page_id % 7) * 10)"
_BASE_N = "(300 + page_id % 5)"
_TS = "CAST('2024-01-01 00:00:00' AS TIMESTAMP)"
OBSERVATIONS_SQL = f"""
SELECT page_id, 'baseline' AS phase, CAST({_BASE_H} AS BIGINT) AS height, CAST({_BASE_N} AS BIGINT) AS n_elements,
       url AS current_url, {_TS} AS observed_at
FROM pages WHERE page_id % 10 <> 9
UNION ALL
SELECT page_id, 'scroll1',
       CAST({_BASE_H} + CASE page_id % 10 WHEN 0 THEN 401 WHEN 1 THEN 400 WHEN 3 THEN 500 WHEN 4 THEN 450
                                          WHEN 5 THEN 420 ELSE 0 END AS BIGINT),
       CAST({_BASE_N} + CASE page_id % 10 WHEN 1 THEN 8 ELSE 0 END AS BIGINT),
       CASE page_id % 10 WHEN 3 THEN concat(url, '?page=2') WHEN 4 THEN concat(url, '#x')
                         WHEN 5 THEN concat(url, '/') ELSE url END,
       {_TS}
FROM pages WHERE page_id % 10 <> 9
UNION ALL
SELECT page_id, 'scroll2',
       CAST({_BASE_H} + CASE page_id % 10 WHEN 1 THEN 400 WHEN 3 THEN 500 ELSE 0 END AS BIGINT),
       CAST({_BASE_N} + CASE page_id % 10 WHEN 1 THEN 8 WHEN 2 THEN 9 ELSE 0 END AS BIGINT),
       CASE page_id % 10 WHEN 3 THEN concat(url, '?page=2') ELSE url END,
       {_TS}
FROM pages WHERE page_id % 10 NOT IN (0, 9)
UNION ALL
SELECT page_id, 'click_before', CAST({_BASE_H} AS BIGINT), CAST({_BASE_N} AS BIGINT), url, {_TS}
FROM pages WHERE page_id % 10 IN (6, 7) OR page_id % 12 = 4
UNION ALL
SELECT page_id, 'click_after',
       CAST({_BASE_H} + CASE CAST(floor(page_id / 10) AS BIGINT) % 3 WHEN 0 THEN 200 WHEN 1 THEN 201 ELSE 0 END AS BIGINT),
       CAST({_BASE_N} + CASE CAST(floor(page_id / 10) AS BIGINT) % 3 WHEN 0 THEN 5 WHEN 1 THEN 0 ELSE 6 END AS BIGINT),
       url, {_TS}
FROM pages WHERE page_id % 10 IN (6, 7) OR page_id % 12 = 4
"""

VERDICTS_SQL = """
SELECT page_id, 'page' AS kind, 'structural' AS branch, 1 AS attempt,
       CASE page_id % 6 WHEN 0 THEN 'next' WHEN 1 THEN ' Pageselect ' WHEN 2 THEN 'scrolldown' ELSE 'none' END AS answer
FROM pages WHERE page_id % 6 < 4
UNION ALL
SELECT page_id, 'page', 'structural', 2, 'pageselect' FROM pages WHERE page_id % 6 = 3
UNION ALL
SELECT page_id, 'page', 'behavioral', 1,
       CASE page_id % 6 WHEN 0 THEN 'loadmore' WHEN 1 THEN 'scrolldown' WHEN 2 THEN 'next' ELSE ' LoadMore' END
FROM pages WHERE page_id % 6 IN (0, 1, 2, 4)
UNION ALL
SELECT page_id, 'url_only', CAST(NULL AS STRING), 1,
       CASE page_id % 5 WHEN 0 THEN 'loadmore | modern site' WHEN 1 THEN 'none | few roles' WHEN 2 THEN 'pageselect'
                        WHEN 3 THEN 'NEXT|x|y' ELSE 'free text without a type' END
FROM pages WHERE page_id % 4 <> 3
"""

# Attempt log from every event: per events.user_id, three events in a row by (ts, event_id) are
# the attempts of one page (the last page of a user may have one or two). 'error' events are
# failed attempts (event_id % 3 = 0: raised, else returned 'error: page_load_failed').
ATTEMPTS_SQL = """
SELECT user_id + 1000000 * CAST(floor((rn - 1) / 3) AS BIGINT) AS page_id, CAST((rn - 1) % 3 + 1 AS INT) AS attempt,
       CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'error: page_load_failed' END
            ELSE CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'next' WHEN 1 THEN 'pageselect'
                                                       WHEN 2 THEN 'loadmore' ELSE 'scrolldown' END END AS outcome,
       CASE WHEN event_type = 'error' AND event_id % 5 <> 0 THEN CASE event_id % 4
            WHEN 0 THEN 'Timed out receiving message from renderer'
            WHEN 1 THEN 'unknown error: net::ERR_NAME_NOT_RESOLVED (DNS_PROBE_FINISHED_NXDOMAIN)'
            WHEN 2 THEN 'renderer crashed'
            ELSE 'boom: the connection was reset while the page body was still loading' END END AS error_message,
       ts
FROM (SELECT event_id, ts, user_id, event_type, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) e
"""


# A tagger's link table that differs from the library's own tagging: per page by page_id % 8 a link with an
# address, without one (texts that stand on the page, lower-cased, long, quoted or nowhere), with and without
# a display flag, two links, or none.
_A_TEXT = "lower(trim(regexp_extract(html, '<li><a href=\"[^\"]*\">([a-z][^<]*)</a>', 1)))"
_B_TEXT = "lower(substr(regexp_extract(html, '<b>[A-Z][^.]*[.] *([^<]*)', 1), 1, 30))"
LINKS_SQL = f"""
SELECT page_id, CAST(1 AS INT) AS pos, CASE page_id % 3 WHEN 0 THEN 'NEXT' ELSE 'PAGE' END AS link_type,
       CASE page_id % 8 WHEN 1 THEN {_A_TEXT} WHEN 2 THEN 'load more' WHEN 3 THEN {_B_TEXT} WHEN 4 THEN 'visitor''s page' WHEN 5 THEN ''
                        ELSE ' Next ' END AS text,
       CASE page_id % 8 WHEN 6 THEN '?page=2' WHEN 7 THEN '/nowhere' WHEN 5 THEN '' END AS href,
       CASE WHEN page_id % 16 >= 8 AND page_id % 8 <> 0 THEN NULL WHEN page_id % 8 = 0 THEN page_id % 5 = 0 ELSE NULL END AS displayed
FROM pages WHERE page_id % 9 <> 8
UNION ALL
SELECT page_id, 2, 'NEXT', {_A_TEXT}, CAST(NULL AS STRING), CASE WHEN page_id % 4 = 1 THEN false END FROM pages WHERE page_id % 5 = 2
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...] = ("pages",)) -> DataFrame:
    """Run a fixture SQL text over the given tables (bound as DataFrame parameters, no views)."""
    text = sql.replace("{", "{{").replace("}", "}}")  # braces of the SQL text itself are no parameters
    kwargs = {}
    for t in tables:
        kwargs[f"t_{t}"] = table(spark, sf_dir, t)
        text = _bind(text, t)
    return spark.sql(text, **kwargs)


def _bind(sql: str, name: str) -> str:
    import re

    return re.sub(rf"\bFROM {name}\b", f"FROM {{t_{name}}}", sql)


def overlay_pages(spark, sf_dir):
    return derive(spark, sf_dir, OVERLAY_PAGES_SQL)


def framed_pages(spark, sf_dir):
    return derive(spark, sf_dir, FRAMED_PAGES_SQL)


def url_list(spark, sf_dir):
    return derive(spark, sf_dir, URL_LIST_SQL)


def observations(spark, sf_dir):
    return derive(spark, sf_dir, OBSERVATIONS_SQL)


def links(spark, sf_dir):
    return derive(spark, sf_dir, LINKS_SQL)


def verdicts(spark, sf_dir):
    return derive(spark, sf_dir, VERDICTS_SQL)


def attempts(spark, sf_dir):
    return derive(spark, sf_dir, ATTEMPTS_SQL, ("events",))


# Measurements from every event: per user, three events in a row by (ts, event_id) are the
# baseline and the two scroll readings of one page; height = value * 100, element count from event_id,
# and a 'view' event reads the URL with a fragment (same page), a 'signup' one with a query.
EVENT_OBSERVATIONS_SQL = """
SELECT user_id + 1000000 * CAST(floor((rn - 1) / 3) AS BIGINT) AS page_id,
       CASE (rn - 1) % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'scroll1' ELSE 'scroll2' END AS phase,
       CAST(floor(value * 100) AS BIGINT) AS height,
       CAST(300 + event_id % 20 AS BIGINT) AS n_elements,
       concat('https://shop.example/u/', CAST(user_id AS STRING),
              CASE event_type WHEN 'view' THEN '#top' WHEN 'signup' THEN '?step=2' ELSE '' END) AS current_url,
       CAST(ts AS TIMESTAMP) AS observed_at
FROM (SELECT event_id, ts, user_id, event_type, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) e
"""


def event_observations(spark, sf_dir):
    return derive(spark, sf_dir, EVENT_OBSERVATIONS_SQL, ("events",))
