"""Oracle SQL (DuckDB) per registered query; same column names as the Spark side."""

from __future__ import annotations

from navbuckets.plans import fixtures as fx
from oracle import pages_sql as P

O = {}

_EV = "WITH RECURSIVE " + P.dom_ctes(P.pages_input(fx.OVERLAY_PAGES_SQL)) + "," + P.evidence_ctes("intended")

O["classify_pages"] = (P.classify_sql(fx.OVERLAY_PAGES_SQL, fx.OBSERVATIONS_SQL, fx.VERDICTS_SQL)
                       + "\nSELECT page_id, url, branch, bucket, bucket_source, "
                         "bucket || ' <- ' || all_msgs AS reason FROM dec")
O["classify_as_written"] = (P.classify_sql(fx.OVERLAY_PAGES_SQL, fx.OBSERVATIONS_SQL, fx.VERDICTS_SQL, "as_written")
                            + "\nSELECT page_id, url, branch, bucket, bucket_source, "
                              "bucket || ' <- ' || all_msgs AS reason FROM dec")

for _name, _field in [("rule_next_keyword", "r2"), ("rule_platform_selector", "r3"), ("rule_range_text", "r4"),
                      ("rule_next_symbol", "r5"), ("rule_first_last", "r6"), ("rule_double_arrow", "r7"),
                      ("rule_number_group", "r8"), ("rule_number_adjacent", "r9")]:
    O[_name] = _EV + f"\nSELECT p.page_id, e.{_field} AS {_field} FROM pg p JOIN ev e ON e.rid = p.rid"

O["frame_indicators"] = _EV + ('\nSELECT p.page_id, e.has_links, e."next" AS next_ind, e.pageselect AS pageselect_ind '
                               "FROM pg p JOIN ev e ON e.rid = p.rid")
O["loadmore_candidate"] = _EV + ("\nSELECT p.page_id, CASE WHEN lm IS NULL THEN NULL WHEN split_part(lm, '|', 1) = 'button' "
                                 "THEN 'button' ELSE 'link' END AS lm_kind, split_part(lm, '|', 2) AS lm_keyword "
                                 "FROM pg p JOIN ev e ON e.rid = p.rid")
O["page_signals"] = _EV + (",\nsr AS (SELECT rid, count(*) AS n_signals, string_agg(msg, ' | ' ORDER BY ord, sub, msg) AS signals_text "
                           "FROM sg GROUP BY rid)\n"
                           "SELECT p.page_id, coalesce(sr.n_signals, 0)::INT AS n_signals, coalesce(sr.signals_text, '') AS signals_text "
                           "FROM pg p LEFT JOIN sr ON sr.rid = p.rid")

# --------------------------------------------------------------------------- URLs
from navbuckets.functions import text as _T  # noqa: E402
from navbuckets.operators import attempts as _A  # noqa: E402

q, strip, inlist, decode = P.q, P.strip, P.inlist, P.decode


def _blank(u):
    return f"({u} IS NULL OR lower({strip(u)}) IN ('', 'nan'))"


def _norm(u, strict=False):
    s = strip(u)
    has = f"(starts_with({s}, 'http://') OR starts_with({s}, 'https://'))" if strict else f"starts_with({s}, 'http')"
    return f"CASE WHEN {has} THEN {s} ELSE 'https://' || {s} END"


_UL = f"ul AS ({fx.URL_LIST_SQL})"
_PEND = f"regexp_matches(lower({strip(chr(99) + 'oalesce(flow, ' + q('nan') + ')')}), '^(error.*|nan|)$')"
_ADM = (f"ua0 AS (SELECT *, {_blank('companyUrl')} AS blank FROM ul),\n"
        f"ua1 AS (SELECT *, CASE WHEN NOT blank THEN {_norm('companyUrl')} END AS url_norm FROM ua0),\n"
        "ua AS (SELECT *, CASE WHEN blank THEN 'invalid_url' "
        "WHEN row_id = min(row_id) OVER (PARTITION BY url_norm) THEN 'admitted' ELSE 'duplicate_in_input' END AS status "
        "FROM ua1)")

# a CSV written in row order and read back: blank cells are null, blanks at a cell's ends stay, lines count from 0
_CELL = "CASE WHEN {0} = '' THEN NULL ELSE {0} END AS {0}"
O["url_list_scan"] = (f"WITH {_UL} SELECT CAST(row_id AS VARCHAR) AS row_id, " + ", ".join(
    _CELL.format(c) for c in ("companyName", "companyUrl", "flow")) + ", row_number() OVER (ORDER BY row_id) - 1 AS line_no FROM ul")
O["url_column_content"] = (
    f"WITH {_UL}, f AS (SELECT " + ", ".join(
        f"coalesce(bool_or(contains(CAST({c} AS VARCHAR), 'http')), false) AS {a}"
        for c, a in [("row_id", "c1"), ("companyName", "c2"), ("companyUrl", "c3"), ("flow", "c4")]) + " FROM ul),\n"
    "r AS (SELECT 1 AS ordinal, 'row_id' AS column_name, c1 AS has_http FROM f UNION ALL "
    "SELECT 2, 'name', c2 FROM f UNION ALL SELECT 3, 'address', c3 FROM f UNION ALL SELECT 4, 'flow', c4 FROM f)\n"
    "SELECT ordinal, column_name, has_http, ordinal = coalesce((SELECT min(ordinal) FROM r WHERE has_http), 1) AS chosen FROM r")
O["url_normalize"] = (f"WITH {_UL} SELECT row_id, {_norm('companyUrl')} AS url_http, "
                      f"{_norm('companyUrl', True)} AS url_strict FROM ul")
O["url_admission"] = f"WITH {_UL}, {_ADM} SELECT row_id, companyUrl, url_norm, status FROM ua"
O["pending_rows"] = (f"WITH {_UL} SELECT row_id, {_norm('companyUrl', True)} AS url_norm, true AS is_retry FROM ul "
                     f"WHERE NOT {_blank('companyUrl')} AND {_PEND}")
O["reprocess_count"] = (f"WITH {_UL} SELECT count(*) FILTER (WHERE {_PEND}) AS n_retry, count(*) AS n_forced FROM ul "
                        f"WHERE NOT {_blank('companyUrl')}")
O["completed_rows"] = f"WITH {_UL} SELECT row_id, flow FROM ul WHERE length(coalesce(flow, 'nan')) > 0"
_RP = (f"todo AS (SELECT row_id, {_norm('companyUrl', True)} AS url_norm FROM ul WHERE NOT {_blank('companyUrl')}),\n"
       f"done AS (SELECT row_id, {_norm('companyUrl', True)} AS k FROM ul WHERE NOT {_PEND}),\n"
       "pend AS (SELECT t.* FROM todo t WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.row_id = t.row_id AND d.k = t.url_norm))")
O["resume_pending"] = f"WITH {_UL}, {_RP} SELECT row_id, url_norm FROM pend"

_CLS = P.classify_sql(fx.OVERLAY_PAGES_SQL, fx.OBSERVATIONS_SQL, fx.VERDICTS_SQL)
O["resume_merge"] = (_CLS + f",\n{_UL}, {_RP},\n"
                     "nw AS (SELECT p.row_id, dec.bucket AS flow FROM pend p LEFT JOIN dec ON dec.page_id = p.row_id // 2),\n"
                     f"od AS (SELECT row_id, flow FROM ul WHERE NOT {_PEND} AND row_id NOT IN (SELECT row_id FROM nw))\n"
                     "SELECT row_id, flow FROM od UNION ALL SELECT row_id, flow FROM nw")
_RES = (_CLS + f",\n{_UL}, {_ADM},\n"
        "rs AS (SELECT ua.*, coalesce(CASE WHEN status <> 'admitted' THEN status END, dec.bucket) AS bucket "
        "FROM ua LEFT JOIN dec ON dec.page_id = ua.row_id // 2)")
O["result_projection"] = _RES + "\nSELECT row_id, companyUrl, bucket FROM rs"
O["result_full"] = _RES + "\nSELECT row_id, companyName, companyUrl, bucket AS flow FROM rs"
_HOST = r"lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), ''))"
O["url_features"] = (
    "SELECT page_id, regexp_matches(coalesce(url, ''), '[?&]page=') AS has_page_param, "
    "contains(coalesce(url, ''), '&p=') AS has_p_param, contains(coalesce(url, ''), '/page/') AS has_page_path, "
    "contains(coalesce(url, ''), '/careers/') AS has_careers_path, contains(coalesce(url, ''), '/jobs/') AS has_jobs_path, "
    f"(ends_with({_HOST}, 'greenhouse.io') OR ends_with({_HOST}, 'lever.co') OR contains({_HOST}, 'workday')) AS is_ats_host, "
    f"{_HOST} AS host FROM pages")
O["url_compare_key"] = (f"SELECT page_id, phase, regexp_replace(split_part(current_url, '#', 1), '/+$', '') AS url_key "
                        f"FROM ({fx.OBSERVATIONS_SQL}) o")

# --------------------------------------------------------------------------- elements
_DOM = "WITH RECURSIVE " + P.dom_ctes(P.pages_input(fx.OVERLAY_PAGES_SQL))
O["element_count"] = _DOM + ("\nSELECT p.page_id, CAST(count(e.pos) AS INTEGER) AS n_elements "
                             "FROM pg p LEFT JOIN el e ON e.rid = p.rid GROUP BY p.page_id")
O["element_displayed"] = _DOM + "\nSELECT rid AS page_id, CAST(pos AS INTEGER) AS pos, tag, displayed FROM el"
O["interactive_elements"] = _DOM + (f"\nSELECT rid AS page_id, CAST(pos AS INTEGER) AS pos, tag, first_text, full_text, "
                                    f"displayed FROM el WHERE tag IN {inlist(['a', 'button', 'span'])}")
_CN = "CASE WHEN length(coalesce(cls, '')) > 0 THEN cls WHEN id IS NOT NULL THEN id ELSE 'None' END"
O["containers"] = _DOM + (f"\nSELECT rid AS page_id, CAST(pos AS INTEGER) AS pos, tag, {_CN} AS name, "
                          f"{P.r4_container()} AS range_container, {P.r8_container()} AS number_container, displayed, "
                          f"CAST(length(text) AS INTEGER) AS text_len FROM el "
                          f"WHERE {P.r4_container()} OR {P.r8_container()}")
O["link_labels"] = _EV + "\nSELECT rid AS page_id, CAST(pos AS INTEGER) AS pos, label AS link_type, href, ltxt AS text FROM lk"
O["visible_links"] = _EV + "\nSELECT rid AS page_id, CAST(pos AS INTEGER) AS pos, label AS link_type, visible FROM lk"

# The links of a page labelled together: the best path to each label of each link, all pages a link at a time.
from navbuckets.operators import tagging as _TG  # noqa: E402

_NEXT, _PAGE = inlist(P.rules.LINK_NEXT_TEXTS), inlist(P.rules.LINK_PAGE_TEXTS)
_MARKS = {"always": "true", "rel_next": "regexp_matches(lower(coalesce(rel, '')), '(^|\\s)next(\\s|$)')",
          "says_next": "(contains(lower(coalesce(cls, '')), 'next') OR contains(lower(coalesce(aria, '')), 'next'))",
          "text_next": f"(starts_with(t, 'next') OR t IN {_NEXT})", "text_number": "regexp_matches(t, '^[0-9]{1,4}$')",
          "text_jump": f"t IN {_PAGE}", "paged_address": f"regexp_matches(href, {q(P.rules.LINK_PAGE_HREF_RE)})"}
_EMIT = "[" + ", ".join(" + ".join(f"CASE WHEN {_MARKS[f]} THEN {w[y]} ELSE 0 END" for f, w in _TG.WEIGHTS.items()) for y in range(3)) + "]"
_STEP = "[" + ", ".join("list_sort([" + ", ".join(
    f"{{'s': {-t[y]} - best[{x + 1}].s, 'x': {x}}}" for x, t in enumerate(_TG.TRANSITIONS)) + "])[1]" for y in range(3)) + "]"
O["link_sequence"] = _DOM + f""",
vl AS (SELECT rid, pos, href, t, {_EMIT} AS emit, row_number() OVER (PARTITION BY rid ORDER BY pos) AS k
       FROM (SELECT *, lower({strip('full_text')}) AS t FROM el WHERE tag = 'a' AND href IS NOT NULL)),
vt AS (SELECT rid, 1::BIGINT AS k, [{{'s': emit[1], 'p': [0]}}, {{'s': emit[2], 'p': [1]}}, {{'s': emit[3], 'p': [2]}}] AS best FROM vl WHERE k = 1
       UNION ALL
       SELECT v.rid, v.k, [{", ".join(f"{{'s': v.emit[{y + 1}] - step[{y + 1}].s, 'p': list_append(best[step[{y + 1}].x + 1].p, {y})}}" for y in range(3))}]
       FROM (SELECT *, {_STEP} AS step FROM vt) w JOIN vl v ON v.rid = w.rid AND v.k = w.k + 1),
vb AS (SELECT rid, list_sort([{{'s': -best[1].s, 'y': 0}}, {{'s': -best[2].s, 'y': 1}}, {{'s': -best[3].s, 'y': 2}}])[1].y AS y, best
       FROM vt QUALIFY row_number() OVER (PARTITION BY rid ORDER BY k DESC) = 1)
SELECT l.rid AS page_id, CAST(l.pos AS INTEGER) AS pos, ['OTHER', 'PAGE', 'NEXT'][best[y + 1].p[l.k] + 1] AS link_type, href, t AS text
FROM vl l JOIN vb ON vb.rid = l.rid"""

# --------------------------------------------------------------------------- frames
_IFRAME = r"""(?i)<iframe\b[^"'>]*(?:(?:"[^"]*"|'[^']*')[^"'>]*)*>"""
_SRCDOC = r"""(?i)\ssrcdoc\s*=\s*("[^"]*"|'[^']*')"""
_FRAMES = (f"SELECT page_id, -1 AS frame_idx, html FROM ({fx.FRAMED_PAGES_SQL}) fp UNION ALL "
           f"SELECT page_id, CAST(frame_idx AS INTEGER), {decode('doc', True)} AS html FROM ("
           f"SELECT page_id, frame_idx, raw[2:-2] AS doc, raw FROM ("
           f"SELECT page_id, frame_idx, regexp_extract(tag, {q(_SRCDOC)}, 1) AS raw FROM ("
           f"SELECT page_id, unnest(regexp_extract_all(html, {q(_IFRAME)})) AS tag, "
           f"generate_subscripts(regexp_extract_all(html, {q(_IFRAME)}), 1) - 1 AS frame_idx "
           f"FROM ({fx.FRAMED_PAGES_SQL}) fq) y) z) x, em WHERE raw <> ''")
O["frame_scan"] = f"WITH {P.EM} {_FRAMES}"
O["frame_merge"] = (
    "WITH RECURSIVE " + P.dom_ctes(f"SELECT page_id * 1000 + frame_idx + 1 AS rid, page_id, frame_idx, html FROM ({_FRAMES}) fr")
    + "," + P.evidence_ctes("intended") + """,
fe AS (SELECT p.page_id, p.frame_idx, e.* FROM pg p JOIN ev e ON e.rid = p.rid),
mn AS (SELECT * FROM fe WHERE frame_idx = -1),
cf AS (SELECT page_id, min(frame_idx) AS cf FROM fe WHERE frame_idx >= 0 AND has_links GROUP BY page_id),
mg AS (SELECT m.page_id, m.rid, NOT m.has_links AND c.cf IS NOT NULL AS use, c.cf, m.has_links AS mh, m."next" AS mn,
              m.pageselect AS mp FROM mn m LEFT JOIN cf c ON c.page_id = m.page_id),
mg2 AS (SELECT g.*, f."next" AS cn, f.pageselect AS cp, f.rid AS crid FROM mg g
        LEFT JOIN fe f ON f.page_id = g.page_id AND f.frame_idx = g.cf),
ss AS (SELECT g.page_id, s.ord, s.sub, s.msg FROM mg2 g JOIN sg s ON s.rid = g.rid
       UNION ALL SELECT g.page_id, s.ord + 1000, s.sub, 'frame(' || CAST(g.cf AS VARCHAR) || ') ' || s.msg
       FROM mg2 g JOIN sg s ON s.rid = g.crid WHERE g.use),
st AS (SELECT page_id, string_agg(msg, ' | ' ORDER BY ord, sub, msg) AS signals_text FROM ss GROUP BY page_id)
SELECT g.page_id, g.mh OR g.use AS has_links, g.mn OR (g.use AND g.cn) AS next_ind,
       g.mp OR (g.use AND g.cp) AS pageselect_ind, CASE WHEN g.use THEN CAST(g.cf AS INTEGER) END AS frame,
       coalesce(st.signals_text, '') AS signals_text
FROM mg2 g LEFT JOIN st ON st.page_id = g.page_id""")

# --------------------------------------------------------------------------- behaviour
_MS = "WITH " + P.measurement_ctes(fx.OBSERVATIONS_SQL)
_SCROLL = ("CASE WHEN coalesce((h_scroll1 > h_baseline + 400 OR n_scroll1 > n_baseline + 8) AND u_scroll1 = u_baseline, false) "
           "THEN 1 WHEN coalesce((h_scroll2 > h_baseline + 400 OR n_scroll2 > n_baseline + 8) AND u_scroll2 = u_baseline, "
           "false) THEN 2 END")
_GREW = ("CASE WHEN h_click_before IS NOT NULL AND h_click_after IS NOT NULL THEN coalesce(h_click_after > h_click_before "
         "+ 200 OR n_click_after > n_click_before + 5, false) END")
O["scroll_confirm"] = _MS + f"\nSELECT page_id, CAST({_SCROLL} AS INTEGER) AS scroll_try FROM ms"
O["loadmore_confirm"] = (_EV + "," + P.measurement_ctes(fx.OBSERVATIONS_SQL) + f""",
lc AS (SELECT p.page_id, CASE WHEN lm IS NULL THEN NULL WHEN split_part(lm, '|', 1) = 'button' THEN 'button' ELSE 'link' END
              AS lm_kind, {_GREW} AS click_grew
       FROM pg p JOIN ev e ON e.rid = p.rid LEFT JOIN ms ON ms.page_id = p.page_id)
SELECT page_id, lm_kind, click_grew, lm_kind IS NOT NULL AND coalesce(click_grew, false) AS confirmed FROM lc""")

# --------------------------------------------------------------------------- decisions
O["decide_structural"] = _CLS + "\nSELECT page_id, bucket, bucket_source FROM dec WHERE branch = 'structural'"
O["decide_behavioral"] = _CLS + "\nSELECT page_id, bucket, bucket_source FROM dec WHERE branch = 'behavioral'"
_CLS0 = P.classify_sql(fx.OVERLAY_PAGES_SQL, None, None)
O["decision_reason"] = _CLS0 + ("\nSELECT page_id, bucket, bucket || ' <- ' || all_msgs "
                                "AS reason FROM dec")

# --------------------------------------------------------------------------- judge
_G = {"next": "a control that leads from one result page to the following one, without page numbers to pick from",
      "pageselect": "numbered or first/last controls with which a visitor picks a result page",
      "loadmore": "a button or link that appends further results to the list in place",
      "scrolldown": "further results appear by themselves when the page is scrolled"}
_OPT = {b: "".join(f"- {c}: {_G[c]}\n" for c in cs) for b, cs in {
    "structural": ["next", "pageselect"], "behavioral": ["loadmore", "scrolldown"], "all": list(_G)}.items()}
O["judge_queue"] = _CLS0 + (
    f"\nSELECT page_id, url, branch, {q('How does this job listing reveal further results? Answer with one word from the list.' + chr(10))} || "
    f"CASE WHEN branch = 'structural' THEN {q(_OPT['structural'])} ELSE {q(_OPT['behavioral'])} END || "
    "'Evidence from ' || url || ': ' || all_msgs AS prompt FROM dec WHERE bucket_source IN ('judge', 'fallback')")
_SN = ("""
sc0 AS (SELECT rid, idx, pos, "end", tag IN ('nav', 'footer') OR coalesce(role, '') = 'navigation' OR """
       + " OR ".join([P.class_word("cls", w) for w in ("pagination", "pager")]
                     + [f"contains(coalesce(cls, ''), {q(x)})" for x in ("pagination", "paging")]) + """ AS paging, tag FROM el),
sc1 AS (SELECT rid, idx, pos, "end" FROM sc0 WHERE paging
        UNION ALL SELECT rid, arg_min(idx, pos), min(pos), arg_min("end", pos) FROM sc0
        WHERE tag = 'body' AND rid NOT IN (SELECT rid FROM sc0 WHERE paging) GROUP BY rid),
si0 AS (SELECT c.rid, c.idx AS cidx, c.pos AS cpos, e.*, row_number() OVER (PARTITION BY c.rid, c.idx ORDER BY e.pos DESC) AS back
        FROM sc1 c LEFT JOIN el e ON e.rid = c.rid AND e.pos > c.pos AND e.pos < c."end" AND e.tag IN ('a', 'button', 'input', 'span')),
sh AS (SELECT i.rid, i.cidx, i.idx, string_agg(t.whole, '' ORDER BY t.pos) AS inner_html FROM si0 i JOIN tk t ON t.rid = i.rid AND t.pos >= i.pos AND t.pos < i."end"
       WHERE i.back <= 30 GROUP BY ALL),
si AS (SELECT i.rid, i.cidx, i.cpos, i.pos, left(CASE WHEN i.tag IN """ + inlist(P.EMPTY_TAGS) + """ THEN '<' || regexp_extract(sh.inner_html[2:], """ + q(P.MARKUP) + """)
              ELSE sh.inner_html || CASE WHEN z.close = i.tag THEN '</' || i.tag || '>' ELSE '' END END, 300)
              || ' (Parent: ' || left(coalesce(u.text, ''), 50) || ')' AS item
       FROM si0 i LEFT JOIN sh ON sh.rid = i.rid AND sh.cidx = i.cidx AND sh.idx = i.idx LEFT JOIN tk z ON z.rid = i.rid AND z.pos = i."end"
       LEFT JOIN el u ON u.rid = i.rid AND u.idx = i.up WHERE i.back <= 30),
sd AS (SELECT rid, cidx, cpos, coalesce(string_agg(item, chr(10) ORDER BY pos) FILTER (item IS NOT NULL), '') AS part FROM si GROUP BY ALL),
sn AS (SELECT pg.page_id, left(coalesce(string_agg(part, chr(10) || '---CONTAINER---' || chr(10) ORDER BY cpos), ''), 3500) AS snippet
       FROM pg LEFT JOIN sd ON sd.rid = pg.rid GROUP BY pg.page_id)""")
O["judge_snippet"] = _DOM + "," + _SN + "\nSELECT page_id, snippet FROM sn"
O["judge_prompt"] = _CLS0 + "," + _SN + (
    f"\nSELECT page_id, branch, {q('How does this job listing reveal further results? Answer with one word from the list.' + chr(10))} || "
    f"CASE WHEN branch = 'structural' THEN {q(_OPT['structural'])} ELSE {q(_OPT['behavioral'])} END || "
    "'Evidence from ' || url || ': ' || all_msgs || chr(10) || 'Markup of its paging area:' || chr(10) || left(snippet, 3000) AS prompt "
    "FROM dec JOIN sn USING (page_id) WHERE bucket_source IN ('judge', 'fallback')")
O["judge_constrained"] = "WITH " + P.verdict_ctes(fx.VERDICTS_SQL) + "\nSELECT page_id, verdict_structural, verdict_behavioral FROM vd"
_UV = f"""uv0 AS (SELECT page_id, arg_min(answer, attempt) AS answer FROM ({fx.VERDICTS_SQL}) v WHERE kind = 'url_only'
               GROUP BY page_id),
uv1 AS (SELECT *, contains(answer, '|') AS has_bar,
               lower({strip("CASE WHEN contains(answer, '|') THEN split_part(answer, '|', 1) ELSE answer END")}) AS typ FROM uv0),
uv AS (SELECT page_id, answer,
              CASE WHEN answer IS NULL THEN NULL WHEN typ IN {inlist(['next', 'pageselect', 'loadmore', 'scrolldown'])}
                   THEN typ ELSE 'next' END AS judge_bucket,
              CASE WHEN answer IS NULL THEN NULL WHEN typ IN {inlist(['next', 'pageselect', 'loadmore', 'scrolldown'])}
                   THEN 'judge_url' ELSE 'judge_default' END AS judge_source,
              CASE WHEN has_bar THEN {strip(chr(114) + "egexp_extract(answer, '(?s)^[^|]*\\|(.*)$', 1)")}
                   ELSE 'AI fallback classification' END AS judge_reason FROM uv1)"""
O["judge_url_only"] = f"WITH {_UV}\nSELECT page_id, answer, judge_bucket, judge_source, judge_reason FROM uv"

# --------------------------------------------------------------------------- attempts
_M = "lower(coalesce(error_message, ''))"
_STATUS = (f"CASE WHEN contains({_M}, 'timeout') OR contains({_M}, 'timed out') THEN 'partial' "
           f"WHEN contains({_M}, 'dns_probe_finished_nxdomain') OR contains({_M}, 'unknown_error') THEN 'error: invalid_url' "
           f"WHEN contains({_M}, 'receiving message') OR contains({_M}, 'renderer') THEN 'partial' "
           "ELSE 'error: page_load_failed' END")
O["error_taxonomy"] = (f"SELECT page_id, attempt, {_STATUS} AS status, 'error: ' || substring(error_message, 1, 50) AS label "
                       f"FROM ({fx.ATTEMPTS_SQL}) a WHERE error_message IS NOT NULL")
_RA = f"""atm AS (SELECT * FROM ({fx.ATTEMPTS_SQL}) a0 WHERE attempt <= 3),
ag AS (SELECT page_id,
         arg_min(outcome, attempt) FILTER (WHERE outcome IS NOT NULL AND NOT starts_with(outcome, 'error:')) AS success,
         min(attempt) FILTER (WHERE outcome IS NOT NULL AND NOT starts_with(outcome, 'error:')) AS success_attempt,
         CAST(count(*) AS INTEGER) AS n_attempts FROM atm GROUP BY page_id),
al AS (SELECT page_id, outcome IS NULL AS raised, error_message, coalesce(outcome, error_message) AS err FROM atm
       QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY attempt DESC) = 1),
{_UV},
ra AS (SELECT g.page_id,
         CASE WHEN success IS NOT NULL THEN success WHEN uv.judge_bucket IS NOT NULL THEN uv.judge_bucket
              WHEN l.raised THEN coalesce('error: ' || substring(l.error_message, 1, 50), 'error: unknown')
              ELSE 'error: timeout_max_retries' END AS bucket,
         CASE WHEN success IS NOT NULL THEN 'attempt ' || CAST(success_attempt AS VARCHAR)
              WHEN uv.judge_bucket IS NOT NULL THEN uv.judge_source ELSE 'error' END AS bucket_source,
         g.n_attempts, CASE WHEN success IS NULL THEN l.err END AS last_error
       FROM ag g JOIN al l ON l.page_id = g.page_id LEFT JOIN uv ON uv.page_id = g.page_id)"""
O["resolve_attempts"] = f"WITH {_RA}\nSELECT page_id, bucket, bucket_source, n_attempts, last_error FROM ra"
O["judge_url_queue"] = (f"WITH {_RA},\nru AS (SELECT *, 'https://jobs.example/list/' || page_id AS url FROM ra)\nSELECT page_id, url, " + q(
    "This listing could not be loaded, so judge by its address alone. Answer as TYPE | reason, with TYPE one of:\n" + _OPT["all"] + "Address: ")
    + " || url || chr(10) || 'Last error: ' || coalesce(last_error, 'none') AS prompt "
    "FROM ru WHERE bucket_source = 'error'")
_AR = (f"WITH {_RA}, {_UL}, {_ADM},\n"
       "rs AS (SELECT ua.*, coalesce(CASE WHEN status <> 'admitted' THEN status END, ra.bucket) AS bucket "
       "FROM ua LEFT JOIN ra ON ra.page_id = ua.row_id // 2)")
O["run_summary"] = _AR + f""",
el_t AS (SELECT epoch(max(ts)) - epoch(min(ts)) AS el FROM ({fx.ATTEMPTS_SQL}) z)
SELECT count(*) FILTER (WHERE status = 'admitted') AS total_admitted,
       count(*) FILTER (WHERE bucket IS NOT NULL AND NOT starts_with(bucket, 'error')) AS successful,
       count(*) FILTER (WHERE starts_with(bucket, 'error')) AS errors,
       count(*) FILTER (WHERE status = 'invalid_url') AS invalid_urls,
       count(*) FILTER (WHERE status = 'duplicate_in_input') AS duplicates,
       count(DISTINCT url_norm) AS distinct_urls,
       (SELECT CAST(floor(el) AS BIGINT) FROM el_t) AS elapsed_sec,
       CASE WHEN count(*) FILTER (WHERE status = 'admitted') > 0 THEN
            CAST(floor((SELECT el FROM el_t) * 1000 / count(*) FILTER (WHERE status = 'admitted')) AS BIGINT) END
            AS avg_ms_per_url
FROM rs"""
O["progress_count"] = _AR + "\nSELECT count(bucket) AS completed, count(*) AS total FROM rs"

O = {k: v for k, v in O.items() if v is not None}

# --------------------------------------------------------------------------- streaming (stream result = batch result)
O["stream_dedup"] = (f"WITH {_UL} SELECT DISTINCT {_norm('companyUrl')} AS url_norm FROM ul "
                     f"WHERE NOT {_blank('companyUrl')}")
O["stream_first_rows"] = (f"WITH {_UL} SELECT {_norm('companyUrl')} AS url_norm, min(row_id) AS row_id FROM ul "
                          f"WHERE NOT {_blank('companyUrl')} GROUP BY ALL")
O["result_sink"] = _AR + (",\nrl AS (SELECT row_id, companyUrl, bucket, CASE WHEN row_id % 3 = 0 THEN 'b-late' ELSE 'a-first' END AS run_id FROM rs)\n"
                          "SELECT row_id, companyUrl, bucket, run_id, row_number() OVER (ORDER BY run_id, row_id) - 1 AS line_no FROM rl")
# runs of attempts: a row a day or more behind the one before it (of its page) begins another
_RUNS = f"""rr0 AS (SELECT *, ts >= lag(ts) OVER (PARTITION BY page_id ORDER BY ts) + INTERVAL 1 DAY AS apart FROM ({fx.ATTEMPTS_SQL}) a0 WHERE attempt <= 3),
rr AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ts) AS run FROM rr0),
rg AS (SELECT page_id, run, min(ts) AS started, CAST(count(*) AS INTEGER) AS n_attempts,
         arg_min(outcome, attempt) FILTER (WHERE outcome IS NOT NULL AND NOT starts_with(outcome, 'error:')) AS success,
         min(attempt) FILTER (WHERE outcome IS NOT NULL AND NOT starts_with(outcome, 'error:')) AS success_attempt FROM rr GROUP BY page_id, run),
rx AS (SELECT page_id, run, outcome IS NULL AS raised, error_message, coalesce(outcome, error_message) AS err FROM rr
       QUALIFY row_number() OVER (PARTITION BY page_id, run ORDER BY attempt DESC) = 1)"""
O["stream_runs"] = f"""WITH {_UV}, {_RUNS}
SELECT g.page_id, g.n_attempts, g.started, CASE WHEN success IS NULL THEN l.err END AS last_error,
       CASE WHEN success IS NOT NULL THEN success WHEN uv.judge_bucket IS NOT NULL THEN uv.judge_bucket
            WHEN l.raised THEN coalesce('error: ' || substring(l.error_message, 1, 50), 'error: unknown') ELSE 'error: timeout_max_retries' END AS bucket,
       CASE WHEN success IS NOT NULL THEN 'attempt ' || CAST(success_attempt AS VARCHAR) WHEN uv.judge_bucket IS NOT NULL THEN uv.judge_source
            ELSE 'error' END AS bucket_source
FROM rg g JOIN rx l ON l.page_id = g.page_id AND l.run = g.run LEFT JOIN uv ON uv.page_id = g.page_id"""
O["stream_classify"] = O["classify_pages"]
O["stream_results"] = _CLS + "\nSELECT page_id, bucket FROM dec WHERE length(bucket) > 0"
O["stream_attempts"] = O["resolve_attempts"]
O["stream_progress"] = _CLS + "\nSELECT bucket, count(*) AS n FROM dec GROUP BY bucket"

# --------------------------------------------------------------------------- user rules (J6), first hits
from navbuckets.operators import rules as _R  # noqa: E402

_RULES = " UNION ALL ".join(f"SELECT {q('LM' + str(i) + t[0])} AS rule_id, {q(t)} AS tag, {q(k)} AS needle"
                            for i, k in enumerate(_R.LOADMORE_KEYWORDS) for t in ("button", "a"))
O["custom_rules"] = _DOM + (f",\nru AS ({_RULES})\nSELECT e.rid AS page_id, r.rule_id, CAST(min(e.pos) AS INTEGER) AS first_pos, "
                            f"count(*) AS n_hits FROM el e JOIN ru r ON r.tag = e.tag "
                            f"WHERE e.displayed AND contains({P.alow('e.first_text')}, lower(r.needle)) "
                            f"GROUP BY e.rid, r.rule_id")


def _fh(rule, x):
    if rule == "R2":
        cond = f"displayed AND NOT top AND (contains(ft, {q(x)}) OR contains(ar, {q(x)}))"
    elif rule == "R5":
        cond = f"displayed AND NOT top AND (contains(full0, {q(x)}) OR contains(aria0, {q(x)}))"
    elif rule == "R6":
        cond = f"displayed AND (contains(ft, {q(x)}) OR contains(ar, {q(x)}))"
    else:
        cond = f"displayed AND contains(full0, {q(x)})"
    return (f"SELECT rid AS page_id, {q(rule)} AS rule_id, {q(x)} AS entry, CAST(min(pos) AS INTEGER) AS first_pos "
            f"FROM ie WHERE {cond} GROUP BY rid")


O["first_hit_per_rule"] = _EV + "\n" + " UNION ALL ".join(_fh(r, x) for r, x in _R.rule_entries())

O["classify_with_links"] = (P.classify_sql(fx.OVERLAY_PAGES_SQL, fx.OBSERVATIONS_SQL, fx.VERDICTS_SQL, links_sql=fx.LINKS_SQL)
                            + "\nSELECT page_id, url, branch, bucket, bucket_source, bucket || ' <- ' || all_msgs AS reason FROM dec")

O["scroll_confirm_events"] = ("WITH " + P.measurement_ctes(fx.EVENT_OBSERVATIONS_SQL)
                              + f"\nSELECT page_id, CAST({_SCROLL} AS INTEGER) AS scroll_try FROM ms")

O["classify_url_list"] = (_CLS + f",\n{_UL}, {_ADM},\n"
                          f"bu AS (SELECT {_norm('url')} AS url_norm, arg_min(bucket, page_id) AS bucket, "
                          "arg_min(bucket_source, page_id) AS bucket_source, "
                          "arg_min(bucket || ' <- ' || all_msgs, page_id) AS reason "
                          "FROM dec GROUP BY 1)\n"
                          "SELECT ua.row_id, ua.companyUrl, ua.url_norm, ua.status, bu.bucket, bu.bucket_source, bu.reason "
                          "FROM ua LEFT JOIN bu ON bu.url_norm = ua.url_norm WHERE ua.status = 'admitted' "
                          "UNION ALL SELECT row_id, companyUrl, url_norm, status, status, 'admission', NULL "
                          "FROM ua WHERE status <> 'admitted'")
