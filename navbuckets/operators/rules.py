"""Evidence rules R0-R10 over the per-row element array (``els`` from ``with_dom``).

Each rule is a Column expression over one page (or frame); rules run in catalogue
order and some are guarded by the indicators set before them, as in the reference.
Nothing here shuffles: the whole catalogue is one projection per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from navbuckets.functions.dom import alow, body_text, full_text_of, keep, let, pin, text_of
from navbuckets.functions.text import first_match, found_in, has_one_and_two, py_strip

# ---------------------------------------------------------------------------
# Rule vocabularies, in the order the rules try them.
INTERACTIVE_TAGS = ["a", "button", "span"]
NEIGHBOURHOOD_TAGS = ["a", "button", "span", "div"]
NEXT_KEYWORDS = ["next", "next page", ">", "→", "chevron_right", "right-arrow"]
PLATFORM_SELECTORS = [
    'button[aria-label*="Next"]', 'button[aria-label*="next"]',
    ".wd-paginator-next-button", '[data-automation-id="pageNext"]',
    ".next-page-button", ".sf-pagination-next",
]
RANGE_PATTERNS = [
    r"results?\s+[0-9]+\s*[-–—]\s*[0-9]+\s+of\s+[0-9,]+",
    r"page\s+([0-9]+)\s+of\s+([0-9]+)",
    r"[0-9]+\s*-\s*[0-9]+\s+of\s+[0-9]+",
    r"items per page",
    r"jump to page",
]
NEXT_SYMBOLS = [">", "→", "›", "‹", "←", "➜"]
PAGESELECT_KEYWORDS = ["first", "last"]
PAGESELECT_SYMBOLS = ["»", ">>", "«", "<<"]
TEXT_SYMBOLS = [*NEXT_SYMBOLS, *PAGESELECT_SYMBOLS]
LOADMORE_KEYWORDS = [
    "load more", "show more", "view more", "see more", "load all",
    "show all", "view all", "see all", "more jobs", "more results",
    "load additional", "show additional",
]
# Link tagging (R0): texts that make an anchor a NEXT or a PAGE link.
LINK_NEXT_TEXTS = [">", "→", "›", "➜"]
LINK_PAGE_TEXTS = ["first", "last", "»", ">>", "«", "<<"]
LINK_PAGE_HREF_RE = r"[?&](page|p)=[0-9]+|/page/[0-9]+"
# Characters of a link's text that are looked for where it has no address.
LINK_TEXT_CUT = 20
# Containers: R4 (range text) and R8 (number group).
R4_CONTAINER_TAGS = ["nav", "footer"]
R4_CONTAINER_CLASS_WORDS = ["pagination", "pager", "results", "result-count", "paginationShell",
                            "nav-pagination", "srHelp"]
R4_CONTAINER_CLASS_PARTS = ["pagination", "shell"]
R4_CONTAINER_ID_PARTS = ["pagination"]
R8_CONTAINER_TAGS = ["nav", "ul", "div"]
R8_CONTAINER_CLASS_PARTS = ["pagination", "paging", "pager", "page"]
R8_CONTAINER_CLASS_WORDS = ["active", "current"]
R8_CONTAINER_ID_PARTS = ["page"]
R8_MAX_LEN = 400
R9_MAX_LEN = 200
# Rule catalogue: id -> (order, indicator).
CATALOGUE = {
    "R1": (10, "both"), "R2": (20, "next"), "R3": (30, "next"), "R4": (40, "pageselect"),
    "R5": (50, "next"), "R6": (60, "pageselect"), "R7": (70, "pageselect"),
    "R8": (80, "pageselect"), "R9": (90, "pageselect"),
}
AS_WRITTEN_RULES = ["R1", "R2", "R3"]
# ---------------------------------------------------------------------------


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def class_word(e: Column, word: str) -> Column:
    """CSS ``.word``: a whole class token (case-sensitive); ``e.cw`` holds the split class."""
    return F.coalesce(F.array_contains(e["cw"], word), F.lit(False))


def platform_selector(e: Column, sel: str) -> Column:
    """The six platform selectors as predicates on one element."""
    preds = {
        PLATFORM_SELECTORS[0]: (e["tag"] == "button") & _s(e["aria"]).contains("Next"),
        PLATFORM_SELECTORS[1]: (e["tag"] == "button") & _s(e["aria"]).contains("next"),
        PLATFORM_SELECTORS[2]: class_word(e, "wd-paginator-next-button"),
        PLATFORM_SELECTORS[3]: _s(e["dai"]) == "pageNext",
        PLATFORM_SELECTORS[4]: class_word(e, "next-page-button"),
        PLATFORM_SELECTORS[5]: class_word(e, "sf-pagination-next"),
    }
    return preds[sel]


def link_label(e: Column, ltxt: Column) -> Column:
    """Rule-based link tagging of an anchor with an href -> 'NEXT' | 'PAGE' | null. ``ltxt``: its
    stripped, lower-cased text."""
    is_link = (e["tag"] == "a") & e["href"].isNotNull()
    nxt = (F.lower(_s(e["rel"])).rlike(r"(^|\s)next(\s|$)")
           | F.lower(_s(e["cls"])).contains("next")
           | F.lower(_s(e["aria"])).contains("next")
           | ltxt.startswith("next")
           | ltxt.isin(LINK_NEXT_TEXTS))
    page = ltxt.rlike(r"^[0-9]{1,4}$") | ltxt.isin(LINK_PAGE_TEXTS) | _s(e["href"]).rlike(LINK_PAGE_HREF_RE)
    return F.when(is_link & nxt, F.lit("NEXT")).when(is_link & page, F.lit("PAGE"))


def r4_container(e: Column) -> Column:
    c = e["tag"].isin(R4_CONTAINER_TAGS)
    for w in R4_CONTAINER_CLASS_WORDS:
        c = c | class_word(e, w)
    for p in R4_CONTAINER_CLASS_PARTS:
        c = c | _s(e["cls"]).contains(p)
    for p in R4_CONTAINER_ID_PARTS:
        c = c | _s(e["id"]).contains(p)
    return c


def r8_container(e: Column) -> Column:
    c = e["tag"].isin(R8_CONTAINER_TAGS)
    for p in R8_CONTAINER_CLASS_PARTS:
        c = c | _s(e["cls"]).contains(p)
    for w in R8_CONTAINER_CLASS_WORDS:
        c = c | class_word(e, w)
    for p in R8_CONTAINER_ID_PARTS:
        c = c | _s(e["id"]).contains(p)
    return c


def container_name(e: Column) -> Column:
    """Python ``class or id``: a non-empty class, else the id, else 'None'."""
    return (F.when(F.length(_s(e["cls"])) > 0, e["cls"])
            .when(e["id"].isNotNull(), e["id"]).otherwise(F.lit("None")))


def range_regex() -> str:
    return "(?i)(" + "|".join(RANGE_PATTERNS) + ")"


def add_rule_columns(d, els: str = "els", toks: str = "_toks"):
    """Add the lean arrays the rules scan: ``_iels`` (a/button/span) and ``_links``."""
    def interactive(e: Column) -> Column:
        """An element's texts are read once, for what the rules ask of them; they are not kept."""
        def read(x: Column) -> Column:
            ltxt = F.lower(py_strip(x["full"]))
            return F.struct(
                e["pos"].alias("pos"), e["tag"].alias("tag"), e["displayed"].alias("displayed"),
                alow(e["first_text"]).alias("ft"), alow(e["aria"]).alias("ar"), _s(e["aria"]).alias("aria"),
                F.filter(F.array(*[F.lit(s) for s in TEXT_SYMBOLS]), lambda s: x["full"].contains(s)).alias("syms"),
                F.lower(x["seen"]).contains("top").alias("top"), e["href"].alias("href"),
                link_label(e, ltxt).alias("label"), F.when(e["tag"] == "a", ltxt).alias("ltxt"))

        return let(F.struct(full_text_of(e, toks).alias("full"), text_of(e).alias("seen")), read)

    iels = F.transform(F.filter(els, lambda e: e["tag"].isin(INTERACTIVE_TAGS)), interactive)
    d = keep(d.withColumn("_iels", pin(iels, toks, "_rend")), "_iels")
    d = keep(d.withColumn("_lmels", F.transform(F.filter(els, lambda e: e["tag"].isin("a", "button")), lambda e: F.struct(
        e["pos"].alias("pos"), e["tag"].alias("tag"), e["displayed"].alias("displayed"),
        alow(e["first_text"]).alias("ft")))), "_lmels")
    links = F.filter("_iels", lambda e: e["label"].isNotNull())
    d = d.withColumn("_lk0", links).withColumn("_anch", F.transform(
        F.filter("_iels", lambda x: (x["tag"] == "a") & x["displayed"] & x["href"].isNotNull()), lambda x: x["href"]))
    d = keep(d, "_lk0", "_anch")
    visible = F.zip_with("_lk0", _href_matches("_lk0", "_anch"), lambda l, c: l.withField("visible", c > 0))
    if "_ext_links" in d.columns:  # precomputed tagged links replace R0, and R1 where they say what is displayed
        d = keep(d.withColumn("_lk1", F.coalesce(F.col("_ext_links"), F.array().cast(
            "array<struct<pos:int,label:string,ltxt:string,href:string,visible:boolean>>"))), "_lk1")
        d = _seen_by_text(d, els)
        told = F.zip_with("_lk1", _href_matches("_lk1", "_anch"), lambda l, c: l.withField("visible", F.coalesce(
            l["visible"], F.when(F.length(_s(l["href"])) > 0, c > 0).otherwise(
                (F.instr(l["ltxt"], "'") == 0) & F.array_contains("_seen", F.substring(l["ltxt"], 1, LINK_TEXT_CUT))))))
        d = keep(d.withColumn("_links", pin(told, "_lk1", "_anch", "_seen")), "_links").drop("_lk1", "_seen")
    else:
        d = keep(d.withColumn("_links", pin(visible, "_lk0", "_anch")), "_links")
    d = d.withColumn("_range_text", F.lower(F.array_join(
        F.transform(F.filter(els, r4_container), lambda e: full_text_of(e, toks)), " ")))
    d = d.withColumn("_range_text", pin(F.col("_range_text"), toks)).withColumn("_body_text", pin(F.lower(body_text(els, toks)), toks))
    return d.drop("_lk0", "_anch")


def _seen_by_text(d, els: str):
    """``_seen``: the first characters of links without an address (``_lk1``, display not told) that stand in
    the first text of a displayed element."""
    asked = F.array_distinct(F.transform(F.filter("_lk1", lambda l: l["visible"].isNull() & (F.length(_s(l["href"])) == 0)),
                                         lambda l: F.substring(l["ltxt"], 1, LINK_TEXT_CUT)))
    shown = F.filter(els, lambda e: e["displayed"])
    hay = F.array_join(F.transform(shown, lambda e: F.concat(F.lit("\u0001"), e["first_text"])), "")
    d = keep(d.withColumn("_asked", asked), "_asked")
    d = d.withColumn("_hay", F.when(F.size("_asked") > 0, hay).otherwise(F.lit("")))
    found = F.when((F.size("_asked") > 0) & (F.length("_hay") > 0), found_in(F.col("_asked"), F.col("_hay"), LINK_TEXT_CUT))
    return keep(d.withColumn("_seen", F.coalesce(found, F.array().cast("array<string>"))), "_seen").drop("_asked", "_hay")


def _href_matches(links: str, anchors: str) -> Column:
    """Per tagged link (in document order): how many displayed anchors share its href, counted
    with sorts -- (#anchors with href <= h) - (#anchors with href < h) -- not a links x anchors scan."""
    def le_or_lt(anchor_first: bool) -> Column:
        ak, lk = (0, 1) if anchor_first else (1, 0)
        mixed = F.array_sort(F.concat(
            F.transform(anchors, lambda h: F.struct(h.alias("h"), F.lit(ak).alias("k"), F.lit(-1).alias("j"))),
            F.transform(links, lambda l, j: F.struct(l["href"].alias("h"), F.lit(lk).alias("k"), j.alias("j")))))
        at = F.filter(F.transform(mixed, lambda x, i: F.struct(x["k"].alias("k"), x["j"].alias("j"), i.alias("i"))),
                      lambda x: x["k"] == lk)
        return F.transform(at, lambda x, r: F.struct(x["j"].alias("j"), (x["i"] - r).alias("n")))

    both = F.zip_with(le_or_lt(True), le_or_lt(False),
                      lambda a, b: F.struct(a["j"].alias("j"), (a["n"] - b["n"]).alias("c")))
    return F.transform(F.array_sort(both), lambda x: x["c"])  # back to document order (by j)


def signal_text(code: str, *args) -> Column:
    """The one template of all signals: a rule or step code with its arguments, ``code(a,b)``."""
    parts = [a if isinstance(a, Column) else F.lit(a) for a in args]
    return F.concat(F.lit(f"{code}("), F.concat_ws(",", *parts), F.lit(")"))


def _sig(ord_: int, rule: str, msg: Column, sub: Column | None = None) -> Column:
    return F.struct(F.lit(ord_).alias("rule_ord"), (sub if sub is not None else F.lit(0)).cast("int").alias("sub"),
                    F.lit(rule).alias("rule_id"), msg.alias("message"))


def _opt(cond_label: Column, ord_: int, rule: str, msg: Column) -> Column:
    return F.when(cond_label.isNotNull(), F.array(_sig(ord_, rule, msg))).otherwise(F.array().cast(
        "array<struct<rule_ord:int,sub:int,rule_id:string,message:string>>"))


def add_evidence(d, rule_set: str = "intended", els: str = "els"):
    """Add ``ev``: STRUCT<has_links, next, pageselect, r2..r9 hit labels, loadmore, signals>.

    Needs the columns added by ``with_dom`` and ``add_rule_columns``. Each guard level is its
    own projection, so an indicator is computed once and read by attribute afterwards (a
    nested Column DAG would otherwise become a tree that doubles with every guard).
    """
    if rule_set not in ("intended", "as_written"):
        raise ValueError("rule_set must be 'intended' or 'as_written'")
    iels, links = "_iels", "_links"
    col = F.col
    null_s = F.lit(None).cast("string")

    def kw_hit(kw: str, top_filter: bool = True) -> Column:
        return F.exists(iels, lambda e: e["displayed"] & (~e["top"] if top_filter else F.lit(True))
                        & (e["ft"].contains(kw) | e["ar"].contains(kw)))

    def sym_hit(sym: str, aria: bool = True, top_filter: bool = True) -> Column:
        return F.exists(iels, lambda e: e["displayed"] & (~e["top"] if top_filter else F.lit(True))
                        & (F.array_contains(e["syms"], sym) | (e["aria"].contains(sym) if aria else F.lit(False))))

    vis = F.filter(links, lambda l: l["visible"])
    d = d.withColumn("_has_links", F.size(links) > 0) \
        .withColumn("_n1", F.exists(links, lambda l: l["visible"] & (l["label"] == "NEXT"))) \
        .withColumn("_p1", F.exists(links, lambda l: l["visible"] & (l["label"] == "PAGE"))) \
        .withColumn("_sig1", F.transform(vis, lambda l: _sig(
            10, "R1", signal_text("R1", l["label"], l["ltxt"]), l["pos"])))
    d = d.withColumn("_r2", F.when(col("_n1"), F.when(kw_hit(NEXT_KEYWORDS[0]), F.lit(NEXT_KEYWORDS[0]))).otherwise(
        first_match([(k, kw_hit(k)) for k in NEXT_KEYWORDS])))
    d = d.withColumn("_r3", first_match([(s, F.exists(els, (lambda sel: lambda e: e["displayed"]
                                                            & platform_selector(e, sel))(s)))
                                         for s in PLATFORM_SELECTORS]))
    d = d.withColumn("_n3", col("_n1") | col("_r2").isNotNull() | col("_r3").isNotNull())
    if rule_set == "as_written":
        d = d.withColumn("_r4", F.lit(False))
        for c in ("_r5", "_r6", "_r7", "_r8"):
            d = d.withColumn(c, null_s)
        d = d.withColumn("_r9", F.lit(False)).withColumn("_next", col("_n3")).withColumn("_psel", col("_p1"))
    else:
        rx = range_regex()
        d = d.withColumn("_r4", col("_range_text").rlike(rx) | col("_body_text").rlike(rx))
        d = d.withColumn("_p4", col("_p1") | col("_r4"))
        d = d.withColumn("_r5", F.when(col("_n3"), F.when(sym_hit(NEXT_SYMBOLS[0]), F.lit(NEXT_SYMBOLS[0]))).otherwise(
            first_match([(s, sym_hit(s)) for s in NEXT_SYMBOLS])))
        d = d.withColumn("_r6", F.when(~col("_p4"), first_match(
            [(k, kw_hit(k, top_filter=False)) for k in PAGESELECT_KEYWORDS])))
        d = d.withColumn("_p6", col("_p4") | col("_r6").isNotNull())
        d = d.withColumn("_r7", F.when(~col("_p6"), first_match(
            [(s, sym_hit(s, aria=False, top_filter=False)) for s in PAGESELECT_SYMBOLS])))
        d = d.withColumn("_p7", col("_p6") | col("_r7").isNotNull())
        # the count of visible characters settles most elements without their text
        def one_and_two(e: Column, limit: int) -> Column:
            return F.when(e["n_vis"].between(2, limit - 1), let(
                text_of(e), lambda t: (F.length(t) < limit) & has_one_and_two(t))).otherwise(F.lit(False))

        r8_first = pin(F.try_element_at(F.filter(els, lambda e: r8_container(e) & e["displayed"] & one_and_two(e, R8_MAX_LEN)),
                                        F.lit(1)), els, "_rend")
        d = d.withColumn("_r8f", F.when(~col("_p7"), r8_first))
        d = d.withColumn("_r8", F.when(col("_r8f").isNotNull(), container_name(col("_r8f"))))
        d = d.withColumn("_p8", col("_p7") | col("_r8").isNotNull())

        # each parent and grandparent of a "1" is looked at once, however many it has
        ones = F.filter(els, lambda e: e["tag"].isin(NEIGHBOURHOOD_TAGS) & e["displayed"] & (
            (e["first_text"] == "1") | F.when(e["n_all"] == 1, full_text_of(e) == "1").otherwise(F.lit(False))))
        d = keep(d.withColumn("_near", pin(F.array_distinct(F.transform(ones, lambda e: e["up"])), els, "_toks")), "_near")
        d = keep(d.withColumn("_near", F.filter(F.array_distinct(F.concat("_near", F.transform(
            F.filter("_near", lambda i: i > 0), lambda i: F.element_at(els, i)["up"]))), lambda i: i > 0)), "_near")
        r9_hit = pin(F.exists("_near", lambda i: let(F.element_at(els, i), lambda q: one_and_two(q, R9_MAX_LEN))), els, "_rend", "_near")
        d = d.withColumn("_r9", F.when(col("_p8"), F.lit(False)).otherwise(F.coalesce(r9_hit, F.lit(False))))
        d = d.withColumn("_next", col("_n3") | col("_r5").isNotNull()).withColumn("_psel", col("_p8") | col("_r9"))
    sigs = [col("_sig1"),
            _opt(col("_r2"), 20, "R2", signal_text("R2", col("_r2"))),
            _opt(col("_r3"), 30, "R3", signal_text("R3", col("_r3"))),
            _opt(F.when(col("_r4"), F.lit("x")), 40, "R4", signal_text("R4")),
            _opt(col("_r5"), 50, "R5", signal_text("R5", col("_r5"))),
            _opt(col("_r6"), 60, "R6", signal_text("R6", col("_r6"))),
            _opt(col("_r7"), 70, "R7", signal_text("R7", col("_r7"))),
            _opt(col("_r8"), 80, "R8", signal_text("R8", col("_r8"))),
            _opt(F.when(col("_r9"), F.lit("x")), 90, "R9", signal_text("R9"))]
    ev = F.struct(
        col("_has_links").alias("has_links"), col("_next").alias("next"), col("_psel").alias("pageselect"),
        *[col(f"_r{i}").alias(f"r{i}") for i in range(2, 10)],
        loadmore_candidate().alias("loadmore"),
        F.concat(*sigs).alias("signals"),
    )
    return d.withColumn("ev", ev)


def loadmore_candidate(els: str = "_lmels") -> Column:
    """Per keyword the first ``button`` then the first ``a`` whose first text holds it;
    only that first node is tested for display. STRUCT<kind, keyword> or null.
    Reads ``_lmels`` (a/button elements with their ASCII-lower-cased first text)."""
    cands = []
    for kw in LOADMORE_KEYWORDS:
        for tag, kind in (("button", "button"), ("a", "link")):
            first = F.try_element_at(F.filter(els, (lambda t, k: lambda e: (e["tag"] == t)
                                                    & e["ft"].contains(k))(tag, kw)), F.lit(1))
            cands.append(F.when(F.coalesce(first["displayed"], F.lit(False)),
                                F.struct(F.lit(kind).alias("kind"), F.lit(kw).alias("keyword"))))
    return F.coalesce(*cands)


def rule_entries() -> list[tuple[str, str]]:
    """(rule_id, entry) for the keyword/symbol rules, in catalogue and list order."""
    return ([("R2", k) for k in NEXT_KEYWORDS] + [("R5", s) for s in NEXT_SYMBOLS]
            + [("R6", k) for k in PAGESELECT_KEYWORDS] + [("R7", s) for s in PAGESELECT_SYMBOLS])


def first_hits(iels: str = "_iels") -> Column:
    """Per keyword/symbol rule entry, the position of the first displayed matching
    a/button/span (unguarded: what each entry alone would find). ARRAY<STRUCT<rule_id, entry, first_pos>>."""
    def pred(rule: str, x: str):
        if rule == "R2":
            return lambda e: e["displayed"] & ~e["top"] & (e["ft"].contains(x) | e["ar"].contains(x))
        if rule == "R5":
            return lambda e: e["displayed"] & ~e["top"] & (F.array_contains(e["syms"], x) | e["aria"].contains(x))
        if rule == "R6":
            return lambda e: e["displayed"] & (e["ft"].contains(x) | e["ar"].contains(x))
        return lambda e: e["displayed"] & F.array_contains(e["syms"], x)

    items = [F.struct(F.lit(r).alias("rule_id"), F.lit(x).alias("entry"),
                      F.array_min(F.transform(F.filter(iels, pred(r, x)), lambda e: e["pos"])).alias("first_pos"))
             for r, x in rule_entries()]
    return F.filter(F.array(*items), lambda h: h["first_pos"].isNotNull())
