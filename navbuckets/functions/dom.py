"""Static DOM model of a page snapshot, built per row with built-in array functions.

A page's HTML is cleaned (comments, script and style removed) and cut once into tokens at each
'<' outside quoted attribute values. Token k (1-based ``pos``) is ``name attrs>text``; an opening tag gives ``tag``, a closing
tag gives ``close``. Elements whose content is text (``textarea``, ``title``, ``noscript``, ...) are one token.

Each opening tag becomes an *element*. One fold over the tokens keeps the stack of open elements
and gives every element its range ``[pos, end)`` in tokens, its parent ``up`` and whether it is hidden:

* a closing tag ends the nearest open element of its name and everything open inside it; it is
  ignored where a table cell or the like stands between (``CLOSE_SCOPE``);
* an opening tag first ends what it implies the end of (``IMPLIED_ENDS``: ``<li>`` an open ``li`` of
  the same list, a block an open ``p``, ...), so an unclosed element ends with its parent at the latest;
* void tags (``br``, ``img``, ``input`` ...) hold no content and are never open;
* formatting elements are not reopened and nothing is moved out of tables.

The fold also tells for each token whether its text is rendered (not below a hidden element) and
counts the rendered characters before it. A range's text is then a slice of the page's pieces, made
only when a rule asks for it, so memory follows the page and not its depth.

Everything stays inside one row: no explode, no shuffle, so the same code serves
batch and streaming. Lambdas never read an outer array that Catalyst could inline
(``pin``), so each array is computed once per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navbuckets.functions.css import hidden, rule_map
from navbuckets.functions.text import ascii_lower, decode_entities, py_strip

# ---------------------------------------------------------------------------
# Markup patterns and tag classes.
CLEAN_RE = r"(?is)<!--.*?-->|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>"
# A token: markup whose quoted values may hold < and >, and the text behind it; markup that does
# not end so is cut at the next <. Possessive loops: long tags need no stack.
_QUOTED = r"""(?:(?:"[^"]*+"|'[^']*+')[^"'<>]*+)*+"""
# Elements whose content is text up to their own closing tag.
RAW_TEXT_TAGS = ["textarea", "title", "noscript", "noembed", "noframes", "iframe", "xmp"]
_RAW = (r"""(?:(?i)(""" + "|".join(RAW_TEXT_TAGS) + r"""))(?=[\s/>])[^"'<>]*+""" + _QUOTED + r""">[\s\S]*?(?=</(?i)\1[\s/>]|\z)""")
TOKEN_RE = r"""<(?:""" + _RAW + r"""|[A-Za-z/!?][^"'<>]*+""" + _QUOTED + r""">)?[^<]*+"""
HEAD_RE = r"""^[A-Za-z/!?][^"'<>]*+""" + _QUOTED + ">"
TAG_RE = r"^([A-Za-z][^\s/>]*)"
CLOSE_RE = r"^/([A-Za-z][^\s/>]*)"
ATTRS_RE = r"(?s)^[A-Za-z][^\s/>]*(.*)>$"
LOOSE_ATTRS_RE = r"^[A-Za-z][^\s/>]*([^>]*)>"
LOOSE_TEXT_RE = r"(?s)^[^>]*>(.*)"
MARKUP_START_RE = r"^[A-Za-z/!?]"
ATTR_PAIR_RE = r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
QUOTED_RE = r""""[^"]*"|'[^']*'"""
SPACES_RE = "[\\s\u00a0]+"
HIDDEN_NAME_RE = r"(?i)(^|\s)hidden(\s|=|/|$)"
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr"]
BLOCK_TAGS = ["address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt",
              "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
              "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section",
              "table", "tbody", "td", "th", "thead", "tr", "ul"]
# Elements that a browser never shows, and those whose content alone it does not show.
HIDDEN_TAGS = ["head", "title", "noscript", "template", "noframes", "noembed"]
MASKED_TAGS = ["iframe"]
# Which open elements an opening tag ends: (tags, names ended, names that shield outer ones).
# The standard's optional end tags and button/table/list scopes.
SCOPE = ["table", "td", "th", "caption", "object", "template", "button", "applet", "marquee"]
P_ENDING = ["address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
            "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p",
            "pre", "search", "section", "summary", "table", "ul"]
IMPLIED_ENDS = [
    (P_ENDING, ["p"], SCOPE),
    (["li"], ["li", "p"], ["ul", "ol", "menu", *SCOPE]),
    (["dd", "dt"], ["dd", "dt", "p"], ["dl", *SCOPE]),
    (["option"], ["option"], ["select", "datalist"]),
    (["optgroup"], ["option", "optgroup"], ["select", "datalist"]),
    (["td", "th"], ["td", "th"], ["table", "template"]),
    (["tr"], ["tr", "caption", "colgroup"], ["table", "template"]),
    (["thead", "tbody", "tfoot"], ["tr", "thead", "tbody", "tfoot", "caption", "colgroup"], ["table", "template"]),
    (["a"], ["a"], SCOPE),
    (["button"], ["button"], [x for x in SCOPE if x != "button"]),
    (["body"], ["head"], ["template"]),
]
# What shields outer elements of its name from a closing tag.
TABLE_PARTS = ["table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"]
CLOSE_SCOPE = [
    (["table"], ["template"]),
    (TABLE_PARTS[1:], ["table", "template"]),
    (["li"], ["ul", "ol", "menu", *SCOPE]),
    *[([x], [y for y in SCOPE if y != x]) for x in ("button", "object", "applet", "marquee")],
]
HEAD_CONTENT = ["title", "meta", "link", "base", "basefont", "bgsound", "noscript", "noframes", "template", "script", "style"]
# Attributes the rules read, exposed as element fields.
ATTR_FIELDS = {"cls": "class", "id": "id", "aria": "aria-label", "href": "href", "rel": "rel",
               "typ": "type", "dai": "data-automation-id", "role": "role", "style": "style"}
# ---------------------------------------------------------------------------


def pin(expr: Column, *arrays: str) -> Column:
    """Evaluate ``expr`` while also referencing ``arrays`` outside any lambda.

    Catalyst's CollapseProject inlines a producer referenced once, also into a lambda
    body, where it would be recomputed for every element. A second, cheap reference
    (``size``) keeps the producer materialized once per row.
    """
    guard = reduce(lambda a, b: a & b, [F.size(F.col(a)) > -2 for a in arrays])
    return F.when(guard, expr)


def keep(d: DataFrame, *names: str) -> DataFrame:
    """Re-expose array columns as ``when(size(a) > -2, a)``.

    A consumer that inlines this cheap wrapper still holds two references to the real
    array, so Catalyst keeps the projection that computes it and the array is built
    once per row, whichever subset of columns a query finally selects.
    """
    for n in names:
        d = d.withColumn(n, F.when(F.size(F.col(n)) > -2, F.col(n)))
    return d


def fence(c: Column) -> Column:
    """Predicate-pushdown fence around a finished per-row result.

    ``spark_partition_id() >= 0`` is always true, but it is non-deterministic and Catalyst
    never pushes a filter through a projection holding one (``rand() >= 0`` would not do: the
    optimizer knows rand's range and removes the test). Without the fence a filter on a result
    is substituted down through every projection of the DOM pipeline, where the pinned arrays
    (referenced twice by design) make the condition grow exponentially -- planning stalls and
    the filter would recompute the DOM. Filters on input columns belong before the call.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once (a lambda's argument is bound, an expression would
    be repeated at each use)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def clean_html(html: Column) -> Column:
    return F.regexp_replace(html, CLEAN_RE, "")


#: by a token's ``rule`` (from 1): what shields outer elements, and what an opening tag ends
SHIELDS = [*[s for _, s in CLOSE_SCOPE], SCOPE, *[s for _, _, s in IMPLIED_ENDS]]
ENDS = [[], *[[] for _ in CLOSE_SCOPE], *[e for _, e, _ in IMPLIED_ENDS]]


def _table(lists: list[list[str]]) -> Column:
    """Lists of names as one constant."""
    rows = ["array(" + ", ".join(f"'{n}'" for n in names) + ")" if names else "cast(array() as array<string>)" for names in lists]
    return F.expr("array(" + ", ".join(rows) + ")")


def tokens(clean: Column, raw: bool = False) -> Column:
    """ARRAY<STRUCT<pos, tag, close, attrs, txt, sep, nb, rule[, raw]>> in document order. ``nb`` counts the
    characters of ``txt`` that are no white space; ``rule`` says which of ``SHIELDS`` (and, for an opening
    tag, of ``ENDS``) holds for the tag, 0: it ends nothing; ``raw`` is the token as written."""

    def tok(t: Column, i: Column) -> Column:
        first = i == 0
        markup = t.rlike(MARKUP_START_RE)
        tag = F.when(first, F.lit("")).otherwise(F.lower(F.regexp_extract(t, TAG_RE, 1)))
        close = F.when(first, F.lit("")).otherwise(F.lower(F.regexp_extract(t, CLOSE_RE, 1)))
        head = F.regexp_extract(t, HEAD_RE, 0)
        whole = F.length(head) > 0
        raw_txt = F.when(first | ~markup, t).when(whole, F.substring(t, F.length(head) + 1, F.length(t))).otherwise(
            F.regexp_extract(t, LOOSE_TEXT_RE, 1))
        attrs = F.when(whole, F.regexp_extract(head, ATTRS_RE, 1)).otherwise(F.regexp_extract(t, LOOSE_ATTRS_RE, 1))
        return F.struct(
            (i + 1).alias("pos"),
            tag.alias("tag"),
            close.alias("close"),
            F.when(first, F.lit("")).otherwise(attrs).alias("attrs"),
            decode_entities(raw_txt).alias("txt"),
            *([t.alias("raw")] if raw else []),
        )

    def classed(x: Column) -> Column:
        tag, close = x["tag"], x["close"]
        rule = F.when(close != "", reduce(lambda c, r: c.when(close.isin(r[1][0]), r[0] + 2), enumerate(CLOSE_SCOPE[1:]),
                                          F.when(close.isin(CLOSE_SCOPE[0][0]), 1)).otherwise(len(CLOSE_SCOPE) + 1))
        for k, (tags, _, _) in enumerate(IMPLIED_ENDS):
            rule = rule.when(tag.isin(tags), len(CLOSE_SCOPE) + 2 + k)
        return F.struct(
            *[x[f].alias(f) for f in ("pos", "tag", "close", "attrs", "txt", *(["raw"] if raw else []))],
            F.when(tag.isin(BLOCK_TAGS) | close.isin(BLOCK_TAGS), F.lit("\n")).otherwise(F.lit("")).alias("sep"),
            F.length(F.regexp_replace(x["txt"], SPACES_RE, "")).alias("nb"),
            rule.otherwise(0).alias("rule"))

    cut = F.concat(F.array(F.regexp_extract(clean, "^[^<]*", 0)), F.transform(
        F.regexp_extract_all(clean, F.lit(TOKEN_RE), F.lit(0)), lambda t: F.substring(t, F.lit(2), F.length(t))))
    return F.transform(F.transform(cut, tok), classed)


def _unquote_value(v: Column) -> Column:
    """Attribute value without its surrounding quotes, entities decoded."""
    quoted = v.startswith('"') | v.startswith("'")
    return decode_entities(F.when(quoted, F.regexp_replace(v, r"""^["']|["']$""", "")).otherwise(v), attribute=True)


#: tokens that the fold takes together: what it emits is appended once a block, so appending
#: costs n * n / BLOCK and not n * n; within a block each step copies up to BLOCK
BLOCK = 32
_FLOW = "array<struct<before:int,all:int,on:boolean,brk:boolean>>"
_ENDED = "array<struct<idx:int,up:int,end:int,ft:int,under:boolean>>"
_OPEN = "array<struct<idx:int,up:int,ft:int,under:boolean,cover:boolean>>"


def _fold(toks: str, hides: str) -> Column:
    """The open-element stack over the tokens: STRUCT<flow (per token), ended (per element, as they end), n>.

    State: ``names`` and ``open`` (the stack, innermost first), ``n`` (elements so far), ``w`` (rendered
    characters so far, white space left out), ``l`` (all characters of texts) and what was emitted. Reads ``toks`` and ``hides`` (per
    element) inside lambdas: ``pin`` them."""
    def place(names: Column, name: Column) -> Column:
        return F.array_position(names, name).cast("int")

    def n_ended(a: Column, t: Column) -> Column:
        """How many innermost open elements the token ends."""
        def looked_up(ends: Column) -> Column:
            def within(shield: Column) -> Column:
                return F.array_max(F.transform(ends, lambda x: let(place(a["names"], x), lambda p: F.when(p < shield, p).otherwise(0))))

            far = F.array_max(F.transform(ends, lambda x: place(a["names"], x)))
            shields = F.element_at(_table(SHIELDS), t["rule"])
            nearest = F.coalesce(F.array_min(F.filter(F.transform(shields, lambda x: place(a["names"], x)), lambda p: p > 0)),
                                 F.lit(1 << 30))
            return F.when(F.coalesce(far, F.lit(0)) > 0, let(nearest, within)).otherwise(0)

        ends = F.when(t["close"] != "", F.array(t["close"])).otherwise(F.element_at(_table(ENDS), t["rule"]))
        implied = F.when(t["rule"] > 0, let(ends, looked_up)).otherwise(0)
        # the head ends before the first thing that cannot stand in it
        body_tag = (t["tag"] != "") & ~t["tag"].isin(HEAD_CONTENT + ["head"]) & (F.try_element_at(a["names"], F.lit(1)) == "head")
        # most closing tags end the innermost element, which nothing shields (but a template itself)
        innermost = (t["close"] != "") & (t["close"] != "template") & (F.try_element_at(a["names"], F.lit(1)) == t["close"])
        return F.when(innermost, F.lit(1)).when(F.coalesce(body_tag, F.lit(False)), F.lit(1)).otherwise(implied)

    def step(a: Column, t: Column) -> Column:
        def popped(k: Column) -> Column:
            return let(F.struct(
                F.when(k == 0, a["names"]).otherwise(F.slice(a["names"], k + 1, F.size(a["names"]))).alias("names"),
                F.when(k == 0, a["open"]).otherwise(F.slice(a["open"], k + 1, F.size(a["open"]))).alias("open"),
                F.slice(a["open"], F.lit(1), k).alias("gone")), pushed)

        def pushed(s: Column) -> Column:
            top = F.try_element_at(s["open"], F.lit(1))
            under = F.coalesce(top["cover"], F.lit(False))
            is_open = t["tag"] != ""
            has_text = t["txt"] != ""
            idx = a["n"] + 1
            hid = F.when(is_open, F.element_at(hides, idx)).otherwise(F.lit(False))
            stays = is_open & ~t["tag"].isin(VOID_TAGS)
            cover = under | hid | t["tag"].isin(MASKED_TAGS)
            up = F.coalesce(top["idx"], F.lit(0))
            me = F.struct(idx.alias("idx"), up.alias("up"), F.when(has_text, t["pos"]).otherwise(0).alias("ft"), under.alias("under"), cover.alias("cover"))
            first = F.coalesce(top["ft"] == 0, F.lit(False)) & has_text
            open_ = F.when(stays, F.concat(F.array(me), s["open"])).when(
                first, F.concat(F.array(top.withField("ft", t["pos"])), F.slice(s["open"], 2, F.size(s["open"])))).otherwise(s["open"])
            on = ~F.when(stays, cover).otherwise(under)
            # a line break goes with the element that the tag opens or ends
            brk = ~F.when(is_open, cover).otherwise(F.coalesce(F.try_element_at(s["gone"], F.lit(-1))["cover"], under))
            gone = F.transform(s["gone"], lambda x: F.struct(x["idx"].alias("idx"), x["up"].alias("up"), t["pos"].alias("end"),
                                                             x["ft"].alias("ft"), x["under"].alias("under")))
            alone = F.when(is_open & ~stays, F.array(F.struct(idx.alias("idx"), up.alias("up"), (t["pos"] + 1).alias("end"), F.lit(0).alias("ft"),
                                                              under.alias("under")))).otherwise(F.array().cast(_ENDED))
            return F.struct(
                F.when(stays, F.concat(F.array(t["tag"]), s["names"])).otherwise(s["names"]).alias("names"),
                open_.alias("open"),
                F.when(is_open, idx).otherwise(a["n"]).alias("n"),
                (a["w"] + F.when(on, t["nb"]).otherwise(0)).alias("w"),
                (a["l"] + F.length(t["txt"])).alias("l"),
                F.concat(a["flow"], F.array(F.struct(a["w"].alias("before"), a["l"].alias("all"), on.alias("on"), brk.alias("brk")))).alias("flow"),
                F.when(F.size(gone) + F.size(alone) == 0, a["ended"]).otherwise(F.concat(a["ended"], gone, alone)).alias("ended"))

        return let(n_ended(a, t), popped)

    def state(a: Column | None, keep_out: bool) -> Column:
        empty = {"names": "array<string>", "open": _OPEN, "flow": _FLOW, "ended": _ENDED}
        fields = []
        for f in ("names", "open", "n", "w", "l", "flow", "ended"):
            fresh = a is None or (not keep_out and f in ("flow", "ended"))
            value = (F.array().cast(empty[f]) if f in empty else F.lit(0)) if fresh else a[f]
            fields.append(value.alias(f))
        return F.struct(*fields)

    def block(a: Column, start: Column) -> Column:
        done = F.aggregate(F.slice(toks, start, F.lit(BLOCK)), state(a, False), step)
        return let(done, lambda b: F.struct(*[b[f].alias(f) for f in ("names", "open", "n", "w", "l")],
                                            F.concat(a["flow"], b["flow"]).alias("flow"), F.concat(a["ended"], b["ended"]).alias("ended")))

    def finish(a: Column) -> Column:  # what is still open ends with the document
        rest = F.transform(a["open"], lambda x: F.struct(x["idx"].alias("idx"), x["up"].alias("up"), (F.size(toks) + 1).alias("end"),
                                                         x["ft"].alias("ft"), x["under"].alias("under")))
        return F.struct(F.concat(a["flow"], F.array(F.struct(a["w"].alias("before"), a["l"].alias("all"), F.lit(False).alias("on"), F.lit(False).alias("brk")))).alias("flow"),
                        F.array_sort(F.concat(a["ended"], rest)).alias("ended"))

    return F.aggregate(F.sequence(F.lit(1), F.size(toks), F.lit(BLOCK)), state(None, False), block, finish)


def with_dom(df: DataFrame, html_col: str = "html", raw: bool = False) -> DataFrame:
    """Add ``_toks`` (token array), ``_rend`` (rendered piece per token) and ``els`` (element array) to each row.

    Element struct: pos, end, idx (place among the elements, from 1), up (its parent's idx, 0: none), tag,
    attrs, cls, id, aria, href, rel, typ, dai, role, style, first_text, cw (class words), own_hidden,
    displayed, n_vis (rendered characters, white space left out), n_all (characters of all texts).
    Texts: ``full_text_of``, ``text_of``; with ``raw`` also ``outer_html``.
    """
    # a missing snapshot is an empty document (no elements): the page falls back
    d = df.withColumn("_css", rule_map(F.coalesce(F.col(html_col), F.lit(""))))
    d = keep(d.withColumn("_toks", tokens(clean_html(F.coalesce(F.col(html_col), F.lit(""))), raw)), "_toks")
    base = F.transform(F.filter("_toks", lambda t: t["tag"] != ""), lambda t: F.struct(
        t["pos"].alias("pos"), t["tag"].alias("tag"), t["attrs"].alias("attrs"),
        F.when(F.length(t["attrs"]) > 1, F.zip_with(  # '' or '/': no attributes to parse
            F.transform(F.regexp_extract_all(t["attrs"], F.lit(ATTR_PAIR_RE), 1), lambda s: F.lower(s)),
            F.transform(F.regexp_extract_all(t["attrs"], F.lit(ATTR_PAIR_RE), 2), _unquote_value),
            lambda k, v: F.struct(k.alias("k"), v.alias("v")),
        )).otherwise(F.array().cast("array<struct<k:string,v:string>>")).alias("pairs"),
    ))
    d = keep(d.withColumn("_els0", base), "_els0")

    def attr(e: Column, name: str) -> Column:
        return F.when(F.size(e["pairs"]) > 0, F.try_element_at(F.filter(e["pairs"], lambda p: p["k"] == name), F.lit(1))["v"])

    d = keep(d.withColumn("_els1", F.transform("_els0", lambda e: F.struct(
        e["pos"].alias("pos"), e["tag"].alias("tag"), e["attrs"].alias("attrs"),
        *[attr(e, a).alias(f) for f, a in ATTR_FIELDS.items()]))), "_els1")
    # (the second reference to the rules keeps them built once per row, see ``pin``)
    d = d.withColumn("_css", F.when(F.size("_css") > -2, F.col("_css")))
    d = keep(d.withColumn("_hides", F.when(F.coalesce(F.size("_css"), F.lit(0)) > -2, F.transform(
        "_els1", lambda e: e["tag"].isin(HIDDEN_TAGS) | _own_hidden(e, F.col("_css"))))), "_hides")
    d = d.withColumn("_fold", pin(_fold("_toks", "_hides"), "_toks", "_hides"))
    d = d.withColumn("_flow", F.col("_fold.flow")).withColumn("_ended", F.col("_fold.ended"))
    d = keep(d, "_flow", "_ended")
    d = keep(d.withColumn("_rend", F.zip_with("_toks", F.slice("_flow", F.lit(1), F.size("_toks")), lambda t, f: F.concat(
        F.when(f["brk"], t["sep"]).otherwise(F.lit("")), F.when(f["on"], t["txt"]).otherwise(F.lit(""))))), "_rend")

    def element(e: Column, x: Column) -> Column:
        hidden = F.element_at("_hides", x["idx"])
        def between(f: str) -> Column:
            return F.element_at("_flow", x["end"])[f] - F.element_at("_flow", e["pos"])[f]

        return F.struct(
            e["pos"].alias("pos"), x["end"].alias("end"), x["idx"].alias("idx"), x["up"].alias("up"), e["tag"].alias("tag"),
            e["attrs"].alias("attrs"), *[e[f].alias(f) for f in ATTR_FIELDS],
            F.when(x["ft"] > 0, F.element_at("_toks", x["ft"])["txt"]).otherwise(F.lit("")).alias("first_text"),
            F.split(e["cls"], r"\s+").alias("cw"),
            hidden.alias("own_hidden"), (~hidden & ~x["under"]).alias("displayed"), between("before").alias("n_vis"),
            between("all").alias("n_all"))

    els = F.zip_with("_els1", "_ended", element)  # both in document order
    d = keep(d.withColumn("els", pin(els, "_els1", "_ended", "_toks", "_hides", "_flow")), "els")
    d = d.drop("_css", "_els0", "_els1", "_hides", "_fold", "_flow", "_ended")
    return d.withColumn("els", fence(F.col("els")))


def _own_hidden(e: Column, rules: Column) -> Column:
    """Hidden by a ``hidden`` attribute (its name, outside quoted values), an inline style, a rule of
    the page's stylesheets, or ``type=hidden``."""
    attrs = e["attrs"]
    by_attribute = F.when(F.length(attrs) > 1, F.regexp_replace(attrs, QUOTED_RE, "''").rlike(HIDDEN_NAME_RE)).otherwise(F.lit(False))
    styled = hidden(e["tag"], F.split(F.coalesce(e["cls"], F.lit("")), r"\s+"), F.coalesce(e["id"], F.lit("")), F.coalesce(e["style"], F.lit("")),
                    by_attribute, rules)
    return styled | F.coalesce(F.lower(F.trim(e["typ"])) == "hidden", F.lit(False))


def full_text_of(e: Column, toks: str = "_toks") -> Column:
    """``textContent``: the text of every token in the element's range. Reads ``toks``
    inside a lambda: the caller's projection must ``pin`` it."""
    return F.array_join(F.transform(F.slice(toks, e["pos"], e["end"] - e["pos"]), lambda t: t["txt"]), "")


def text_of(e: Column, rend: str = "_rend") -> Column:
    """Rendered text, hidden parts left out: block-level boundaries become newlines; stripped. Reads
    ``rend``: ``pin`` it."""
    return py_strip(F.array_join(F.slice(rend, e["pos"], e["end"] - e["pos"]), ""))


def outer_html(e: Column, limit: int, toks: str = "_toks") -> Column:
    """The first ``limit`` characters of the element's markup in the cleaned page, from its opening tag
    to its closing one. Reads ``toks``: ``pin`` it."""
    # every token has a character at least, so no more than ``limit`` tokens are needed
    inner = F.transform(F.slice(toks, e["pos"], F.least(e["end"] - e["pos"], F.lit(limit))), lambda t: F.concat(F.lit("<"), t["raw"]))
    own_close = F.concat(F.lit("</"), e["tag"], F.lit(">"))
    closed = F.coalesce(F.try_element_at(toks, e["end"])["close"] == e["tag"], F.lit(False)) & ~e["tag"].isin(VOID_TAGS)
    own = F.element_at(toks, e["pos"])["raw"]
    head = F.coalesce(F.nullif(F.regexp_extract(own, HEAD_RE, 0), F.lit("")), F.regexp_extract(own, "^[^>]*>?", 0))
    markup = F.when(e["tag"].isin(VOID_TAGS), F.concat(F.lit("<"), head)).otherwise(
        F.concat(F.array_join(inner, ""), F.when(closed, own_close).otherwise(F.lit(""))))
    return F.substring(markup, 1, limit)


def with_texts(els: str = "els", toks: str = "_toks", rend: str = "_rend") -> Column:
    """``els`` with ``full_text`` and ``text`` for every element (audit tables)."""
    return pin(F.transform(els, lambda e: e.withField("full_text", full_text_of(e, toks)).withField("text", text_of(e, rend))), toks, rend)


def body_text(els: str = "els", toks: str = "_toks") -> Column:
    """``document.body.textContent``: full text of the first ``body`` element, else all text. Reads
    ``toks``: ``pin`` it."""
    body = F.try_element_at(F.filter(els, lambda e: e["tag"] == "body"), F.lit(1))
    return F.when(body.isNotNull(), full_text_of(body, toks)).otherwise(F.array_join(F.transform(toks, lambda t: t["txt"]), ""))


def alow(c: Column) -> Column:
    return ascii_lower(F.coalesce(c, F.lit("")))
