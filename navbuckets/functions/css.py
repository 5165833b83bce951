"""Visibility through a page's own stylesheets, built per row with built-in array functions.

The ``<style>`` blocks of a page are cut into rules; a rule counts if it declares ``display`` or
``visibility`` and one of its selectors is *simple*: a tag, classes and an id in any combination,
without combinators, attributes and pseudo-classes. Rules are kept in a map by the last name of their
selector, so an element looks only at the rules of its own tag, classes and id. Per property the
declaration that wins the cascade decides: important ones first, then specificity, then order; an
inline style stands above every selector, the ``hidden`` attribute below. Rules inside ``@`` blocks
(media queries and the like) depend on the device and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Stylesheet patterns.
COMMENT_RE = r"(?s)<!--.*?-->"
STYLE_RE = r"(?is)<style[^>]*>(.*?)</style\s*>"
CSS_DROP_RE = r"(?s)/\*.*?\*/|@[^{};]*;|@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}"
CSS_RULE_RE = r"([^{}]+)\{([^{}]*)\}"
SIMPLE_RE = r"^([A-Za-z][A-Za-z0-9-]*|\*)?((?:[.#][A-Za-z_][A-Za-z0-9_-]*)*)$"
NAME_RE = r"[.#][A-Za-z_][A-Za-z0-9_-]*"
HIDING = {"display": r"^none\b", "visibility": r"^(hidden|collapse)\b"}
INLINE = 1 << 20  # above the specificity of every selector
# ---------------------------------------------------------------------------
_RULE = "struct<key:string,tag:string,names:array<string>,spec:int,ord:int,display:struct<imp:boolean,ord:int,hide:boolean>,visibility:struct<imp:boolean,ord:int,hide:boolean>>"


def declared(text: Column, prop: str) -> Column:
    """The declaration of ``prop`` that counts in a block: STRUCT<imp, ord, hide>, or null."""
    values = F.regexp_extract_all(text, F.lit(rf"(?i)(?:^|;)\s*{prop}\s*:\s*([^;]*)"), F.lit(1))
    return F.array_max(F.transform(values, lambda v, i: F.struct(
        F.lower(v).contains("!important").alias("imp"), i.alias("ord"), F.lower(v).rlike(HIDING[prop]).alias("hide"))))


def rule_map(html: Column) -> Column:
    """MAP<last name of a selector, ARRAY<rule>> of a page's stylesheets, or null without such rules."""
    sheets = F.array_join(F.regexp_extract_all(F.regexp_replace(html, COMMENT_RE, ""), F.lit(STYLE_RE), F.lit(1)), "\n")
    text = F.regexp_replace(sheets, CSS_DROP_RE, "")
    blocks = F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(CSS_RULE_RE), F.lit(1)).alias("pre"),
                                      F.regexp_extract_all(text, F.lit(CSS_RULE_RE), F.lit(2)).alias("body")),
                         lambda b, i: F.struct(b["pre"].alias("pre"), b["body"].alias("body"), i.alias("ord")))
    telling = F.filter(blocks, lambda b: b["body"].rlike(r"(?i)(display|visibility)\s*:"))

    def selectors(b: Column) -> Column:
        simple = F.filter(F.transform(F.split(b["pre"], ","), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")),
                          lambda s: (s != "") & s.rlike(SIMPLE_RE))

        def rule(s: Column) -> Column:
            tag = F.lower(F.regexp_extract(s, SIMPLE_RE, 1))
            names = F.regexp_extract_all(s, F.lit(NAME_RE), F.lit(0))
            spec = (F.size(F.filter(names, lambda n: n.startswith("#"))) * 10000 + F.size(F.filter(names, lambda n: n.startswith("."))) * 100
                    + F.when(tag.isin("", "*"), 0).otherwise(1))
            return F.struct(F.coalesce(F.try_element_at(names, F.lit(-1)), F.when(tag == "", "*").otherwise(tag)).alias("key"), tag.alias("tag"),
                            names.alias("names"), spec.alias("spec"), b["ord"].alias("ord"),
                            declared(b["body"], "display").alias("display"), declared(b["body"], "visibility").alias("visibility"))

        return F.transform(simple, rule)

    rules = F.flatten(F.transform(telling, selectors))
    keyed = F.transform(F.array(rules), lambda rs: F.map_from_entries(F.transform(
        F.array_distinct(F.transform(rs, lambda r: r["key"])), lambda k: F.struct(k, F.filter(rs, lambda r: r["key"] == k)))))
    return F.when(html.rlike(r"(?is)<style[^>]*>[^<]*(display|visibility)"), F.element_at(keyed, 1))


def hidden(tag: Column, words: Column, id_: Column, style: Column, by_attribute: Column, rules: Column) -> Column:
    """Is an element hidden by itself. ``words``: its classes; ``by_attribute``: a ``hidden`` attribute;
    ``rules``: the page's ``rule_map``. Reads ``rules`` inside lambdas: pin it."""
    def inline(prop: str) -> Column:
        d = F.when(style.rlike(f"(?i){prop}"), declared(style, prop))
        return F.when(d.isNotNull(), F.array(F.struct(d["imp"].alias("imp"), F.lit(INLINE).alias("spec"), d["ord"].alias("ord"), d["hide"].alias("hide"))))

    def sheet(prop: str) -> Column:
        keys = F.concat(F.array(F.lit("*"), tag), F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit("."), w)),
                        F.when(F.length(id_) > 0, F.array(F.concat(F.lit("#"), id_))).otherwise(F.array().cast("array<string>")))
        near = F.flatten(F.transform(F.filter(keys, lambda k: F.map_contains_key(rules, k)), lambda k: F.element_at(rules, k)))
        mine = F.filter(near, lambda r: r[prop].isNotNull() & (r["tag"].isin("", "*") | (r["tag"] == tag))
                        & F.forall(r["names"], lambda n: F.array_contains(keys, n)))
        return F.transform(mine, lambda r: F.struct(r[prop]["imp"].alias("imp"), r["spec"].alias("spec"), r["ord"].alias("ord"), r[prop]["hide"].alias("hide")))

    empty = F.array().cast("array<struct<imp:boolean,spec:int,ord:int,hide:boolean>>")

    def winner(prop: str) -> Column:
        found = F.concat(F.coalesce(inline(prop), empty), F.when(rules.isNotNull(), sheet(prop)).otherwise(empty))
        return F.array_max(found)["hide"]

    return F.coalesce(winner("display"), by_attribute) | F.coalesce(winner("visibility"), F.lit(False))
