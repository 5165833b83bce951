"""Element / link audit tables (P5, P6, P8, R0, R1, S5/A4) exploded from the per-row DOM.

The main path never explodes; these tables are for inspection and user rules (J6). The
explode is a narrow Generate over the fenced DOM arrays: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navbuckets.functions.dom import TOKEN_RE, clean_html, fence, full_text_of, pin, text_of, with_dom, with_texts
from navbuckets.operators.rules import (
    INTERACTIVE_TAGS, add_rule_columns, container_name, r4_container, r8_container,
)


def elements(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``elements(page_id, pos, end, tag, attrs, cls, id, aria, href, ..., first_text, full_text, text, displayed)``."""
    d = with_dom(pages.select(*keep, "html")).select(*keep, with_texts().alias("els"))
    return d.select(*keep, F.inline("els"))


def element_count(pages: DataFrame) -> DataFrame:
    """Static element count per page (opening tags after cleaning): the tags are cut, no
    element is built."""
    cut = F.regexp_extract_all(clean_html(F.coalesce(F.col("html"), F.lit(""))), F.lit(TOKEN_RE), F.lit(0))
    return pages.select("page_id", F.size(F.filter(cut, lambda t: t.rlike("^<[A-Za-z]"))).alias("n_elements"))


def interactive_elements(pages: DataFrame) -> DataFrame:
    """a/button/span elements with their texts and display flag; texts of other elements are not made."""
    d = with_dom(pages.select("page_id", "html"))
    found = F.transform(F.filter("els", lambda e: e["tag"].isin(INTERACTIVE_TAGS)), lambda e: F.struct(
        e["pos"].alias("pos"), e["tag"].alias("tag"), e["first_text"].alias("first_text"), full_text_of(e).alias("full_text"),
        text_of(e).alias("text"), e["displayed"].alias("displayed")))
    return d.select("page_id", F.inline(pin(found, "els", "_toks", "_rend")))


def containers(pages: DataFrame) -> DataFrame:
    """Elements that are range-text (R4) or number-group (R8) containers."""
    d = with_dom(pages.select("page_id", "html"))
    c = F.filter("els", lambda e: r4_container(e) | r8_container(e))
    c = F.transform(c, lambda e: F.struct(
        e["pos"].alias("pos"), e["tag"].alias("tag"), container_name(e).alias("name"),
        r4_container(e).alias("range_container"), r8_container(e).alias("number_container"),
        e["displayed"].alias("displayed"), F.length(text_of(e)).alias("text_len")))
    return d.select("page_id", F.inline(pin(c, "els", "_rend")))


def links(pages: DataFrame) -> DataFrame:
    """R0 + R1: labelled links ``(page_id, pos, link_type, href, text, displayed, visible)``."""
    d = add_rule_columns(with_dom(pages.select("page_id", "html")))
    # fenced: the explode's own filter on its array would build the elements a second time
    d = d.select("page_id", fence(F.transform("_links", lambda l: F.struct(
        l["pos"].alias("pos"), l["label"].alias("link_type"), l["href"].alias("href"), l["ltxt"].alias("text"),
        l["displayed"].alias("displayed"), l["visible"].alias("visible")))).alias("l"))
    return d.select("page_id", F.inline("l"))


def _grams(text, sizes: list[int]):
    """The distinct substrings of ``text`` of the given sizes ('' for size 0)."""
    def of(n: int):
        last = F.length(text) - n + 1
        cut = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
        return F.array(F.lit("")) if n == 0 else F.coalesce(cut, F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


GRAM = 3


def custom_rules(elements_df: DataFrame, rules: DataFrame) -> DataFrame:
    """User rules ``(rule_id, tag, needle)`` matched against displayed elements whose
    ASCII-lower-cased first text contains the needle.

    Every needle is keyed by that of its three-letter substrings (of itself, if shorter) which the
    fewest distinct texts of its tag hold, and texts by all of theirs, so the join by (tag, gram) meets few
    pairs that the exact check rejects, however many rules there are and however common a tag is.
    Distinct texts are matched once and joined back to their elements, so a text on every page is no hot
    group of the match. Rules with a null tag or needle match nothing, an empty needle every element of its
    tag; a repeated rule counts once.

    Output: page_id, rule_id, first_pos, n_hits (per page and rule)."""
    from navbuckets.functions.dom import alow
    from navbuckets.session import materialize

    r = rules.select("rule_id", "tag", F.lower(F.col("needle")).alias("needle")).where("tag is not null and needle is not null").distinct()
    sizes = sorted(x.n for x in r.select(F.least(F.length("needle"), F.lit(GRAM)).alias("n")).distinct().collect())  # at most GRAM + 1
    shown = materialize(elements_df.filter("displayed").select("page_id", "pos", "tag", alow(F.col("first_text")).alias("ft")))
    texts = shown.select("tag", "ft").distinct()
    keyed = materialize(texts.join(r.select("tag").distinct(), "tag", "left_semi").select(
        "tag", "ft", F.explode(_grams(F.col("ft"), sizes or [0])).alias("gram")))
    held = keyed.groupBy("tag", "gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.filter(_grams(F.col("needle"), sizes or [0]), lambda g: F.length(g) == F.least(F.length("needle"), F.lit(GRAM)))
    rarest = (r.select("*", F.explode(own).alias("gram")).join(held, ["tag", "gram"], "left").groupBy("rule_id", "tag", "needle")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("k"))
              .where("k.n > 0").select("rule_id", "tag", "needle", F.col("k.gram").alias("gram")))
    hits = keyed.join(rarest, ["tag", "gram"]).where(F.col("ft").contains(F.col("needle"))).select("tag", "ft", "rule_id", "needle")
    return shown.join(hits, ["tag", "ft"]).groupBy("page_id", "rule_id").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_hits"))
