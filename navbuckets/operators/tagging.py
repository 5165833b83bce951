"""R0 by sequence: the links of a page are labelled together.

Paging links stand in a row (1, 2, 3, next), so a link's label depends on its neighbours'. Every link
gets a score per label from its features, every pair of neighbouring labels a score from a table, and the
labels of a page are the sequence with the largest sum, found by Viterbi's recursion: one fold forward
over the links keeps the best score and predecessor of each label, one fold back reads the path.
Scores are whole numbers, so results are exact; of equal predecessors the one earlier in ``LABELS`` wins.
All of it is one projection per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navbuckets.functions.dom import full_text_of, keep, let, pin, with_dom
from navbuckets.functions.text import py_strip
from navbuckets.operators.rules import LINK_NEXT_TEXTS, LINK_PAGE_HREF_RE, LINK_PAGE_TEXTS

LABELS = ["OTHER", "PAGE", "NEXT"]
#: scores of a link's features per label, in the order of ``LABELS``
WEIGHTS = {
    "always": [4, 0, 0],
    "rel_next": [0, 0, 9],
    "says_next": [0, 0, 6],      # class or label
    "text_next": [0, 0, 7],
    "text_number": [0, 6, 0],
    "text_jump": [0, 5, 0],
    "paged_address": [0, 3, 2],
}
#: scores of a label (row) before another (column)
TRANSITIONS = [[2, 0, 0], [0, 3, 2], [1, 1, 0]]


def link_features(e: Column, text: Column) -> dict[str, Column]:
    """The features of an anchor; ``text``: its stripped, lower-cased text."""
    def low(c: str) -> Column:
        return F.lower(F.coalesce(e[c], F.lit("")))

    return {
        "always": F.lit(True),
        "rel_next": low("rel").rlike(r"(^|\s)next(\s|$)"),
        "says_next": low("cls").contains("next") | low("aria").contains("next"),
        "text_next": text.startswith("next") | text.isin(LINK_NEXT_TEXTS),
        "text_number": text.rlike(r"^[0-9]{1,4}$"),
        "text_jump": text.isin(LINK_PAGE_TEXTS),
        "paged_address": F.coalesce(e["href"], F.lit("")).rlike(LINK_PAGE_HREF_RE),
    }


def viterbi(seq: str, n: int, transitions: list[list[int]]) -> Column:
    """The best labels (numbers) of column ``seq``, an array of arrays of ``n`` scores. Reads ``seq``: ``pin`` it."""
    start = F.struct(F.array(*[F.lit(0)] * n).alias("best"), F.array().cast("array<array<int>>").alias("back"))

    def forward(a: Column, emit: Column) -> Column:
        def from_(y: int) -> Column:  # (score, -predecessor)
            ways = [F.struct((F.element_at(a["best"], x + 1) + transitions[x][y]).alias("s"), F.lit(-x).alias("x")) for x in range(n)]
            return F.when(F.size(a["back"]) == 0, F.struct(F.lit(0).alias("s"), F.lit(0).alias("x"))).otherwise(F.array_max(F.array(*ways)))

        return let(F.array(*[from_(y) for y in range(n)]), lambda w: F.struct(
            F.zip_with(w, emit, lambda p, e: p["s"] + e).alias("best"),
            F.concat(a["back"], F.array(F.transform(w, lambda p: -p["x"]))).alias("back")))

    def path(a: Column) -> Column:
        last = -F.array_max(F.transform(a["best"], lambda s, y: F.struct(s.alias("s"), (-y).alias("y"))))["y"]
        # the first link has no predecessor
        back = F.reverse(F.slice(a["back"], F.lit(2), F.greatest(F.size(a["back"]) - 1, F.lit(0))))
        return F.reverse(F.aggregate(back, F.array(last), lambda out, b: F.concat(out, F.array(F.element_at(b, F.element_at(out, -1) + 1)))))

    return F.when(F.size(seq) > 0, let(F.aggregate(seq, start, forward), path)).otherwise(F.array().cast("array<int>"))


def tag_links(pages: DataFrame, weights: dict[str, list[int]] | None = None, transitions: list[list[int]] | None = None) -> DataFrame:
    """``(page_id, pos, link_type, href, text)`` of every anchor with an address, labelled by sequence.
    Pages without links, and null pages, give no rows."""
    weights, transitions = weights or WEIGHTS, transitions or TRANSITIONS

    def link(e: Column) -> Column:
        def scored(text: Column) -> Column:
            marks = link_features(e, text)
            score = [sum((F.when(marks[f], w[y]).otherwise(0) for f, w in weights.items()), F.lit(0)) for y in range(len(LABELS))]
            return F.struct(e["pos"].alias("pos"), e["href"].alias("href"), text.alias("text"), F.array(*score).alias("scores"))

        return let(F.lower(py_strip(full_text_of(e))), scored)

    d = with_dom(pages.select("page_id", "html"))
    anchors = F.filter("els", lambda e: (e["tag"] == "a") & e["href"].isNotNull())
    d = keep(d.withColumn("_seq", pin(F.transform(anchors, link), "_toks", "els")), "_seq")
    d = keep(d.withColumn("_scores", F.transform("_seq", lambda x: x["scores"])), "_scores")
    d = keep(d.withColumn("_path", pin(viterbi("_scores", len(LABELS), transitions), "_scores")), "_path")
    names = F.array(*[F.lit(x) for x in LABELS])
    rows = F.zip_with("_seq", "_path", lambda x, y: F.struct(
        x["pos"].alias("pos"), F.element_at(names, y + 1).alias("link_type"), x["href"].alias("href"), x["text"].alias("text")))
    return d.select("page_id", F.inline(rows))
