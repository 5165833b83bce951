"""Judge queue export and verdict import (the model call itself is external)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navbuckets.functions.dom import outer_html, pin, text_of
from navbuckets.functions.text import py_strip

# The branch choices, the URL-only vocabulary and reason texts.
BRANCH_CHOICES = {"structural": ["next", "pageselect"], "behavioral": ["loadmore", "scrolldown"]}
URL_ONLY_BUCKETS = ["next", "pageselect", "loadmore", "scrolldown"]
URL_ONLY_NO_BAR_REASON = "AI fallback classification"
SNIPPET_TAGS = ["a", "button", "input", "span"]
SNIPPET_LAST_N = 30
SNIPPET_HTML_CAP = 300
SNIPPET_PARENT_CAP = 50
SNIPPET_TOTAL_CAP = 3500
PROMPT_SNIPPET_CAP = 3000
CONTAINER_SEPARATOR = "\n---CONTAINER---\n"


def page_verdicts(verdicts: DataFrame) -> DataFrame:
    """Per page, the first answer (by attempt) valid for its branch.

    Output: page_id, verdict_structural, verdict_behavioral. Invalid answers are skipped,
    as the reference asks again after an invalid choice.
    """
    v = verdicts.filter(F.col("kind") == "page").select(
        "page_id", "branch", "attempt", F.lower(py_strip(F.col("answer"))).alias("ans"))
    out = []
    for br, choices in BRANCH_CHOICES.items():
        ok = (F.col("branch") == br) & F.col("ans").isin(choices)
        out.append(F.min(F.when(ok, F.struct("attempt", "ans")))["ans"].alias(f"verdict_{br}"))
    return v.groupBy("page_id").agg(*out)


def parse_url_only(answer: Column) -> list[Column]:
    """``TYPE | reason`` split once; unknown type -> 'next' with source 'judge_default'."""
    has_bar = answer.contains("|")
    typ = F.lower(py_strip(F.when(has_bar, F.split_part(answer, F.lit("|"), F.lit(1))).otherwise(answer)))
    # text after the first bar (split once)
    rest = F.when(has_bar, py_strip(F.regexp_extract(answer, r"(?s)^[^|]*\|(.*)$", 1)))
    reason = F.when(has_bar, rest).otherwise(F.lit(URL_ONLY_NO_BAR_REASON))
    valid = typ.isin(URL_ONLY_BUCKETS)
    bucket = F.when(answer.isNull(), F.lit(None)).when(valid, typ).otherwise(F.lit("next"))
    source = F.when(answer.isNull(), F.lit(None)).when(valid, F.lit("judge_url")).otherwise(F.lit("judge_default"))
    return [bucket.alias("judge_bucket"), source.alias("judge_source"), reason.alias("judge_reason")]


def url_only_verdicts(verdicts: DataFrame) -> DataFrame:
    """First URL-only answer per page, parsed."""
    v = verdicts.filter(F.col("kind") == "url_only").groupBy("page_id").agg(
        F.min(F.struct("attempt", "answer"))["answer"].alias("answer"))
    return v.select("page_id", "answer", *parse_url_only(F.col("answer")))


SNIPPET_CONTAINER_TAGS = ["nav", "footer"]
SNIPPET_CLASS_WORDS = ["pagination", "pager"]
SNIPPET_CLASS_PARTS = ["pagination", "paging"]


def _snippet_container(e: Column) -> Column:
    from navbuckets.operators.rules import class_word

    c = e["tag"].isin(SNIPPET_CONTAINER_TAGS) | (F.coalesce(e["role"], F.lit("")) == "navigation")
    for w in SNIPPET_CLASS_WORDS:
        c = c | class_word(e, w)
    for p in SNIPPET_CLASS_PARTS:
        c = c | F.coalesce(e["cls"], F.lit("")).contains(p)
    return c


def snippet(els: str = "els") -> Column:
    """P10: last 30 interactive elements per paginator container (else the body), each as its outer
    markup cut at 300 plus the rendered text of its parent cut at 50; cut at 3500."""
    conts = F.filter(els, _snippet_container)
    body = F.slice(F.filter(els, lambda e: e["tag"] == "body"), F.lit(1), F.lit(1))
    chosen = F.when(F.size(conts) > 0, conts).otherwise(body)

    def item(e: Column) -> Column:
        parent = F.when(e["up"] > 0, text_of(F.element_at(els, e["up"])))
        return F.concat(outer_html(e, SNIPPET_HTML_CAP), F.lit(" (Parent: "),
                        F.substring(F.coalesce(parent, F.lit("")), 1, SNIPPET_PARENT_CAP), F.lit(")"))

    def per_container(c: Column) -> Column:
        # the elements inside a container are the next m elements after it, m = opening tags
        # in its token range: a slice, not a scan of the whole page
        m = F.size(F.filter(F.slice("_toks", c["pos"] + 1, c["end"] - c["pos"] - 1), lambda t: t["tag"] != ""))
        inside = F.filter(F.slice(els, c["idx"] + 1, m), lambda e: e["tag"].isin(SNIPPET_TAGS))
        last = F.slice(inside, F.greatest(F.size(inside) - SNIPPET_LAST_N + 1, F.lit(1)), SNIPPET_LAST_N)
        return F.array_join(F.transform(last, item), "\n")

    return pin(F.substring(F.array_join(F.transform(chosen, per_container), CONTAINER_SEPARATOR), 1,
                           SNIPPET_TOTAL_CAP), els, "_toks", "_rend")


# What each answer means, for the prompt (own wording).
CHOICE_GUIDE = {
    "next": "a control that leads from one result page to the following one, without page numbers to pick from",
    "pageselect": "numbered or first/last controls with which a visitor picks a result page",
    "loadmore": "a button or link that appends further results to the list in place",
    "scrolldown": "further results appear by themselves when the page is scrolled",
}


def prompt(url: Column, signals: Column, snippet_col: Column | None, branch: Column) -> Column:
    """Prompt text for a constrained choice; the answer must be one of the branch's two."""

    def options(br: str) -> Column:
        return F.lit("".join(f"- {c}: {CHOICE_GUIDE[c]}\n" for c in BRANCH_CHOICES[br]))

    guide = F.when(branch == "structural", options("structural")).otherwise(options("behavioral"))
    lines = [F.lit("How does this job listing reveal further results? Answer with one word from the list.\n"), guide,
             F.lit("Evidence from "), url, F.lit(": "), F.array_join(signals, "; ")]
    if snippet_col is not None:
        lines += [F.lit("\nMarkup of its paging area:\n"), F.substring(snippet_col, 1, PROMPT_SNIPPET_CAP)]
    return F.concat(*lines)


def url_only_prompt(url: Column, error: Column) -> Column:
    """The question for a page that could not be loaded; the answer is ``TYPE | reason``."""
    return F.concat(
        F.lit("This listing could not be loaded, so judge by its address alone. Answer as TYPE | reason, with TYPE one of:\n"
              + "".join(f"- {c}: {CHOICE_GUIDE[c]}\n" for c in URL_ONLY_BUCKETS)),
        F.lit("Address: "), url, F.lit("\nLast error: "), F.coalesce(error, F.lit("none")))


def url_only_queue(resolved: DataFrame, pages: DataFrame) -> DataFrame:
    """The prompts of pages whose attempts all failed and that have no URL-only verdict yet.

    ``resolved`` is ``resolve_attempts``' output; ``pages(page_id, url)``. Output: page_id, url, prompt."""
    failed = resolved.filter(F.col("bucket_source") == "error").select("page_id", "last_error")
    return failed.join(pages.select("page_id", "url"), "page_id").select(
        "page_id", "url", url_only_prompt(F.col("url"), F.col("last_error")).alias("prompt"))
