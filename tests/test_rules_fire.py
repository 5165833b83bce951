"""Every entry of every rule's list decides at least one page of the fixture (sf0.01)."""

from pyspark.sql import functions as F

from navbuckets.operators import rules
from navbuckets.plans import fixtures as fx
from navbuckets.plans.classify import page_evidence
from navbuckets.plans.registry import Q

SF = "/root/testdata/sf0.01"


def test_every_rule_and_entry_fires(spark):
    ev = page_evidence(fx.overlay_pages(spark, SF), keep=["page_id"], partitions=4).select("page_id", "ev.*").cache()
    rows = ev.collect()
    for r in ("r2", "r3", "r5", "r6", "r7", "r8"):
        assert any(getattr(x, r) for x in rows), r
    assert any(x.r4 for x in rows) and any(x.r9 for x in rows)
    assert {x.r3 for x in rows} - {None} == set(rules.PLATFORM_SELECTORS)
    assert {x.r6 for x in rows} - {None} == set(rules.PAGESELECT_KEYWORDS)
    found = {(x.loadmore.kind, x.loadmore.keyword) for x in rows if x.loadmore}
    assert found == {(k, w) for w in rules.LOADMORE_KEYWORDS for k in ("button", "link")}
    hits = Q["first_hit_per_rule"](spark, SF).select("rule_id", "entry").distinct().collect()
    assert {tuple(h) for h in hits} == set(rules.rule_entries())


def test_attempt_endings_occur(spark):
    out = Q["resolve_attempts"](spark, SF).groupBy("bucket_source", F.col("bucket").startswith("error: ").alias("e"), "bucket").count().collect()
    seen = {(r.bucket_source, r.bucket) for r in out}
    assert ("error", "error: timeout_max_retries") in seen and ("error", "error: unknown") in seen
    assert {s for s, _ in seen} >= {"attempt 1", "attempt 2", "attempt 3", "error"}
    assert fx.attempts(spark, SF).count() == fx.table(spark, SF, "events").count()
