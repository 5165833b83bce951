"""User rules keyed by their rarest gram, against a plain containment test."""

import random

from pyspark.sql import functions as F

from navbuckets.operators.elements import custom_rules


def frames(spark, n_elements, n_rules, seed=1):
    rnd = random.Random(seed)
    words = [rnd.choice("abcde") * rnd.randint(1, 2) + rnd.choice(["next", "page", "more", "ab", ""]) + str(rnd.randint(0, 99)) for _ in range(500)]
    els = [(i % 50, i, rnd.choice(["a", "a", "a", "button", "span"]), "Next" if i % 3 == 0 else " ".join(rnd.choice(words) for _ in range(4)).title(),
            rnd.random() < 0.9) for i in range(n_elements)]
    rules = [(f"r{i}", rnd.choice(["a", "button", "div"]), rnd.choice(words)[: rnd.randint(0, 9)].upper()) for i in range(n_rules)]
    rules += [("none", None, "x"), ("null", "a", None), ("r0", *rules[0][1:]), ("empty", "span", ""), ("r1", "a", "NEXT"), ("one", "a", "é")]
    e = spark.createDataFrame(els, "page_id long, pos int, tag string, first_text string, displayed boolean")
    return els, rules, e, spark.createDataFrame(rules, "rule_id string, tag string, needle string")


def test_rules_equal_plain_containment(spark):
    els, rules, e, r = frames(spark, 600, 150)
    want = {}
    for rule, tag, needle in {x for x in rules if None not in x}:
        for page, pos, t, text, shown in els:
            if shown and t == tag and needle.lower() in text.lower():
                first, n = want.get((page, rule), (1 << 30, 0))
                want[page, rule] = (min(first, pos), n + 1)
    got = {(x.page_id, x.rule_id): (x.first_pos, x.n_hits) for x in custom_rules(e.repartition(4), r).collect()}
    assert got == want
    assert custom_rules(e.limit(0), r).collect() == [] and custom_rules(e, r.limit(0)).collect() == []


def test_fifty_thousand_rules_meet_few_texts(spark):
    rules = spark.range(50_000).select(F.concat(F.lit("r"), "id").alias("rule_id"), F.lit("a").alias("tag"), F.concat(
        F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" page")).alias("needle"))
    els = spark.range(20_000).select((F.col("id") % 400).alias("page_id"), F.col("id").cast("int").alias("pos"), F.lit("a").alias("tag"), F.when(
        F.col("id") % 3 == 0, "Next page").otherwise(F.concat(F.lit("Go to "), F.lpad((F.col("id") % 5000).cast("string"), 6, "0"),
                                                             F.lit(" Page"))).alias("first_text"), F.lit(True).alias("displayed"))
    out = custom_rules(els, rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "gram" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = out.collect()
    want = {i % 5000 for i in range(20_000) if i % 3}
    assert len({r.rule_id for r in rows}) == len(want) and sum(r.n_hits for r in rows) == sum(1 for i in range(20_000) if i % 3)
