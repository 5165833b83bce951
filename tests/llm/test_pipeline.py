"""The pipeline's stages on the smallest tables, each against its operator's brute force, and the registry."""

import importlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_search import brute_contamination, jaccard_words
from tokenizers import Tokenizer

import corpus_pipeline
from navbuckets.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents").union(spark.createDataFrame(
        [(10_000, "12 -- 34 !", "en", "s", 10), (10_001, None, "en", "s", 0), (10_002, "the and of hehand thatnd mail a.b@c.org now", None, None, None)],
        table(spark, SF, "documents").schema))
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language ID"](spark, docs, SF)
    assert told.columns == COLUMNS
    kept = {r.doc_id: r.text for r in told.collect()}
    lost = {r.doc_id for r in docs.collect()} - set(kept)
    assert lost == {10_000, 10_001}

    small = docs.where("doc_id < 60 OR doc_id > 9999")
    one = stages["n-gram Jaccard join"](spark, small, SF)
    sets = {}
    for r in small.collect():
        w = jaccard_words(r.text)
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    assert one.columns == COLUMNS and {r.doc_id for r in one.collect()} == {d for d, r in root.items() if d == r}

    clean = stages["benchmark decontamination"](spark, docs, SF)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in docs.collect()], items, 10) if r[2]}
    assert bad and clean.columns == COLUMNS and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad

    masked = stages["PII"](spark, docs, SF)
    assert masked.columns == COLUMNS and masked.where("n_chars <> length(text)").count() == 0
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[10_001] is None and texts[10_002].endswith("mail [EMAIL] now") and len(texts) == docs.count()

    coded = stages["BPE encoding and decoding"](spark, masked, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in coded:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.round_trip


def test_language_stage_drops_what_no_learned_language_is_near(spark):
    docs = table(spark, SF, "documents")
    odd = ["Быстрая коричневая лиса прыгает через ленивую собаку и бежит домой", "敏捷的棕色狐狸跳过了懒狗然后回家了",
           "asdf jkl; qwer uiop zxcv bnm, asdfjkl qwpoei zmxncb", "for (int i = 0; i < n; ++i) { a[i] = b[i] * c[i]; } return std::move(a);"]
    clean = ["the", "the and of", "der die und", "les de la", "the and of 20.118.157.107 +1 (726) 555-7857 the 4325404893167225"]
    rows = [(20_000 + i, x, None, "s", len(x)) for i, x in enumerate(odd)] + [(30_000 + i, x, None, "s", len(x)) for i, x in enumerate(clean)]
    added = docs.union(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, added, SF).collect()}
    assert {r.doc_id for r in docs.collect()} - kept == set()
    assert {i for i in kept if i >= 20_000} == {30_000 + i for i in range(len(clean))}
    # no labels: nothing is learned, so only texts without a letter go
    bare = added.withColumn("lang", F.lit(None).cast("string")).union(spark.createDataFrame([(40_000, "12 -- !", None, "s", 7)], docs.schema))
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, bare, SF).collect()} == {r.doc_id for r in added.collect()}


def test_run_applies_the_stages_in_order(spark):
    out = corpus_pipeline.run(spark, SF)
    n = table(spark, SF, "documents").count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "PII",
                                                      "BPE encoding and decoding"]
    assert 0 < out.count() < n and out.where("NOT round_trip OR n_tokens = 0").count() == 0


def test_empty_documents_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_registered(spark):
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
