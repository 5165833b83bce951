"""Operators 1, 3 and 6 against brute force, with nulls, empties, ties and repeats."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from navbuckets.llm import decontam, jaccard, lexical
from navbuckets.llm.topk import exact_topk, quantized


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- 1. exact top-k ---------------------------------------------------------------------------
def brute_topk(vectors, k):
    out = []
    for q, x in vectors:
        if q % 5:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in vectors if v != q and len(y) == len(x))
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,query_block", [(64, 7), (2048, 1024)])
def test_topk_equals_brute_force(spark, block, query_block):
    rnd = random.Random(3)
    same = [rnd.randint(-40, 40) for _ in range(12)]
    data = [(i, same if i % 3 == 0 else [rnd.randint(-90, 90) for _ in range(12)]) for i in range(500)]
    data += [(700, [1, 2]), (705, [3, 4])]  # of another length
    df = spark.createDataFrame(data, "vec_id long, vec array<long>").repartition(5)
    got = exact_topk(df, df.where("vec_id % 5 = 0"), 5, block, query_block)
    assert rows(got, "query_id", "rank", "vec_id", "score") == brute_topk(data, 5)


def test_topk_null_vectors_and_empty_tables(spark):
    raw = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
                                 (5, [0.5, -0.001]), (6, [1.0, 2.0])], "vec_id long, embedding array<float>")
    clean = quantized(raw.withColumn("score", F.lit("x")))
    assert rows(clean, "vec_id", "vec") == [(5, [128, -1]), (6, [256, 512])]
    assert rows(exact_topk(clean, clean), "query_id", "rank", "vec_id", "score") == [(5, 1, 6, 128 * 256 - 512), (6, 1, 5, 128 * 256 - 512)]
    assert exact_topk(clean.limit(0), clean.limit(0)).collect() == []


# --- 3. decontamination -----------------------------------------------------------------------
def brute_contamination(docs, items, window):
    wins = {}
    for i, t in items:
        w = decontam.words_of(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[p:p + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = decontam.words_of(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in wins:
                    found |= wins[tuple(w[p:p + n])]
                    hit |= set(range(p, p + n))
        out.append((d, len(w), len(hit), len(found - {None})))
    return sorted(out, key=repr)


def corpus(rnd):
    vocab = [a + b for a in ("ka", "lo", "Mi", "é", "7") for b in ("n", "r", "zz", "")]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n)) + rnd.choice(["", ".", "\n"])
    items = [(i, text(rnd.randint(1, 30))) for i in range(25)] + [(90, None), (91, ""), (92, "--"), (None, text(12))]
    docs = [(i, text(rnd.randint(0, 200))) for i in range(80)]
    for i in range(80, 160):
        piece = rnd.choice(items[:25])[1].upper()
        docs.append((i, text(rnd.randint(0, 20)) + " " + piece + " " + text(rnd.randint(0, 20)) + piece))
    docs += [(200, None), (201, ""), (202, "?!"), (203, docs[100][1]), (203, docs[100][1]), (None, docs[101][1])]
    return docs, items


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_contamination_equals_brute_force(spark, block_words):
    docs, items = corpus(random.Random(4))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(d, i, 6, block_words)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items") == brute_contamination(docs, items, 6)
    assert got.where("contaminated <> (n_hit > 0)").count() == 0


def test_longest_matches_and_locations(spark):
    item = "a b c d e f g h"
    d = spark.createDataFrame([(1, "x a b c d e y"), (2, "a b c d e f g h z"), (3, "q r s")], "doc_id long, text string")
    i = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = rows(decontam.matches(d, i, 4), "doc_id", "item_id", "item_pos", "doc_pos", "length")
    assert (1, "7", 0, 1, 5) in got and (1, "7", 1, 2, 4) in got and (2, "7", 0, 0, 8) in got
    assert all(r[0] != 3 for r in got)


def test_decontaminated_keeps_clean_rows_and_columns(spark):
    d = spark.createDataFrame([(1, "a b c d", "s"), (2, "a b", "t"), (2, "a b", "t"), (3, None, "u")], "doc_id long, text string, contaminated string")
    i = spark.createDataFrame([(7, "b c d")], "item_id long, text string")
    out = decontam.decontaminated(d, i, 10)
    assert out.columns == d.columns and rows(out, "doc_id", "contaminated") == [(2, "t"), (2, "t"), (3, "u")]
    assert decontam.decontaminated(d, i.limit(0), 10).count() == 4
    assert decontam.decontaminated(d.limit(0), i, 10).count() == 0


# --- 6. n-gram Jaccard join -------------------------------------------------------------------
def brute_components(docs, size, num, den):
    def shingles(t):
        w = jaccard_words(t)
        return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), find(d)) for d, s in sets), key=repr)


def jaccard_words(t):
    import re

    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("num", [90, 80])
def test_components_equal_brute_force(spark, num, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # many blocks in a bucket of this size
    rnd = random.Random(num)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    base = [word() for _ in range(120)]
    docs = []
    for i in range(260):  # one large group of copies with 0 to 14 edits, so links chain
        w = list(base)
        for _ in range(rnd.randint(0, 14) if i % 4 else 0):
            w[rnd.randrange(len(w))] = word()
        docs.append((i, " ".join(w) if i % 2 else "\n".join(w).upper().replace("É", "é")))
    for i in range(300, 420):
        docs.append((i, " ".join(word() for _ in range(rnd.choice([0, 1, 2, 3, 5, 40])))))
    docs += [(900, None), (901, ""), (902, " \t"), (903, "a b"), (904, "A  b"), (905, "a b a b a b")]
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit("x")).repartition(4)
    got = jaccard.similar_components(df, 3, num, 100)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute_components(docs, 3, num, 100)


def test_deduplicated_rows(spark):
    docs = [(1, "a b c d", 5), (2, "a b c d", 6), (3, "x y z", 7), (3, "x y z", 7), (None, "x y z", 8), (4, None, 9), (5, None, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n long")
    out = jaccard.deduplicated(df, 3, 90, 100)
    assert out.columns == df.columns
    assert rows(out, "doc_id", "text", "n") == rows(spark.createDataFrame([docs[0], docs[2], docs[4], docs[5], docs[6]], df.schema), "doc_id", "text", "n")
    assert jaccard.deduplicated(df.limit(0)).collect() == []


def test_parts_keep_linked_sets_and_part_others():
    """Linked sets of all sizes share a key; sets without a common shingle share none."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 1 << 16).astype(np.uint64)
    for num in (50, 80, 90):
        bands = jaccard.Bands(num, 100)
        apart, tried = [], 0
        for n in [*range(1, 60), 113, 170, 400]:
            for _ in range(20):
                a = rng.choice(pool, n, replace=False)
                cut, new = rng.integers(0, n // 5 + 2), rng.integers(0, n // 4 + 2)
                b = np.unique(np.concatenate([a[cut:], rng.choice(pool, new)]))
                a = np.unique(a)
                if len(b) and bands.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                    tried += 1
                    assert len(np.intersect1d(jaccard.parts(a, bands), jaccard.parts(b, bands)))
            apart.append(np.unique(jaccard.parts(np.unique(rng.integers(0, 1 << 63, 40).astype(np.uint64)), bands)))
        assert tried > 100 and len(np.unique(np.concatenate(apart))) == sum(map(len, apart))


def test_texts_of_one_id_are_one_node(spark):
    docs = [(2, "a b c d"), (3, "x y z w"), (5, "a b c d"), (5, "x y z w"), (5, ""), (6, "p q r s"), (7, "p q r s"), (None, "a b c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jaccard.similar_components(df, 3, 90, 100)
    assert rows(got.where("doc_id IS NOT NULL"), "doc_id", "n_shingles", "component_id") == sorted(
        [(2, 2, 2), (3, 2, 2), (5, 2, 2), (5, 2, 2), (5, 0, 2), (6, 2, 6), (7, 2, 6)])
    assert rows(jaccard.deduplicated(df, 3, 90, 100).where("doc_id IS NOT NULL"), "doc_id") == [(2,), (6,)]


def test_repeated_words_and_long_texts_stay_linear(spark):
    import time

    docs = [(1, "a " * 60000), (2, "b " + "a " * 9 + "b"), (3, "a " * 15 + "b"), (4, "x " * 400000 + " ".join(f"w{i}" for i in range(40)))]
    items = [(1, "a " * 2000), (2, "A"), (3, " ".join(f"w{i}" for i in range(10, 60))), (4, "a " * 9 + "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    t = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(d, b).collect()}
    assert got == {1: (60000, 60000, 2), 2: (11, 10, 2), 3: (16, 16, 3), 4: (400040, 30, 1)}
    assert time.time() - t < 60
    kept = decontam.decontaminated(d.union(d.select(F.lit(9), F.lit("b b"), "n_hit").limit(1)), b)
    assert [r.doc_id for r in kept.collect()] == [9] and kept.columns == d.columns


# --- 11. ranked lexical search ----------------------------------------------------------------
def brute_search(docs, items, k):
    found = [(d, lexical.terms(t)) for d, t in docs]
    found = [(d, w) for d, w in found if w]
    n_docs, total = len(found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for d, w in found:
            tf, m = Counter(w), 50 + 50 * len(w) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m))
                        for t in set(lexical.terms(text)) if t in tf)
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("words,seeds,pairs", [(1 << 21, 1 << 14, 1 << 20), (40, 60, 64)])
def test_lexical_search_equals_brute_force(spark, monkeypatch, words, seeds, pairs):
    rnd = random.Random(12)
    vocabulary = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["Äb", "x1", "A"]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 20, 60])))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(120)]  # ties beyond k
    docs += [(7, docs[9][1]), (None, docs[7][1].upper()), (2000, None), (2001, ""), (2002, "-- ,"), (2003, "w1 " * 3000)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 4, 15])))) for i in range(30)]
    items += [(50, docs[7][1]), (50, "w1"), (51, None), (52, ""), (53, "nowhere"), (None, "x1 äB ÄB")]
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "DOC_ROWS", 100)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = rows(lexical.ranked_search(d, b, 10, words, seeds), "item_id", "rank", "doc_id", "score")
    assert got == brute_search(docs, items, 10)


def test_lexical_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert rows(lexical.ranked_search(d, b), "item_id", "rank", "doc_id") == [(1, 1, 1)]
    for left, right in ((d.limit(0), b), (d, b.limit(0)), (d.where("doc_id = 2"), b), (d, b.select("item_id", F.lit("").alias("text")))):
        assert lexical.ranked_search(left, right).collect() == []


def test_bounds_of_the_trees_hold():
    rnd = np.random.default_rng(4)
    sizes = rnd.integers(0, 12, 70)
    term = np.concatenate([np.sort(rnd.choice(40, n, replace=False)) for n in sizes])
    start = np.append(0, np.cumsum(sizes))
    tree = lexical.Tree(lexical.Rows(start, term, rnd.integers(1, 99, len(term))), 40)
    assert sorted(tree.order.tolist()) == list(range(70))
    for level in range(1, len(tree.levels)):
        for node in range(len(tree.levels[level])):
            of, kids = tree.children(level, np.array([node]))
            top = np.zeros(40, np.int64)
            for kid in kids:
                at = slice(tree.levels[level - 1].start[kid], tree.levels[level - 1].start[kid + 1])
                np.maximum.at(top, tree.levels[level - 1].term[at], tree.levels[level - 1].value[at])
            own = slice(tree.levels[level].start[node], tree.levels[level].start[node + 1])
            dense = np.zeros(40, np.int64)
            dense[tree.levels[level].term[own]] = tree.levels[level].value[own]
            assert (dense == top).all()


def test_buckets_beyond_a_broadcast_pass_the_bitmap(spark, monkeypatch):
    """The plan for many buckets gives the same components; the bitmap lets every bucket's keys through."""
    rnd = random.Random(21)
    base = [" ".join(f"w{rnd.randint(0, 300)}" for _ in range(rnd.choice([6, 40, 120]))) for _ in range(40)]
    docs = [(i, " ".join(w if rnd.random() > 0.02 else "z" for w in base[i % 40].split())) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = rows(jaccard.similar_components(df, 3, 80, 100), "doc_id", "n_shingles", "component_id")
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "FILTER_WORDS", 1 << 6)
    assert rows(jaccard.similar_components(df, 3, 80, 100), "doc_id", "n_shingles", "component_id") == want
    keys = spark.createDataFrame([(int(x),) for x in np.random.default_rng(3).integers(-2**63, 2**63, 500)], "key long")
    bitmap = jaccard.bucket_bitmap(keys)
    assert jaccard.may_hold(bitmap, np.array([r.key for r in keys.collect()], np.int64)).all()
