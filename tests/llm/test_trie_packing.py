"""Operators 12 and 13 against brute force and the tokenizer library, with nulls, empties, ties and repeats."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from navbuckets.llm import packing
from navbuckets.llm.ordered import in_order, running
from navbuckets.llm.trie import CHUNK, _digests, prefix_trie, ranked

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables over several partitions, as large ones would be."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


# --- ordered scans ----------------------------------------------------------------------------
def test_running_values_cross_partitions(spark):
    rnd = random.Random(5)
    data = [(7 if rnd.random() < 0.6 else rnd.randint(0, 30), i, rnd.randint(-2**62, 2**62)) for i in range(900)]
    df = in_order(spark.createDataFrame(data, "g long, i long, x long").repartition(6), "g", "i")
    assert df.select("part").distinct().count() > 2
    got = sorted((r.g, r.i, r.nth, r.last, r.x_sum, r.x_before) for r in running(df, "g", ("x",)).collect())
    want, total, nth = [], 0, 0
    ordered = sorted(data)
    for k, (g, i, x) in enumerate(ordered):
        if k == 0 or ordered[k - 1][0] != g:
            total, nth = 0, 0
        before, total = total, (total + x + 2**63) % 2**64 - 2**63
        want.append((g, i, nth, k + 1 == len(ordered) or ordered[k + 1][0] != g, total, before))
        nth += 1
    assert got == want
    assert running(in_order(df.drop("part").limit(0), "g", "i"), "g").collect() == []


def test_list_ranking_of_a_shuffled_list(spark):
    rnd = random.Random(6)
    names = [(c, a) for c in range(120) for a in range(4)]
    rnd.shuffle(names)
    rows = [(*n, *(names[i + 1] if i + 1 < len(names) else (None, None)), i % 3, i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "conv_id long, at long, next_conv long, next_at long, leaf long, saved long").repartition(5)
    got = {(r.conv_id, r.at): (r.ones, r.leaf, r.saved) for r in ranked(df).collect()}
    for i, n in enumerate(names):
        assert got[n] == (len(names) - i, sum(k % 3 for k in range(i, len(names))), sum(range(i, len(names))))


# --- 12. prefix trie --------------------------------------------------------------------------
def brute_trie(rows, block=20, spread=4):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = (turn is not None, turn or 0, hashlib.sha256(f"{role}\n{text}".encode()).hexdigest())
            turns.setdefault(c, []).append((key, (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % spread
        base = c - int(np.fmod(c, block))
        made[c] = own[c] if base == c else own.get(base, [])[:h] + own[c][h:]
    nodes = {tuple(s[:d]) for s in made.values() for d in range(len(s) + 1)}
    out = set()
    for v in nodes:
        d = len(v)
        inside = {x for x in nodes if x[:d] == v}
        members = {x: [c for c, s in made.items() if tuple(s[:len(x)]) == x] for x in inside}
        leaves = [x for x in inside if not any(y[:-1] == x for y in nodes if y)]
        words = {x: len([w for w in x[-1][1].replace("\x0b", " ").split()]) if x else 0 for x in inside}
        ends = ",".join(map(str, sorted(c for c, s in made.items() if tuple(s) == v)))
        parent = min(c for c, s in made.items() if tuple(s[:d - 1]) == v[:-1]) if d else None
        out.add((min(members[v]), d, parent, len(members[v]), sum(1 for y in nodes if y and y[:-1] == v), len(leaves),
                 sum((len(members[x]) - 1) * words[x] for x in inside), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 45), 60, 63, 67, -7, -20, 2**40]:
        for t in range(rnd.randint(1, 5)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "hi\tthere  you", "", None, "x"])))
    rows += [(41, None, "user", "first"), (41, 0, "user", "again"), (41, 0, "user", "again"), (None, 1, "user", "nobody")]
    rows += [(3, t, "user", f"turn {t % 3}") for t in range(200)]  # a long conversation
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = talk(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).repartition(3)
    got = prefix_trie(df).collect()
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {tuple(r[c] for c in cols) for r in got} == brute_trie(rows) and len(got) == len(brute_trie(rows))
    # the arcs are a proper tour: spans nest, every place is taken once
    places = sorted([r.enter for r in got] + [r.leave for r in got])
    assert places == list(range(2 * len(got)))
    top = next(r for r in got if r.depth == 0)
    assert (top.enter, top.leave) == (0, 2 * len(got) - 1)


def test_trie_of_empty_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(21, 0, "user", "mine")]  # 21 takes its first turns of conversation 20, which is absent
    h = zlib.crc32(b"21") % 4
    got = prefix_trie(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == (1 if h else 2)


def test_long_lists_of_ends_are_streamed(spark):
    n = 3 * CHUNK // 4
    df = spark.range(n).select(F.lit(1).cast("long").alias("depth"), F.col("id").alias("conv_id")).repartition(7)
    got = _digests(df, ["depth"]).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()]


# --- 13. packing ------------------------------------------------------------------------------
def test_tournament_tree_is_first_fit():
    rnd = random.Random(8)
    for _ in range(30):
        sizes = [rnd.randint(1, 64) for _ in range(rnd.randint(1, 90))]
        room, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(64)
            room[b] -= sizes[i]
            want[i] = b
        assert packing.first_fit(sizes, 64) == want


def documents():
    rnd = random.Random(9)
    pieces = ["the", " ", "ing", "É", "ß", "字", "'s", "12", "!", "<|endoftext|>", "\n", " ", "é", "Σ", "\x85", "\x1c", "ABC"]
    texts = [None, "", " ", "word " * 900, "a" * 5000]
    return [(i % 40, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 400)))) for i in range(150)] + [(None, t) for t in texts]


@pytest.mark.parametrize("docs_,tokens", [(4096, 1 << 22), (7, 1 << 22), (4096, 900)])
def test_packing_holds_every_id_once(spark, docs_, tokens):
    data = [(i, d, t) for i, (d, t) in enumerate(documents())]
    df = spark.createDataFrame(data, "row long, doc_id long, text string").withColumn("offset", F.lit("clash")).repartition(3)
    out = packing.packed(df, PATH, 128, 1, ["row", "doc_id"], docs_, tokens).collect()
    from navbuckets.llm.units import library
    lib = library(PATH)
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.row, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
    assert len(by_doc) == len(data)
    for i, d, t in data:
        want = lib.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist() == want
        at = 0
        for r in parts:
            assert r.start == at and r.doc_tokens == len(want) and r.doc_id == d
            at += r.length
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 128 or at.bit_count() == 1 and at < 128  # no padding
    assert packing.packed(df.limit(0), PATH).collect() == []
