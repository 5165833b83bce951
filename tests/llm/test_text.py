"""Operators 7, 8, 9 and 10 against brute force and the tokenizer libraries."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from navbuckets.llm import bpe, chat, tokencount, urlfilter

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\x1c", "'s", "'ll", "1", "23", "!", "..", "é", "ß", "字", "<|endoftext|>", "the", " and", "ing", "\t", "\x85",
          "\u2003", "😀", "\u0301", "aaaa", "zz"]


def texts(seed, n, longest=60):
    rnd = random.Random(seed)
    out = [None, "", " ", "a" * 3000, "ab" * 2000, " " * 500, "-" * 700]
    while len(out) < n:
        if rnd.random() < 0.5:
            out.append("".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, longest))))
        else:
            out.append("".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0, 0x2FFF)])) for _ in range(rnd.randint(0, longest))))
    return out


# --- 10. BPE ----------------------------------------------------------------------------------
def test_bpe_equals_the_library_and_round_trips(spark):
    docs = texts(1, 1500)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(4)
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    library = Tokenizer.from_file(PATH)
    assert len(out) == len(docs)
    for r in out:
        want = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), PATH).collect() == []


# --- 8. token counts --------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, name):
    path = public_tokenizers.path(name)
    docs = texts(2, 300, 200)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    code = tokencount.coder(path)
    want = {i: c for i, c in enumerate(code.counts([t or "" for t in docs]))}
    for chunk, overlap in ((40, 8), (97, 3), (1 << 15, 256)):
        out = tokencount.token_counts(df, path, 20, chunk=chunk, overlap=overlap).collect()
        assert {r.doc_id: r.n_tokens for r in out} == want
        assert all(r.n_bytes == len((docs[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 20) for r in out)
    assert tokencount.token_counts(df.limit(0), path).collect() == []


# --- 7. chat ----------------------------------------------------------------------------------
def tree_rows():
    return [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "a <b> & </turn>", 1.0), ("t", 3, 1, "assistant", None, 2.0),
            ("t", 4, 2, "user", 'say "x"', 0.0), ("t", 5, 4, 'od"d<&', "\\### &lt; ok", None), ("t", 6, 99, "user", "lost parent", 0.0),
            ("t", 7, 8, "user", "cycle", 0.0), ("t", 8, 7, "user", "cycle", 0.0), ("t", 9, 8, "user", "under it", 0.0),
            ("t", None, 1, "user", "no id", 0.0), (None, 1, None, "user", "null tree", 0.0), ("t", 1, None, "user", "zz repeated", 0.0)]


def test_paths_ranks_and_reading_back(spark):
    nodes = spark.createDataFrame(tree_rows(), "tree_id string, node_id long, parent_id long, role string, text string, score double")
    out = chat.conversations(nodes).withColumn("turns", chat.read_turns(F.col("formatted"))) \
        .withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    got = {(r.tree_id, r.leaf_id): r for r in out.collect()}
    assert set(got) == {("t", 3), ("t", 5), ("t", 6), (None, 1)}
    long = got[("t", 5)]
    assert [tuple(t) for t in long.turns] == [("user", "hi"), ("assistant", "a <b> & </turn>"), ("user", 'say "x"'), ('od"d<&', "\\### &lt; ok")]
    assert long.loss == "a <b> & </turn>" and long["rank"] == 2 and got[("t", 3)]["rank"] == 1 and got[("t", 6)]["rank"] == 3
    assert [tuple(t) for t in got[("t", 3)].turns] == [("user", "hi"), ("assistant", "")]
    assert chat.conversations(nodes.limit(0)).collect() == []


def test_deep_linear_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}") for t in range(300)] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.tree_id: r for r in chat.conversations(chat.linear_tree(turns)).withColumn(
        "loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert out[1].n_turns == 300 and out[1].loss == "".join(f"text {t}" for t in range(1, 300, 2))
    assert out[2].n_turns == 2 and out[2].loss == "xx"


# --- 9. url filter ----------------------------------------------------------------------------
def test_url_parts_and_rules(spark):
    urls = [(1, "HTTP://Sub.Example.ORG/en/1x?q#f"), (2, "x://example.org/en/1"), (3, "x://notexample.org/es/"), (4, "x://a.com/fr/"), (5, "x://a.com/de/1"),
            (6, "x://a.com"), (7, None), (8, "no scheme/"), (9, "x://example.org?x=/es/"), (10, ""), (4, "x://a.com/fr/")]
    pages = spark.createDataFrame([(i, u, None) for i, u in urls], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame([("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True),
                                   ("com", "/de/", False)], "host string, path string, allow boolean")
    out = sorted(urlfilter.judge_urls(pages, rules, rounds=2).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out if r.page_id not in (6, 9)] == [
        (1, "sub.example.org", "/en/1x", "example.org/en/1", "block"), (2, "example.org", "/en/1", "example.org/en/1", "block"),
        (3, "notexample.org", "/es/", "org/", "allow"), (4, "a.com", "/fr/", "com/fr/", "allow"), (4, "a.com", "/fr/", "com/fr/", "allow"),
        (5, "a.com", "/de/1", "com/de/", "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (10, "", "", None, "allow")]
    assert urlfilter.judge_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in urlfilter.judge_urls(pages, rules.limit(0), rounds=1).collect()} == {"allow"}


def brute_rank(links, seeds, rounds, damping):
    total = sum(seeds.values())
    start = {h: m / total for h, m in seeds.items() if m}
    out = {}
    for (a, _), n in links.items():
        out[a] = out.get(a, 0) + n
    mass = dict(start)
    for _ in range(rounds):
        new = {h: (1 - damping) * m for h, m in start.items()}
        for (a, b), n in links.items():
            if a in mass:
                new[b] = new.get(b, 0) + damping * mass[a] * n / out[a]
        mass = new
    return mass


def test_propagation_equals_brute_force(spark):
    rnd = random.Random(6)
    hosts = [f"h{i}" for i in range(30)]
    links = {}
    for _ in range(150):
        a, b = rnd.choice(hosts[:3] + hosts), rnd.choice(hosts)
        if a != b:
            links[a, b] = links.get((a, b), 0) + rnd.randint(1, 3)
    seeds = {h: (float(rnd.randint(0, 2)), float(rnd.randint(0, 1))) for h in hosts[:8]}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()] + [("h1", "h1", 5)], "src string, dst string, n long")
    start = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in urlfilter.propagate(edges, start, rounds=5).collect()}
    trust = brute_rank(links, {h: s[0] for h, s in seeds.items()}, 5, 0.85)
    distrust = brute_rank({(b, a): n for (a, b), n in links.items()}, {h: s[1] for h, s in seeds.items()}, 5, 0.85)
    assert set(got) == set(trust) | set(distrust)
    for h, (t, d) in got.items():
        assert abs(t - trust.get(h, 0)) < 1e-9 and abs(d - distrust.get(h, 0)) < 1e-9


def test_links_in_pages_spread_trust(spark):
    pages = spark.createDataFrame([(1, "x://good.org/", '<a href="http://FRIEND.net/x">'), (2, "x://bad.org/no/", ""),
                                   (3, "x://friend.net/a", ""), (4, "x://shady.net/b", "<a HREF='https://bad.org/'>"), (5, "x://new.net/", None)],
                                  "page_id long, url string, html string")
    rules = spark.createDataFrame([("good.org", "/", True), ("bad.org", "/", False)], "host string, path string, allow boolean")
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow"}


def test_propagation_reaches_hosts_far_from_a_seed(spark):
    """A chain of links longer than the 12 rounds there once were ends at a blocked host."""
    n = 15
    edges = spark.createDataFrame([(f"h{i:02}", f"h{i + 1:02}", 1) for i in range(n)], "src string, dst string, n long")
    start = spark.createDataFrame([(f"h{n}", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: r.distrust for r in urlfilter.propagate(edges, start).collect()}
    assert len(got) == n + 1
    for i in range(n + 1):
        assert got[f"h{i:02}"] == pytest.approx(0.15 * 0.85 ** (n - i))


def test_long_words_and_forgotten_words(spark):
    machine, library = bpe.automaton(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(14)
    odd = ["".join(rnd.choice("abcXYZ019+/=") for _ in range(30000)), "字" * 9000, "é" * 3000, "ab " * 400, "x" * bpe.LONG, "x" * (bpe.LONG + 1)]
    for text, ids in zip(odd, machine.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    held, machine.coder.memo.limit = machine.coder.memo.limit, 1000  # every call starts a new generation
    many = texts(15, 200)
    for at in range(0, 200, 20):
        for text, ids in zip(many[at:at + 20], machine.encode([t or "" for t in many[at:at + 20]]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert len(machine.coder.memo.young) < 2000
    machine.coder.memo.limit = held


def test_one_map_round_trip(spark):
    docs = texts(16, 200)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("decoded", F.lit("clash")).repartition(2)
    one, two = bpe.round_trip(df, PATH), bpe.decode(bpe.encode(df.drop("decoded"), PATH), PATH)
    assert sorted(map(tuple, one.select(*two.columns).collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)
    assert bpe.round_trip(df.limit(0), PATH).collect() == []
