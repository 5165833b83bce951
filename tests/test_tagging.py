"""Links labelled by sequence: the decoded path is a best one of all label sequences."""

import itertools
import random


from conftest import page
from navbuckets.functions.dom import pin
from navbuckets.operators.tagging import LABELS, TRANSITIONS, tag_links, viterbi


def test_viterbi_equals_brute_force(spark):
    rnd = random.Random(4)
    seqs = [(i, [[rnd.randint(-3, 4) for _ in range(3)] for _ in range(rnd.randint(0, 6))]) for i in range(60)] + [(99, [[0, 0, 0]] * 4)]
    df = spark.createDataFrame(seqs, "id long, s array<array<int>>")

    def total(path, emit):
        return sum(e[y] for y, e in zip(path, emit, strict=True)) + sum(TRANSITIONS[a][b] for a, b in itertools.pairwise(path))

    got = {r.id: r.p for r in df.select("id", pin(viterbi("s", 3, TRANSITIONS), "s").alias("p")).collect()}
    for i, emit in seqs:
        best = max(total(p, emit) for p in itertools.product(range(3), repeat=len(emit)))
        assert len(got[i]) == len(emit) and total(got[i], emit) == best


def test_neighbours_decide(spark):
    """A bare arrow among numbers is a page control, alone it is not; long rows are linear."""
    rows = [(1, page('<a href="/a">Jobs</a> <a href="?page=1">1</a> <a href="/x">3 of 9</a> <a href="?page=3">3</a> <a href="/n">Next</a>')),
            (2, page('<a href="/a">Jobs</a> <a href="/x">3 of 9</a> <a href="/b">Blog</a>')), (3, page("no links")), (4, None),
            (5, page("".join(f'<a href="?page={i}">{i}</a>' for i in range(1500))))]
    got = {}
    for r in tag_links(spark.createDataFrame(rows, "page_id long, html string")).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r.link_type)
    assert got[1] == ["OTHER", "PAGE", "PAGE", "PAGE", "NEXT"] and got[2] == ["OTHER"] * 3 and set(got) == {1, 2, 5}
    assert got[5] == ["PAGE"] * 1500 and set(got[1]) <= set(LABELS)
