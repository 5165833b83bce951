"""11. Ranked lexical search by dual trees.

Documents and items are sparse vectors over the items' terms: a document's coordinate is the
saturated, length-normalised frequency of a term, an item's is the term's weight; a score is
their integer inner product. Both sides are put into hierarchies: rows that share terms lie side
by side (recursive bisection), and every node holds the maximum of each coordinate below it. The
product of two nodes' maxima bounds every score between their rows, so a pair of nodes whose bound
is below the weakest k-th score of its items is dropped with all pairs under it, exactly. Pairs that
survive are split on the larger side; leaf pairs are scored.

On Spark: one map over the texts counts terms and writes the documents' vectors over the items'
vocabulary; document frequencies are an aggregation over them; a second map builds a document
tree per block and walks it against the items' tree, which is broadcast. k-th scores found so
far are kept over a task's blocks, and start from those of a bounded sample of documents (only a
start: a lower bound of the true ones whichever documents it holds). Winners of the tasks, at
most k an item each, meet in a ranked window. Items are taken in blocks of a bounded number of words,
so what is broadcast is bounded; each block is a pass over the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navbuckets.llm.textkernel import pieces
from navbuckets.session import scratch_path

#: words of a block of items (one longer item is a block by itself)
ITEM_WORDS = 1 << 21
#: bounds of a block of documents: rows and coordinates
DOC_ROWS = 4096
DOC_ENTRIES = 1 << 20
#: documents of the sample that the k-th scores start from
SEED_ROWS = 1 << 14
#: children of a node, and pairs of nodes that are looked at together
FAN = 8
PAIRS = 1 << 20

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_LOWER = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode().translate(_LOWER).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Rows:
    """Sparse rows: coordinates ``term`` (ascending in a row) and ``value``, those of row i from ``start[i]``."""

    def __init__(self, start: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.start, self.term, self.value = start, term, value

    def __len__(self) -> int:
        return len(self.start) - 1

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the coordinates of ``rows``, and where each row's begin among them."""
        sizes = self.start[rows + 1] - self.start[rows]
        begin = np.append(0, np.cumsum(sizes))
        return np.repeat(self.start[rows] - begin[:-1], sizes) + np.arange(begin[-1]), begin

    def take(self, rows: np.ndarray) -> Rows:
        at, begin = self.entries(rows)
        return Rows(begin, self.term[at], self.value[at])

    def products(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Inner products of ``rows`` with a dense vector."""
        if len(rows) == len(self):  # rows are distinct and ascending, so all of them
            total = np.append(0, np.cumsum(dense[self.term] * self.value))
            return total[self.start[1:]] - total[self.start[:-1]]
        at, begin = self.entries(rows)
        total = np.append(0, np.cumsum(dense[self.term[at]] * self.value[at]))
        return total[begin[1:]] - total[begin[:-1]]

    def maxima(self, fan: int, width: int) -> Rows:
        """Rows of the coordinate maxima of ``fan`` rows each."""
        node = np.repeat(np.arange(len(self)) // fan, np.diff(self.start))
        key = node * width + self.term
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        value = np.maximum.reduceat(self.value[order], first) if len(key) else self.value
        key = key[first]
        nodes = -(-len(self) // fan)
        return Rows(np.searchsorted(key, np.arange(nodes + 1) * width), key % width, value)


def arranged(rows: Rows, width: int, leaf: int = FAN) -> np.ndarray:
    """An order of the rows in which rows with shared coordinates lie side by side: parts are halved
    by whether a row is nearer to the first one or to the one least like it."""
    order, dense = np.arange(len(rows)), np.zeros(width)
    length = np.sqrt(np.maximum(np.diff(np.append(0, np.cumsum(rows.value.astype(float) ** 2))[rows.start]), 1.0))
    stack = [(0, len(order))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= leaf:
            continue
        part = np.sort(order[lo:hi])

        def likeness(row, part=part):
            at = slice(rows.start[row], rows.start[row + 1])
            dense[rows.term[at]] = rows.value[at]
            out = rows.products(part, dense) / length[part]
            dense[rows.term[at]] = 0.0
            return out / length[row]

        near = likeness(part[0])
        far = likeness(part[np.argmin(near)])
        order[lo:hi] = part[np.argsort(near - far, kind="stable")]
        cut = lo + -(-(hi - lo) // (2 * leaf)) * leaf
        stack += [(lo, cut), (cut, hi)]
    return order


class Tree:
    """A hierarchy over sparse rows: ``levels[0]`` are the rows in tree order, each further level holds the
    coordinate maxima of ``FAN`` nodes below; ``order`` gives the given row of each leaf."""

    def __init__(self, rows: Rows, width: int):
        self.order = arranged(rows, width)
        self.levels = [rows.take(self.order)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].maxima(FAN, width))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``nodes`` each child belongs to, and the children, one level down."""
        ends = np.minimum(FAN * (nodes + 1), len(self.levels[level - 1]))
        sizes = ends - FAN * nodes
        of = np.repeat(np.arange(len(nodes)), sizes)
        return of, np.repeat(FAN * nodes - np.append(0, np.cumsum(sizes))[:-1], sizes) + np.arange(len(of))


class Best:
    """The k best (score, smaller id first, null ids before all) of every item so far."""

    def __init__(self, items: int, k: int, floor: np.ndarray):
        self.k, self.seed = k, floor
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.known = np.zeros(0, bool)
        self.floor = floor.copy()

    def add(self, item, score, id_, known) -> None:
        item, score, id_, known = (np.concatenate(x) for x in
                                   ((self.item, item), (self.score, score), (self.id, id_), (self.known, known)))
        order = np.lexsort((id_, known, -score, item))
        sorted_ = item[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        won = order[place < self.k]
        self.item, self.score, self.id, self.known = item[won], score[won], id_[won], known[won]
        last = order[place == self.k - 1]
        self.floor = self.seed.copy()
        self.floor[item[last]] = np.maximum(self.floor[item[last]], score[last])


def dual_search(items: Tree, docs: Tree, ids: np.ndarray, known: np.ndarray, best: Best, width: int) -> None:
    """Add to ``best`` every document of a block that can be among an item's k best."""
    dense = np.zeros(width, np.int64)

    def weakest() -> list[np.ndarray]:
        out = [best.floor[items.order]]
        for level in items.levels[1:]:
            out.append(np.minimum.reduceat(out[-1], np.arange(len(level)) * FAN))
        return out

    def bounds(level: Rows, at: np.ndarray, below: Rows, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        edges = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = slice(level.start[at[lo]], level.start[at[lo] + 1])
            dense[level.term[own]] = level.value[own]
            out[lo:hi] = below.products(nodes[lo:hi], dense)
            dense[level.term[own]] = 0
        return out

    i, j = len(items.levels) - 1, len(docs.levels) - 1
    floors = weakest()
    stack = [(i, j, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, j, at, nodes = stack.pop()
        bound = bounds(items.levels[i], at, docs.levels[j], nodes)
        open_ = (bound > 0) & (bound >= floors[i][at])
        at, nodes, bound = at[open_], nodes[open_], bound[open_]
        if not len(at):
            continue
        if i == 0 and j == 0:
            rows = docs.order[nodes]
            best.add(items.order[at], bound, ids[rows], known[rows])
            floors = weakest()
            continue
        for lo in range(0, len(at), PAIRS // FAN):
            a, n = at[lo:lo + PAIRS // FAN], nodes[lo:lo + PAIRS // FAN]
            if j and j >= i:
                of, kids = docs.children(j, n)
                stack.append((i, j - 1, a[of], kids))
            else:
                of, kids = items.children(i, a)
                order = np.lexsort((n[of], kids))
                stack.append((i - 1, j, kids[order], n[of][order]))


def item_blocks(items: DataFrame, limit: int = ITEM_WORDS) -> Iterator[list[tuple]]:
    """Blocks of (item_id, distinct terms) with at most ``limit`` words, streamed through the driver."""
    held, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        found = sorted(set(terms(r.text)))
        if held and size + max(1, len(found)) > limit:
            yield held
            held, size = [], 0
        held.append((r.item_id, found))
        size += max(1, len(found))
    if held:
        yield held


def doc_vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n: terms with repeats, term: ids in the vocabulary, tf) of every document with a term."""
    def run(batches):
        known = vocabulary.value
        get = known.get
        for batch in batches:
            for piece in pieces(batch):
                found = [terms(t) for t in piece.column("text").to_pylist()]
                sizes = np.array([len(f) for f in found], np.int64)
                ids = np.array([get(w, -1) for f in found for w in f], np.int64)
                key = np.repeat(np.arange(len(found)), sizes) * (len(known) + 1) + ids
                key, tf = np.unique(key[ids >= 0], return_counts=True)
                row, term = np.divmod(key, len(known) + 1)
                start = np.searchsorted(row, np.arange(len(found) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(start), pa.array(x.astype(np.int32))) for x in (term, tf)]
                out = pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(sizes), *lists],
                                                 names=["doc_id", "n", "term", "tf"])
                yield out.filter(pa.array(sizes > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


def _doc_rows(batches, n_docs: int, total: int, useful: np.ndarray) -> Iterator[tuple]:
    """Blocks of documents as (ids, known ids, sparse rows) of the coordinates that carry weight."""
    held, entries = [], 0

    def out():
        ids, known, sizes, term, value = (np.concatenate(x) for x in zip(*held, strict=True))
        return ids, known, Rows(np.append(0, np.cumsum(sizes)), term, value)

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sizes = np.asarray(part.column("term").value_lengths(), np.int64)
            term, tf = (np.asarray(part.column(c).flatten(), np.int64) for c in ("term", "tf"))
            n = np.asarray(part.column("n"), np.int64)
            m = np.repeat(50 + 50 * n * n_docs // total, sizes)
            row, use = np.repeat(np.arange(part.num_rows), sizes), useful[term]
            ids = part.column("doc_id")
            held.append((np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_valid()).astype(bool),
                         np.bincount(row[use], minlength=part.num_rows), term[use], (1000000000 * tf // (1000 * tf + 20 * m))[use]))
            entries += len(held[-1][3])
            if sum(len(h[0]) for h in held) >= DOC_ROWS or entries >= DOC_ENTRIES:
                yield out()
                held, entries = [], 0
    if held:
        yield out()


def _search(vectors: DataFrame, shared, k: int) -> DataFrame:
    """(item, doc_id, score): at most ``k`` candidates an item and task, all of the k best among them."""
    def run(batches):
        tree, floor, weights, n_docs, total = shared.value
        width = len(weights)
        best = Best(len(floor), k, floor)
        for ids, known, rows in _doc_rows(batches, n_docs, total, weights > 0):
            dual_search(tree, Tree(rows, width), ids, known, best, width)
        for at in range(0, len(best.item), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(best.item[s]), pa.array(best.id[s], mask=~best.known[s]), pa.array(best.score[s])],
                                             names=["item", "doc_id", "score"])

    found = vectors.mapInArrow(run, "item long, doc_id long, score long")
    first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, item_words: int = ITEM_WORDS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """The ``k`` best documents ``docs(doc_id, text)`` of each row of ``items(item_id, text)``: ``item_id``,
    ``rank`` (from 1), ``doc_id``, ``score`` (above 0). Equal scores go by ascending doc_id, null ids first.

    Rows with a repeated id are documents (items) of their own. Null, empty and wordless texts have
    no terms: such documents do not count and such items find nothing. Other columns are ignored.
    An empty table on either side gives no rows. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    out = []
    for block in item_blocks(items, item_words):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
        if not vocabulary:
            continue
        path = scratch_path(spark, "lexical")
        doc_vectors(docs, share(vocabulary)).write.parquet(path)
        vectors = spark.read.parquet(path)
        n_docs, total = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            return _nothing(spark)
        df = np.zeros(len(vocabulary), np.int64)
        for term, count in vectors.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # one row a term of the block
            df[term] = count
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        found = [np.array([vocabulary[t] for t in ts], np.int64) for _, ts in block]
        start = np.append(0, np.cumsum([len(f) for f in found]))
        term = np.concatenate(found)
        tree = Tree(Rows(start, term, weights[term]), len(weights))
        floor = np.zeros(len(block), np.int64)
        part = n_docs // seed_rows
        if part > 1:
            some = vectors.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(part)) == 0)
            seeds = _search(some, share((tree, floor, weights, n_docs, total)), k).where(F.col("rank") == k)
            for item, score in seeds.select("item", "score").collect():  # one row an item of the block
                floor[item] = score
        ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
        out.append(_search(vectors, share((tree, floor, weights, n_docs, total)), k).join(F.broadcast(ids), "item")
                   .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.union, out) if out else _nothing(spark)


def _nothing(spark) -> DataFrame:
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
