"""3. Benchmark decontamination with training suffix arrays.

Training text is read in shards (pieces of an Arrow batch). A shard's words become ids of
the test vocabulary (0: any other word, which no test suffix contains). Its suffix array
holds every training suffix that starts with ``lead`` words of the test set in a row that
occur so in some test item (a suffix without them cannot reach a window), sorted by words up
to the longest item. Every test suffix is binary-searched in it, word by word, which yields
its longest verbatim match and the interval of all its locations. Matches that reach a window
(``window`` words, or the whole of a shorter item) are checked word for word, and the words
they cover are marked.

The test set goes to the tasks in blocks of at most ``BLOCK_WORDS`` words (a broadcast of
bounded size per pass); a larger test set takes several passes whose hits are merged by row.
The training side is never shuffled in the one-block case.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navbuckets.llm.textkernel import ALNUM_WORDS, HashTable, Words, pieces, text_buffers

BLOCK_WORDS = 2_000_000
#: fixed value: the word rule of the contract, after lower-casing A-Z
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_CAPITALS))


class TestBlock:
    """The suffixes of one block of test items, as ids of the block's own vocabulary."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int):
        items = [(i, w) for i, w in items if w]
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.need = np.minimum(lengths, window)  # words of a match that make a window, by item
        joined = " ".join(w for ws in self.words for w in ws).encode()
        hashes = Words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), ALNUM_WORDS).hashes
        self.vocab, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
        every = [w for ws in self.words for w in ws]
        self.spelled = [every[i] for i in at]
        if len(set(every)) != len(self.spelled):
            raise ValueError("two words of the test set have one hash")
        self.flat = ids.astype(np.int64) + 1
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        self.item = np.repeat(np.arange(len(items)), lengths)
        self.left = self.first[1:][self.item] - np.arange(len(self.flat))  # words to the item's end
        self.table = HashTable(self.vocab)
        self.lead = int(min(3, self.need.min(initial=3)))
        self.base = np.int64(len(self.vocab) + 1)
        leads = self.pack(self.flat, np.flatnonzero(self.left >= self.lead), self.lead)
        self.leads = np.unique(leads)
        self.deep = int(lengths.max(initial=0))

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        return self.table.find(hashes) + 1

    def pack(self, flat, at, n):
        """``n`` (at most 3) words from each position as one integer (ids are under 2**21)."""
        key = flat[at].copy()
        for k in range(1, n):
            key = key * self.base + flat[at + k]
        return key


def suffix_array(ids: np.ndarray, stop: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """Sorted candidate suffixes of a shard. ``ids``: word ids with 0 for foreign words;
    ``stop``: for each word the end of its text. Returns (positions, known words ahead)."""
    n, lead = len(ids), block.lead
    place = np.arange(n)
    foreign = np.minimum.accumulate(np.where(ids == 0, place, n)[::-1])[::-1]
    run = np.minimum(foreign, stop) - place  # words that could match from here
    at = np.flatnonzero(run >= lead)
    if not len(at):
        return at, run
    key = block.pack(ids, at, lead)
    where = np.searchsorted(block.leads, key)
    where[where == len(block.leads)] = 0
    keep = block.leads[where] == key
    at, key = at[keep], key[keep]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    # refine equal groups by further words until they differ, run out or reach the longest item
    rank = np.cumsum(np.append(0, key[1:] != key[:-1])) if len(at) else key
    deep = lead
    open_ = np.arange(len(at))
    while len(open_) and deep < block.deep:
        same = np.zeros(len(open_), bool)
        r = rank[open_]
        same[1:] = r[1:] == r[:-1]
        same[:-1] |= same[1:]
        open_ = open_[same]
        if not len(open_):
            break
        p, r = at[open_], rank[open_]
        key = np.zeros(len(p), np.int64)
        ahead = run[p]
        for k in range(2):
            have = ahead > deep + k
            key = key * block.base + np.where(have, ids[np.minimum(p + deep + k, n - 1)], 0)
        order = np.lexsort((key, r))
        at[open_] = p[order]
        key, r = key[order], r[order]
        fresh = np.append(True, (r[1:] != r[:-1]) | (key[1:] != key[:-1]))
        rank[open_] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(p)), 0))]
        deep += 2
    return at, run


def longest_matches(ids, stop, block: TestBlock):
    """For every test suffix with a match of its item's need: (suffix, length, first, last) of
    the interval of ``positions`` that share the longest match, and the positions."""
    at, run = suffix_array(ids, stop, block)
    suffix = np.flatnonzero(block.left >= block.lead)
    lo = np.zeros(len(suffix), np.int64)
    hi = np.full(len(suffix), len(at), np.int64)
    found = []
    depth = 0
    n = len(ids)

    def bound(lo, hi, want, upper):
        """Binary search of the next word inside each suffix's own interval."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            go = lo < hi
            if not go.any():
                return lo
            mid = (lo + hi) >> 1
            p = at[np.where(go, mid, 0)]
            word = np.where(run[p] > depth, ids[np.minimum(p + depth, n - 1)], 0)
            right = go & ((word <= want) if upper else (word < want))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(go & ~right, mid, hi)

    while len(suffix) and len(at):
        want = block.flat[suffix + depth]
        a, b = bound(lo, hi, want, False), bound(lo, hi, want, True)
        hit = a < b
        # every match that reaches its need, at each depth where locations drop out
        enough = depth >= block.need[block.item[suffix]]
        gone = enough & ((b - a) < (hi - lo))
        for s, l0, h0, a0, b0 in zip(suffix[gone], lo[gone], hi[gone], a[gone], b[gone], strict=True):
            found += [(s, depth, l0, a0), (s, depth, b0, h0)]
        suffix, lo, hi = suffix[hit], a[hit], b[hit]
        depth += 1
        ended = block.left[suffix] == depth
        done = ended & (depth >= block.need[block.item[suffix]])
        found += [(s, depth, l0, h0) for s, l0, h0 in zip(suffix[done], lo[done], hi[done], strict=True)]
        suffix, lo, hi = suffix[~ended], lo[~ended], hi[~ended]
    return at, [f for f in found if f[2] < f[3]]


def shard_matches(piece: pa.RecordBatch, block: TestBlock):
    """(row in piece, suffix, length, word position in the text) arrays of the verified matches
    of one shard that cannot be extended to the right, and the word counts by row."""
    data, offsets = text_buffers(piece.column("text"))
    words = Words(data, offsets, ALNUM_WORDS)
    counts = np.diff(words.first)
    empty = [np.zeros(0, np.int64)] * 4
    if not len(words.hashes) or not len(block.flat):
        return counts, empty
    ids = block.word_ids(words.hashes)
    stop = np.repeat(words.first[1:], counts)
    at, found = longest_matches(ids, stop, block)
    if not found:
        return counts, empty
    suffix = np.concatenate([np.full(b - a, s) for s, _, a, b in found])
    length = np.concatenate([np.full(b - a, d) for _, d, a, b in found])
    where = np.concatenate([at[a:b] for _, _, a, b in found])
    row = np.searchsorted(words.first, where, side="right") - 1
    where = where - words.first[row]
    # word-for-word check of what the hashes matched, on texts with a match only
    texts = piece.column("text")
    ok = np.ones(len(row), bool)
    order = np.argsort(row, kind="stable")
    last, own = -1, []
    for i in order:
        if row[i] != last:
            last, own = row[i], words_of(texts[int(row[i])].as_py())
        s, d, w = int(suffix[i]), int(length[i]), int(where[i])
        item = block.item[s]
        start = s - int(block.first[item])
        ok[i] = own[w:w + d] == block.words[item][start:start + d]
    return counts, [x[ok] for x in (row, suffix, length, where)]


def window_intervals(ids, stop, block: TestBlock):
    """For every test suffix that is a window (or a whole shorter item) and occurs: the suffixes, the
    intervals ``[lo, hi)`` of their locations, and the suffix array's positions."""
    at, run = suffix_array(ids, stop, block)
    suffix = np.flatnonzero(block.left >= block.need[block.item]) if len(block.flat) else np.zeros(0, np.int64)
    lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(at), np.int64)
    out = [np.zeros(0, np.int64)] * 3
    n, depth = len(ids), 0
    while len(suffix) and len(at):
        want = block.flat[suffix + depth]
        ends = []
        for upper in (False, True):
            a, b = lo.copy(), hi.copy()
            while (go := a < b).any():
                mid = (a + b) >> 1
                p = at[np.where(go, mid, 0)]
                word = np.where(run[p] > depth, ids[np.minimum(p + depth, n - 1)], 0)
                right = go & ((word <= want) if upper else (word < want))
                a, b = np.where(right, mid + 1, a), np.where(go & ~right, mid, b)
            ends.append(a)
        hit = ends[0] < ends[1]
        suffix, lo, hi = suffix[hit], ends[0][hit], ends[1][hit]
        depth += 1
        done = block.need[block.item[suffix]] == depth
        out = [np.append(x, y[done]) for x, y in zip(out, (suffix, lo, hi), strict=True)]
        suffix, lo, hi = suffix[~done], lo[~done], hi[~done]
    return at, *out


def shard_hits(piece: pa.RecordBatch, block: TestBlock):
    """The word counts of a shard's texts, and for every text with a hit its covered intervals (starts and
    ends in turn) and the numbers of the items that occur.

    Windows with the same words share one interval of locations, which is marked once, so a text and an
    item that repeat a word cost their lengths and not the product. Every covered word is compared with
    the test word its hash stood for; a word that only shared a hash becomes foreign and the shard is
    searched again."""
    words = Words(*text_buffers(piece.column("text")), ALNUM_WORDS)
    counts = np.diff(words.first)
    if not len(words.hashes) or not len(block.flat):
        return counts, {}
    ids, stop = block.word_ids(words.hashes), np.repeat(words.first[1:], counts)
    texts = piece.column("text")
    while True:
        at, suffix, lo, hi = window_intervals(ids, stop, block)
        if not len(suffix):
            return counts, {}
        item = block.item[suffix]
        group, of = np.unique(np.stack([lo, hi, block.need[item]]), axis=1, return_inverse=True)
        of = of.reshape(-1)
        edge, pairs = np.zeros(len(ids) + 1, np.int64), []
        order = np.argsort(of, kind="stable")
        parts = np.split(item[order], np.cumsum(np.bincount(of))[:-1])
        for (a, b, need), found in zip(group.T.tolist(), parts, strict=True):
            where = at[a:b]  # distinct positions
            edge[where] += 1
            edge[where + need] -= 1
            rows = np.unique(np.searchsorted(words.first, where, side="right") - 1)
            items = np.unique(found)
            pairs.append(np.stack([np.repeat(rows, len(items)), np.tile(items, len(rows))]))
        on = np.cumsum(edge[:-1]) > 0
        row, item = np.unique(np.concatenate(pairs, axis=1), axis=1)
        out, false_ = {}, []
        for r, names in zip(np.unique(row).tolist(), np.split(item, np.flatnonzero(np.diff(row)) + 1), strict=True):
            first, last = int(words.first[r]), int(words.first[r + 1])
            mine, own = np.flatnonzero(on[first:last]), words_of(texts[r].as_py())
            false_ += [first + k for k, i in zip(mine.tolist(), ids[first + mine].tolist(), strict=True) if own[k] != block.spelled[i - 1]]
            out[r] = (np.flatnonzero(np.diff(np.concatenate([[0], on[first:last].astype(np.int8), [0]]))), names)
        if not false_:
            return counts, out
        ids[false_] = 0


def item_blocks(items: DataFrame, window: int, block_words: int = BLOCK_WORDS):
    """The test set in blocks of bounded size, streamed through the driver one at a time. An
    item of more words than a block is cut into overlapping parts that hold all its windows."""
    held, size = [], 0
    for item in items.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = words_of(item["text"])
        step = max(1, block_words - window)
        parts = [words[a:a + block_words] for a in range(0, max(1, len(words) - window), step)] if len(words) > block_words else [words]
        for part in parts:
            if held and size + len(part) > block_words:
                yield TestBlock(held, window)
                held, size = [], 0
            held.append((item["item_id"], part))
            size += len(part)
    yield TestBlock(held, window)


def matches(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The operator's own output: (doc_id, item_id, item_pos, doc_pos, length), one row per test
    suffix and location of its longest verbatim match of at least a window; positions count words."""
    passes = []
    for block in item_blocks(items, window):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                for piece in pieces(batch):
                    _, (row, suffix, length, where) = shard_matches(piece, block)
                    item = block.item[suffix] if len(suffix) else suffix
                    yield pa.RecordBatch.from_arrays([
                        piece.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array([block.ids[i] for i in item], pa.string()),
                        pa.array(suffix - block.first[item], pa.int64()), pa.array(where, pa.int64()),
                        pa.array(length, pa.int64())], names=["doc_id", "item_id", "item_pos", "doc_pos", "length"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        passes.append(docs.select("doc_id", "text").mapInArrow(
            run, f"doc_id {kind}, item_id string, item_pos long, doc_pos long, length long"))
    out = passes[0]
    for p in passes[1:]:
        out = out.union(p)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an item (or
    of the whole of a shorter item). Null and empty texts have no words and no hits; items
    without words never occur; items with a null id mark words but are not listed; repeated
    rows are judged each for itself; an empty test set marks nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, n_words long, spans array<long>, items array<string>"
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in item_blocks(items, window, block_words)]
    passes = []
    for shared in blocks:
        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                for piece in pieces(batch):
                    counts, hits = shard_hits(piece, block)
                    spans, names = [None] * len(counts), [None] * len(counts)
                    for r, (turns, found) in hits.items():
                        spans[r] = turns.tolist()
                        names[r] = sorted({block.ids[i] for i in found} - {None})
                    yield pa.RecordBatch.from_arrays([
                        piece.column("doc_id"), piece.column("row"), pa.array(counts, pa.int64()),
                        pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))],
                        names=["doc_id", "row", "n_words", "spans", "items"])

        numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
        passes.append(numbered.mapInArrow(run, schema))
    if len(passes) == 1:
        merged = passes[0]
    else:  # several test blocks: the hits of a row meet again
        merged = passes[0]
        for p in passes[1:]:
            merged = merged.union(p)
        merged = (merged.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("ends"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .withColumn("spans", _merge_spans("ends")))
    spans = F.coalesce("spans", F.array().cast("array<long>"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    # merged spans alternate start, end: the covered words are the signed sum
    hit = F.aggregate(F.transform(spans, lambda v, i: F.when(i % 2 == 1, v).otherwise(-v)), F.lit(0).cast("long"),
                      lambda a, v: a + v)
    return merged.select("doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                         F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _merge_spans(column: str):
    """Union of intervals given as start, end, start, end, ... : starts and ends in order, with
    the running depth; an interval opens at depth 0 -> 1 and closes at 1 -> 0."""
    points = F.sort_array(F.transform(F.col(column), lambda v, i: F.struct(v.alias("at"), F.when(i % 2 == 1, 1).otherwise(0).alias("close"))))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<long>").alias("out"))

    def step(acc, p):
        depth = acc["depth"] + F.when(p["close"] == 1, -1).otherwise(1)
        edge = ((p["close"] == 0) & (acc["depth"] == 0)) | ((p["close"] == 1) & (acc["depth"] == 1))
        return F.struct(depth.alias("depth"), F.when(edge, F.concat(acc["out"], F.array(p["at"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(points, start, step)["out"]


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that contain a window of the test set; all columns and the order of
    rows kept. One map per block of test items drops the rows where they are: nothing is shuffled."""
    out = docs
    for block in item_blocks(items, window):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                for piece in pieces(batch):
                    keep = np.ones(piece.num_rows, bool)
                    keep[list(shard_hits(piece, shared.value)[1])] = False
                    yield piece.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
