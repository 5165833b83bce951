"""6. N-gram Jaccard join with parity sketches.

A document's set holds its distinct word shingles. Documents with equal sets form a class, found
by a 128-bit fingerprint of the set; only one document of a class joins. Each set is XOR-hashed:

* A *bit sketch*: every shingle flips one bit, so the Hamming distance of two sketches is at most
  the size of the symmetric difference.
* *Parts*: two linked sets of a size band differ in at most ``d`` shingles. Shingles are dealt to
  ``d + 1`` parts; a part's parity bits are kept as their 64-bit XOR image (equal bits have equal
  images). By the pigeonhole principle two linked sets agree in a part, so the join on (band,
  part, image) misses no pair. A set joins its own band and, if a larger partner may lie in
  it, the next one.
* *Empty parts* make no key, as sets that share nothing would meet there. A set of which linked
  sets differ in fewer shingles than it has filled parts agrees with each of them in a filled
  part. Any other set also joins by (band, shingle) for the shingles of its *prefix*, its
  smallest hashes: two linked sets have one in common.

Buckets of equal parts are not expanded into pairs. First every member meets one other set only, the
smallest member of the buckets it shares most; Hamming distance, then the exact sets, decide.
Components of these links come next.
Buckets that still hold several components then compare only pairs of different components: small
ones (up to ``SMALL`` members) by a join, larger ones as blocks of sketches inside tasks; what passes the Hamming bound is verified exactly. Links
inside a component cannot change it, so the components are those of all links.

Small sides are broadcast only after they have been counted (``BROADCAST_ROWS`` narrow rows, or
``BROADCAST_BYTES`` of sketches); beyond that the same joins shuffle. Part keys then pass a bitmap of
``FILTER_WORDS`` words first, in which every bucket has set a bit, so that most keys without a bucket
stay where they are made; what passes is joined exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navbuckets.llm.common import components, materialize
from navbuckets.llm.textkernel import SPACE_WORDS, Words, mix, pieces, text_buffers

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
FILTER_WORDS = 1 << 20  # 64-bit words of the bitmap of buckets, 8 MB whatever the input
BLOCK = 256
SMALL = 32  # buckets of up to so many members are paired by a join, at most SMALL / 2 rows a member
_U = np.uint64


class Bands:
    """Size bands and the numbers that follow from a similarity of ``num / den``."""

    def __init__(self, num: int = 90, den: int = 100, growth: float = 1.5):
        self.num, self.den = num, den
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(lows[-1] * growth)))
        self.lows = np.array(lows)

    def differ(self, total):
        """Largest symmetric difference of two linked sets of ``total`` elements together: from
        |A and B| >= t / (1 + t) * total."""
        return total * (self.den - self.num) // (self.den + self.num)

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, parts) that a set of ``n`` joins."""
        own = int(np.searchsorted(self.lows, n, side="right")) - 1
        top = int(np.searchsorted(self.lows, n * self.den // self.num, side="right")) - 1
        return [(b, int(self.differ(2 * (int(self.lows[b + 1]) - 1))) + 1) for b in range(own, top + 1)]

    def prefix(self, n: int) -> int:
        """So many smallest shingles of a set of ``n`` hold one that a linked set has among its own:
        they have ``num / den * n`` or more in common."""
        return n + (-n * self.num) // self.den + 1

    def width(self, n: int) -> int:
        """64-bit words of the bit sketch of a set of ``n``: a power of two, so that a longer one
        folds onto a shorter one."""
        return 1 << max(0, int(n * 2 // 64).bit_length())

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


def shingle_sets(piece: pa.RecordBatch, size: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a piece."""
    words = Words(*text_buffers(piece.column("text")), SPACE_WORDS)
    h, out = words.hashes, []
    n = max(0, len(h) - size + 1)
    whole = np.zeros(n, _U)
    for k in range(size):
        whole = mix(whole + h[k:k + n] * _U(2 * k + 3))
    for a, e in zip(words.first[:-1], words.first[1:], strict=True):
        if e - a >= size:
            out.append(np.unique(whole[a:e - size + 1]))
        elif e > a:  # fewer words: the sequence is the only shingle, of its own kind by length
            one = np.array([e - a], _U)
            for x in h[a:e]:
                one = mix(one * _U(0x9E3779B97F4A7C15) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, _U))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(np.bitwise_xor.reduce(mix(s)).view(np.int64)), int(np.add.reduce(mix(s ^ _U(0x5851F42D4C957F2D))).view(np.int64))


def parts(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the filled parts of a set in all bands that it joins, and of its prefix where those
    alone could miss a linked set."""
    out = []
    for band, count in bands.of(len(s)):
        m = mix(s ^ _U(band * 2654435761 + 1))
        at = ((m >> _U(32)) % _U(count)).astype(np.int64)
        image = np.zeros(count, _U)
        np.bitwise_xor.at(image, at, mix(m))
        filled = np.bincount(at, minlength=count) > 0
        out.append(mix(image + mix(np.arange(count, dtype=_U) + _U(band << 40)))[filled])
        largest = min(int(bands.lows[band + 1]) - 1, len(s) * bands.den // bands.num)
        if filled.sum() <= bands.differ(len(s) + largest):
            out.append(mix(s[:bands.prefix(len(s))] ^ mix(np.array([band], _U) + _U(1 << 62))))
    return np.concatenate(out).view(np.int64)


def bit_sketch(s: np.ndarray, words: int) -> np.ndarray:
    """Parity of the shingles at each of ``64 * words`` hashed positions."""
    m = mix(s ^ _U(0x2545F4914F6CDD1D))
    out = np.zeros(words, _U)
    np.bitwise_xor.at(out, ((m >> _U(6)) & _U(words - 1)).astype(np.int64), _U(1) << (m & _U(63)))
    return out


def _folded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sketches at the length of the shorter one."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2:]
    return a, b


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` and ``b``; the longer sketches are folded."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2:]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2:]
    out = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
    return out


def _map_sets(docs: DataFrame, size: int, row, schema: str) -> DataFrame:
    """``row(ids, sets)`` -> columns, over the shingle sets of every piece of ``docs``."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                columns = row(piece.column("doc_id"), shingle_sets(piece, size))
                yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns.values()],
                                                 names=list(columns))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sizes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, f1, f2) per row."""
    def row(ids, sets):
        marks = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
        return {"doc_id": ids, "n": np.array([len(s) for s in sets], np.int64),
                "f1": np.ascontiguousarray(marks[:, 0]), "f2": np.ascontiguousarray(marks[:, 1])}

    return _map_sets(docs, size, row, "doc_id long, n long, f1 long, f2 long")


def bucket_bitmap(buckets: DataFrame) -> np.ndarray:
    """``FILTER_WORDS`` words in which the bit of every ``key`` of ``buckets`` is set (keys are hashes, so
    their lowest bits name a place). One row a word at most reaches the driver."""
    word = F.shiftrightunsigned("key", 6).bitwiseAND(FILTER_WORDS - 1)
    rows = buckets.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[np.asarray(rows.column("word"), np.int64)] = np.asarray(rows.column("bits"), np.int64)
    return out.view(_U)


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    u = keys.view(_U)
    return bitmap[(u >> _U(6)) & _U(len(bitmap) - 1)] >> (u & _U(63)) & _U(1) == 1


def _keys(docs: DataFrame, size: int, bands: Bands, bitmap=None) -> DataFrame:
    """(key, rep): a row per part of each document, only those that may be in the (broadcast) ``bitmap``
    if there is one. Cheaper to make again than to store."""
    def row(ids, sets):
        made = [np.unique(parts(s, bands)) if len(s) else np.zeros(0, np.int64) for s in sets]
        if bitmap is not None:
            made = [m[may_hold(bitmap.value, m)] for m in made]
        return {"key": np.concatenate(made), "rep": np.repeat(np.asarray(ids, dtype=np.int64), [len(m) for m in made])}

    return _map_sets(docs, size, row, "key long, rep long")


def _bits(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """(doc_id, n, bits): the bit sketches, as bytes."""
    def row(ids, sets):
        return {"doc_id": ids, "n": np.array([len(s) for s in sets], np.int64),
                "bits": pa.array([bit_sketch(s, bands.width(len(s))).tobytes() if len(s) else b"" for s in sets], pa.binary())}

    return _map_sets(docs, size, row, "doc_id long, n long, bits binary")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a narrow table that has been counted, if it is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _near(pairs: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose sketches are close enough for a link."""
    def run(batches):
        for batch in batches:
            keep = []
            na, nb = (np.asarray(batch.column(c), dtype=np.int64) for c in ("na", "nb"))
            for i, (x, y) in enumerate(zip(batch.column("ba"), batch.column("bb"), strict=True)):
                x, y = _folded(np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U))
                if np.bitwise_count(x ^ y).sum(dtype=np.int64) <= bands.differ(int(na[i] + nb[i])):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    side = lambda k: sketches.select(F.col("doc_id").alias(k), F.col("n").alias("n" + k), F.col("bits").alias("b" + k))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """The distinct pairs (a, b) that are linked, by their whole sets. The sets of one ``a`` and of up
    to about ``BLOCK`` partners meet in a cell; each partner's set crosses the network once."""
    pairs = materialize(pairs)
    cells = F.greatest(F.ceil(F.col("c") / BLOCK), F.lit(1)).cast("long")
    dealt = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("c")), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), cells).alias("cell"))
    need = materialize(dealt.select(F.col("b").alias("doc_id"), "a", "cell", F.lit(True).alias("partner")).union(
        dealt.select("a", "a", "cell", F.lit(False)).distinct()))

    def sets(batches):
        for batch in batches:
            for piece in pieces(batch):
                found = pa.array([s.tobytes() for s in shingle_sets(piece, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in ("doc_id", "a", "cell", "partner")] + [found],
                                                 names=["doc_id", "a", "cell", "partner", "set"])

    def compare(cell: pa.Table) -> pa.Table:
        ids, partner = cell.column("doc_id").to_pylist(), cell.column("partner").to_pylist()
        own = [np.frombuffer(x, _U) for x in cell.column("set").to_pylist()]
        heads = [s for s, p in zip(own, partner, strict=True) if not p]
        hit = sorted({i for i, s, p in zip(ids, own, partner, strict=True) if p and any(
            bands.linked(len(np.intersect1d(s, h, assume_unique=True)), len(s), len(h)) for h in heads)})
        a = cell.column("a")[0].as_py()
        return pa.table([pa.array([a] * len(hit), pa.int64()), pa.array(hit, pa.int64())], names=["a", "b"])

    rows = docs.join(_small(need, need.count()), "doc_id").select("doc_id", "a", "cell", "partner", "text")
    return (rows.mapInArrow(sets, "doc_id long, a long, cell long, partner boolean, set binary")
            .groupBy("a", "cell").applyInArrow(compare, "a long, b long"))


def _block_pairs(members: DataFrame, bands: Bands) -> DataFrame:
    """Pairs of different components whose sketches are close, from (key, rep, comp, core, n_core,
    n_other, n, bits): blocks of a bucket's core component meet blocks of the others, and those
    meet each other; core members never meet among themselves."""
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("core"), blocks("n_core")).otherwise(blocks("n_other")).cast("long")).cast("int")
    placed = members.withColumn("block", mine)
    others = F.sequence(F.lit(0), blocks("n_other") - 1)
    meet_core = F.transform(F.sequence(F.lit(0), blocks("n_core") - 1), lambda i: F.struct((-1 - i).alias("x"), F.col("block").alias("y")))
    meet_other = F.transform(others, lambda j: F.struct(F.least(j, F.col("block")).alias("x"), F.greatest(j, F.col("block")).alias("y")))
    from_core = F.transform(others, lambda j: F.struct((-1 - F.col("block")).alias("x"), j.alias("y")))
    cells = F.when(F.col("core"), from_core).otherwise(F.concat(meet_core, meet_other))
    placed = placed.select("key", "rep", "comp", "n", "bits", F.when(F.col("core"), -1 - F.col("block")).otherwise(F.col("block")).alias("spot"),
                           F.explode(cells).alias("cell")).select("key", "cell.x", "cell.y", "spot", "rep", "comp", "n", "bits")

    def run(table: pa.Table) -> pa.Table:
        block, rep, comp, n = (np.asarray(table.column(c), dtype=np.int64) for c in ("spot", "rep", "comp", "n"))
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        bits = [np.frombuffer(b, _U) for b in table.column("bits").to_pylist()]
        width = np.array([len(b) for b in bits])
        out = []
        for wa in np.unique(width):
            left = np.flatnonzero((block == x) & (width == wa))
            for wb in np.unique(width):
                right = np.flatnonzero((block == y) & (width == wb))
                if not len(left) or not len(right):
                    continue
                far = hamming(np.array([bits[i] for i in left]), np.array([bits[i] for i in right]))
                near = (far <= bands.differ(n[left][:, None] + n[right][None, :])) & (comp[left][:, None] != comp[right][None, :])
                i, j = np.nonzero(near)
                out.append(np.stack([rep[left][i], rep[right][j]]))
        pair = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        low, high = pair.min(0, initial=np.iinfo(np.int64).max), pair.max(0, initial=np.iinfo(np.int64).min)
        return pa.table([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])

    return placed.groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs(doc_id, text)``: components of the links
    ``den * |A and B| >= num * |A or B|`` between the documents' shingle sets.

    ``component_id`` is the smallest doc_id reachable (links join all texts of an id). Null and empty texts, and texts without words,
    have an empty set (0) and link with nothing, not even each other; a text of fewer words than
    a shingle has its whole sequence as its one shingle. Rows with the same doc_id are one
    node of the link graph. Rows with a null doc_id take no part (component null). Empty
    tables give no rows.
    """
    bands = Bands(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id IS NOT NULL")
    marks = materialize(_sizes(docs, size))
    classes = materialize(marks.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    repeated = bool(marks.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count())
    if repeated:  # one row per text
        known = known.dropDuplicates(["doc_id", "text"])
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    reps = _small(reps, reps.count())
    chosen = known.join(reps, "doc_id", "left_semi")
    keys = _keys(chosen, size, bands)
    buckets = materialize(keys.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("low"), F.max("rep").alias("high"))
                          .where("m > 1 AND low < high"))
    n_buckets = buckets.count()
    if n_buckets > BROADCAST_ROWS:
        keys = _keys(chosen, size, bands, docs.sparkSession.sparkContext.broadcast(bucket_bitmap(buckets)))
    members = keys.join(_small(buckets.select("key", "low"), n_buckets), "key").select("key", "low", "rep")
    members = materialize(members.distinct() if repeated else members)  # else a set makes a key once
    # every set meets first the smallest member with which it shares most buckets
    shared = members.where("rep > low").groupBy("rep", "low").agg(F.count("*").alias("c"))
    star = shared.groupBy("rep").agg(F.max_by("low", F.struct("c", -F.col("low"))).alias("a")).select("a", F.col("rep").alias("b"))
    ids = materialize(members.select(F.col("rep").alias("doc_id")).distinct())
    sketches = materialize(_bits(known.join(_small(ids, ids.count()), "doc_id", "left_semi"), size, bands))
    weight = sketches.agg(F.coalesce(F.sum(F.octet_length("bits") + 32), F.lit(0)).alias("w")).first()["w"]
    small_sketches = F.broadcast(sketches) if weight <= BROADCAST_BYTES else sketches
    links = _verified(_near(star, small_sketches, bands).distinct(), known, size, bands)
    if repeated:  # the texts of an id are one node: its classes are linked
        held = marks.where("doc_id IS NOT NULL").join(classes, ["n", "f1", "f2"]).select("doc_id", "rep").distinct()
        first = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
        links = links.union(held.join(first, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct())
    links = materialize(links)
    comp = components(links)

    # buckets that still hold several components
    labelled = members.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("comp"))
    labelled = materialize(labelled)
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2")
    sized = (labelled.join(mixed.select("key"), "key").groupBy("key", "comp").agg(F.count("*").alias("c")))
    cores = sized.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("core_comp"), F.max("c").alias("n_core"),
                                     F.sum("c").alias("all"))
    cores = materialize(cores)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # narrow rows, but work for Python
    few = labelled.join(cores.where(F.col("all") <= SMALL).select("key"), "key")
    near = _near(few.join(few.select("key", F.col("rep").alias("rep2"), F.col("comp").alias("comp2")), "key")
                 .where("rep < rep2 AND comp <> comp2").select(F.col("rep").alias("a"), F.col("rep2").alias("b")).repartition(width, "a", "b").distinct(),
                 small_sketches, bands)
    open_ = (labelled.join(cores.where(F.col("all") > SMALL), "key").join(sketches.select(F.col("doc_id").alias("rep"), "n", "bits"), "rep")
             .select("key", "rep", "comp", (F.col("comp") == F.col("core_comp")).alias("core"), "n_core",
                     (F.col("all") - F.col("n_core")).alias("n_other"), "n", "bits"))
    more = materialize(_verified(near.union(_block_pairs(open_, bands)).distinct(), known, size, bands))
    lifted = (more.join(comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
              .join(comp.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
              .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    joined = components(lifted)
    final = (classes.select("n", "f1", "f2", "rep")
             .join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
             .select("n", "f1", "f2", F.coalesce("component", "rep").alias("id"))
             .join(joined, "id", "left").select("n", "f1", "f2", F.coalesce("component", "id").alias("component")))
    rows = marks.join(final, ["n", "f1", "f2"], "left")
    if repeated:  # texts without words too
        node = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component").alias("component"))
        rows = rows.drop("component").join(node, "doc_id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"),
                       F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One document of each component of ``docs`` (the smallest doc_id), all columns kept. Rows
    without a doc_id stay; of rows that repeat a doc_id one stays, the smallest by text."""
    found = similar_components(docs, size, num, den)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    own = docs.join(keep, "doc_id", "left_semi")
    first = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    single = own.join(first.select("doc_id"), "doc_id", "left_anti")
    many = own.join(first.select("doc_id"), "doc_id", "left_semi")
    packed = many.groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("r"))
    return single.select(*docs.columns).union(packed.select("doc_id", "r.*").select(*docs.columns)).union(docs.where("doc_id IS NULL"))
