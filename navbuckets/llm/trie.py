"""12. Conversation prefix trie by the Euler-tour technique.

Conversations are sequences of turns; a node of the trie is a distinct sequence of first turns.
Every member of every node is one row (conversation, depth) with a 128-bit key of its sequence:
the sum, over its turns, of hashes of (depth, digest of role and text), so keys are running sums
and a conversation of any length is spread over many tasks. Nodes are the groups of equal keys
(aggregated before the shuffle); a node is named by its smallest member and its depth.

The tour has two arcs a node, enter and exit. One global sort puts each node before its children,
and one pass over it, looking one row ahead, gives every arc its successor: enter leads to the
first child or the own exit, exit to the next sibling or the parent's exit. The tour is then
list-ranked: arcs are dealt by ranges of their names, so that most successors are in the same
partition; each partition contracts its chains to one link each, the links are ranked by pointer
doubling over joins, and each arc adds its place in its chain. Ranking carries the sums of weights
behind each arc along with the arc's place. Leaves and savings of a subtree are differences of the
tour's sums at the two arcs of its top.

No task holds a group: hot first turns, long conversations and wide nodes are spread by the sorts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navbuckets.llm.common import materialize
from navbuckets.llm.ordered import in_order, ints, running

#: characters of a chunk of joined ids (a task sorts and streams chunks, it never holds a node's)
CHUNK = 1 << 14


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def rebuilt(conversations: DataFrame, block: int = 20, spread: int = 4) -> DataFrame:
    """The turns of the rebuilt conversations, sorted (``in_order``): ``conv_id``, ``seq``, ``digest`` (of
    role and text; null in the textless row that begins every conversation), ``words``.

    Conversation c takes the first h turns of conversation c - c % ``block``, then its own behind
    its first h; h is crc32(c as text) % ``spread``.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(role, F.lit("\n"), text).cast("binary"), 256)
    turns = materialize(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("digest"), words(text).alias("words"),
        F.monotonically_increasing_id().alias("row")))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]
    placed = materialize(running(in_order(turns, *order), "conv_id").select("conv_id", (F.col("nth") + 1).alias("seq"), "digest", "words"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread
    base = F.col("conv_id") - F.col("conv_id") % block
    all_ = materialize(placed.groupBy("conv_id").agg(h.alias("h"), base.alias("base")))
    heads = placed.where((F.col("conv_id") % block == 0) & (F.col("seq") < spread)).withColumnRenamed("conv_id", "base")
    lent = (all_.where((F.col("base") != F.col("conv_id")) & (F.col("h") > 0)).join(heads, "base").where(F.col("seq") <= F.col("h"))
            .select("conv_id", (F.col("seq") - spread).alias("seq"), "digest", "words"))
    own = placed.where((F.col("conv_id") % block == 0) | (F.col("seq") > h))
    tops = all_.select("conv_id", F.lit(-spread - 1).cast("long").alias("seq"), F.lit(None).cast("string").alias("digest"),
                       F.lit(0).cast("long").alias("words"))
    return in_order(tops.unionByName(lent).unionByName(own), "conv_id", "seq")


def members(sequences: DataFrame) -> DataFrame:
    """One row per conversation and depth: ``conv_id``, ``depth``, ``words`` of the last turn, ``last``, the key
    ``a_sum, b_sum`` of the sequence and ``a_before, b_before`` of that without its last turn."""
    deep = running(sequences, "conv_id").withColumnRenamed("nth", "depth")
    lane = [F.when(F.col("digest").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "depth", "digest")).alias(x)
            for k, x in enumerate("ab")]
    hashed = materialize(deep.select("conv_id", "depth", "words", F.col("last").alias("is_last"), "part", *lane))
    return materialize(running(hashed, "conv_id", ("a", "b"))
                       .select("conv_id", "depth", "words", F.col("is_last").alias("last"), "a_sum", "b_sum", "a_before", "b_before"))


def tour(nodes: DataFrame) -> DataFrame:
    """The arcs of the Euler tour of ``nodes`` (conv_id, depth, n_convs, words, a, b, a_up, b_up): ``conv_id``,
    ``at`` (2 * depth for enter, 2 * depth + 1 for exit), ``next_conv``, ``next_at`` (null behind the last
    arc), the weights ``leaf`` and ``saved``, and ``parent`` (its conv_id, in exit arcs)."""
    name = ["a", "b", "level", "child", "conv_id"]
    tops = nodes.select("a", "b", F.col("depth").alias("level"), F.lit(0).cast("long").alias("child"), "conv_id",
                        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    kids = nodes.where("depth > 0").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"), (F.col("depth") - 1).alias("level"),
                                           F.lit(1).cast("long").alias("child"), "conv_id", F.lit(0).cast("long").alias("saved"))
    family = in_order(tops.union(kids), "level", "a", "b", "child", "conv_id")

    def summary(batches):
        first = top = part = None
        for batch in batches:
            if batch.num_rows and first is None:
                first, part = [int(ints(batch, c)[0]) for c in name], int(ints(batch, "part")[0])
            heads = ints(batch, "conv_id")[ints(batch, "child") == 0]
            top = int(heads[-1]) if len(heads) else top
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (part, *first, top)], names=["part", *name, "top"])

    rows = sorted(family.select("part", *name).mapInArrow(summary, ", ".join(f"{c} long" for c in ["part", *name, "top"])).collect())
    before, after, top = {}, {}, None
    for i, r in enumerate(rows):
        before[r.part], after[r.part] = top, list(rows[i + 1][1:6]) if i + 1 < len(rows) else None
        top = r.top if r.top is not None else top
    made = ["conv_id", "at", "next_conv", "next_at", "leaf", "saved", "parent"]

    def arcs(batches):
        behind, top, following = None, None, None

        def finish(batch, nxt):
            nonlocal top
            a, b, level, child, conv = (ints(batch, c) for c in name)
            nxt = nxt or [0, 0, -1, 0, 0]
            na, nb, nl, nc = (np.append(x[1:], y) for x, y in zip((a, b, level, conv), (nxt[0], nxt[1], nxt[2], nxt[4]), strict=True))
            same = (na == a) & (nb == b) & (nl == level)
            # the conversation of the node each row belongs to: the last node row so far
            seen = np.maximum.accumulate(np.where(child == 0, np.arange(len(a)), -1))
            parent = np.where(seen >= 0, conv[seen], top if top is not None else 0)
            top = int(parent[-1])
            is_top = child == 0
            at = np.where(is_top, 2 * level, 2 * level + 3)
            to = np.where(same, nc, np.where(is_top, conv, parent))
            to_at = np.where(same, 2 * level + 2, 2 * level + 1)
            leaf = (is_top & ~same).astype(np.int64)
            columns = [pa.array(x, pa.int64()) for x in (conv, at, to, to_at, leaf, ints(batch, "saved"))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(parent, pa.int64(), mask=is_top)], names=made)

        for batch in batches:
            if not batch.num_rows:
                continue
            if behind is None:
                part = int(ints(batch, "part")[0])
                top, following = before[part], after[part]
            else:
                yield finish(behind, [int(ints(batch, c)[0]) for c in name])
            behind = batch
        if behind is not None:
            yield finish(behind, following)

    null = F.lit(None).cast("long")
    end = nodes.where("depth = 0").select("conv_id", F.lit(1).cast("long").alias("at"), null.alias("next_conv"), null.alias("next_at"),
                                          F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"), null.alias("parent"))
    return family.mapInArrow(arcs, ", ".join(f"{c} long" for c in made)).union(end)


def _chains(weights: tuple[str, ...]):
    """Within a partition: each arc's sums to the end of its local chain and the arc behind that end."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        conv, at = (np.asarray(table.column(c), np.int64) for c in ("conv_id", "at"))
        to, to_at = (np.asarray(table.column(c).fill_null(-1), np.int64) for c in ("next_conv", "next_at"))
        names = np.unique(conv)
        span = int(max(at.max(), to_at.max())) + 2
        key = np.searchsorted(names, conv) * span + at  # ascending, as the rows are sorted
        place = np.minimum(np.searchsorted(names, to), len(names) - 1)
        want = np.where((names[place] == to) & (to_at >= 0), place * span + to_at, -1)
        found = np.minimum(np.searchsorted(key, want), len(key) - 1)
        step = np.where(key[found] == want, found, -1)
        head = np.ones(len(key), bool)
        head[step[step >= 0]] = False
        sums = [np.ones(len(key), np.int64), *[np.asarray(table.column(w), np.int64).copy() for w in weights]]
        end, jump = np.where(step < 0, np.arange(len(key)), step), step.copy()
        while (jump >= 0).any():
            live = np.flatnonzero(jump >= 0)
            goal = jump[live]
            for s in sums:
                s[live] += s[goal].copy()
            jump[live] = jump[goal].copy()
        while (end[end] != end).any():
            end = end[end]
        gone = to_at[end] < 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv), pa.array(at), pa.array(to[end], mask=gone), pa.array(to_at[end], mask=gone), pa.array(head), *map(pa.array, sums)],
            names=["conv_id", "at", "to_conv", "to_at", "head", "ones", *weights])

    return run


def ranked(arcs: DataFrame, weights: tuple[str, ...] = ("leaf", "saved")) -> DataFrame:
    """List ranking of ``arcs`` (conv_id, at, next_conv, next_at, weights): ``conv_id``, ``at``, ``ones`` (the
    number of arcs from here to the end, so the place in the tour counted from its end) and each
    weight's sum from here to the end."""
    sums = ["ones", *weights]
    order = ["conv_id", "at"]
    dealt = arcs.select(*order, "next_conv", "next_at", *weights)
    ddl = ", ".join(["conv_id long", "at long", "to_conv long", "to_at long", "head boolean", *[f"{s} long" for s in sums]])
    local = materialize(dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chains(weights), ddl))
    links = local.where("head").select(*order, "to_conv", "to_at", *sums)
    links = materialize(links)
    while links.where(F.col("to_conv").isNotNull()).limit(1).count():  # as many rounds as the logarithm of the links
        ahead = links.select(F.col("conv_id").alias("to_conv"), F.col("at").alias("to_at"), F.col("to_conv").alias("far_conv"),
                             F.col("to_at").alias("far_at"), *[F.col(s).alias(f"far_{s}") for s in sums])
        links = materialize(links.join(ahead, ["to_conv", "to_at"], "left").select(
            *order, F.col("far_conv").alias("to_conv"), F.col("far_at").alias("to_at"),
            *[(F.col(s) + F.coalesce(f"far_{s}", F.lit(0))).alias(s) for s in sums]))
    rest = links.select(F.col("conv_id").alias("to_conv"), F.col("at").alias("to_at"), *[F.col(s).alias(f"far_{s}") for s in sums])
    return (local.drop("head").join(rest, ["to_conv", "to_at"], "left")
            .select(*order, *[(F.col(s) + F.coalesce(f"far_{s}", F.lit(0))).alias(s) for s in sums]))


def _digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """``key`` with ``ends_sha256``: of its conversations' ids, ascending, comma-joined. Ids are joined to
    chunks where they are sorted; one task streams a node's chunks through the hash."""
    def chunks(batches):
        held, names, size, part = None, [], 0, 0

        def out():
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in held], pa.array([part], pa.int64()),
                                               pa.array([",".join(names)])], names=[*key, "chunk", "joined"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = int(ints(batch, "part")[0]) << 32
            for *k, conv in zip(*[ints(batch, c).tolist() for c in [*key, "conv_id"]], strict=True):
                if names and (k != held or size >= CHUNK):
                    yield out()
                    names, size, part = [], 0, part + 1
                held = k
                part = max(part, own)
                names.append(str(conv))
                size += len(names[-1]) + 1
        if names:
            yield out()

    def hashes(batches):
        held, state = None, None

        def out():
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in held], pa.array([state.hexdigest()])],
                                              names=[*key, "ends_sha256"])

        for batch in batches:
            for *k, joined in zip(*[ints(batch, c).tolist() for c in key], batch.column("joined").to_pylist(), strict=True):
                if k == held:
                    state.update(b",")
                else:
                    if held is not None:
                        yield out()
                    held, state = k, hashlib.sha256()
                state.update(joined.encode())
        if held is not None:
            yield out()

    kinds = ", ".join(f"{c} long" for c in key)
    joined = in_order(ends.select(*key, "conv_id"), *key, "conv_id").mapInArrow(chunks, kinds + ", chunk long, joined string")
    return joined.repartition(*key).sortWithinPartitions(*key, "chunk").mapInArrow(hashes, kinds + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = 20, spread: int = 4) -> DataFrame:
    """The trie of the rebuilt ``conversations(conv_id, turn, role, text)``, one row per node: ``conv_id``
    (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``, and ``enter``, ``leave`` (places of its arcs in the tour, from 0).

    Turns are ordered by ``turn`` (null first; equal ones by the digest of role and text, so repeated
    rows are turns of their own); null role and text are empty; rows with a null conv_id take no
    part; other columns are ignored; an empty table has no node.
    """
    rows = members(rebuilt(conversations, block, spread))
    key = ["depth", "a", "b"]
    at = rows.withColumnsRenamed({"a_sum": "a", "b_sum": "b"})
    nodes = materialize(at.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
                                             F.max("a_before").alias("a_up"), F.max("b_before").alias("b_up")))
    arcs = materialize(tour(nodes))
    places = ranked(arcs)
    enter = F.col("at") % 2 == 0
    sign = F.when(enter, 1).otherwise(-1)
    n_arcs = 2 * nodes.count()
    spans = places.groupBy("conv_id", F.floor(F.col("at") / 2).alias("depth")).agg(
        F.sum(sign * F.col("leaf")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"),
        (F.lit(n_arcs) - F.max("ones")).alias("enter"), (F.lit(n_arcs) - F.min("ones")).alias("leave"))
    exits = arcs.where("parent is not null").select("conv_id", F.floor(F.col("at") / 2).alias("depth"), F.col("parent").alias("parent_conv_id"))
    kids = exits.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = _digests(at.where("last"), key)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return (nodes.join(ends, key, "left").join(spans, ["conv_id", "depth"]).join(exits, ["conv_id", "depth"], "left")
            .join(kids, ["conv_id", "depth"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"), "enter", "leave"))
