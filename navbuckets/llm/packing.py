"""13. Packing by first-fit decreasing over a tournament tree of bin capacities.

Documents are shuffled into random groups. A group's documents are encoded, an end token is
added, and each is cut into full sequences and a remainder. The remainders are placed longest
first, each into the first bin with room for it; a tournament tree, whose nodes hold the largest
capacity below them, finds that bin in one descent. What first-fit leaves open is closed by
cutting: the emptiest bins are dissolved into the gaps of the fullest. At most one bin of a
group is then neither full nor empty; it is dealt into sequences whose lengths are powers of two,
which need no padding. So no sequence is padded, and a group adds few short ones.

One shuffle moves the texts; encoding, packing and the pieces' ids stay in one task per group.
A group is bounded in documents and tokens (one longer document is a group by itself), so a
task's memory is that bound. Rows are dealt by their position in the input, never by an id, so a
repeated id is no hot group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navbuckets.llm.common import extended
from navbuckets.llm.textkernel import pieces
from navbuckets.llm.units import WordCoder, library_coder

#: bounds of a group: documents and tokens
GROUP_DOCS = 4096
GROUP_TOKENS = 1 << 22
#: ids of a group's pieces are handed on in batches of about so many tokens
OUT_TOKENS = 1 << 20


class Bins:
    """Bins of one size in a row, as the leaves of a tournament tree of their capacities."""

    def __init__(self, count: int, size: int):
        self.leaves = 1 << max(0, count - 1).bit_length()
        self.best = [size] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """The first bin with room for ``need``, which it takes."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < need:
                at += 1
        bin_ = at - self.leaves
        best[at] -= need
        while at > 1:
            at //= 2
            top = max(best[2 * at], best[2 * at + 1])
            if best[at] == top:
                break
            best[at] = top
        return bin_


def first_fit(sizes: list[int], size: int) -> list[int]:
    """The bin of each size (all at most ``size``), first-fit in decreasing order (equal: as given)."""
    bins, out = Bins(len(sizes), size), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.place(sizes[i])
    return out


def pack(tokens: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) of one group's documents of ``tokens`` ids."""
    full = [[(d, s, size)] for d, n in enumerate(tokens) for s in range(0, n - size + 1, size)]
    rest = [(d, n - n % size, n % size) for d, n in enumerate(tokens) if n % size]
    if not rest:
        return full
    where = first_fit([n for _, _, n in rest], size)
    bins: list[list] = [[] for _ in range(max(where) + 1)]
    for piece, b in zip(rest, where, strict=True):
        bins[b].append(piece)
    room = [size - sum(n for _, _, n in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (room[b], b))
    i, j = 0, len(order) - 1
    while i < j:  # the emptiest bin is dissolved into the fullest open one
        to, of = order[i], order[j]
        if not room[to]:
            i += 1
            continue
        if not bins[of]:
            j -= 1
            continue
        d, s, n = bins[of].pop()
        moved = min(n, room[to])
        bins[to].append((d, s, moved))
        room[to] -= moved
        room[of] += moved
        if moved < n:
            bins[of].append((d, s + moved, n - moved))
    out = full + [b for b in bins if b and sum(n for _, _, n in b) == size]
    for b in bins:
        left = sum(n for _, _, n in b)
        if 0 < left < size:
            out += _powers(b, left)
    return out


def _powers(pieces_: list, total: int) -> Iterator[list]:
    """One open bin as sequences whose lengths are powers of two, longest first."""
    queue = pieces_[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        want, taken = total & (1 << bit), []
        while want:
            d, s, n = queue.pop()
            k = min(n, want)
            taken.append((d, s, k))
            want -= k
            if k < n:
                queue.append((d, s + k, n - k))
        if taken:
            yield taken


_CODERS: dict[str, WordCoder] = {}


def _coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = library_coder(path)
    return _CODERS[path]


def packed(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, keep: list[str] | None = None,
           group_docs: int = GROUP_DOCS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``docs`` packed into sequences of at most ``size`` tokens: one row per piece.

    The columns ``keep`` (all) of the piece's document, ``start`` (ids of the document before the
    piece), ``length``, ``ids`` (binary: little-endian unsigned 32-bit), ``doc_tokens`` (with the end
    token), ``sequence_id`` and ``offset`` (in the sequence, gapless from 0). Every id lies in exactly
    one piece. Sequences are full or have a power of two as their length. A null or empty text is
    its end token alone; rows with a repeated or null id are documents of their own; a text of any
    length is packed whole; an empty table gives no rows; clashing columns of ``docs`` are left
    out. ``path`` must be readable on executors.
    """
    made = {"start": "bigint", "length": "bigint", "ids": "binary", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    keep = [c for c in keep or docs.columns if c not in made]
    end = np.array([end_id], "<u4").tobytes()

    def rows(held: list, coded: list[bytes], first: int) -> Iterator[pa.RecordBatch]:
        kept = pa.concat_batches(held)
        tokens = [len(x) // 4 for x in coded]
        out, waiting, sequence = [], 0, first
        for seq in pack(tokens, size):
            at = 0
            for d, s, n in seq:
                out.append((d, s, n, sequence, at))
                at += n
            sequence += 1
            waiting += at
            if waiting >= OUT_TOKENS:
                yield batch_of(kept, out, coded, tokens)
                out, waiting = [], 0
        if out:
            yield batch_of(kept, out, coded, tokens)

    def batch_of(kept, out, coded, tokens) -> pa.RecordBatch:
        d, s, n, q, at = (np.array(c, np.int64) for c in zip(*out, strict=True))
        ids = [coded[x][4 * y:4 * (y + z)] for x, y, z in zip(d.tolist(), s.tolist(), n.tolist(), strict=True)]
        part = kept.take(pa.array(d))
        return pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(s), pa.array(n), pa.array(ids, pa.binary()), pa.array(np.array(tokens)[d]), pa.array(q), pa.array(at)],
            names=[*keep, *made])

    def run(batches):
        code = _coder(path)
        sequence = TaskContext.get().partitionId() << 33
        held, coded, n = [], [], 0
        for batch in batches:
            for piece in pieces(batch):
                part = piece.select(keep) if keep else piece.select([])
                ids = code.encode([t or "" for t in piece.column("text").to_pylist()])
                held.append(part)
                coded += [x + end for x in ids]
                n += sum(len(x) for x in ids) // 4
                if len(coded) >= group_docs or n >= group_tokens:
                    for out in rows(held, coded, sequence):
                        yield out
                    sequence += 1 + sum(len(x) // 4 // size + 12 for x in coded)  # more than the group's sequences
                    held, coded, n = [], [], 0
        if coded:
            yield from rows(held, coded, sequence)

    source = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("__deal", F.xxhash64(F.monotonically_increasing_id()))
    dealt = source.repartition("__deal").sortWithinPartitions("__deal")
    return dealt.mapInArrow(run, extended(docs.select(*keep), **made))
