"""Running values over a globally sorted table, whatever the size of its groups.

The table is dealt by ranges of its whole sort key, so a hot group is spread over many partitions.
A running value needs what stands before each partition: one small row per partition goes to the
driver (as many rows as there are partitions, never data), is added up there in order and handed
back to a second pass. Nothing of a group's size meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navbuckets.llm.common import extended, materialize


def in_order(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` sorted by ``keys`` over all partitions and written, with ``part``, the partition.
    The keys must tell rows apart unless equal rows may change places."""
    return materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))


def ints(batch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).cast(pa.int64()).fill_null(0), dtype=np.int64)


def _starts(group: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.append(True, group[1:] != group[:-1]))


def _runs(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums (wrapping) that begin anew at each start."""
    total = np.cumsum(sums)
    before = (total - sums)[starts]
    return total - np.repeat(before, np.diff(np.append(starts, len(sums))))


def running(df: DataFrame, group: str, add: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (from ``in_order``, or mapped from it row by row) with ``nth``, the place in the
    ``group`` (a long, sorted; from 0), ``last`` (of its group), and for each column x of ``add`` (longs)
    the running sums ``x_sum`` and, without the row itself, ``x_before``. Sums wrap at 64 bits."""
    def summary(batches):
        first = last = part = None
        tail = np.zeros(1 + len(add), np.int64)  # rows and sums of the last group in this partition
        for batch in batches:
            if not batch.num_rows:
                continue
            g = ints(batch, group)
            if first is None:
                first, last, part = int(g[0]), int(g[0]), int(ints(batch, "part")[0])
            if g[-1] != last:
                tail[:] = 0
                last = int(g[-1])
            from_ = int(np.searchsorted(g, last, side="left"))
            tail += [len(g) - from_, *[ints(batch, x)[from_:].sum() for x in add]]
        if first is not None:
            names = ["part", "first", "last", *[f"t{i}" for i in range(len(tail))]]
            yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in (part, first, last, *tail)], names=names)

    ddl = ", ".join(["part long", "first long", "last long", *[f"t{i} long" for i in range(1 + len(add))]])
    rows = sorted(df.select("part", group, *add).mapInArrow(summary, ddl).collect())
    carry: dict[int, tuple[list[int], int | None]] = {}
    held, held_group = np.zeros(1 + len(add), np.int64), None
    for i, r in enumerate(rows):
        if held_group != r.first:
            held, held_group = np.zeros(1 + len(add), np.int64), r.first
        carry[r.part] = (held.tolist(), rows[i + 1].first if i + 1 < len(rows) else None)
        held = np.array(r[3:], np.int64) + (held if r.first == r.last else 0)
        held_group = r.last

    def values(batches):
        state, behind, after = None, None, None

        def finish(batch, following):
            nonlocal state
            g = ints(batch, group)
            starts = _starts(g)
            sums = [np.ones(len(g), np.int64), *[ints(batch, x) for x in add]]
            out = []
            first_end = starts[1] if len(starts) > 1 else len(g)
            same = state[0] is None or state[0] == g[0]
            after_ = []
            for k, own in enumerate(sums):
                run = _runs(own, starts)
                if same:
                    run[:first_end] += state[1][k]
                out.append((run, run - own))
                after_.append(run[-1])
            state = (g[-1], np.array(after_, np.int64))
            last = np.append(g[1:] != g[:-1], following is None or following != g[-1])
            new = [pa.array(out[0][1]), pa.array(last)]
            for run, before in out[1:]:
                new += [pa.array(run), pa.array(before)]
            return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *made])

        for batch in batches:
            if not batch.num_rows:
                continue
            if behind is None:
                start, after = carry[int(ints(batch, "part")[0])]
                state = (None, np.array(start, np.int64))
            else:
                yield finish(behind, int(ints(batch, group)[0]))
            behind = batch
        if behind is not None:
            yield finish(behind, after)

    kinds = {"nth": "bigint", "last": "boolean"}
    for x in add:
        kinds |= {f"{x}_sum": "bigint", f"{x}_before": "bigint"}
    made = list(kinds)
    return df.mapInArrow(values, extended(df, **kinds))
