"""Sums of the partial vectors of many tasks, on the executors.

A pass over the data leaves one row a task and key. Up to FAN tasks, these rows go to the driver as they are.
Long ones of as few tasks are added in one level. Beyond, they are added in two levels: FAN groups of tasks first, then the groups, so that one row a key comes
back and the scan keeps all its tasks. All levels stream over sorted rows and hold one vector a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial vectors of one key that are added by one task, or that the driver takes without help.
FAN = 64
#: Numbers of all keys of a task up to which the driver takes up to FAN tasks without help.
FEW = 1 << 12
#: Numbers of all keys of a task for each task that adds them.
LONG = 1 << 16


def task_number() -> int:
    """The partition that the calling task works on: the value of the column `part` of its partial sums."""
    context = TaskContext.get()
    return context.partitionId() if context else 0


def tasks_of(df: DataFrame) -> int:
    """Partitions of a table that is cached or written: how many partial sums a pass over it makes."""
    return df.rdd.getNumPartitions()


def _added(batches: Iterator[pa.RecordBatch], keys: Sequence[str], sums: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys, its arrays added; integers wrap modulo 2^64."""
    held, totals, schema = None, [], None

    def told() -> pa.RecordBatch:
        own = [pa.array([v], schema.field(c).type) for c, v in zip(keys, held, strict=True)]
        return pa.RecordBatch.from_arrays([*own, *(pa.array([t], schema.field(c).type) for c, t in zip(sums, totals, strict=True))], [*keys, *sums])

    for batch in batches:
        schema = batch.schema
        names = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True)) if keys else [()] * batch.num_rows
        for i, name in enumerate(names):
            own = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in sums]
            if held is None or name != held:
                if held is not None:
                    yield told()
                held, totals = name, [x.copy() for x in own]
            else:
                with np.errstate(over="ignore"):
                    for t, x in zip(totals, own, strict=True):
                        t += x
    if held is not None:
        yield told()


def added(partials: DataFrame, keys: Sequence[str], sums: Sequence[str], tasks: int, width: int = 0) -> DataFrame:
    """One row for each value of the keys, with the arrays named by sums added element by element.

    partials has the keys, `part` (the number of the task) and the arrays. With up to FAN tasks it comes back as
    it is, without part, and the caller adds the few rows of a key. Where a task sends more than FEW numbers (width),
    two tasks are enough to be added here, up to FAN tasks in one level. The order of addition is fixed, so reruns agree.
    """
    keys, sums = list(keys), list(sums)
    if tasks <= (FAN if width <= FEW else 1):
        return partials.select(*keys, *sums)
    if tasks <= FAN:
        met = partials.repartition(min(FAN, 1 + width // LONG), *keys) if keys else partials.repartition(1)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in partials.select(*keys, *sums).schema.fields)
        return met.sortWithinPartitions(*keys, "part").select(*keys, *sums).mapInArrow(lambda it: _added(it, keys, sums), schema)
    fields = {f.name: f.dataType.simpleString() for f in partials.schema.fields}
    schema = lambda names: ", ".join(f"`{c}` {fields[c]}" for c in names)
    first = partials.withColumn("slot", F.pmod("part", F.lit(FAN)).cast("int")).repartition(FAN, "slot").sortWithinPartitions(*keys, "slot", "part")
    fields["slot"] = "int"
    halfway = first.select(*keys, "slot", *sums).mapInArrow(lambda it: _added(it, [*keys, "slot"], sums), schema([*keys, "slot", *sums]))
    dealt = halfway.repartition(FAN, *keys) if keys else halfway.coalesce(1)
    last = dealt.sortWithinPartitions(*keys, "slot")
    return last.select(*keys, *sums).mapInArrow(lambda it: _added(it, keys, sums), schema([*keys, *sums]))


def collected(partials: DataFrame, keys: Sequence[str], sums: Sequence[str], tasks: int, width: int = 0) -> dict[tuple, list[np.ndarray]]:
    """The sums of every key on the driver, in the order of sums."""
    out: dict[tuple, list[np.ndarray]] = {}
    rows = added(partials, keys, sums, tasks, width).toArrow()
    names = list(zip(*(rows.column(c).to_pylist() for c in keys), strict=True)) if keys else [()] * rows.num_rows
    columns = [rows.column(c) for c in sums]
    for i, name in enumerate(names):
        own = [c[i].values.to_numpy(zero_copy_only=False) for c in columns]
        if name not in out:
            out[name] = [x.copy() for x in own]
        else:
            with np.errstate(over="ignore"):
                for t, x in zip(out[name], own, strict=True):
                    t += x
    return out


def _folded(batches: Iterator[pa.RecordBatch], column: str, fold: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each slot: its arrays folded one after the other."""
    held, total = None, None
    told = lambda: pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["slot", column])
    for batch in batches:
        for i, slot in enumerate(batch.column("slot").to_pylist()):
            own = batch.column(column)[i].values.to_numpy(zero_copy_only=False)
            if slot != held:
                if held is not None:
                    yield told()
                held, total = slot, own.copy()
            else:
                total = fold(total, own)
    if held is not None:
        yield told()


def folded(partials: DataFrame, column: str, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], tasks: int) -> np.ndarray | None:
    """What a fold that may be grouped at will makes of one array a task (part, column): beyond FAN tasks, groups of them are folded on the executors first."""
    rows = partials.select(F.col("part").alias("slot"), column)
    if tasks > FAN:
        dealt = partials.select("part", F.pmod("part", F.lit(FAN)).cast("int").alias("slot"), column).repartition(FAN, "slot").sortWithinPartitions("slot", "part")
        rows = dealt.select("slot", column).mapInArrow(lambda it: _folded(it, column, fold), f"slot int, `{column}` array<double>")
    total = None
    for _, own in sorted((r["slot"], r[column]) for r in rows.collect()):
        total = np.array(own) if total is None else fold(total, np.array(own))
    return total
