"""Exact splits, folds, shuffles and under-sampling.

Spark rows have no order, so every operator here orders by a stated key. A rank takes one range
exchange: each task sorts its range and numbers its rows, the table is written, and the counts of the
ranges (one number each) are added on. No task sorts a whole table, whatever the types of the keys; rows
of equal keys are dealt by a hash of the whole row. Null keys come first and count like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Bits of monotonically_increasing_id that number the rows of one partition.
_ROW_BITS = 33


def shuffle_key(row_id: str, seed: int = 0) -> Column:
    """A pseudo-random key that any SQL engine can make again; a null id counts as an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))))


def value_rank(df: DataFrame, order: list[str], name: str = "row_rank") -> DataFrame:
    """df with the place (from 0) of each row in ascending order of the columns, nulls first; ties by a hash of the row."""
    keys = [F.col(f"`{c}`") for c in order]
    whole = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields))
    ranged = df.withColumn("__tie", whole).repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")
    placed = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", _ROW_BITS).cast("int")
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0]
    for i in range(max(counts, default=-1) + 1):
        starts.append(starts[-1] + counts.get(i, 0))
    inside = F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn(name, F.element_at(F.lit(starts).cast("array<bigint>"), part + 1) + inside).drop("__at")


def shuffle_rank(df: DataFrame, row_id: str, seed: int = 0, name: str = "shuffle_rank") -> DataFrame:
    """df with the place (from 0) of each row in a seeded shuffle; ties by row_id."""
    return value_rank(df.withColumn("__shuffle", shuffle_key(row_id, seed)), ["__shuffle", row_id], name).drop("__shuffle")


def pass_ranks(df: DataFrame, row_id: str, turns: int, seed: int = 0, turn: str = "turn", name: str = "place") -> DataFrame:
    """df once for each turn (from 0), with the place of each row in the shuffle of seed * 1000 + turn; ties by row_id, then by the whole row."""
    copies = df.withColumn(turn, F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    key = F.md5(F.concat((F.lit(seed * 1000) + F.col(turn)).cast("string"), F.lit(":"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))))
    ranked = value_rank(copies.withColumn("__shuffle", key), [turn, "__shuffle", row_id], name).drop("__shuffle")
    # Every turn has as many rows as df.
    return ranked.withColumn(name, F.col(name) - F.col(turn) * F.lit(df.count()))


def train_test_split(df: DataFrame, row_id: str, test_fraction: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; the test part has exactly ceil(test_fraction * n) rows, the first of the shuffle. Null ids take part."""
    ranked = shuffle_rank(df, row_id, seed)
    cut = math.ceil(test_fraction * ranked.count() - 1e-9)
    return ranked.where(F.col("shuffle_rank") >= cut).drop("shuffle_rank"), ranked.where(F.col("shuffle_rank") < cut).drop("shuffle_rank")


def index_split(df: DataFrame, row_id: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is listed in the one column of rows, and the others."""
    ids = rows.toDF(row_id)
    return df.join(ids, row_id, "left_semi"), df.join(ids, row_id, "left_anti")


def contiguous_folds(df: DataFrame, order: list[str], k: int, name: str = "fold") -> DataFrame:
    """df with its fold: fold i has the places from n*i div k up to n*(i+1) div k."""
    ranked = value_rank(df, order, "__place")
    n = ranked.count()
    # The greatest i with n*i div k <= place.
    return ranked.withColumn(name, F.expr(f"cast(((__place + 1) * {k} - 1) div {max(n, 1)} as int)")).drop("__place")


def balanced(df: DataFrame, row_id: str, label: str, keep_all, seed: int = 1) -> DataFrame:
    """All rows of the class keep_all, and as many of the others, the first of a seeded shuffle."""
    least = df.where(F.col(label) == keep_all)
    others = shuffle_rank(df.where(F.col(label) != keep_all), row_id, seed, "__place")
    return least.unionByName(others.where(F.col("__place") < least.count()).drop("__place"))
