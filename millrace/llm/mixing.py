"""Mixing sources to target weights over a time-varying curriculum.

Each source has a target of words: its weight's share of the total, stopped at a multiple of its own
size, with the excess reshared among the others by weight. Inside a source the documents stand in a
fixed pseudo-random order, pass after pass, on an axis of cumulative words; the mix takes the axis up to
the target, so the last document of a pass may be taken in part. Each source's weight may vary over
training: its piecewise linear schedule is integrated, and the inverse of that integral turns the place
on the word axis into a training position between 0 and 1. Documents are range-sorted by position.

Prefix sums take two levels: hash ranges of a source are summed first, so no task holds a whole source.

Defined results: null text has size 0; documents of size 0 are never taken. The null source is a source
of its own, last in order. Rows of one id and different texts stand in order of their sizes and text hashes,
so reruns agree on each; rows that are equal in id, text and source share their places in either order. Rows
without an id stand by a hash of their text. An empty table gives no rows. Columns of the input other than
doc_id, text and source are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

#: Rows that a hash range of the prefix sums holds on average.
RANGE_ROWS = 4096
#: A word of the contract.
WORD = r"[^\x20\x09-\x0D]+"

Knots = Sequence[tuple[float, float]]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row for each source: source, rank (from 0), weight, source_size, target.

    Weights repeat over the sources in code-point order, null last. Filling is by level: a source is
    full when its cap over its weight lies below the level, and the level of those left is the maximum
    over all prefixes of full sources. The table is as long as there are sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    full = weighted.withColumn("__cap", F.lit(float(cap)) * F.col("source_size"))
    order = W.orderBy(F.col("__cap") / F.col("weight"), "rank")
    level = full.withColumns({
        "__before": F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "__left": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
        "__total": F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()),
    })
    level = level.withColumn("__level", F.max((F.col("__total") - F.col("__before")) / F.col("__left")).over(W.partitionBy()))
    return level.select("source", "rank", "weight", "source_size", F.least("__cap", F.col("weight") * F.col("__level")).alias("target"))


def segments(knots: Knots) -> list[tuple[float, float, float, float, float, float]]:
    """(start, length, weight at start, slope, share of the integral before, whole integral) of each piece."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        pieces.append((t0, t1 - t0, w0, (w1 - w0) / (t1 - t0), total))
        total += (w0 + w1) / 2 * (t1 - t0)
    return [(*p[:4], p[4] / total, total) for p in pieces]


def position(demand: Column, knots: Knots) -> Column:
    """Where the integrated schedule reaches the share demand (0 to 1) of its whole."""
    out = None
    for t0, _, w0, slope, before, total in reversed(segments(knots)):
        area = F.greatest(demand - F.lit(before), F.lit(0.0)) * F.lit(total)
        here = F.lit(t0) + F.lit(2.0) * area / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * area, F.lit(0.0))))
        out = here if out is None else F.when(demand >= F.lit(segments_end(knots, t0)), out).otherwise(here)
    return F.least(F.coalesce(out, F.lit(0.0)), F.lit(float(knots[-1][0])))


def segments_end(knots: Knots, start: float) -> float:
    """Share of the integral at the end of the piece that starts at start."""
    pieces = segments(knots)
    i = [p[0] for p in pieces].index(start)
    return pieces[i + 1][4] if i + 1 < len(pieces) else 1.0


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, schedules: Sequence[Knots] = (((0.0, 1.0), (1.0, 1.0)),), range_rows: int = RANGE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, keep, source, size, source_size, target, place (words before it in
    a pass), copies (words and position of each), taken (words of all copies), position (of the first).

    schedules repeat over the sources as weights do; each gives the shape of a source's weight over time.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order_key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text))))
    # The hashes are made here, where the text is at hand.
    sizes = stored(docs.select("doc_id", *keep, "source", word_count(F.col("text")).alias("size"), order_key.alias("__key"), F.xxhash64(text).alias("__tie")), "mix-sizes")
    rows = sizes.count()
    ranges = max(64, -(-rows // range_rows))
    keyed = sizes.withColumn("__range", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("bigint") * F.lit(ranges) / F.lit(float(1 << 32))))
    per_range = keyed.groupBy("source", "__range").agg(F.sum("size").alias("__size"))
    starts = per_range.select("source", "__range", F.coalesce(F.sum("__size").over(W.partitionBy("source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    goals = targets(sizes, weights, share, cap)
    bounds = starts.alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "__range", "__start", "rank", "source_size", "target")
    inside = W.partitionBy("source", "__range").orderBy("__key", "doc_id", "size", "__tie").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("p").join(bounds.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.__range") == F.col("b.__range")))
    joined = joined.select("p.doc_id", *(f"p.{c}" for c in keep), "p.source", "p.size", "b.rank", "b.source_size", "b.target", (F.col("b.__start") + F.col("p.__inside")).alias("place"))
    demand, whole = F.floor("target"), F.col("source_size")
    words = [F.greatest(F.least(demand - F.col("place") - F.lit(i) * whole, F.col("size")), F.lit(0)).cast("bigint") for i in range(int(-(-cap // 1)))]

    def where(i: int) -> Column:
        at = F.when(F.col("target") > 0, (F.col("place") + F.lit(i) * whole) / F.col("target")).otherwise(F.lit(1.0))
        out = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            out = F.when(F.col("rank") % len(schedules) == k, position(at, knots)).otherwise(out)
        return out

    copies = F.array(*(F.struct(n.alias("words"), where(i).alias("position")) for i, n in enumerate(words)))
    return joined.withColumns({"copies": copies, "taken": sum(words[1:], words[0]), "position": where(0)}).drop("rank")


def sorted_by_position(planned: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by training position, ties by doc_id."""
    return planned.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def tilted(tilt: float = 0.5) -> tuple[Knots, Knots]:
    """Two schedules of equal integral: one fades over training, one grows."""
    return ((0.0, 1 + tilt), (1.0, 1 - tilt)), ((0.0, 1 - tilt), (1.0, 1 + tilt))


