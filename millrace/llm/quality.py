"""Quality rules: rule statistics of each text, and an isolation forest over them.

The statistics are shares between 0 and 1. Trees split that unit box at random over a bounded sample
of rows that are labelled good; a text that few splits part from all of those is anomalous, also where
no good row has ever been. (Cuts between the ends of a node's own rows, as isolation forests of mixed
rows have them, never fall where good rows do not reach: on the labelled rows at hand they told under 5 % of
the bad from the good where the unit box tells 96 %.)

The labelled rows are dealt into two parts by a hash of their id: the forest grows on the good rows of
one, and the score from which a text is rejected is calibrated on the other, with both labels: of the
cuts above which no more than a stated share of the good rows lies, the one that rejects most bad rows,
and of such cuts the greatest.

Defined results: a null or blank text has no words, so all statistics are 0 and it fails the base
rules. Repeated rows get the same verdict each. A labelled id that several rows have counts for each of
their distinct statistics once. Without rows labelled good the forest is empty and only the base rules
decide. A very long text is counted in pieces: it takes about twice its size and 40 bytes a word of
memory. Other columns of the input are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import OpenSpan, distinct, row_blocks, span_hashes, text_bytes, window_hashes, word_hashes, word_spans

#: The symbols of the base rules.
_SYMBOLS = b"#*$%&|<>"

WIDTH = 5
#: Bound of the labelled sample that the forest and its threshold are fitted on.
LABELLED_ROWS = 20000
TREES, TREE_ROWS, DEPTH, SEED = 100, 256, 10, 7
#: Share of rows labelled good that may lie above the threshold.
GOOD_LOSS = 0.005

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_alpha", "n_marks")
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share")

_BIT = {name: i for i, name in enumerate(("symbol", "upper", "alpha", "mark"))}
_CLASS = np.zeros(256, np.uint8)
for _name, _chars in (("symbol", _SYMBOLS), ("upper", bytes(range(65, 91))), ("alpha", bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))), ("mark", b"!?")):
    _CLASS[list(_chars)] |= 1 << _BIT[_name]
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _block_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """COUNTS of each row."""
    n = len(offs) - 1
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(data):
        return out
    starts, ends, words = word_spans(data, offs)
    per = lambda running: np.diff(running[offs])
    kinds = _CLASS[data]
    share = lambda name: per(_running(kinds >> _BIT[name] & 1))
    points = _running(~_CONTINUES[data])
    out[:, 0] = np.diff(words)
    lengths = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(points[ends] - points[starts], out=lengths[1:])
    out[:, 1] = np.diff(lengths[words])
    out[:, 2], out[:, 6], out[:, 7], out[:, 8] = (share(x) for x in ("symbol", "upper", "alpha", "mark"))
    windows = window_hashes(span_hashes(data, starts, ends), WIDTH)
    for i in np.flatnonzero(out[:, 0] > WIDTH).tolist():
        out[i, 4] = _repeated_words(windows[words[i] : words[i + 1] - WIDTH + 1])
    # Lines begin where rows do and after breaks, and end at breaks and where rows do; in order, starts and ends pair up.
    breaks = np.flatnonzero(data == 10)
    first, last = np.sort(np.concatenate((offs[:-1], breaks + 1))), np.sort(np.concatenate((breaks, offs[1:])))
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, offs)) + 1)
    full = np.searchsorted(starts, first) < np.searchsorted(starts, last)
    row, lines = row[full], span_hashes(data, first[full], last[full])
    order = np.lexsort((lines, row))
    again = (row[order][1:] == row[order][:-1]) & (lines[order][1:] == lines[order][:-1])
    out[:, 5], out[:, 3] = np.bincount(row, minlength=n), np.bincount(row[order][1:][again], minlength=n)
    return out


def _long_counts(data: np.ndarray) -> np.ndarray:
    """COUNTS of one very long text: sums over pieces, hashes of words and lines that may run over several."""
    out = np.zeros(len(COUNTS), np.int64)
    lines, spans, worded = [], OpenSpan(), False
    for at in range(0, len(data), common.BLOCK_BYTES):
        piece = data[at : at + common.BLOCK_BYTES]
        last = at + len(piece) == len(data)
        kinds = _CLASS[piece]
        for i, name in ((2, "symbol"), (6, "upper"), (7, "alpha"), (8, "mark")):
            out[i] += np.count_nonzero(kinds & (1 << _BIT[name]))
        out[1] += np.count_nonzero(~_CONTINUES[piece] & ~common.SPACE[piece])
        breaks = np.flatnonzero(piece == 10)
        first, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(piece)]))
        inked = np.concatenate(([0], np.cumsum(~common.SPACE[piece])))
        full = inked[ends] > inked[first]
        full[0] |= worded
        made = spans.feed(piece, first, ends, True, not last)
        worded = bool(full[-1])
        lines.append(made[full[: len(made)]])
    hashes, seen = word_hashes(data), np.concatenate(lines)
    out[0] = len(hashes)
    if len(hashes) > WIDTH:
        out[4] = _repeated_words(window_hashes(hashes, WIDTH))
    out[5], out[3] = len(seen), len(seen) - len(np.unique(seen))
    return out


def _counts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row ranges [i, j) and their COUNTS."""
    for i, j in row_blocks(offs):
        part = data[offs[i] : offs[j]]
        long = j == i + 1 and len(part) > common.BLOCK_BYTES
        yield i, j, _long_counts(part)[None] if long else _block_counts(part, offs[i : j + 1] - offs[i])


def _repeated_words(windows: np.ndarray) -> int:
    """Words that lie in a window which the text has twice or more."""
    ordered = np.sort(windows)
    twice = distinct(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(twice):
        return 0
    covered, end = 0, 0
    for i in range(0, len(windows), 1 << 16):
        part = windows[i : i + (1 << 16)]
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, part), len(twice) - 1)] == part) + i
        if len(at):
            # Each window covers WIDTH words from its place on, less those that the one before it covers.
            covered += int(np.minimum(np.diff(at, prepend=end - WIDTH), WIDTH).sum())
            end = int(at[-1]) + WIDTH
    return covered


def _features(c: np.ndarray) -> np.ndarray:
    """FEATURES of each row of COUNTS, all in [0, 1]."""
    c = c.astype(float)
    part = lambda a, b: np.minimum(c[:, a] / np.maximum(c[:, b], 1), 1)
    return np.stack([part(2, 0), part(3, 5), part(4, 0), part(6, 7), part(8, 0)], axis=1)


def _count_batches(batches: Iterator[pa.RecordBatch], names: list[str], model: str | None) -> Iterator[pa.RecordBatch]:
    forest = json.loads(model) if model is not None else None
    for batch in batches:
        for i, j, counts in _counts(*text_bytes(batch.column("text"))):
            kept = [batch.column(k).slice(i, j - i) for k in names]
            score = [] if forest is None else [pa.array(anomaly(forest, _features(counts)))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in counts.T), *score], [*names, *COUNTS, *(["anomaly"] if score else [])])


def rule_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), forest: dict | None = None) -> DataFrame:
    """The columns named in keep, COUNTS (long) of each row's whole text and, with a forest, its anomaly: one pass without a shuffle."""
    names, model = list(keep), None if forest is None else json.dumps(forest)
    source = docs.select(*names, F.col("text").cast("string").alias("text")) if "text" not in names else docs.select(*names)
    fields = {f.name: f.dataType for f in source.schema.fields}
    schema = ", ".join([*(f"`{k}` {fields[k].simpleString()}" for k in names), *(f"{k} bigint" for k in COUNTS), *(["anomaly double"] if forest is not None else [])])
    return source.mapInArrow(lambda it: _count_batches(it, names, model), schema)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


# ---------------------------------------------------------------- the forest

def _harmonic(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = SEED) -> dict:
    """A forest over the unit box as flat arrays: feature (-1 at a leaf), cut, left child (right is next), value of leaves.

    A cut is uniform over its node's box, not over the rows in it, so empty parts of the box end early.
    """
    rng, out = np.random.Generator(np.random.PCG64(seed)), []
    for _ in range(trees if len(rows) else 0):
        picked = rows[rng.choice(len(rows), min(tree_rows, len(rows)), replace=False)]
        tree = {"feature": [-1], "cut": [0.0], "left": [0], "value": [0.0]}
        work = [(0, picked, np.zeros(rows.shape[1]), np.ones(rows.shape[1]), 0)]
        while work:
            node, part, lo, hi, level = work.pop()
            if level >= depth or len(part) <= 1:
                tree["value"][node] = level + _harmonic(len(part))
                continue
            f = int(rng.integers(rows.shape[1]))
            at = float(rng.uniform(lo[f], hi[f]))
            tree["feature"][node], tree["cut"][node], tree["left"][node] = f, at, len(tree["feature"])
            for below in (True, False):
                low, high = lo.copy(), hi.copy()
                (high if below else low)[f] = at
                work.append((len(tree["feature"]), part[(part[:, f] < at) == below], low, high, level + 1))
                for name, empty in (("feature", -1), ("cut", 0.0), ("left", 0), ("value", 0.0)):
                    tree[name].append(empty)
        out.append(tree)
    return {"trees": out, "norm": _harmonic(min(tree_rows, len(rows))) or 1.0}


def anomaly(forest: dict, x: np.ndarray) -> np.ndarray:
    """2^(-mean path length / expected length): near 1 for rows that few splits isolate."""
    if not forest["trees"]:
        return np.zeros(len(x))
    total = np.zeros(len(x))
    for t in forest["trees"]:
        feature, cut, left, value = (np.asarray(t[k]) for k in ("feature", "cut", "left", "value"))
        node = np.zeros(len(x), np.int64)
        live = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(live):
            at = node[live]
            node[live] = left[at] + (x[live, feature[at]] >= cut[at])
            live = live[feature[node[live]] >= 0]
        total += value[node]
    return np.exp2(-total / len(forest["trees"]) / forest["norm"])


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, good_loss: float = GOOD_LOSS) -> dict:
    """Grow the forest on one part of the labelled rows and place its threshold on the other.

    At most labelled_rows labels are used, the smallest by a hash of doc_id, so reruns agree; the
    bound is what the driver holds (five statistics a row) and what is broadcast (an id and a label a
    row). Rows of one id and equal statistics come as one; more than twice the bound of rows with
    distinct ones are cut by the same hash. Scoring covers every row.
    """
    tagged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    ids = tagged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    part = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(2)).cast("int").alias("part")
    known = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "quality", part, "text")
    distinct = rule_counts(known, keep=("doc_id", "quality", "part")).where(~base_failed()).distinct()
    rows = distinct.orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(2 * labelled_rows).toPandas()
    x, quality, grown = _features(rows[list(COUNTS)].to_numpy(np.int64)), rows["quality"].to_numpy(), rows["part"].to_numpy() == 0
    if not ((quality == 1) & grown).any() or not ((quality == 1) & ~grown).any():
        grown = np.ones(len(rows), bool)
    forest, held = grow(x[(quality == 1) & grown]), ~grown if not grown.all() else grown
    return {"forest": forest, "threshold": threshold(anomaly(forest, x[held]), quality[held], good_loss)}


def threshold(score: np.ndarray, quality: np.ndarray, good_loss: float = GOOD_LOSS) -> float:
    """The cut above which most bad rows and at most good_loss of the good ones lie, the greatest of equals; 2 (rejects none) without good rows."""
    good, bad = np.sort(score[quality == 1]), np.sort(score[quality != 1])
    if not len(good):
        return 2.0
    least = good[len(good) - 1 - int(good_loss * len(good))]
    caught = bad[bad > least]
    # Halfway between the last bad row that the least cut catches and the good row next below it.
    return float((caught[0] + max(least, good[good < caught[0]].max(initial=least))) / 2) if len(caught) else float(max(least, good[-1]))


def judge(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, COUNTS, base_failed, anomaly (0 to 1) and kept of each row, in one pass; nothing is shuffled."""
    scored = rule_counts(docs, keep, model["forest"])
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(model["threshold"])))
