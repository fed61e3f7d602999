"""Greedy binary trees on 0/1 features by misclassification, weighted trees, pruning and boosting.

Rows carry their features as one array. A tree is three flat arrays (feature, left, right), so scoring
walks them inside one built-in expression whose size does not depend on the tree's. A level of the tree
is grown from one aggregation over all its nodes and features.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, in_tasks, stored
from .reduce import collected, task_number, tasks_of

#: Errors that differ by less count as equal.
_EQUAL = 12
#: Predictions of a leaf whose classes tie.
PLAIN_TIE, WEIGHTED_TIE = -1, 1


@dataclass
class Node:
    depth: int
    positive: float = 0.0
    negative: float = 0.0
    parent: int | None = None
    feature: int | None = None
    left: int | None = None
    right: int | None = None
    prediction: int | None = None

    @property
    def leaf(self) -> bool:
        return self.feature is None


@dataclass
class Tree:
    """nodes[0] is the root. Rows with feature value 0 go left, others right."""

    names: tuple[str, ...]
    nodes: list[Node] = field(default_factory=list)

    def reachable(self) -> list[int]:
        out, work = [], [0] if self.nodes else []
        while work:
            i = work.pop()
            out.append(i)
            if not self.nodes[i].leaf:
                work += [self.nodes[i].right, self.nodes[i].left]
        return out

    def count_nodes(self) -> int:
        return len(self.reachable())

    def count_leaves(self) -> int:
        return sum(self.nodes[i].leaf for i in self.reachable())

    def depth(self) -> int:
        return max((self.nodes[i].depth for i in self.reachable()), default=0)

    def node_of(self, x: Column, sparse: bool = False) -> Column:
        """The node where a row ends, by as many steps as the tree is deep. sparse: x lists the features that are set."""
        arrays = [F.lit([int(v if v is not None else -1) for v in vs]) for vs in zip(*((n.feature, n.left, n.right) for n in self.nodes), strict=True)]

        def step(node: Column, _: Column) -> Column:
            at = node + 1
            feature = F.element_at(arrays[0], at)
            unset = ~F.array_contains(x, feature) if sparse else F.element_at(x, F.greatest(feature + 1, F.lit(1))) == 0
            return F.when(feature < 0, node).when(unset, F.element_at(arrays[1], at)).otherwise(F.element_at(arrays[2], at))

        return F.aggregate(F.sequence(F.lit(0), F.lit(self.depth())), F.lit(0), step)

    def predict(self, x: Column, sparse: bool = False) -> Column:
        labels = F.lit([int(n.prediction if n.prediction is not None else 0) for n in self.nodes])
        return F.element_at(labels, self.node_of(x, sparse) + 1)

    def table(self, spark) -> DataFrame:
        paths = self.paths()
        rows = [(i, n.depth, paths[i], self.names[n.feature] if not n.leaf else None, n.left, n.right, n.prediction if n.leaf else None, n.positive + n.negative) for i, n in ((i, self.nodes[i]) for i in sorted(self.reachable()))]
        return spark.createDataFrame(rows, "node_id int, depth int, path string, feature string, left_id int, right_id int, prediction int, size double")

    def paths(self) -> dict[int, str]:
        """The turns from the root to each node that can be reached: 0 for left, 1 for right."""
        out = {0: ""}
        for i in self.reachable():
            if not self.nodes[i].leaf:
                out[self.nodes[i].left], out[self.nodes[i].right] = out[i] + "0", out[i] + "1"
        return out

    def trace(self, row: Sequence[int]) -> list[str]:
        """What is asked of one row on its way to a leaf."""
        out, i = [], 0
        while not self.nodes[i].leaf:
            n = self.nodes[i]
            out.append(f"split on {self.names[n.feature]} = {row[n.feature]}")
            i = n.left if row[n.feature] == 0 else n.right
        return [*out, f"leaf, predicting {self.nodes[i].prediction}"]

    def dot(self) -> str:
        lines = [f'{i} [label="{self.names[n.feature] if not n.leaf else n.prediction}"];' for i, n in ((i, self.nodes[i]) for i in self.reachable())]
        edges = [f"{i} -> {c};" for i in self.reachable() for c in (self.nodes[i].left, self.nodes[i].right) if c is not None]
        return "digraph tree {\n" + "\n".join([*lines, *edges]) + "\n}"


def mistakes(positive: Column, negative: Column) -> Column:
    """Of a node that predicts its majority."""
    return F.least(positive, negative)


def split_counts(df: DataFrame, x: str, y: str, features: Sequence[int], node: Column, weight: Column | None = None) -> list:
    """For each node: weight of +1 and -1 rows, and of those with each feature set."""
    w = weight if weight is not None else F.lit(1.0)
    up, down = F.when(F.col(y) == 1, w).otherwise(0.0), F.when(F.col(y) != 1, w).otherwise(0.0)
    on = lambda f, v: F.sum(F.when(F.col(x)[f] != 0, v).otherwise(0.0))
    made = [c for f in features for c in (on(f, up).alias(f"p{f}"), on(f, down).alias(f"n{f}"))]
    return df.where(F.col(y).isNotNull()).groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("rows"), F.sum(up).alias("p"), F.sum(down).alias("n"), *made).collect()


def best_split(counts, features: Sequence[int]) -> int | None:
    """Fewest mistakes; then the most even split; then the first feature."""
    best = None
    for f in features:
        p1, n1 = counts[f"p{f}"], counts[f"n{f}"]
        p0, n0 = counts["p"] - p1, counts["n"] - n1
        key = (round(min(p0, n0) + min(p1, n1), _EQUAL), abs((p0 + n0) - (p1 + n1)))
        if best is None or key < best[0]:
            best = key, f
    return best[1] if best else None


def _weighted_errors(counts, features: Sequence[int]) -> dict[int, float]:
    whole, out = counts["p"] + counts["n"], {}
    for f in features:
        p1, n1 = counts[f"p{f}"], counts[f"n{f}"]
        out[f] = round((min(counts["p"] - p1, counts["n"] - n1) + min(p1, n1)) / whole if whole else 0.0, _EQUAL)
    return out


def best_weighted_split(counts, features: Sequence[int]) -> int | None:
    """Least weighted error; None if all features tie, which a single one always does."""
    errors = _weighted_errors(counts, features)
    return None if len(set(errors.values())) < 2 else min(features, key=errors.__getitem__)


def _close(node: Node, tie: int) -> None:
    node.prediction = 1 if node.positive > node.negative else -1 if node.positive < node.negative else tie


class Counts:
    """The sums of one node: p and n, and for each feature the weights of its +1 and -1 rows that have it set. Named as split_counts names them."""

    def __init__(self, sums: np.ndarray):
        self.rows, self.p, self.n = int(sums[0]), float(sums[1]), float(sums[2])
        self.up, self.down = sums[3:].reshape(2, -1)

    def __getitem__(self, name: str) -> float:
        if len(name) == 1:
            return getattr(self, name)
        return float((self.up if name[0] == "p" else self.down)[int(name[1:])])

    def mistakes(self, features: Sequence[int]) -> np.ndarray:
        at = np.asarray(features, np.int64)
        up, down = self.up[at], self.down[at]
        return np.minimum(self.p - up, self.n - down) + np.minimum(up, down)


def _chosen(counts: Counts, features: Sequence[int], weighted: bool) -> int | None:
    """best_split or best_weighted_split over many features: only those within rounding of the fewest mistakes are compared one by one."""
    wrong = counts.mistakes(features)
    near = [features[i] for i in np.flatnonzero(wrong <= wrong.min() + 1e-10 * max(counts.p + counts.n, 1e-300)).tolist()]
    if not weighted:
        return best_split(counts, near)
    # All tie if the least and the greatest do.
    if best_weighted_split(counts, [features[int(wrong.argmin())], features[int(wrong.argmax())]]) is None:
        return None
    return min(near, key=_weighted_errors(counts, near).__getitem__)


#: Numbers of one task in a pass over a level: nodes times features. Wider levels take several passes.
CELLS = 1 << 17


def _walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, at: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The node where each row stands; at gives, for a feature a row, whether it is set and whether it is null."""
    feature, left, right = tree
    node = np.zeros(n, np.int64)
    while (asked := feature[node] >= 0).any():
        on, unknown = at(np.maximum(feature[node], 0))
        node = np.where(asked, np.where(on | unknown, right[node], left[node]), node)
    return node


def _level_sums(batches: Iterator[pa.RecordBatch], tree: tuple[np.ndarray, np.ndarray, np.ndarray], level: np.ndarray, width: int, sparse: bool) -> Iterator[pa.RecordBatch]:
    """For the nodes of a level, a task's rows, weights of both classes, and those with each feature set."""
    slots = np.full(len(tree[0]), -1, np.int64)
    slots[level] = np.arange(len(level))
    total = np.zeros((len(level), 3 + 2 * width))
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        positive, w = batch.column("y").to_numpy(zero_copy_only=False) == 1, batch.column("w").to_numpy(zero_copy_only=False)
        lists = batch.column("x")
        if sparse:
            ids, row = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            none = np.zeros(n, bool)
            node = _walk(tree, n, lambda f, ids=ids, row=row, n=n, none=none: (np.bincount(row[ids == f[row]], minlength=n) > 0, none))
        else:
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            on, unknown, every = (x != 0) & ~np.isnan(x), np.isnan(x), np.arange(n)
            node = _walk(tree, n, lambda f, on=on, unknown=unknown, every=every: (on[every, f], unknown[every, f]))
        slot = slots[node]
        up, down = np.where(positive, w, 0.0), np.where(positive, 0.0, w)
        mine = slot >= 0
        for i, v in enumerate((np.ones(n), up, down)):
            total[:, i] += np.bincount(slot[mine], v[mine], len(level))
        for i, v in enumerate((up, down)):
            part = total[:, 3 + i * width : 3 + (i + 1) * width]
            if sparse:
                own = mine[row]
                part += np.bincount(slot[row[own]] * width + ids[own], v[row[own]], len(level) * width).reshape(len(level), width)
            else:
                for k in np.unique(slot[mine]).tolist():
                    here = slot == k
                    part[k] += v[here] @ on[here]
    used = np.flatnonzero(total[:, 0])
    yield pa.RecordBatch.from_arrays([pa.array(level[used].astype(np.int32)), pa.array(np.full(len(used), task_number(), np.int32)), pa.array(list(total[used]), pa.list_(pa.float64()))], ["node", "part", "sums"])


def level_counts(data: DataFrame, tree: Tree, level: Sequence[int], width: int, sparse: bool, tasks: int) -> dict[int, Counts]:
    """The sums of each node of a level that has rows, over prepared rows (x, y, w): histograms of all features in every task, added on the executors."""
    whole = lambda v: -1 if v is None else v
    arrays = tuple(np.array([whole(getattr(n, c)) for n in tree.nodes], np.int64) for c in ("feature", "left", "right"))
    out: dict[int, Counts] = {}
    most = max(1, CELLS // (2 * width + 3))
    for i in range(0, len(level), most):
        part = np.array(level[i : i + most], np.int64)
        made = data.mapInArrow(lambda it, part=part: _level_sums(it, arrays, part, width, sparse), "node int, part int, sums array<double>")
        out |= {node: Counts(sums) for (node,), (sums,) in collected(made, ("node",), ("sums",), tasks).items()}
    return out


def grow(df: DataFrame, x: str, y: str, names: Sequence[str], max_depth: int = 10, weight: Column | None = None, features: Sequence[int] | None = None, sparse: bool = False) -> Tree:
    """A tree over the feature array x and label y (+1 or -1), one pass a level (several where a level is very wide).

    x holds a 0/1 for each name, or with sparse=True the numbers of the features that are set. A node becomes a leaf when it is
    pure (weighted: its relative error is at most 1e-15), when no feature is left on its path, at the greatest depth,
    and when its best split leaves a side empty.
    """
    # Each level reads the feature array again, not what it was made from.
    kind = "int" if sparse else "double"
    array = F.transform(x, lambda v: v.cast(kind))
    data = df.where(F.col(y).isNotNull()).select(array.alias("x"), F.col(y).cast("int").alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w")).persist()
    try:
        return _grown(data, names, max_depth, weight is not None, features, sparse)
    finally:
        data.unpersist()


def _grown(data: DataFrame, names: Sequence[str], max_depth: int, weighted: bool, features: Sequence[int] | None, sparse: bool) -> Tree:
    tie = WEIGHTED_TIE if weighted else PLAIN_TIE
    tree = Tree(tuple(names), [Node(0)])
    own = {0: list(range(len(names)) if features is None else features)}
    level, tasks = [0], tasks_of(data)
    while level:
        found = level_counts(data, tree, level, len(names), sparse, tasks)
        following = []
        for i in level:
            n, r = tree.nodes[i], found.get(i)
            n.positive, n.negative = (r["p"], r["n"]) if r else (0.0, 0.0)
            whole = n.positive + n.negative
            pure = min(n.positive, n.negative) <= (1e-15 * whole if weighted else 0)
            choice = None if r is None or pure or not own[i] or n.depth >= max_depth else _chosen(r, own[i], weighted)
            if choice is not None:
                on = r[f"p{choice}"] + r[f"n{choice}"]
                if on == 0 or round(whole - on, _EQUAL) == 0:
                    choice = None
            if choice is None:
                _close(n, tie)
                continue
            n.feature = choice
            for side in ("left", "right"):
                setattr(n, side, len(tree.nodes))
                own[len(tree.nodes)] = [f for f in own[i] if f != choice]
                following.append(len(tree.nodes))
                tree.nodes.append(Node(n.depth + 1, parent=i))
            del own[i]
        level = following
    return tree


def prune(tree: Tree, df: DataFrame, x: str, y: str, penalty: float) -> Tree:
    """Collapse nodes of two leaves, deepest first, where error + penalty * leaves falls.

    Class counts of every leaf on the given rows come from one pass; a collapse only adds them up. A
    collapsed node predicts the class of its larger child (by training size), the right one on a tie.
    """
    out = Tree(tree.names, [Node(**vars(n)) for n in tree.nodes])
    rows = df.where(F.col(y).isNotNull()).groupBy(out.node_of(F.col(x)).alias("node")).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n")).collect()
    counts = {r["node"]: (r["p"], r["n"] - r["p"]) for r in rows}
    whole = sum(p + n for p, n in counts.values())
    order = itertools.count()
    both = lambda i: not out.nodes[i].leaf and out.nodes[out.nodes[i].left].leaf and out.nodes[out.nodes[i].right].leaf
    queue = [(-out.nodes[i].depth, next(order), i) for i in sorted(out.reachable()) if both(i)]
    heapq.heapify(queue)
    wrong = lambda c, label: c[1] if label == 1 else c[0]
    while queue:
        _, _, i = heapq.heappop(queue)
        n = out.nodes[i]
        left, right = out.nodes[n.left], out.nodes[n.right]
        a, b = counts.get(n.left, (0, 0)), counts.get(n.right, (0, 0))
        larger = left if left.positive + left.negative > right.positive + right.negative else right
        merged = a[0] + b[0], a[1] + b[1]
        change = (wrong(merged, larger.prediction) - wrong(a, left.prediction) - wrong(b, right.prediction)) / max(whole, 1)
        if round(change - penalty, _EQUAL) < 0:
            counts[i] = merged
            n.prediction, n.feature, n.left, n.right = larger.prediction, None, None, None
            if n.parent is not None and both(n.parent):
                heapq.heappush(queue, (-out.nodes[n.parent].depth, next(order), n.parent))
    return out


def tree_error(df: DataFrame, tree: Tree, x: str, y: str) -> DataFrame:
    return df.agg((1 - F.avg((tree.predict(F.col(x)) == F.col(y)).cast("double"))).alias("error"))


# ---------------------------------------------------------------- boosting

@dataclass(frozen=True)
class Stump:
    feature: int
    left: int
    right: int
    coefficient: float
    error: float

    def vote(self, x: Column, sparse: bool = False) -> Column:
        return F.when(~F.array_contains(x, self.feature) if sparse else x[self.feature] == 0, self.left).otherwise(self.right)


def _weights(stumps: Sequence[Stump], x: Column, y: Column) -> Column:
    """exp of minus the sum of coefficient * y * vote: the weights of all rounds in closed form."""
    if not stumps:
        return F.lit(1.0)
    table = F.array(*(F.struct(F.lit(s.feature).alias("f"), F.lit(float(s.left)).alias("l"), F.lit(float(s.right)).alias("r"), F.lit(s.coefficient).alias("c")) for s in stumps))
    votes = F.aggregate(table, F.lit(0.0), lambda acc, s: acc + s["c"] * F.when(F.element_at(x, s["f"] + 1) == 0, s["l"]).otherwise(s["r"]))
    return F.exp(-y * votes)


def _bits(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The 0/1 features of each row (null counts as 0) and whether its label is +1."""
    flat = batch.column("x").flatten().fill_null(0).to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) != 0, batch.column("y").to_numpy(zero_copy_only=False) == 1


#: Kinds of rows that a task of a round reads at least, if there are as many: smaller tasks would cost more to start than to run.
TASK_KINDS = 1 << 16


def _kind_blocks(batches: Iterator[pa.RecordBatch], sparse: bool) -> Iterator[pa.RecordBatch]:
    """The kinds of a batch as bytes: x (the numbers of all features that are set, or a byte for each feature), how many of them a kind has, whether its label is +1, and how many rows are alike."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if sparse:
            lists = batch.column("x")
            x, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.diff(lists.offsets.to_numpy()).astype(np.int32)
            positive = batch.column("y").to_numpy(zero_copy_only=False) == 1
        else:
            bits, positive = _bits(batch)
            x, sizes = bits.astype(np.uint8), np.full(batch.num_rows, bits.shape[1], np.int32)
        alike = batch.column("alike").to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (x, sizes, positive.astype(np.uint8), alike))], ["n", "x", "sizes", "positive", "alike"])


def _kinds(df: DataFrame, x: str, y: str, sparse: bool) -> DataFrame:
    """The kinds of rows as written blocks, read by as many tasks as they are worth, whatever the number of shuffle partitions."""
    made = stored(_voters(df, x, y, sparse).mapInArrow(lambda it: _kind_blocks(it, sparse), "n int, x binary, sizes binary, positive binary, alike binary"), "kinds")
    kinds = made.agg(F.sum("n")).first()[0] or 0
    return in_tasks(made, -(-kinds // TASK_KINDS))


class _Voters:
    """Some kinds of rows: x, which holds a 0/1 for each feature or, if sparse, the numbers of those that are set, the label, and how many rows are alike."""

    def __init__(self, block: dict, width: int, sparse: bool):
        self.n, self.width, self.sparse = block["n"], width, sparse
        self.alike, self.positive = np.frombuffer(block["alike"], np.int64), np.frombuffer(block["positive"], np.uint8) == 1
        if sparse:
            self.ids, self.row = np.frombuffer(block["x"], np.int32), np.repeat(np.arange(self.n), np.frombuffer(block["sizes"], np.int32))
        else:
            self.x = np.frombuffer(block["x"], np.uint8).reshape(self.n, -1) != 0

    def said(self, stumps: Sequence[Stump]) -> np.ndarray:
        """The vote of each stump (a column) on each row."""
        if not stumps:
            return np.zeros((self.n, 0))
        if not self.sparse:
            return np.stack([np.where(self.x[:, s.feature], s.right, s.left) for s in stumps], axis=1).astype(float)
        # Each feature has one stump at most.
        column = np.full(self.width, -1, np.int64)
        column[[s.feature for s in stumps]] = np.arange(len(stumps))
        out = np.tile(np.array([s.left for s in stumps], float), (self.n, 1))
        own = column[self.ids]
        out[self.row[own >= 0], own[own >= 0]] = np.array([s.right for s in stumps], float)[own[own >= 0]]
        return out

    def score(self, stumps: Sequence[Stump]) -> np.ndarray:
        """The weighted votes of all stumps on each row: what every row would have with no feature set, and what each of its features changes."""
        turns, unset = np.zeros(self.width if self.sparse else self.x.shape[1]), 0.0
        for s in stumps:
            unset += s.coefficient * s.left
            turns[s.feature] += s.coefficient * (s.right - s.left)
        return unset + (np.bincount(self.row, turns[self.ids], self.n) if self.sparse else self.x @ turns)

    def on(self, v: np.ndarray) -> np.ndarray:
        """The values v of the rows that have each feature set, added."""
        return np.bincount(self.ids, v[self.row], self.width) if self.sparse else v @ self.x


def _stump_sums(batches: Iterator[pa.RecordBatch], stumps: Sequence[Stump], width: int, sparse: bool) -> Iterator[pa.RecordBatch]:
    """Of a task's rows, weighted by the stumps so far: those rows, the weights of both classes, and those with each feature set."""
    total: np.ndarray | None = None
    for batch in batches:
        for block in batch.to_pylist():
            rows = _Voters(block, width, sparse)
            w = rows.alike * np.exp(-np.where(rows.positive, 1.0, -1.0) * rows.score(stumps))
            up, down = np.where(rows.positive, w, 0.0), np.where(rows.positive, 0.0, w)
            found = np.concatenate(([rows.alike.sum(), up.sum(), down.sum()], rows.on(up), rows.on(down)))
            total = found if total is None else total + found
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([task_number()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["part", "sums"])


def _boosted_counts(data: DataFrame, stumps: Sequence[Stump], width: int, sparse: bool, tasks: int) -> Counts | None:
    """The sums of a round; None without rows."""
    made = data.mapInArrow(lambda it: _stump_sums(it, stumps, width, sparse), "part int, sums array<double>")
    found = collected(made, (), ("sums",), tasks)
    return Counts(found[()][0]) if found else None


def _voters(df: DataFrame, x: str, y: str, sparse: bool = False) -> DataFrame:
    """x and y of each kind of rows, and how many rows are alike: they have the same weight and votes in every round."""
    kind = "int" if sparse else "double"
    rows = df.where(F.col(y).isNotNull()).select(F.transform(x, lambda b: b.cast(kind)).alias("x"), F.col(y).cast("int").alias("y"))
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("alike"))


def adaboost(df: DataFrame, x: str, y: str, names: Sequence[str], rounds: int, exclude: Sequence[int] = (), least_error: float = 1e-10, sparse: bool = False) -> list[Stump]:
    """Boosted stumps, each feature used once; one job a round.

    Rows that are alike are counted once and written as blocks of bytes, and a round reads each kind of rows. Row weights are never stored: a round's are a
    function of the stumps so far, so nothing grows with the rounds and a lost executor loses nothing. The ensemble ends at a round whose stump cannot split.
    The weighted error is held between least_error and 1 - least_error. With sparse=True x holds the numbers of the features
    that are set.
    """
    stumps: list[Stump] = []
    data = _kinds(df, x, y, sparse)
    left, tasks = [f for f in range(len(names)) if f not in set(exclude)], tasks_of(data)
    for _ in range(rounds):
        r = _boosted_counts(data, tuple(stumps), len(names), sparse, tasks) if left else None
        if r is None:
            break
        whole = r["p"] + r["n"]
        choice = None if min(r["p"], r["n"]) <= 1e-15 * whole else _chosen(r, left, True)
        if choice is None:
            break
        p1, n1 = r[f"p{choice}"], r[f"n{choice}"]
        p0, n0 = r["p"] - p1, r["n"] - n1
        if p1 + n1 == 0 or round(p0 + n0, _EQUAL) == 0:
            break
        label = lambda p, n: 1 if p >= n else -1
        error = float(min(max((min(p0, n0) + min(p1, n1)) / whole, least_error), 1 - least_error))
        stumps.append(Stump(choice, label(p0, n0), label(p1, n1), 0.5 * math.log((1 - error) / error), error))
        left.remove(choice)
    discard(data)
    return stumps


def ensemble_predict(stumps: Sequence[Stump], x: Column, vote: str = "unweighted", sparse: bool = False) -> Column:
    """+1 if the votes add up above 0, else -1. unweighted counts each stump alike, weighted by its coefficient."""
    terms = [s.vote(x, sparse) * F.lit(s.coefficient if vote == "weighted" else 1.0) for s in stumps]
    return F.when(sum(terms[1:], terms[0]) > 0, 1).otherwise(-1) if terms else F.lit(-1)


def _staged(batches: Iterator[pa.RecordBatch], stumps: Sequence[Stump], scale: np.ndarray, width: int, sparse: bool) -> Iterator[pa.RecordBatch]:
    rows, wrong = 0, np.zeros(len(stumps), np.int64)
    for batch in _kind_blocks(batches, sparse):
        for block in batch.to_pylist():
            voters = _Voters(block, width, sparse)
            wrong += voters.alike @ ((np.cumsum(voters.said(stumps) * scale, axis=1) > 0) != voters.positive[:, None])
            rows += int(voters.alike.sum())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(stumps) + 1, dtype=np.int32)), pa.array(wrong), pa.array(np.full(len(stumps), rows))], ["stage", "wrong", "rows"])


def staged_error(df: DataFrame, stumps: Sequence[Stump], x: str, y: str, vote: str = "unweighted", sparse: bool = False, width: int = 0) -> DataFrame:
    """stage and error of the first stage stumps, all from one pass: running sums of votes inside each Arrow batch. Sparse rows need the number of features."""
    scale = np.array([s.coefficient if vote == "weighted" else 1.0 for s in stumps])
    counts = _voters(df, x, y, sparse).mapInArrow(lambda it: _staged(it, stumps, scale, width, sparse), "stage int, wrong bigint, rows bigint")
    return counts.groupBy("stage").agg((F.sum("wrong") / F.sum("rows")).alias("error"))


def describe_stump(stump: Stump, names: Sequence[str]) -> str:
    return f"[{names[stump.feature]} == 0] -> {stump.left}\n[{names[stump.feature]} == 1] -> {stump.right}\ncoefficient {stump.coefficient:.4f}"


def row_weights(df: DataFrame, stumps: Sequence[Stump], x: str, y: str, name: str = "alpha") -> DataFrame:
    """df with the weights after the given rounds, which add up to 1: one sum, then a division by it on each row."""
    w = _weights(stumps, F.col(x), F.col(y).cast("double"))
    whole = df.agg(F.sum(w)).first()[0]
    return df.withColumn(name, w / F.lit(float(whole) if whole else 1.0))


# ---------------------------------------------------------------- gini

def gini_tree(df: DataFrame, x: str, y: str, names: Sequence[str], max_depth: int):
    """The library tree (pyspark.ml, impurity gini) on 0/1 features and +1/-1 labels.

    Features are declared binary, so every one is a candidate at every node: no thresholds are sampled.
    Leaves of one parent that predict the same class are merged.
    """
    return DecisionTreeClassifier(maxDepth=max_depth, impurity="gini", featuresCol="features", labelCol="label").fit(_declared(gini_rows(df, x, y), names))


def boosted_trees(df: DataFrame, x: str, y: str, names: Sequence[str], rounds: int = 5, max_depth: int = 6, step: float = 0.1, seed: int = 1):
    """The library ensemble (pyspark.ml, gradient-boosted trees with logistic loss) on the same rows; gini_accuracy takes its model too."""
    return GBTClassifier(maxIter=rounds, maxDepth=max_depth, stepSize=step, seed=seed, featuresCol="features", labelCol="label").fit(_declared(gini_rows(df, x, y), names))


def _declared(made: DataFrame, names: Sequence[str]) -> DataFrame:
    """The features named and declared binary."""
    attributes = {"ml_attr": {"attrs": {"binary": [{"idx": i, "name": n} for i, n in enumerate(names)]}, "num_attrs": len(names)}}
    return made.withMetadata("features", attributes)


def gini_rows(df: DataFrame, x: str, y: str) -> DataFrame:
    """features and label, as gini_tree's model takes them."""
    return df.select(array_to_vector(F.transform(x, lambda v: v.cast("double"))).alias("features"), (F.col(y) == 1).cast("double").alias("label"))


def gini_accuracy(model, df: DataFrame, x: str, y: str) -> float | None:
    """Share of the rows that the model classifies right."""
    return model.transform(gini_rows(df, x, y)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
