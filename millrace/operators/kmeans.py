"""k-means over dense arrays and over long sparse tables, with careful seeding and restarts.

Centroids are k vectors on the driver, written into the plan; each Lloyd step is one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.distance import squared
from ..functions.text import common_terms_of, letter_entries, with_df
from ..session import discard, stored
from .reduce import collected, task_number, tasks_of
from .splits import shuffle_key, value_rank

Vectors = Sequence[Sequence[float]]


def squared_distances(vector: Column, centroids: Vectors) -> Column:
    """One array with the squared distance to each centroid."""
    table = F.lit([[float(x) for x in c] for c in centroids])
    return F.transform(table, lambda c: squared(vector, c))


def cluster_of(vector: Column, centroids: Vectors) -> Column:
    """The nearest centroid (from 0), the lowest of equals."""
    d = squared_distances(vector, centroids)
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def assign_distance(vector: Column, centroids: Vectors) -> Column:
    """Euclidean distance to the nearest centroid."""
    return F.sqrt(F.array_min(squared_distances(vector, centroids)))


def assign(df: DataFrame, vector: str, centroids: Vectors) -> DataFrame:
    """df with cluster and the squared distance to its centroid."""
    spread = df.withColumn("__d", squared_distances(F.col(vector), centroids))
    least = F.array_min("__d")
    return spread.withColumn("cluster", (F.array_position("__d", least) - 1).cast("int")).withColumn("squared_distance", least).drop("__d")


def heterogeneity(df: DataFrame, vector: str, centroids: Vectors) -> DataFrame:
    """Sum of squared distances to the own centroid."""
    return assign(df, vector, centroids).agg(F.coalesce(F.sum("squared_distance"), F.lit(0.0)).alias("heterogeneity"))


def cluster_sizes(assigned: DataFrame, k: int) -> DataFrame:
    """cluster and size, clusters without rows too."""
    ids = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return ids.join(assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("size"))


def revise(df: DataFrame, vector: str, centroids: Vectors) -> np.ndarray:
    """Means of the clusters; a cluster without rows keeps its centroid."""
    sums = _sums_of(_prepared(df, vector), [np.array(centroids, float)])[0]
    return np.array([sums[i][3] / sums[i][0] if i in sums else np.array(c, float) for i, c in enumerate(centroids)])


#: Rows of a block of vectors, which a pass hands to Python as bytes and works on in the cache of a core.
BLOCK_ROWS = 1024


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, vectors and hashes of the vectors of up to BLOCK_ROWS rows, as bytes."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(i, BLOCK_ROWS)
            x, h = (part.column(0).flatten(), part.column(1))
            x.to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)  # all of one width
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *(pa.array([v.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for v in (x, h))], ["n", "x", "h"])


def _prepared(df: DataFrame, vector: str) -> DataFrame:
    """Blocks of vectors in doubles (x) and of a hash of each (h): a pass copies bytes to Python, not numbers one by one."""
    rows = df.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda v: v.cast("double")).alias("x"), F.xxhash64(vector).alias("h"))
    return rows.mapInArrow(_blocks, "n int, x binary, h binary")


@dataclass
class Clustering:
    centroids: np.ndarray
    heterogeneity: float
    history: list[float] = field(default_factory=list)
    empty: list[int] = field(default_factory=list)


def _own(x: np.ndarray, runs: list[np.ndarray]) -> list[np.ndarray]:
    """The nearest centroid of each row in each run, the lowest of equals.

    One product with all centroids tells it, but for rows where the second nearest is as near as its rounding; these are looked at plainly.
    """
    every = np.concatenate(runs)
    lengths, xx = (every * every).sum(1), np.einsum("ij,ij->i", x, x)
    rough, out, i = lengths - 2 * (x @ every.T), [], 0
    doubt = 8 * np.finfo(float).eps * (x.shape[1] + 2) * (xx + lengths.max())
    for centroids in runs:
        far = rough[:, i : i + len(centroids)]
        i += len(centroids)
        own = far.argmin(1)
        # Also rows that are not finite.
        unclear = np.flatnonzero(~((far > (far[np.arange(len(x)), own] + doubt)[:, None]).sum(1) == len(centroids) - 1))
        if len(unclear):
            own[unclear] = np.stack([((x[unclear] - c) ** 2).sum(1) for c in centroids], axis=1).argmin(1)
        out.append(own)
    return out


def _partial(batches: Iterator[pa.RecordBatch], runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows, squared distance, hash of the members and vector sum of each run's clusters, over the blocks of a task."""
    k, width = max(map(len, runs)), runs[0].shape[1]
    n, h, d, s = np.zeros((len(runs), k), np.int64), np.zeros((len(runs), k), np.int64), np.zeros((len(runs), k)), np.zeros((len(runs), k, width))
    for batch in batches:
        for rows, vectors, hashed in zip(*(batch.column(c) for c in ("n", "x", "h")), strict=True):
            x, hashes = np.frombuffer(vectors.as_buffer(), float).reshape(rows.as_py(), width), np.frombuffer(hashed.as_buffer(), np.int64)
            plain = np.isfinite(x).all()
            for r, (centroids, own) in enumerate(zip(runs, _own(x, runs), strict=True)):
                apart = x - centroids[own]
                n[r] += np.bincount(own, minlength=k)
                d[r] += np.bincount(own, np.einsum("ij,ij->i", apart, apart), k)
                mine = own == np.arange(k)[:, None]
                # A product would spread what is not finite to all clusters.
                s[r] += mine.astype(float) @ x if plain else np.stack([x[m].sum(0) for m in mine])
                with np.errstate(over="ignore"):  # a sum modulo 2^64
                    h[r] += np.where(mine, hashes, 0).sum(1)
    yield pa.RecordBatch.from_arrays([pa.array([task_number()], pa.int32()), pa.array([np.concatenate((n.ravel(), h.ravel()))], pa.list_(pa.int64())), pa.array([np.concatenate((d.ravel(), s.ravel()))], pa.list_(pa.float64()))], ["part", "counts", "sums"])


def _sums_of(data: DataFrame, runs: list[np.ndarray], tasks: int | None = None) -> list[dict[int, tuple[int, float, int, np.ndarray]]]:
    """Rows, squared distance, hash of the members and vector sum of each cluster, for several runs in one pass over prepared rows (x, h)."""
    made = data.mapInArrow(lambda it: _partial(it, runs), "part int, counts array<bigint>, sums array<double>")
    found = collected(made, (), ("counts", "sums"), tasks_of(data) if tasks is None else tasks)
    k, width = max(map(len, runs)), runs[0].shape[1]
    out: list[dict] = [{} for _ in runs]
    for counts, sums in found.values():
        n, h = counts.reshape(2, len(runs), k)
        d, s = sums[: len(runs) * k].reshape(len(runs), k), sums[len(runs) * k :].reshape(len(runs), k, width)
        for r, c in zip(*np.nonzero(n), strict=True):
            out[r][int(c)] = int(n[r, c]), float(d[r, c]), int(h[r, c]) % (1 << 64), s[r, c]
    return out


def lloyd_runs(df: DataFrame, vector: str, starts: Sequence[Vectors], max_iter: int = 500) -> list[Clustering]:
    """Assign and revise from each start until its clusters keep their members (or max_iter); the runs share each pass.

    Members are compared by an order-free hash of each cluster, so the assignment is never stored.
    """
    if not starts:
        return []
    data = _prepared(df, vector).persist()
    tasks = tasks_of(data)
    out = [Clustering(np.array(s, float), 0.0) for s in starts]
    before: list[dict | None] = [None] * len(out)
    left = list(range(len(out)))
    for _ in range(max_iter):
        going = []
        for i, sums in zip(left, _sums_of(data, [out[i].centroids for i in left], tasks), strict=True):
            run = out[i]
            run.history.append(float(sum(s[1] for s in sums.values())))
            run.empty = [c for c in range(len(run.centroids)) if c not in sums]
            run.centroids = np.array([sums[c][3] / sums[c][0] if c in sums else run.centroids[c] for c in range(len(run.centroids))])
            members = {c: (s[0], s[2]) for c, s in sums.items()}
            if members != before[i]:
                going.append(i)
            before[i] = members
        left = going
        if not left:
            break
    for run, sums in zip(out, _sums_of(data, [run.centroids for run in out], tasks), strict=True):
        run.heterogeneity = float(sum(s[1] for s in sums.values()))
    data.unpersist()
    return out


def lloyd(df: DataFrame, vector: str, start: Vectors, max_iter: int = 500) -> Clustering:
    """One run of lloyd_runs."""
    return lloyd_runs(df, vector, [start], max_iter)[0]


def random_start(df: DataFrame, row_id: str, vector: str, k: int, seed: int = 0, distinct: bool = True) -> np.ndarray:
    """k rows of a seeded shuffle; with distinct=False they are drawn with replacement."""
    rows = df.where(F.col(vector).isNotNull()).orderBy(shuffle_key(row_id, seed), row_id).select(vector).limit(k).collect()
    picked = np.array([r[0] for r in rows], float)
    return picked if distinct or not len(picked) else picked[np.random.RandomState(seed).randint(0, len(picked), k)]


def _uniform(row_id: str, seed: int, step: int) -> Column:
    """A number between 0 and 1 from the first 13 hexadecimal digits of an MD5 that any SQL engine can make again."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{step}:"), F.coalesce(F.col(row_id).cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _drawn(batches: Iterator[pa.RecordBatch], centres: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each seed the least -ln(u) / D^2 among a task's rows, ties by row id, with the row's vector."""
    best: dict[int, tuple[float, int, list[float]]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        u = batch.column("u").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for s, own in enumerate(centres):
            d2 = np.min([((x - c) ** 2).sum(1) for c in own], axis=0)
            with np.errstate(divide="ignore"):
                race = np.where(d2 > 0, -np.log(u[:, s]) / d2, np.inf)
            first = int(np.lexsort((ids, race))[0])
            found = float(race[first]), int(ids[first]), x[first].tolist()
            if np.isfinite(found[0]) and (s not in best or found[:2] < best[s][:2]):
                best[s] = found
    rows = sorted(best.items())
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([r[0] for _, r in rows], pa.float64()), pa.array([r[1] for _, r in rows], pa.int64()), pa.array([r[2] for _, r in rows], pa.list_(pa.float64()))], ["seed", "race", "id", "x"])


def careful_starts(df: DataFrame, row_id: str, vector: str, k: int, seeds: Sequence[int]) -> list[np.ndarray]:
    """k-means++ for several seeds at once: each next centre is drawn with chance proportional to the squared distance to the nearest so far.

    Drawn without a running total: the least -ln(u) / D^2 over the rows, u a seeded hash of the row, picks a
    row with exactly that chance in one pass, which all seeds share. With fewer distinct rows than k there are fewer centres.
    """
    usable = df.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("bigint").alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("x")).persist()
    firsts = usable.agg(*(F.min(F.struct(shuffle_key("id", s), "id", "x")).alias(f"s{i}") for i, s in enumerate(seeds))).first()
    centres = [np.array([firsts[f"s{i}"]["x"]], float) if firsts[f"s{i}"] is not None else np.zeros((0, 0)) for i in range(len(seeds))]
    going = [i for i, c in enumerate(centres) if len(c)]
    for step in range(1, k):
        if not going:
            break
        chances = F.array(*(_uniform("id", seeds[i], step) for i in going)).alias("u")
        held = [centres[i] for i in going]
        # The least of each seed is found on the executors.
        raced = usable.select("id", "x", chances).mapInArrow(lambda it, held=held: _drawn(it, held), "seed int, race double, id bigint, x array<double>")
        found = {r["seed"]: (r["m"]["race"], r["m"]["id"], r["m"]["x"]) for r in raced.groupBy("seed").agg(F.min(F.struct("race", "id", "x")).alias("m")).collect()}
        for s, (_, _, x) in found.items():
            centres[going[s]] = np.vstack([centres[going[s]], x])
        going = [going[s] for s in sorted(found)]
    usable.unpersist()
    return centres


def careful_start(df: DataFrame, row_id: str, vector: str, k: int, seed: int = 0) -> np.ndarray:
    """careful_starts of one seed."""
    return careful_starts(df, row_id, vector, k, [seed])[0]


# ---------------------------------------------------------------- seeding for many centres

def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the lowest of equals, and its squared distance; a few centres at a time."""
    best, own = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for i in range(0, len(centres), 16):
        far = ((x[:, None, :] - centres[None, i : i + 16]) ** 2).sum(2)
        at = far.argmin(1)
        least = far[np.arange(len(x)), at]
        nearer = least < best
        best[nearer], own[nearer] = least[nearer], at[nearer] + i
    return own, best


def _raced(batches: Iterator[pa.RecordBatch], centres: np.ndarray, m: int) -> Iterator[pa.RecordBatch]:
    """The m rows of least -ln(u) / D^2 of each batch: a draw without replacement with chances by D^2."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            d2 = _nearest(x, centres)[1]
            with np.errstate(divide="ignore"):
                race = np.where(d2 > 0, -np.log(part.column("u").to_numpy(zero_copy_only=False)) / d2, np.inf)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            at = np.lexsort((ids, race))[:m]
            at = at[np.isfinite(race[at])]
            yield pa.RecordBatch.from_arrays([pa.array(race[at]), pa.array(ids[at]), pa.array(x[at].tolist(), pa.list_(pa.float64()))], ["race", "id", "x"])


def _weights(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many rows of a task are nearest to each centre, and their squared distances added."""
    n, cost = np.zeros(len(centres)), np.zeros(len(centres))
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            own, d2 = _nearest(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), centres)
            n += np.bincount(own, minlength=len(n))
            cost += np.bincount(own, d2, minlength=len(n))
    yield pa.RecordBatch.from_arrays([pa.array([task_number()], pa.int32()), pa.array([np.concatenate((n, cost))], pa.list_(pa.float64()))], ["part", "sums"])


def oversampled(df: DataFrame, row_id: str, vector: str, m: int, rounds: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """1 + rounds * m candidate centres, and how many rows are nearest to each: rounds + 2 passes over the rows, whatever m.

    Each round draws m rows at once, with chances by the squared distance to the candidates so far; the draw needs
    no running total, and each task passes on m rows of a batch at most, of which the executors keep the least m.
    """
    usable = df.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("bigint").alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("x")).persist()
    first = usable.agg(F.min(F.struct(shuffle_key("id", seed).alias("k"), "id", "x")).alias("m")).first()["m"]
    if first is None:
        usable.unpersist()
        return np.zeros((0, 0)), np.zeros(0)
    centres = np.array([first["x"]], float)
    for step in range(1, rounds + 1):
        raced = usable.select("id", "x", _uniform("id", seed, step).alias("u")).mapInArrow(lambda it, c=centres: _raced(it, c, m), "race double, id bigint, x array<double>")
        drawn = raced.orderBy("race", "id").limit(m).collect()
        if not drawn:
            break
        centres = np.vstack([centres, [r["x"] for r in drawn]])
    (sums,) = collected(usable.mapInArrow(lambda it: _weights(it, centres), "part int, sums array<double>"), (), ("sums",), tasks_of(usable))[()]
    usable.unpersist()
    return centres, sums[: len(centres)]


def weighted_start(points: np.ndarray, weights: np.ndarray, k: int, seed: int = 0, tries: int = 5, steps: int = 20) -> np.ndarray:
    """k centres of weighted points: k-means++ by weight times squared distance, then weighted means until nothing moves; the best of some tries."""
    rng, best, least = np.random.Generator(np.random.PCG64(seed)), points[:k], np.inf
    for _ in range(tries):
        own = [int(rng.choice(len(points), p=weights / weights.sum()))]
        d2 = ((points - points[own[0]]) ** 2).sum(1)
        while len(own) < k and (weights * d2).sum() > 0:
            own.append(int(rng.choice(len(points), p=weights * d2 / (weights * d2).sum())))
            d2 = np.minimum(d2, ((points - points[own[-1]]) ** 2).sum(1))
        centres = points[own]
        for _ in range(steps):
            near, _ = _nearest(points, centres)
            total = np.bincount(near, weights, minlength=len(centres))
            means = np.stack([np.bincount(near, weights * column, minlength=len(centres)) for column in points.T], axis=1) if points.shape[1] else centres
            moved = np.where(total[:, None] > 0, means / np.where(total > 0, total, 1)[:, None], centres)
            if np.array_equal(moved, centres):
                break
            centres = moved
        cost = float((weights * _nearest(points, centres)[1]).sum())
        if cost < least:
            best, least = centres, cost
    return best


def parallel_start(df: DataFrame, row_id: str, vector: str, k: int, seed: int = 0, rounds: int = 5, oversample: float = 2.0) -> np.ndarray:
    """k centres for large k (k-means||): oversample * k candidates a round, then the weighted candidates are clustered on the driver.

    rounds + 2 passes in all; careful_starts takes one for each centre. The driver holds 1 + rounds * oversample * k vectors.
    """
    points, weights = oversampled(df, row_id, vector, max(1, int(oversample * k)), rounds, seed)
    # A candidate that repeats another has no rows of its own.
    points, weights = points[weights > 0], weights[weights > 0]
    return weighted_start(points, weights, k, seed) if len(points) > k else points


def restarts(df: DataFrame, row_id: str, vector: str, k: int, seeds: Sequence[int], careful: bool = True, max_iter: int = 500) -> tuple[int, Clustering]:
    """The seed and clustering of least heterogeneity, the first of equals."""
    starts = careful_starts(df, row_id, vector, k, seeds) if careful else [random_start(df, row_id, vector, k, s) for s in seeds]
    return min(zip(seeds, lloyd_runs(df, vector, starts, max_iter), strict=True), key=lambda r: r[1].heterogeneity)


def heterogeneity_by_k(df: DataFrame, row_id: str, vector: str, ks: Sequence[int], seeds: Sequence[int], max_iter: int = 500) -> list[tuple[int, int, float]]:
    """(k, seed, heterogeneity) of the best restart for each k; the runs of all k share each pass over the rows."""
    # The first j centres of a seed are its start for k = j.
    most = careful_starts(df, row_id, vector, max(ks), seeds)
    plans = [(k, s, c[:k]) for k in ks for s, c in zip(seeds, most, strict=True)]
    runs = lloyd_runs(df, vector, [c for _, _, c in plans], max_iter)
    best: dict[int, tuple[int, int, float]] = {}
    for (k, s, _), run in zip(plans, runs, strict=True):
        if k not in best or run.heterogeneity < best[k][2]:
            best[k] = k, s, run.heterogeneity
    return [best[k] for k in ks]


# ---------------------------------------------------------------- sparse rows

#: Bytes of a centroid table up to which it is broadcast; beyond, it is joined by term as a plain exchange, which Spark splits at common terms.
BROADCAST_BYTES = 16 << 20


def sparse_assign(bag: DataFrame, doc_id: str, centroids: DataFrame, value: str = "value", k: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, cluster, squared_distance over a long table (doc_id, term, value) and centroids (cluster, term, value).

    |x|^2 - 2 x.c + |c|^2. Only clusters that share a term with a row are joined with it; of the others, which lie
    |x|^2 + |c|^2 away, the shortest is the nearest, and the k lengths are on hand in order. With k, clusters
    without any term take part as zero vectors. Of equals the lowest cluster. Absent terms count as zero.
    """
    told = centroids.groupBy("cluster").agg(F.sum(F.col(value) * F.col(value)).alias("cc"), F.sum(F.octet_length("term") + 24).alias("bytes")).collect()
    lengths = {r["cluster"]: r["cc"] for r in told}
    lengths |= {c: 0.0 for c in range(k or 0) if c not in lengths}
    listed = sorted((float(cc), c) for c, cc in lengths.items())
    named = centroids.select("term", "cluster", F.col(value).alias("__c"))
    sent = F.broadcast(named) if sum(r["bytes"] or 0 for r in told) <= broadcast_bytes else named.hint("merge")
    products = bag.join(sent, "term").groupBy(doc_id, "cluster").agg(F.sum(F.col(value) * F.col("__c")).alias("xc"))
    shared = products.groupBy(doc_id).agg(F.collect_list(F.struct("cluster", "xc")).alias("__shared"))
    own = bag.groupBy(doc_id).agg(F.sum(F.col(value) * F.col(value)).alias("xx"))
    # At most k products a row.
    both = own.join(shared, doc_id, "left").withColumn("__shared", F.coalesce("__shared", F.array().cast(shared.schema["__shared"].dataType)))
    kind = centroids.schema["cluster"].dataType.simpleString()
    at = F.map_from_arrays(F.lit([c for _, c in listed]).cast(f"array<{kind}>"), F.lit([cc for cc, _ in listed]).cast("array<double>"))
    candidate = lambda d, c: F.struct(F.greatest(d, F.lit(0.0)).alias("squared_distance"), c.alias("cluster"))
    met = F.array_min(F.transform("__shared", lambda s: candidate(F.col("xx") - 2 * s["xc"] + F.element_at(at, s["cluster"]), s["cluster"])))
    order = F.lit([c for _, c in listed]).cast(f"array<{kind}>")
    first = F.get(F.filter(order, lambda c: ~F.exists("__shared", lambda s: s["cluster"] == c)), F.lit(0))
    apart = F.when(first.isNotNull(), candidate(F.col("xx") + F.element_at(at, first), first))
    best = both.select(doc_id, F.least(met, apart).alias("b"))
    return best.select(doc_id, "b.cluster", "b.squared_distance")


def sparse_revise(bag: DataFrame, doc_id: str, assigned: DataFrame, value: str = "value") -> DataFrame:
    """cluster, term, mean value over all rows of the cluster, those without the term too."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sums = bag.join(assigned.select(doc_id, "cluster"), doc_id).groupBy("cluster", "term").agg(F.sum(value).alias("s"))
    return sums.join(sizes, "cluster").select("cluster", "term", (F.col("s") / F.col("n")).alias(value))


def sparse_rows(bag: DataFrame, doc_id: str, ids: Sequence, value: str = "value") -> DataFrame:
    """The rows of the given ids as centroids (cluster, term, value), numbered in their order."""
    kind = bag.schema[doc_id].dataType.simpleString()
    at = F.map_from_arrays(F.lit(list(ids)).cast(f"array<{kind}>"), F.lit(list(range(len(ids)))).cast("array<int>"))
    return bag.where(F.col(doc_id).isin(list(ids))).select(F.element_at(at, F.col(doc_id)).alias("cluster"), "term", value)


def sparse_start(bag: DataFrame, doc_id: str, k: int, seed: int = 0, value: str = "value") -> DataFrame:
    """k rows of a seeded shuffle as centroids."""
    picked = bag.select(doc_id).distinct().where(F.col(doc_id).isNotNull()).orderBy(shuffle_key(doc_id, seed), doc_id).limit(k).collect()
    return sparse_rows(bag, doc_id, [r[0] for r in picked], value)


@dataclass
class SparseClustering:
    """centroids (cluster, term, value) and assigned (doc_id, cluster, squared_distance) are written tables."""

    centroids: DataFrame
    assigned: DataFrame
    #: Sum of squared distances of each round, the last one to the final centroids.
    history: list[float] = field(default_factory=list)
    empty: list[int] = field(default_factory=list)

    @property
    def heterogeneity(self) -> float:
        return self.history[-1]


#: Clusters times commonest terms whose sums a task keeps in one array, and entries of the rarer terms that it holds before it adds them up.
DENSE_CELLS, HELD = 1 << 20, 1 << 20
#: Bytes of centroids (16 for each cluster and term that may meet) up to which they are sent to the tasks each round.
SENT_BYTES = 1 << 29
#: Numbers of a cluster beside its terms: rows, squared distance, and four sums of 16 bits of a hash of its members.
_TOLD = 6


def _packed(rows: DataFrame, doc_id: str, ids: DataFrame) -> DataFrame:
    """doc_id, h (a hash of it), xx (the squared length), and the numbers and values of the terms of each row."""
    met = with_df(rows, ids).groupBy(doc_id).agg(F.collect_list(F.struct(F.col("tid").cast("int").alias("t"), F.col("value").alias("x"))).alias("e"))
    both = met.select(doc_id, F.xxhash64(doc_id).alias("h"), F.col("e.t").alias("terms"), F.col("e.x").alias("xs"))
    return both.withColumn("xx", F.aggregate("xs", F.lit(0.0), lambda a, x: a + x * x))


class _Centres:
    """Centroids (clusters, terms and values, in order of the term) and their squared lengths, with the commonest terms as dense columns."""

    def __init__(self, k: int, width: int, cluster: np.ndarray, tid: np.ndarray, value: np.ndarray):
        self.k, self.width, self.common = k, width, min(width, max(1, DENSE_CELLS // k))
        order = np.argsort(tid, kind="stable")
        self.cluster, self.tid, self.value = cluster[order], tid[order], value[order]
        self.lengths = np.bincount(self.cluster, self.value * self.value, k).astype(float)

    def opened(self) -> None:
        """What a task makes of them once."""
        few = int(np.searchsorted(self.tid, self.common))
        self.dense = np.zeros((self.k, self.common))
        self.dense[self.cluster[:few], self.tid[:few]] = self.value[:few]
        self.ends = np.searchsorted(self.tid, np.arange(self.width + 1))

    def own(self, m: int, xx: np.ndarray, common: tuple, rare: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each of m rows, the lowest of equals, and its squared distance; entries are (row, term, value)."""
        row, term, x = common
        dots = np.stack([np.bincount(row, x * column[term], m) for column in self.dense], axis=1).astype(float)
        row, term, x = rare
        low = self.ends[term]
        n = self.ends[term + 1] - low
        place = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        dots += np.bincount(np.repeat(row, n) * self.k + self.cluster[place], np.repeat(x, n) * self.value[place], m * self.k).reshape(m, self.k)
        far = np.maximum(xx[:, None] - 2 * dots + self.lengths, 0.0)
        own = far.argmin(1)
        return own, far[np.arange(m), own]


def _entries(batch: pa.RecordBatch, most: int) -> tuple[np.ndarray, tuple, tuple]:
    """The squared lengths of packed rows, and their entries (row, term, value) of the commonest and of the rarer terms."""
    lists = batch.column("terms")
    row, term = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    x, common = batch.column("xs").flatten().to_numpy(zero_copy_only=False), term < most
    return batch.column("xx").to_numpy(zero_copy_only=False), (row[common], term[common], x[common]), (row[~common], term[~common], x[~common])


def _placed(batches: Iterator[pa.RecordBatch], centres: _Centres) -> Iterator[pa.RecordBatch]:
    """The cluster and squared distance of each packed row."""
    centres.opened()
    for batch in batches:
        if batch.num_rows:
            own, far = centres.own(batch.num_rows, *_entries(batch, centres.common))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(far)], [batch.schema.names[0], "cluster", "squared_distance"])


def _round(batches: Iterator[pa.RecordBatch], centres: _Centres) -> Iterator[pa.RecordBatch]:
    """The sum of each cluster and term over a task's rows; terms below 0 are the numbers of a cluster that _TOLD counts."""
    centres.opened()
    k, width, most = centres.k, centres.width, centres.common
    sums, met, told, held, waiting = np.zeros(k * most), np.zeros(k * most, bool), np.zeros((k, _TOLD)), [], 0

    def made(cluster: np.ndarray, tid: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(tid.astype(np.int32)), pa.array(s.astype(float))], ["cluster", "tid", "s"])

    def added() -> pa.RecordBatch:
        key, place = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return made(key // width, key % width, np.bincount(place, np.concatenate([x for _, x in held]), len(key)))

    for batch in batches:
        if not batch.num_rows:
            continue
        xx, common, rare = _entries(batch, most)
        own, far = centres.own(batch.num_rows, xx, common, rare)
        h = batch.column("h").to_numpy(zero_copy_only=False)
        for i, v in enumerate((np.ones(len(own)), far, *((h >> (16 * j)) & 0xFFFF for j in range(4)))):
            told[:, i] += np.bincount(own, v, k)
        key = own[common[0]] * most + common[1]
        sums += np.bincount(key, common[2], k * most)
        met[key] = True
        held.append((own[rare[0]] * width + rare[1], rare[2]))
        waiting += len(rare[0])
        if waiting > HELD:
            yield added()
            held, waiting = [], 0
    if held:
        yield added()
    at = np.flatnonzero(met)
    yield made(at // most, at % most, sums[at])
    yield made(np.repeat(np.arange(k), _TOLD), np.tile(-1 - np.arange(_TOLD), k), told.ravel())


def _packed_lloyd(rows: DataFrame, doc_id: str, start: DataFrame, k: int, max_iter: int, ids: DataFrame) -> SparseClustering:
    """sparse_lloyd over rows that are packed once: a round is one pass that sends the centroids to the tasks and adds their sums by one exchange of what each task found."""
    spark = rows.sparkSession
    packed = stored(_packed(rows, doc_id, ids), "packed-rows")
    kind = packed.schema[doc_id].dataType.simpleString()
    width = ids.count()
    plain = lambda table: [table.column(c).to_numpy() for c in table.column_names]
    centres = _Centres(k, width, *plain(start.join(ids, "term").select("cluster", F.col("tid").cast("int").alias("tid"), "value").toArrow()))
    history: list[float] = []
    before, turn = None, 0
    while True:
        sent = spark.sparkContext.broadcast(centres)
        made = packed.select("h", "xx", "terms", "xs").mapInArrow(lambda it, sent=sent: _round(it, sent.value), "cluster int, tid int, s double")
        cluster, tid, s = plain(made.groupBy("cluster", "tid").agg(F.sum("s").alias("s")).toArrow())
        told, term = np.zeros((k, _TOLD)), tid >= 0
        told[cluster[~term], -1 - tid[~term]] = s[~term]
        n, members = told[:, 0], told[:, [0, 2, 3, 4, 5]].tolist()
        history.append(float(told[:, 1].sum()))
        if members == before or turn == max_iter:
            break
        sent.destroy()
        before, turn = members, turn + 1
        kept = (n == 0)[centres.cluster]
        centres = _Centres(k, width, *(np.concatenate(pair) for pair in ((cluster[term], centres.cluster[kept]), (tid[term], centres.tid[kept]), (s[term] / n[cluster[term]], centres.value[kept]))))
    assigned = stored(packed.select(doc_id, "xx", "terms", "xs").mapInArrow(lambda it: _placed(it, sent.value), f"`{doc_id}` {kind}, cluster int, squared_distance double"), "assigned")
    sent.destroy()
    last = spark.createDataFrame(pa.table({"cluster": centres.cluster, "tid": centres.tid, "value": centres.value}), "cluster int, tid int, value double")
    centroids = stored(last.join(ids.select(F.col("tid").cast("int").alias("tid"), "term"), "tid").select("cluster", "term", "value"), "centroids")
    discard(packed)
    return SparseClustering(centroids, assigned, history, np.flatnonzero(n == 0).tolist())


def sparse_lloyd(bag: DataFrame, doc_id: str, start: DataFrame, k: int, max_iter: int = 500, value: str = "value", broadcast_bytes: int = SENT_BYTES) -> SparseClustering:
    """Assign and revise long tables from the centroids start (cluster from 0 to k - 1, term, value) until the clusters keep their members, or max_iter times.

    Terms are numbered, the commonest first, and each row is written once as the numbers and values of its terms. A round sends the centroids to
    the tasks, which pass on one sum for each cluster and term that they meet. The driver holds the centroids, which are bounded by the
    vocabulary; where they may take more than broadcast_bytes, they stay tables, and every round joins them. Members are
    compared by an order-free hash of each cluster. A cluster without rows keeps its centroid.
    """
    start = stored(start.select(F.col("cluster").cast("int").alias("cluster"), "term", F.col(value).cast("double").alias("value")), "centroids")
    rows = bag.where(F.col(doc_id).isNotNull() & F.col("term").isNotNull()).select(doc_id, "term", F.col(value).cast("double").alias("value"))
    own = None if hasattr(bag, "_stored_at") else stored(rows, "rows")
    rows = rows if own is None else own
    found = stored(rows.select("term").unionByName(start.where(F.col("term").isNotNull()).select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    most = found.agg(F.sum(F.least("df", F.lit(k)))).first()[0] or 0
    if 16 * most <= broadcast_bytes:
        ids = stored(value_rank(found.withColumn("__down", -F.col("df")), ["__down", "term"], "tid").select("term", "df", "tid"), "vocabulary")
        out = _packed_lloyd(rows, doc_id, start, k, max_iter, ids)
    else:
        out = _table_lloyd(rows, doc_id, start, k, max_iter)
    discard(own, found)
    return out


def _table_lloyd(rows: DataFrame, doc_id: str, centroids: DataFrame, k: int, max_iter: int) -> SparseClustering:
    """sparse_lloyd where rows, assignments and centroids stay tables, whatever the vocabulary.

    A round's centroids are written, so a lost executor costs a round at most, and those of the round before are removed; k rows a
    round reach the driver. Every round exchanges all rows.
    """
    history: list[float] = []
    before, assigned, members, turn = None, None, {}, 0
    while True:
        discard(assigned)
        assigned = stored(sparse_assign(rows, doc_id, centroids, k=k, broadcast_bytes=0), "assigned")
        told = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(doc_id)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), F.col(doc_id))).alias("b"), F.sum("squared_distance").alias("d")).collect()
        history.append(float(sum(r["d"] for r in told)))
        members = {r["cluster"]: (r["n"], r["a"], r["b"]) for r in told}
        if members == before or turn == max_iter:
            break
        before, turn = members, turn + 1
        means = sparse_revise(rows, doc_id, assigned)
        kept = [c for c in range(k) if c not in members]
        if kept:
            means = means.unionByName(centroids.where(F.col("cluster").isin(kept)))
        old, centroids = centroids, stored(means, "centroids")
        discard(old)
    return SparseClustering(centroids, assigned, history, [c for c in range(k) if c not in members])


# ---------------------------------------------------------------- one step over rows of words

class _Nearest:
    """Centroids that are TF-IDF rows of a few documents: their terms, the weights of these, and one row of values a centroid."""

    def __init__(self, terms: pa.Array, weights: np.ndarray, values: np.ndarray):
        self.terms, self.weights, self.values = terms, weights, values
        self.lengths = (values * values).sum(1)

    def own(self, m: int, row: np.ndarray, words: pa.DictionaryArray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid c of each of m rows x, the lowest of equals, and |c|^2 - 2 x.c. What |x|^2 adds is the same for all, so rows are placed without it."""
        at = pc.index_in(words.dictionary, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)[words.indices.to_numpy(zero_copy_only=False)]
        met = np.flatnonzero(at >= 0)
        row, at = row[met], at[met]
        x = tf[met] * self.weights[at]
        far = self.lengths - 2 * np.stack([np.bincount(row, x * c[at], m) for c in self.values], axis=1)
        own = far.argmin(1)
        return own, far[np.arange(m), own]


def _words(batches: Iterator[pa.RecordBatch], tally: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray, np.ndarray]]:
    """Rows of counts (id, terms, tfs) or lower-cased texts (id, text) and their entries: row, term and number; of texts without tally, an entry for each word.

    About HELD entries at a time (a word of a text counts as 8 bytes), so that look-ups in a vocabulary are few.
    """
    held, waiting = [], 0

    def told() -> tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        if whole.num_columns == 2:
            return whole, *letter_entries(whole.column(1), tally)
        lists = whole.column("terms")
        row = np.repeat(np.arange(whole.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        return whole, row, lists.flatten().dictionary_encode(), whole.column("tfs").flatten().to_numpy(zero_copy_only=False)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            waiting += batch.column(1).nbytes // 8 if batch.num_columns == 2 else len(batch.column("tfs").flatten())
        if waiting >= HELD:
            yield told()
            held, waiting = [], 0
    if held:
        yield told()


def _kept(batch: pa.RecordBatch, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row has a word, and whether it has an id."""
    return np.bincount(row, minlength=batch.num_rows) > 0, batch.column(0).is_valid().to_numpy(zero_copy_only=False)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, term, tf."""
    for batch, row, words, tf in _words(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), words.dictionary_decode(), pa.array(tf, pa.int64())], [batch.schema.names[0], "term", "tf"])


def _among(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[pa.RecordBatch]:
    """How many of a task's rows have each of some terms, and, at the place after them, how many have a word and an id."""
    kinds = len(terms)
    n = np.zeros(kinds + 1, np.int64)
    for batch, row, words, _ in _words(batches, tally=False):
        at = pc.index_in(words.dictionary, value_set=terms).fill_null(kinds).to_numpy(zero_copy_only=False)[words.indices.to_numpy(zero_copy_only=False)]
        met = at < kinds
        n[:kinds] += np.bincount(np.unique(row[met] * (kinds + 1) + at[met]) % (kinds + 1), minlength=kinds)
        n[kinds] += np.logical_and(*_kept(batch, row)).sum()
    met = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met])], ["place", "n"])


def _term_sums(batches: Iterator[pa.RecordBatch], centres: _Nearest) -> Iterator[pa.RecordBatch]:
    """How many rows of each cluster have each term, and how often; the null term has the rows of the clusters. A term comes back once for about HELD entries.

    Rows without an id share no term with a centroid and add nothing to a mean, as in joins by id.
    """
    k = len(centres.lengths)
    for batch, row, words, tf in _words(batches):
        kinds, index = len(words.dictionary), words.indices.to_numpy(zero_copy_only=False)
        worded, named = _kept(batch, row)
        own = np.where(named, centres.own(batch.num_rows, row, words, tf)[0], centres.lengths.argmin())
        key = own[row] * kinds + index
        n, times = np.bincount(key, minlength=k * kinds), np.bincount(key, tf * named[row], k * kinds).astype(np.int64)
        met, sizes = np.flatnonzero(n), np.bincount(own[worded], minlength=k)
        columns = [np.append(met // max(1, kinds), np.arange(k)).astype(np.int32), pa.concat_arrays([words.dictionary.take(pa.array(met % max(1, kinds))), pa.nulls(k, pa.string())]), np.append(n[met], sizes), np.append(times[met], sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "term", "df", "tf"])


def _placed_counts(batches: Iterator[pa.RecordBatch], centres: _Nearest, common: tuple[pa.Array, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The cluster of each row with a word and an id, |c|^2 - 2 x.c, the squares of its values of common terms added, and its rarer terms with their numbers."""
    terms, weights = common
    weights = np.append(weights, 0.0)  # the last one for terms that are not there
    for batch, row, words, tf in _words(batches):
        m, index = batch.num_rows, words.indices.to_numpy(zero_copy_only=False)
        own, near = centres.own(m, row, words, tf)
        at = pc.index_in(words.dictionary, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
        x = tf * weights[at][index]
        rare = np.flatnonzero((at < 0)[index])
        offsets = pa.array(np.searchsorted(row[rare], np.arange(m + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, words.dictionary.take(pa.array(index[rare]))), pa.ListArray.from_arrays(offsets, pa.array(tf[rare], pa.int64()))]
        made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(near), pa.array(np.bincount(row, x * x, m).astype(float)), *lists], [batch.schema.names[0], "cluster", "near", "xx", "terms", "tfs"])
        yield made.filter(pa.array(np.logical_and(*_kept(batch, row))))


def _tf_idf_sums(rows: DataFrame, doc_id: str, ids: Sequence) -> tuple[_Nearest, float, DataFrame]:
    """The rows of ids as centroids, the number of rows, and a written table: term, df, and how often the rows of each cluster have the term (tfs); the null term has the clusters' sizes."""
    kind = rows.schema[doc_id].dataType.simpleString()
    table = rows.where(F.col(doc_id).isin(list(ids))).mapInArrow(_listed, f"`{doc_id}` {kind}, term string, tf bigint").toArrow().sort_by("term")
    words = table["term"].combine_chunks().dictionary_encode()
    terms, at = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
    told = rows.mapInArrow(lambda it: _among(it, terms), "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1)
    df[told["place"].to_numpy()] = told["n"].to_numpy()
    n = float(df[-1])
    w = np.log(n / df[:-1])
    values = np.zeros((len(ids), len(w)))
    of, tf = np.array(table[doc_id].to_pylist(), object), table["tf"].to_numpy()
    for c, i in enumerate(ids):
        mine = of == i
        values[c, at[mine]] = tf[mine] * w[at[mine]]
    centres = _Nearest(terms, w, values)
    found = rows.mapInArrow(lambda it: _term_sums(it, centres), "cluster int, term string, df bigint, tf bigint")
    each = (F.coalesce(F.sum(F.when(F.col("cluster") == c, F.col("tf"))), F.lit(0)) for c in range(len(ids)))
    return centres, n, stored(found.groupBy("term").agg(F.sum("df").alias("df"), F.array(*each).alias("tfs")), "sums")


def _means(sums: DataFrame, n: float) -> DataFrame:
    sizes = sums.where(F.col("term").isNull()).first()
    of = F.element_at(F.lit(list(sizes["tfs"]) if sizes else [0]).cast("array<bigint>"), F.col("cluster") + 1)
    each = sums.where(F.col("term").isNotNull()).select("term", "df", F.posexplode("tfs").alias("cluster", "tf")).where("tf > 0")
    return each.select("cluster", "term", (F.col("tf") * F.log(F.lit(n) / F.col("df")) / of).alias("value"))


def tf_idf_means(rows: DataFrame, doc_id: str, ids: Sequence) -> DataFrame:
    """The centroids after tf_idf_step alone: two passes over the rows, and one exchange of a row for each term and cluster of a task; no document is exchanged or written."""
    _, n, sums = _tf_idf_sums(rows, doc_id, ids)
    return _means(sums, n)


def tf_idf_step(rows: DataFrame, doc_id: str, ids: Sequence, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """sparse_assign of the raw TF-IDF rows of written counts (doc_id, terms, tfs) or text.letter_rows to those of a few documents, in the order of ids, and sparse_revise.

    The TF-IDF rows are never made: a document is placed by the terms it shares with the centroids, whose df a first pass counts, and a mean is the
    weight of a term times its number in the cluster, which a second pass counts together with df. A third pass tells distances; of the documents,
    only the terms that broadcast_bytes do not hold are exchanged, for the squared lengths. The driver holds the rows of ids and the common terms.
    """
    centres, n, sums = _tf_idf_sums(rows, doc_id, ids)
    vocabulary = sums.where(F.col("term").isNotNull()).select("term", "df")
    common = common_terms_of(vocabulary, broadcast_bytes)
    sent = rows.sparkSession.sparkContext.broadcast((common["term"].combine_chunks(), np.log(n / common["df"].to_numpy().astype(float))))
    kind = rows.schema[doc_id].dataType.simpleString()
    placed = stored(rows.mapInArrow(lambda it: _placed_counts(it, centres, sent.value), f"`{doc_id}` {kind}, cluster int, near double, xx double, terms array<string>, tfs array<bigint>"), "placed")
    sent.destroy()
    value = F.col("tf") * F.log(F.lit(n) / F.col("df"))
    rare = placed.select(doc_id, F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select(doc_id, F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))
    squares = rare.join(vocabulary.hint("merge"), "term").groupBy(doc_id).agg(F.sum(value * value).alias("__rare"))
    far = F.greatest(F.col("xx") + F.coalesce("__rare", F.lit(0.0)) + F.col("near"), F.lit(0.0))
    assigned = stored(placed.drop("terms", "tfs").join(squares, doc_id, "left").select(doc_id, "cluster", far.alias("squared_distance")), "assigned")
    discard(placed)
    return assigned, _means(sums, n)


def top_terms(centroids: DataFrame, k: int = 5, value: str = "value") -> DataFrame:
    """The k terms of the highest mean in each cluster."""
    order = W.partitionBy("cluster").orderBy(F.desc(value), "term")
    return centroids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_members(assigned: DataFrame, row_id: str, k: int = 8) -> DataFrame:
    """The k rows of each cluster nearest to its centroid."""
    order = W.partitionBy("cluster").orderBy("squared_distance", row_id)
    return assigned.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def described(centroids: DataFrame, assigned: DataFrame, titles: DataFrame, doc_id: str, title: str, terms: int = 5, members: int = 8, value: str = "value") -> DataFrame:
    """cluster, its terms of the highest mean (best first) and the titles of the members nearest to its centroid (nearest first)."""
    words = top_terms(centroids, terms, value).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    near = nearest_members(assigned, doc_id, members).select("cluster", "rank", doc_id)
    named = near.join(titles.select(doc_id, F.col(title).alias("__title")), doc_id, "left").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("rank", "__title"))).alias("m"))
    return words.join(named, "cluster", "full").select("cluster", F.col("t.term").alias("terms"), F.col("m.__title").alias("members"))
