"""MinHash near-duplicates through a multi-index Hamming join of b-bit signatures.

A document's set is its distinct 5-word shingles over lower-cased words. Its signature has SYMBOLS
min-hashes of 16 bits, cut into chunks of CHUNK symbols. Two signatures that differ in at most TOLERANCE =
2 * chunks - 1 symbols agree, by the pigeonhole principle, in some chunk up to one symbol, so each chunk is
filed once for each symbol that may be wrong, without it: every pair within that distance meets under
some key. TOLERANCE is also the greatest distance at which a pair is looked at further, so all pairs
under the threshold are found; a pair of similarity 0.75 lies beyond it with probability 1.3e-6, one of
0.8 with 2e-9. A pair is dropped when the sizes of the sets rule it out, and it is a link only if its full
sets are similar enough. With exact=True no pair that meets under a key is dropped by its distance or its
sketch: full sets alone decide.

Documents with equal sets are one class; its least id stands for it. Classes are linked in three rounds,
and each round only looks at keys whose classes lie in different components so far:

1. under each key, the least class with all others;
2. a least spanning forest of the signature distances under each key: those links join nearly
   all that belongs together without listing the pairs of a large group;
3. all pairs that are left between different components, so that no link is lost. Sets of up to SKETCH
   shingles come along whole, and decide there and then. Of larger ones the number of shingles in each of
   CELLS classes of hashes comes along: what two sets share is at most the sum of the lesser numbers, so a pair that
   falls short by that bound is no link for certain, and all others go on to be judged by the full sets.

Keys of many classes are dealt out in square blocks. Defined results: null and blank texts have an empty
set and are linked with nothing. Repeated rows (and other rows of equal sets) share a component. Rows of
one id with different texts are judged by their own text each; component_id is the least id of the rows
reachable. Texts of fewer than 5 words have one shingle. Rows with a null id are linked with nothing and
kept. An empty table gives no rows. A very long text is hashed in pieces: it takes about twice its size
and 40 bytes a word of memory. Columns of the input other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import value_rank
from . import common
from .common import distinct, lower_ascii, mixed, row_blocks, sequence_hash, span_hashes, stored, text_bytes, window_hashes, word_hashes, word_spans
from .graph import components

WIDTH = 5
SYMBOLS, CHUNK = 80, 4
#: The distance up to which the keys guarantee that a pair meets, and up to which pairs are looked at.
TOLERANCE = 2 * (SYMBOLS // CHUNK) - 1
#: Classes of one key that a task compares with as many others.
SQUARE = 4096
#: Sets of up to so many shingles come along to the last round, which compares them inside its tasks; larger ones as counts of so many classes of hashes.
SKETCH, CELLS = 256, 2048

#: Shingles signed at once.
_AT_ONCE = 1 << 12

_rng = np.random.Generator(np.random.PCG64(99))
_MULTIPLY = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)


def _set_of(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of one text's word hashes."""
    if len(hashes) >= WIDTH:
        return distinct(window_hashes(hashes, WIDTH))
    return np.array([sequence_hash(hashes)], np.uint64) if len(hashes) else np.zeros(0, np.uint64)


def _shingle_sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The set of each row of a block (of one row, if it is longer than a block)."""
    data = lower_ascii(data)
    if len(offs) == 2 and len(data) > common.BLOCK_BYTES:
        yield _set_of(word_hashes(data))
        return
    starts, ends, words = word_spans(data, offs)
    hashes = span_hashes(data, starts, ends)
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        yield _set_of(hashes[a:b])


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit min-hashes of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _AT_ONCE):
        least = np.minimum(least, (_MULTIPLY[:, None] * x[None, i : i + _AT_ONCE] + _ADD[:, None]).min(axis=1))
    return (mixed(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _names(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    return (int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(s)).view(np.int64))) if len(s) else (0, 0)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        for i, j in row_blocks(offs):
            sizes, names, signs = [], [], []
            for s in _shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                sizes.append(len(s))
                names.append(_names(s))
                signs.append(signature(s).view(np.int16) if len(s) else None)
            first, second = zip(*names, strict=True)
            kept = [batch.column(c).slice(i, j - i) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(signs, pa.list_(pa.int16()))], ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "sig"])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells apart the rows of one id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))


def text_key(text):
    return F.xxhash64(text)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, a 128-bit name of the set, and its signature (null for an empty set)."""
    return _texts(docs).mapInArrow(_signed, "doc_id bigint, text_key bigint, n_shingles bigint, set_a bigint, set_b bigint, sig array<smallint>")


def _keys(classes: DataFrame) -> DataFrame:
    """rep, number of the key, key: each chunk without each of its symbols in turn."""
    made = []
    for k in range(SYMBOLS):
        chunk, drop = divmod(k, CHUNK)
        rest = [chunk * CHUNK + i for i in range(CHUNK) if i != drop]
        made.append(F.xxhash64(F.lit(k), *(F.col("sig")[i] for i in rest)))
    return classes.select("rep", F.posexplode(F.array(*made)).alias("number", "key"))


def _apart(a, b):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))


def _possible(a, b, percent: int):
    """Sizes of sets that can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        for i, j in row_blocks(offs):
            made = list(_shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
            whole, sketches = ([x.tobytes() for x in made], [(s if len(s) <= SKETCH else _cells(s)).tobytes() for s in made])
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i), pa.array(whole, pa.binary()), pa.array(sketches, pa.binary())], ["id", "shingles", "sketch"])


def _cells(shingles: np.ndarray) -> np.ndarray:
    """How many hashes of a set lie in each class; 255 stands for that many and more."""
    return np.minimum(np.bincount((shingles % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8)


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * common >= percent * (len(p) + len(q) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _wanted_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id and shingles of the given classes, by the text that stands for each. Always joined by sorting, so the plan is alike at every size."""
    found = _texts(docs).join(classes.select("rep", F.col("least_id").alias("doc_id"), "text_key").hint("merge"), ["doc_id", "text_key"])
    # By the keys of the join, whose exchange serves for this too.
    return found.dropDuplicates(["doc_id", "text_key"]).select("rep", "text").mapInArrow(_sets, "id bigint, shingles binary, sketch binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    # b first: a is the least class of its keys and may stand in very many pairs; its set is added last.
    one = lambda name, held: sets.select(F.col("id").alias(name), F.col("shingles").alias(held)).hint("merge")
    both = pairs.join(one("b", "sb"), "b").join(one("a", "sa"), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(lambda it: _similar(it, percent), "a bigint, b bigint")


def _squares(batches: Iterator[pa.RecordBatch], percent: int, forest: bool, exact: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of each (key, row, column) square; the input is sorted by these."""
    held, parts = None, []
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "row", "col")])
        cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if i == j:
                continue
            name = tuple(names[:, i].tolist())
            if name != held and parts:
                yield _square(parts, percent, forest, exact)
                parts = []
            held = name
            parts.append(batch.slice(i, j - i))
    if parts:
        yield _square(parts, percent, forest, exact)


def _square(parts: list[pa.RecordBatch], percent: int, forest: bool, exact: bool) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts).combine_chunks()
    rep, label, side, size = (t.column(c).to_numpy() for c in ("rep", "label", "side", "n_shingles"))
    number, row, col = (t.column(c)[0].as_py() for c in ("number", "row", "col"))
    sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(len(rep), SYMBOLS)
    if forest:
        a, b = _forest(rep, label, size, sig, percent)
    else:
        sketches = None if exact else [np.frombuffer(x.as_buffer(), np.uint64 if n <= SKETCH else np.uint8) for x, n in zip(t.column("sketch").combine_chunks(), size.tolist(), strict=True)]
        a, b = _all_pairs(rep, label, size, sig, sketches, percent, number, np.flatnonzero(side == row), np.flatnonzero(side == col), row == col)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _fits(size: np.ndarray, own: int, percent: int) -> np.ndarray:
    return 100 * np.minimum(size, own) >= percent * np.maximum(size, own)


def _forest(rep: np.ndarray, label: np.ndarray, size: np.ndarray, sig: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a least spanning forest over the components, by signature distance up to TOLERANCE."""
    n, far = len(rep), SYMBOLS + 1
    _, group = np.unique(label, return_inverse=True)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(group.max() + 2))
    inside, best, source = np.zeros(n, bool), np.full(n, far), np.zeros(n, np.int64)
    edges: list[tuple[int, int]] = []

    def take(g: int) -> None:
        for u in order[starts[g] : starts[g + 1]].tolist():
            inside[u] = True
            distance = np.where(_fits(size, size[u], percent), (sig != sig[u]).sum(1), far)
            nearer = distance < best
            best[nearer], source[nearer] = distance[nearer], u

    for first in range(n):
        if inside[first]:
            continue
        best[:] = far
        take(group[first])
        while not inside.all():
            v = int(np.where(inside, far, best).argmin())
            if inside[v] or best[v] > TOLERANCE:
                break
            edges.append((int(source[v]), v))
            take(group[v])
    at = np.array(edges, np.int64).reshape(-1, 2)
    return rep[at[:, 0]], rep[at[:, 1]]


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two whole sets are similar enough."""
    at = np.searchsorted(p, q)
    common = int((p[np.minimum(at, len(p) - 1)] == q).sum())
    return 100 * common >= percent * (len(p) + len(q) - common)


def _may_link(i: int, others: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], cells: np.ndarray | None, percent: int) -> np.ndarray:
    """Which of the others may be similar enough to i: exact between small sets, else by what they can share at most."""
    out = np.ones(len(others), bool)
    large = (size[others] > SKETCH) | (size[i] > SKETCH)
    for k in np.flatnonzero(~large).tolist():
        out[k] = _linked(sketches[i], sketches[others[k]], percent)
    at = np.flatnonzero(large)
    if len(at):
        least = np.minimum(cells[others[at]], cells[i])
        shared = least.sum(1, dtype=np.int64)
        # A class that is full on both sides says nothing.
        out[at] = (100 * shared >= percent * (size[others[at]] + size[i] - shared)) | (least == 255).any(1)
    return out


def _all_pairs(rep, label, size, sig, sketches: list[np.ndarray] | None, percent: int, number: int, left: np.ndarray, right: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs between components; a pair belongs to the first of the keys it shares and is passed over elsewhere."""
    a_out, b_out = [], []
    cells = np.stack([_cells(x) if n <= SKETCH else x for x, n in zip(sketches, size.tolist(), strict=True)]) if sketches is not None and (size > SKETCH).any() else None
    for i in left.tolist():
        others = right[(label[right] != label[i]) & ((rep[right] > rep[i]) if diagonal else True) & _fits(size[right], size[i], percent)]
        if not len(others):
            continue
        same = sig[others] == sig[i]
        if sketches is not None:
            near = same.sum(1) >= SYMBOLS - TOLERANCE
            others, same = others[near], same[near]
            if not len(others):
                continue
        chunks = same.reshape(len(others), -1, CHUNK)
        agree = chunks.sum(2, keepdims=True) - chunks == CHUNK - 1
        own = others[agree.reshape(len(others), -1).argmax(1) == number]
        own = own[_may_link(i, own, size, sketches, cells, percent)] if len(own) and sketches is not None else own
        a_out.append(np.full(len(own), rep[i]))
        b_out.append(rep[own])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (empty, empty)


def _between(members: DataFrame, classes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, forest: bool, exact: bool) -> DataFrame:
    """Pairs (a, b) of classes that share a key but no component yet, other than those with a key's least class."""
    named = members.where("rep <> pivot").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "number", "rep", F.coalesce("component", "rep").alias("label"))
    open_keys = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("n")).where("l <> h").select("key", F.ceil(F.col("n") / F.lit(SQUARE)).alias("sides"))
    rows = named.join(open_keys, "key").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("sides")))
    known = classes.select("rep", "sig", "n_shingles")
    sketched = not forest and not exact
    if sketched:
        known = known.join(sets.select(F.col("id").alias("rep"), "sketch"), "rep")
    signed = rows.join(known, "rep").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sides") - 1)))
    signed = signed.select("key", "number", "rep", "label", "side", "n_shingles", "sig", *(["sketch"] if sketched else []), F.least("side", "other").alias("row"), F.greatest("side", "other").alias("col"))
    n = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = signed.repartition(n, "key", "row", "col").sortWithinPartitions("key", "row", "col")
    return dealt.mapInArrow(lambda it: _squares(it, percent, forest, exact), "a bigint, b bigint").distinct()


def _classes(signed: DataFrame) -> tuple[DataFrame, bool]:
    """One row for each distinct set: rep (its number), least_id and text_key of the row that stands for it, set_a, set_b, sig, n_shingles.

    The number is the least id. Only where some id stands for several sets, numbers follow the order of
    the least ids instead, so that the least number of a component is a class of its least id either way; then the second result is true.
    """
    full = signed.where("n_shingles > 0 and doc_id is not null")
    made = full.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = stored(made.select(F.col("at.doc_id").alias("rep"), F.col("at.doc_id").alias("least_id"), F.col("at.text_key").alias("text_key"), "set_a", "set_b", "sig", "n_shingles"), "classes")
    if classes.groupBy("rep").count().where("count > 1").isEmpty():
        return classes, False
    return value_rank(classes.drop("rep"), ["least_id", "text_key", "set_a", "set_b"], "rep"), True


def near_duplicates(docs: DataFrame, percent: int = 75, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id),
    text_key (xxhash64 of the text) and first: true for the rows of the one text that stands for its component.
    """
    signed = stored(signatures(docs), "signatures")
    classes, numbered = _classes(signed)
    keys = _keys(classes)
    # Written first: a join of two plain exchanges can be split where one key is very common.
    least = stored(keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "pivot"), "least")
    members = stored(keys.join(least, "key"), "members")
    sets = stored(_wanted_sets(docs, classes.join(members.select("rep").distinct(), "rep", "left_semi")), "sets")
    star = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    one = lambda name: classes.select(F.col("rep").alias(name), F.col("sig").alias(f"sig_{name}"), F.col("n_shingles").alias(f"n_{name}"))
    near = star.join(one("b"), "b").join(one("a"), "a").where(_possible(F.col("n_a"), F.col("n_b"), percent))
    near = (near if exact else near.where(_apart(F.col("sig_a"), F.col("sig_b")) <= TOLERANCE)).select("a", "b")
    links = stored(confirmed(near, sets, percent), "confirmed")
    labels = stored(components(links), "components")
    for forest in (True, False):
        pairs = stored(_between(members, classes, labels, sets, percent, forest, exact), "pairs")
        more = stored(confirmed(pairs, sets, percent), "confirmed")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = stored(components(links), "components")
    homes = classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("set_a", "set_b", "rep", F.coalesce("component", "rep").alias("home"), "least_id", F.col("text_key").alias("first_key"))
    # The id of a component is that of its least class.
    homes = homes.join(classes.select(F.col("rep").alias("home"), F.col("least_id").alias("home_id")), "home") if numbered else homes.withColumn("home_id", F.col("home"))
    placed = signed.drop("sig").join(homes, ["set_a", "set_b"], "left")
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(some, F.col("home_id")).otherwise(F.col("doc_id"))
    first = ~some | ((F.col("rep") == F.col("home")) & (F.col("doc_id") == F.col("least_id")) & (F.col("text_key") == F.col("first_key")))
    named = placed.select("doc_id", "n_shingles", component.alias("component_id"), "text_key", F.coalesce(first, F.lit(True)).alias("first"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
