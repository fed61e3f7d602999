"""Registered queries over models that are grown, boosted or iterated, and the SQL that each has to agree with.

The SQL of a tree or an ensemble has one table for each level or round, so it is made by functions here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features, text
from ..operators import kmeans, linear, logistic, metrics, splits, trees
from ..session import discard, scratch, stored, table
from ..streaming import online
from . import registry
from .registry import query, rounded

# ---------------------------------------------------------------- trees

_MISTAKES = "round(least(p0, n0) + least(p1, n1), 12)"


def _tree_sql(rows: str, n_features: int, depth: int, weighted: bool = False, gini: bool = False) -> str:
    """Tables lv0, lv1, .. of a greedy tree's nodes (path, p, n, f: the feature asked, null at a leaf) over rows (x, y, w)."""
    out = [f"r0 as materialized (select '' as path, []::int[] as used, x, y, sum(w)::double as w from ({rows}) group by x, y)"]
    for k in range(depth + 1):
        pure = "least(p, n) <= 1e-15 * (p + n)" if weighted else "least(p, n) = 0"
        side = lambda p, n: f"(case when {p} + {n} > 0 then 2 * {p} * {n} / ({p} + {n}) else 0 end)"
        if gini:
            key = f"round({side('p0', 'n0')} + {side('p1', 'n1')}, 9), i"
        elif weighted:
            key = f"round((least(p0, n0) + least(p1, n1)) / (p + n), 12), i"
        else:
            key = f"{_MISTAKES}, abs((p0 + n0) - (p1 + n1)), i"
        ties = "count(distinct round((least(p0, n0) + least(p1, n1)) / (p + n), 12)) over (partition by path)" if weighted else "2"
        gains = f"and round({side('p', 'n')} - {side('p0', 'n0')} - {side('p1', 'n1')}, 9) > 0" if gini else ""
        out.append(f"""t{k} as materialized (select path, any_value(used) as used, coalesce(sum(w) filter (y = 1), 0) as p, coalesce(sum(w) filter (y <> 1), 0) as n from r{k} group by path),
    s{k} as materialized (select t{k}.path, any_value(p) as p, any_value(n) as n, i::int as i, coalesce(sum(w) filter (x[i] = 1 and y = 1), 0) as p1, coalesce(sum(w) filter (x[i] = 1 and y <> 1), 0) as n1, coalesce(sum(w) filter (x[i] = 0 and y = 1), 0) as p0,
        coalesce(sum(w) filter (x[i] = 0 and y <> 1), 0) as n0 from r{k} join t{k} using (path), range(1, {n_features + 1}) f(i) where not list_contains(t{k}.used, i::int) group by t{k}.path, i),
    c{k} as materialized (select *, row_number() over (partition by path order by {key}) as place, {ties} as kinds from s{k}),
    lv{k} as materialized (select t{k}.path, t{k}.p, t{k}.n, case when {k} < {depth} and not ({pure.replace('p,', f't{k}.p,').replace(', n)', f', t{k}.n)').replace('(p + n)', f'(t{k}.p + t{k}.n)')}) and kinds > 1 and p1 + n1 > 0 and round(p0 + n0, 12) <> 0 {gains.replace('2 * p * n', f'2 * t{k}.p * t{k}.n').replace('(p + n)', f'(t{k}.p + t{k}.n)').replace('when p + n', f'when t{k}.p + t{k}.n')} then i end as f
        from t{k} left join c{k} on c{k}.path = t{k}.path and place = 1)""")
        if k < depth:
            out.append(f"r{k + 1} as materialized (select r{k}.path || (case when x[f] = 0 then '0' else '1' end) as path, list_append(used, f) as used, x, y, w from r{k} join lv{k} using (path) where f is not null)")
    return ",\n    ".join(out)


def _nodes_sql(depth: int, names: Sequence[str], tie: int = -1) -> str:
    named = f"[{', '.join(chr(39) + n + chr(39) for n in names)}]"
    label = "case when p > n then 1 when p < n then -1 else " + str(tie) + " end"
    levels = " union all ".join(f"select {k} as depth, path, p, n, f from lv{k}" for k in range(depth + 1))
    return f"nodes as materialized (select depth, path, {named}[f] as feature, f, (case when f is null then {label} end)::int as prediction, p + n as size from ({levels}))"


_ORDERS = registry.TREE_ROWS.split(" as (", 1)[1][:-1].replace("select case", "select o_orderkey, o_custkey, case", 1)
_N = len(registry.TREE_NAMES)
_FULL_TREE = f"with {_tree_sql(f'select x, y, 1 as w from ({_ORDERS})', _N, 6)}, {_nodes_sql(6, registry.TREE_NAMES)}"
_NODE = "depth::int as depth, path, feature, prediction, size::double as size"


@query(f"{_FULL_TREE} select {_NODE} from nodes")
def decision_tree_nodes(spark, sf_dir):
    return trees.grow(registry.tree_rows(spark, sf_dir), "x", "y", registry.TREE_NAMES, max_depth=6).table(spark).select("depth", "path", "feature", "prediction", "size")


@query(f"{_FULL_TREE} select count(*)::int as nodes, count(prediction)::int as leaves, max(depth)::int as depth from nodes")
def tree_size(spark, sf_dir):
    tree = trees.grow(registry.tree_rows(spark, sf_dir), "x", "y", registry.TREE_NAMES, max_depth=6)
    return spark.createDataFrame([(tree.count_nodes(), tree.count_leaves(), tree.depth())], "nodes int, leaves int, depth int")


@query(f"with {_tree_sql(f'select x, y, (1 + o_custkey % 3) as w from ({_ORDERS})', _N, 4, weighted=True)}, {_nodes_sql(4, registry.TREE_NAMES, 1)} select {_NODE} from nodes")
def weighted_tree_nodes(spark, sf_dir):
    rows = registry.tree_rows(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    tree = trees.grow(rows, "x", "y", registry.TREE_NAMES, max_depth=4, weight=(1 + F.col("o_custkey") % 3).cast("double"))
    return tree.table(spark).select("depth", "path", "feature", "prediction", "size")


def _split_sql(fraction: float) -> str:
    """The rows of the trees with is_valid, by the split of seed 0."""
    return f"o as materialized (select *, row_number() over (order by md5('0:' || o_orderkey), o_orderkey) <= ceil({fraction} * count(*) over () - 1e-9) as is_valid from ({_ORDERS}))"


def _walk_sql(depth: int) -> str:
    """Where the rows v0 (x, y, w and more) are at each level, and leaf_of: those of them that end there."""
    steps = ["v0 as materialized (select '' as path, * from v)"]
    steps += [f"v{k + 1} as materialized (select v{k}.path || (case when x[f] = 0 then '0' else '1' end) as path, v{k}.* exclude (path) from v{k} join lv{k} using (path) where f is not null)" for k in range(depth)]
    ends = " union all ".join(f"select v{k}.* from v{k} join lv{k} using (path) where f is null" for k in range(depth + 1))
    return ", ".join([*steps, f"leaf_of as materialized ({ends})"])


def _pruned_sql(depth: int, penalty: float) -> str:
    """State q<d> after the nodes of depth d were looked at: path, leaf, prediction, validation counts, training size."""
    wrong = lambda p, n, label: f"(case when {label} = 1 then {n} else {p} end)"
    out = [f"q{depth} as materialized (select nodes.depth, nodes.path, feature, prediction is not null as leaf, prediction, size, coalesce(vp, 0) as vp, coalesce(vn, 0) as vn from nodes left join (select path, count(*) filter (y = 1) as vp, count(*) filter (y <> 1) as vn from leaf_of group by path) using (path))"]
    for d in range(depth - 1, -1, -1):
        q = f"q{d + 1}"
        merged = ("l.vp + r.vp", "l.vn + r.vn")
        larger = "case when l.size > r.size then l.prediction else r.prediction end"
        change = f"({wrong(*merged, f'({larger})')} - {wrong('l.vp', 'l.vn', 'l.prediction')} - {wrong('r.vp', 'r.vn', 'r.prediction')}) / greatest((select count(*) from v), 1)::double"
        out.append(f"k{d} as materialized (select c.path, {larger} as prediction, {merged[0]} as vp, {merged[1]} as vn from {q} c join {q} l on l.path = c.path || '0' join {q} r on r.path = c.path || '1' where c.depth = {d} and not c.leaf and l.leaf and r.leaf and round({change} - {penalty}, 12) < 0)")
        out.append(f"q{d} as materialized (select a.depth, a.path, case when k.path is null then feature end as feature, leaf or k.path is not null as leaf, coalesce(k.prediction, a.prediction) as prediction, size, coalesce(k.vp, a.vp) as vp, coalesce(k.vn, a.vn) as vn from {q} a left join k{d} k on k.path = a.path where a.path = '' or a.path[1:len(a.path) - 1] not in (select path from k{d}))")
    return ", ".join(out)


@query(f"""with {_split_sql(0.3)}, {_tree_sql('select x, y, 1 as w from o where not is_valid', _N, 6)}, {_nodes_sql(6, registry.TREE_NAMES)},
    v as materialized (select x, y from o where is_valid), {_walk_sql(6)}, {_pruned_sql(6, 0.001)} select {_NODE} from q0""")
def pruned_tree_nodes(spark, sf_dir):
    train, valid = splits.train_test_split(registry.tree_rows(spark, sf_dir), "o_orderkey", 0.3)
    pruned = trees.prune(trees.grow(train, "x", "y", registry.TREE_NAMES, max_depth=6), valid, "x", "y", 0.001)
    return pruned.table(spark).select("depth", "path", "feature", "prediction", "size")


def _gini_sql(depth: int) -> str:
    tables = _tree_sql("select x, y, 1 as w from o where not is_valid", _N, depth, gini=True)
    right = lambda part: f"round(avg((prediction = y)::int) filter ({part}), 9)"
    return f"""(with {tables}, {_nodes_sql(depth, registry.TREE_NAMES)}, v as materialized (select x, y, is_valid from o), {_walk_sql(depth)}
        select {depth} as max_depth, {right('not is_valid')} as train_accuracy, {right('is_valid')} as valid_accuracy from leaf_of join nodes using (path))"""


@query(f"with {_split_sql(0.2)} " + " union all ".join(f"select * from {_gini_sql(d)}" for d in (6, 2, 10)))
def gini_tree_depths(spark, sf_dir):
    """The library tree at the reference's depths 6, 2 and 10, with its accuracy on both parts."""
    train, valid = (part.persist() for part in splits.train_test_split(registry.tree_rows(spark, sf_dir), "o_orderkey", 0.2))
    rows = []
    for depth in (6, 2, 10):
        model = trees.gini_tree(train, "x", "y", registry.TREE_NAMES, depth)
        rows.append((depth, *(trees.gini_accuracy(model, part, "x", "y") for part in (train, valid))))
    train.unpersist()
    valid.unpersist()
    return spark.createDataFrame(rows, "max_depth int, train_accuracy double, valid_accuracy double").select("max_depth", rounded("train_accuracy", 9), rounded("valid_accuracy", 9))


@query(f"with {_split_sql(0.2)} select * from {_gini_sql(6)}")
def boosted_library_first_round(spark, sf_dir):
    """The library ensemble after one round: a tree on the labels themselves, which splits as the gini tree does."""
    train, valid = (part.persist() for part in splits.train_test_split(registry.tree_rows(spark, sf_dir), "o_orderkey", 0.2))
    model = trees.boosted_trees(train, "x", "y", registry.TREE_NAMES, rounds=1)
    row = (6, *(trees.gini_accuracy(model, part, "x", "y") for part in (train, valid)))
    train.unpersist()
    valid.unpersist()
    return spark.createDataFrame([row], "max_depth int, train_accuracy double, valid_accuracy double").select("max_depth", rounded("train_accuracy", 9), rounded("valid_accuracy", 9))


# ---------------------------------------------------------------- boosting

_LINE_BITS = {
    "quantity>10": "l_quantity > 10", "quantity>20": "l_quantity > 20", "quantity>25": "l_quantity > 25", "quantity>30": "l_quantity > 30", "quantity>40": "l_quantity > 40", "quantity>45": "l_quantity > 45",
    "discount>0.05": "l_discount > 0.05", "tax>0.04": "l_tax > 0.04", "flag=R": "l_returnflag = 'R'", "flag=A": "l_returnflag = 'A'", "status=O": "l_linestatus = 'O'", "late": "month(l_shipdate) > 6",
}
_LINE_NAMES = tuple(_LINE_BITS)
#: All of these matter somewhat, and so does a price that no feature shows.
_LINE_LABEL = (
    "l_quantity + 200 * l_discount + 150 * l_tax + l_extendedprice / 4000 + case l_returnflag when 'R' then 9 when 'A' then -9 else 0 end "
    "+ case when l_linestatus = 'O' then 7 else 0 end + case when month(l_shipdate) > 6 then 8 else 0 end > 62"
)
#: Rounds of the reference's first ensemble.
_ROUNDS = 10
_LINE_ROWS = f"select case when {_LINE_LABEL} then 1 else -1 end as y, [{', '.join(f'coalesce(({b})::int, 0)' for b in _LINE_BITS.values())}] as x from lineitem"


def _line_rows(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.when(F.expr(_LINE_LABEL), 1).otherwise(-1).alias("y"), F.array(*(F.coalesce(F.expr(f"cast({b} as int)"), F.lit(0)) for b in _LINE_BITS.values())).alias("x"))


def _boost_sql(rounds: int) -> str:
    """Tables g<t> (x, y, m rows, s and u: the weighted and plain votes before round t) and b<t> (the stump of round t)."""
    out = [f"g0 as materialized (select x, y, count(*)::double as m, 0.0::double as s, 0::bigint as u, []::int[] as used from ({_LINE_ROWS}) group by x, y)"]
    for t in range(rounds):
        out.append(f"""w{t} as materialized (select *, m * exp(-y * s) as w from g{t}),
    e{t} as materialized (select i::int as i, sum(w) as whole, coalesce(sum(w) filter (x[i] = 1 and y = 1), 0) as p1, coalesce(sum(w) filter (x[i] = 1 and y <> 1), 0) as n1, coalesce(sum(w) filter (x[i] = 0 and y = 1), 0) as p0, coalesce(sum(w) filter (x[i] = 0 and y <> 1), 0) as n0
        from w{t}, range(1, {len(_LINE_NAMES) + 1}) f(i) where not list_contains(used, i::int) group by i),
    b{t} as materialized (select i, least(greatest((least(p0, n0) + least(p1, n1)) / whole, 1e-10), 1 - 1e-10) as e, (case when p0 >= n0 then 1 else -1 end)::int as l, (case when p1 >= n1 then 1 else -1 end)::int as r
        from e{t} where (select count(distinct round((least(p0, n0) + least(p1, n1)) / whole, 12)) from e{t}) > 1 order by round((least(p0, n0) + least(p1, n1)) / whole, 12), i limit 1),
    g{t + 1} as materialized (select x, y, m, s + 0.5 * ln((1 - e) / e) * (case when x[i] = 0 then l else r end) as s, u + (case when x[i] = 0 then l else r end) as u, list_append(used, i) as used from g{t}, b{t})""")
    return ",\n    ".join(out)


_BOOSTED = f"with {_boost_sql(_ROUNDS)}"
_NAMED = f"[{', '.join(chr(39) + n + chr(39) for n in _LINE_NAMES)}][i]"


def _stumps(spark, sf_dir) -> list[trees.Stump]:
    return trees.adaboost(_line_rows(spark, sf_dir), "x", "y", _LINE_NAMES, _ROUNDS)


@query(_BOOSTED + " " + " union all ".join(f"select {t + 1} as round, {_NAMED} as feature, round(e, 9) as error, round(0.5 * ln((1 - e) / e), 9) as coefficient, l as left_label, r as right_label from b{t}" for t in range(_ROUNDS)))
def adaboost_stumps(spark, sf_dir):
    rows = [(t, _LINE_NAMES[s.feature], s.error, s.coefficient, s.left, s.right) for t, s in enumerate(_stumps(spark, sf_dir), 1)]
    return spark.createDataFrame(rows, "round int, feature string, error double, coefficient double, left_label int, right_label int").select("round", "feature", rounded("error", 9), rounded("coefficient", 9), "left_label", "right_label")


@query(_BOOSTED + " " + " union all ".join(f"select {t} as stage, round(sum(m) filter ((case when u > 0 then 1 else -1 end) <> y) / sum(m), 9) as error, round(sum(m) filter ((case when s > 0 then 1 else -1 end) <> y) / sum(m), 9) as weighted_error from g{t} having count(*) > 0" for t in range(1, _ROUNDS + 1)))
def staged_error(spark, sf_dir):
    rows = _line_rows(spark, sf_dir).persist()
    stumps = trees.adaboost(rows, "x", "y", _LINE_NAMES, _ROUNDS)
    plain, weighted = (trees.staged_error(rows, stumps, "x", "y", vote).select("stage", F.round("error", 9).alias(name)) for vote, name in (("unweighted", "error"), ("weighted", "weighted_error")))
    out = stored(plain.join(weighted, "stage"), "staged")
    rows.unpersist()
    return out


@query(f"{_BOOSTED} select (case when u > 0 then 1 else -1 end)::int as plain, (case when s > 0 then 1 else -1 end)::int as weighted, y::int as y, sum(m)::bigint as rows from g{_ROUNDS} group by all")
def ensemble_predictions(spark, sf_dir):
    stumps = _stumps(spark, sf_dir)
    said = [trees.ensemble_predict(stumps, F.col("x"), vote).alias(name) for vote, name in (("unweighted", "plain"), ("weighted", "weighted"))]
    return _line_rows(spark, sf_dir).select(*said, "y").groupBy("plain", "weighted", "y").agg(F.count(F.lit(1)).alias("rows"))


@query(f"with {_boost_sql(2)}, w as (select x, y, m, exp(-y * s) as w from g2) select array_to_string(x, '') as bits, y::int as y, round(any_value(w) / (select sum(m * w) from w) * (select sum(m) from w), 9) as relative_weight from w group by x, y")
def boosted_row_weights(spark, sf_dir):
    """The weights after two rounds beside the rows they belong to, in multiples of the mean."""
    rows = _line_rows(spark, sf_dir)
    weighted = trees.row_weights(rows, _stumps(spark, sf_dir)[:2], "x", "y")
    return weighted.groupBy(F.concat_ws("", F.transform("x", lambda b: b.cast("string"))).alias("bits"), "y").agg(F.round(F.first("alpha") * rows.count(), 9).alias("relative_weight"))


@query(f"with {_boost_sql(1)} select '[' || {_NAMED} || ' == 0] -> ' || l || '\n[' || {_NAMED} || ' == 1] -> ' || r || '\ncoefficient ' || format('{{:.4f}}', 0.5 * ln((1 - e) / e)) as stump from b0")
def stump_text(spark, sf_dir):
    first = trees.adaboost(_line_rows(spark, sf_dir), "x", "y", _LINE_NAMES, 1)[0]
    return spark.createDataFrame([(trees.describe_stump(first, _LINE_NAMES),)], "stump string")


# ---------------------------------------------------------------- selection

_DEGREES = """with recursive p as materialized (select p_size::double as x, p_retailprice as y, row_number() over (order by md5('0:' || p_partkey), p_partkey) > ceil(0.3 * count(*) over () - 1e-9) as tr from part),
    z as materialized (select (2 * x - min(x) over () - max(x) over ()) / (max(x) over () - min(x) over ()) as x, y, tr from p),
    r(d, x, y, tr, a, b, f) as (
        select 0, x, y, tr, 1.0::double, 0.0::double, (select avg(y) from z where tr) from z
        union all
        select d + 1, x, y, tr, nxt, a, f + nxt * sum(y * nxt) filter (tr) over () / sum(nxt * nxt) filter (tr) over ()
        from (select *, (x - sum(x * a * a) filter (tr) over () / sum(a * a) filter (tr) over ()) * a - case when d = 0 then 0.0 else b * sum(a * a) filter (tr) over () / sum(b * b) filter (tr) over () end as nxt from r where d < 15))
    select d::int as degree, round(sum((y - f) ** 2) filter (not tr) / 1e6, 4) as validation_rss from r where d > 0 group by d"""


@query(_DEGREES)
def polynomial_degrees_of_powers(spark, sf_dir):
    """The same from raw powers of 1 to 50, up to 50^15, by a decomposition without products."""
    train, valid = splits.train_test_split(table(spark, sf_dir, "part"), "p_partkey", 0.3)
    scores = spark.createDataFrame(linear.select_degree_of_powers(train, valid, "p_size", "p_retailprice"), "degree int, validation_rss double")
    return scores.select("degree", F.round(F.col("validation_rss") / 1e6, 4).alias("validation_rss"))


@query(_DEGREES)
def polynomial_degree_selection(spark, sf_dir):
    train, valid = splits.train_test_split(table(spark, sf_dir, "part"), "p_partkey", 0.3)
    scores = spark.createDataFrame(linear.select_degree(train, valid, "p_size", "p_retailprice"), "degree int, validation_rss double")
    return scores.select("degree", F.round(F.col("validation_rss") / 1e6, 4).alias("validation_rss"))


_LASSO_NAMES = ("p_size", "key_part", "name_length")
_LASSO_ROWS = "select p_partkey, p_size::double as a, (p_partkey % 100)::double as b, len(p_type)::double as c, p_retailprice + 40.0::double * p_size + 3.0::double * (p_partkey % 100) as y from part"


def _lasso_grams(spark, sf_dir) -> tuple[linear.Gram, linear.Gram]:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size"), (F.col("p_partkey") % 100).alias("key_part"), F.char_length("p_type").alias("name_length"), (F.col("p_retailprice") + 40.0 * F.col("p_size") + 3.0 * (F.col("p_partkey") % 100)).alias("y"))
    train, valid = splits.train_test_split(part, "p_partkey", 0.5)
    return linear.gram(train, _LASSO_NAMES, "y"), linear.gram(valid, _LASSO_NAMES, "y")


#: Sums of centred, length-scaled features on the training half, and the rows of the validation half.
_LASSO_BASE = f"""p as materialized (select *, row_number() over (order by md5('0:' || p_partkey), p_partkey) > ceil(0.5 * count(*) over () - 1e-9) as tr from ({_LASSO_ROWS})),
    m as materialized (select count(*)::double as n, avg(a) as ma, avg(b) as mb, avg(c) as mc, avg(y) as my from p where tr),
    l as materialized (select sqrt(sum((a - ma) ** 2)) as la, sqrt(sum((b - mb) ** 2)) as lb, sqrt(sum((c - mc) ** 2)) as lc from p, m where tr),
    k as materialized (select any_value(n) as n, any_value(ma) as ma, any_value(mb) as mb, any_value(mc) as mc, any_value(my) as my, any_value(la) as la, any_value(lb) as lb, any_value(lc) as lc,
        sum((a - ma) / la * (b - mb) / lb) as ab, sum((a - ma) / la * (c - mc) / lc) as ac, sum((b - mb) / lb * (c - mc) / lc) as bc, sum((a - ma) / la * (y - my)) as ay, sum((b - mb) / lb * (y - my)) as b_y, sum((c - mc) / lc * (y - my)) as cy from p, m, l where tr)"""


def _soft(rho: str) -> str:
    return f"(case when {rho} > half then {rho} - half when {rho} < -half then {rho} + half else 0.0 end)"


def _lasso_sql(t: str, grid: str, rounds: int = 60) -> str:
    """Tables <t>r (weights by round) and <t>v (alpha, validation RSS, non-zero weights with the intercept) for the penalties of grid (alpha)."""
    return f"""{t}r(i, alpha, wa, wb, wc) as (select 0, alpha, 0.0::double, 0.0::double, 0.0::double from {grid} union all
        select i + 1, alpha, va, vb, {_soft('rc')} from (select *, cy - ac * va - bc * vb as rc from (select *, {_soft('rb')} as vb from (select *, b_y - ab * va - bc * wc as rb
            from (select *, {_soft('ra')} as va from (select {t}r.*, k.*, ay - ab * wb - ac * wc as ra, alpha * n as half from {t}r, k where i < {rounds})))))),
    {t}v as materialized (select alpha, sum((y - my - wa / la * (a - ma) - wb / lb * (b - mb) - wc / lc * (c - mc)) ** 2) as rss, any_value(1 + (wa <> 0)::int + (wb <> 0)::int + (wc <> 0)::int) as nonzero from {t}r, k, p where i = {rounds} and not tr group by alpha)"""


_ALPHAS = tuple(round(10 ** (k / 2), 9) for k in range(-4, 9))


@query(f"with recursive {_LASSO_BASE}, g as (select unnest([{', '.join(f'{a}::double' for a in _ALPHAS)}]) as alpha), {_lasso_sql('t', 'g')} select alpha as penalty, round(rss / 1e6, 4) as validation_rss, nonzero::int as nonzero from tv")
def lasso_penalty_path(spark, sf_dir):
    """The library form of the lasso at thirteen penalties, with its validation error."""
    train, valid = _lasso_grams(spark, sf_dir)
    rows = [(float(p), float(r), k) for p, r, k in linear.lasso_by_validation(train, valid, _ALPHAS)]
    return spark.createDataFrame(rows, "penalty double, validation_rss double, nonzero int").select("penalty", F.round(F.col("validation_rss") / 1e6, 4).alias("validation_rss"), "nonzero")


def _grid_sql(low: str, high: str) -> str:
    return f"(select 10 ** (log10({low}) + (log10({high}) - log10({low})) * j / 19.0::double) as alpha from range(20) t(j))"


def _sparsity_sql(passes: int, most: int) -> str:
    """Each pass narrows [low, high] to the largest penalty with too many and the smallest with too few weights."""
    out = ["h0 as materialized (select 1e-3::double as low, 1e6::double as high)"]
    for t in range(passes):
        out.append(f"a{t} as materialized (select alpha from {_grid_sql('low', 'high').replace('from range(20) t(j)', f'from h{t}, range(20) t(j)')})")
        out.append(_lasso_sql(f"x{t}", f"a{t}"))
        out.append(f"h{t + 1} as materialized (select coalesce((select max(alpha) from x{t}v where nonzero > {most}), low) as low, coalesce((select min(alpha) from x{t}v where nonzero < {most}), high) as high from h{t})")
    every = " union all ".join(f"select {t} as pass, alpha, rss from x{t}v where nonzero = {most}" for t in range(passes))
    return f"""with recursive {_LASSO_BASE}, {', '.join(out)}, best as (select alpha, rss from ({every}) order by rss, pass, alpha limit 1)
    select round(log10(alpha), 6) as log_penalty, round(rss / 1e6, 4) as validation_rss, round(log10(low), 6) as log_low, round(log10(high), 6) as log_high from best, h{passes}"""


@query(_sparsity_sql(3, 2))
def lasso_sparsity_search(spark, sf_dir):
    train, valid = _lasso_grams(spark, sf_dir)
    penalty, rss, (low, high) = linear.lasso_for_sparsity(train, valid, 1e-3, 1e6, max_nonzeros=2)
    found = spark.createDataFrame([(float(penalty), float(rss), low, high)], "penalty double, rss double, low double, high double")
    log = lambda c, name: F.round(F.log10(c), 6).alias(name)
    return found.select(log("penalty", "log_penalty"), F.round(F.col("rss") / 1e6, 4).alias("validation_rss"), log("low", "log_low"), log("high", "log_high"))


# ---------------------------------------------------------------- logistic

_P = "1 / (1 + exp(-(w0 + w1 * a + w2 * b)))"


@query(f"""with recursive {registry.LABELLED}, r(i, w0, w1, w2) as (select 0, 0.0::double, 0.0::double, 0.0::double union all
        select i + 1, w0 + (g0 * (e * j - h * h) - g1 * (c * j - h * f) + g2 * (c * h - e * f)) / det, w1 + (-g0 * (c * j - f * h) + g1 * (k * j - f * f) - g2 * (k * h - c * f)) / det, w2 + (g0 * (c * h - e * f) - g1 * (k * h - f * c) + g2 * (k * e - c * c)) / det
        from (select *, k * (e * j - h * h) - c * (c * j - h * f) + f * (c * h - e * f) as det
            from (select i, w0, w1, w2, sum(t - p) - w0 as g0, sum((t - p) * a) - w1 as g1, sum((t - p) * b) - w2 as g2, 1 + sum(p * (1 - p)) as k, sum(p * (1 - p) * a) as c, sum(p * (1 - p) * b) as f, 1 + sum(p * (1 - p) * a * a) as e, sum(p * (1 - p) * a * b) as h, 1 + sum(p * (1 - p) * b * b) as j
                from (select r.*, a, b, (y = 1)::int as t, {_P} as p from r, d where i < 15) group by i, w0, w1, w2)))
    select feature, round(w, 6) as weight from (select unnest(['constant', 'length', 'marks']) as feature, unnest([w0, w1, w2]) as w from r where i = 15)""")
def logistic_newton(spark, sf_dir):
    data = logistic.prepared(registry.labelled(spark, sf_dir), features.matrix("a", "b"), "y")
    w = logistic.newton(data, 3)
    discard(data)
    return linear.weights_table(spark, ["constant", "length", "marks"], w).select("feature", rounded("weight"))


_STEPS = tuple(10.0**k for k in range(-4, 3))
_STABLE = "case when s > 0 then -ln(1 + exp(-s)) else s - ln(1 + exp(s)) end"


@query(f"""with recursive {registry.LABELLED}, n as materialized (select count(*) as n, 10 * count(*) // 100 as total, greatest(1, (count(*) + 99) // 100 - 1) as m from d),
    o as materialized (select turn, a, b, (y = 1)::int as t, row_number() over (partition by turn order by md5((1000 + turn) || ':' || doc_id), doc_id) - 1 as place from d, n, range(20) r(turn) where turn * m < total),
    rows as materialized (select turn * m + place // 100 + 1 as step, a, b, t from o, n where place < m * 100),
    r(i, eta, w0, w1, w2) as (select 0::bigint, eta, 0.0::double, 0.0::double, 0.0::double from (select unnest([{', '.join(f'{s}::double' for s in _STEPS)}]) as eta) union all
        select i + 1, eta, w0 + eta / 100 * sum(e), w1 + eta / 100 * sum(e * a), w2 + eta / 100 * sum(e * b)
        from (select r.*, a, b, t - (case when w0 + w1 * a + w2 * b > 0 then {_P} else exp(w0 + w1 * a + w2 * b) / (1 + exp(w0 + w1 * a + w2 * b)) end) as e from r join rows on step = i + 1, n where i < total) group by i, eta, w0, w1, w2)
    select eta as step_size, i::int as iteration, round(avg((t - 1) * s + ({_STABLE})), 6) as log_likelihood from (select r.*, t, w0 + w1 * a + w2 * b as s from r join rows on step = i) group by eta, i""")
def mini_batch_step_sweep(spark, sf_dir):
    """Ten passes over all labelled rows in batches of 100 for each of the seven step sizes, as the reference has it."""
    swept = logistic.mini_batch(registry.labelled(spark, sf_dir), "doc_id", features.matrix("a", "b"), "y", steps=_STEPS, batch=100)
    return swept.select("step_size", "iteration", rounded("log_likelihood"))


_L2 = (0.0, 4.0, 10.0)
_PATH = registry.ascent_sql(_L2, 15)


def _weights(spark, sf_dir):
    data = logistic.prepared(registry.labelled(spark, sf_dir), features.matrix("a", "b"), "y")
    w, history = logistic.ascent(data, [0.0] * 3, 0.002, 15, _L2)
    discard(data)
    return w, history


@query(f"with path as ({_PATH}), u as (select l2, unnest(['constant', 'length', 'marks']) as feature, unnest([constant, length, marks]) as w from path) select feature, " + ", ".join(f"round(max(w) filter (l2 = {p}), 6) as l2_{p:g}" for p in _L2) + " from u group by feature")
def coefficient_path(spark, sf_dir):
    w, _ = _weights(spark, sf_dir)
    return logistic.coefficient_path(spark, ["constant", "length", "marks"], _L2, w).select("feature", *(rounded(f"l2_{p:g}") for p in _L2))


@query(f"""with path as ({_PATH}), u as (select unnest(['constant', 'length', 'marks']) as feature, unnest([constant, length, marks]) as w from path where l2 = 4)
    (select 'top' as "end", feature, round(w, 6) as weight from u order by w desc, feature limit 2) union all (select 'bottom', feature, round(w, 6) from u order by w, feature limit 2)""")
def extreme_coefficients(spark, sf_dir):
    w, _ = _weights(spark, sf_dir)
    path = logistic.coefficient_path(spark, ["constant", "length", "marks"], _L2, w)
    return logistic.extreme_features(path, "l2_4", 2).select("end", "feature", rounded("weight"))


@query(f"""with recursive {registry.LABELLED}, o as materialized (select *, row_number() over (order by md5('0:' || doc_id), doc_id) > ceil(0.2 * count(*) over () - 1e-9) as tr from d),
    path as materialized ({registry.ascent_sql(_L2, 15, '(select y, a, b from o where tr)', False)})
    select l2, round(avg(right_::int) filter (tr), 9) as train_accuracy, round(avg(right_::int) filter (not tr), 9) as validation_accuracy
    from (select l2, tr, (case when constant + length * a + marks * b > 0 then 1 else -1 end) = y as right_ from path, o) group by l2""")
def accuracy_by_penalty(spark, sf_dir):
    train, valid = (part.persist() for part in splits.train_test_split(registry.labelled(spark, sf_dir), "doc_id", 0.2))
    data = logistic.prepared(train, features.matrix("a", "b"), "y")
    w, _ = logistic.ascent(data, [0.0] * 3, 0.002, 15, _L2)
    report = logistic.accuracy_by_penalty(train, valid, features.matrix("a", "b"), "y", _L2, w)
    discard(data)
    for df in (train, valid):
        df.unpersist()
    return report.select("l2", rounded("train_accuracy", 9), rounded("validation_accuracy", 9))


@query(f"""with recursive {registry.LABELLED}, r(i, w0, w1, w2) as (select 0, 0.0::double, 0.0::double, 0.0::double union all
        select i + 1, w0 + 0.002 * sum(e), w1 + 0.002 * sum(e * a), w2 + 0.002 * sum(e * b) from (select r.*, a, b, (y = 1)::int - {_P} as e from r, d where i < 14) group by i, w0, w1, w2)
    select i::int as iteration, round(sum((y = 1)::int * s - s + ({_STABLE})), 4) as log_likelihood from (select i, y, w0 + w1 * a + w2 * b as s from r, d) group by i""")
def ascent_curve(spark, sf_dir):
    """The log-likelihood before each step: the series of the reference's plot."""
    _, history = _weights(spark, sf_dir)
    return spark.createDataFrame([(i, float(h[0])) for i, h in enumerate(history)], "iteration int, log_likelihood double").select("iteration", rounded("log_likelihood", 4))


_W = (2.0, 1.0, -30.0)
_S = "2 + a - 30 * b as s"


@query(f"with {registry.LABELLED} select doc_id, round(1 / (1 + exp(-s)), 9) as probability, (case when s > 0 then 1 else -1 end)::int as said from (select doc_id, {_S} from d)")
def scored_classes(spark, sf_dir):
    scored = registry.labelled(spark, sf_dir).select("doc_id", logistic.score(features.matrix("a", "b"), _W).alias("s"))
    return scored.select("doc_id", F.round(logistic.sigmoid(F.col("s")), 9).alias("probability"), logistic.predicted_class(F.col("s")).alias("said"))


@query(f"with {registry.LABELLED} select doc_id, round(s, 9) as score, row_number() over (order by s desc, doc_id)::int as rank from (select doc_id, {_S} from d) order by s desc, doc_id limit 5")
def top_scored_rows(spark, sf_dir):
    return logistic.top_scored(registry.labelled(spark, sf_dir), "doc_id", features.matrix("a", "b"), _W, 5).select("doc_id", rounded("score", 9), "rank")


@query(f"""with {registry.LABELLED}, l as (select sum((y = 1)::int * s - s + ({_STABLE})) as l, count(*) as n from (select y, {_S} from d))
    select round(l - 0.7, 4) as penalised, round(l / n, 9) as average, round((l - 0.7) / n, 9) as penalised_average from l""")
def likelihood_forms(spark, sf_dir):
    rows, s = registry.labelled(spark, sf_dir).persist(), F.lit(2.0) + F.col("a") - 30 * F.col("b")
    forms = {"penalised": (0.7, False, 4), "average": (0.0, True, 9), "penalised_average": (0.7, True, 9)}
    found = [metrics.log_likelihood(rows, s, "y", penalty=p, average=a).first()[0] for p, a, _ in forms.values()]
    rows.unpersist()
    return spark.createDataFrame([tuple(found)], ", ".join(f"{k} double" for k in forms)).select(*(rounded(k, d) for k, (_, _, d) in forms.items()))


#: All files that are there make one micro-batch.
_ALL_FILES = (1 << 31) - 1


@query(f"""with {registry.LABELLED}, one as (select 0.5 * avg(e) as w0, 0.5 * avg(e * a) as w1, 0.5 * avg(e * b) as w2 from (select a, b, (y = 1)::int - 0.5 as e from d where doc_id % 2 = 0)),
    two as (select any_value(w0) + 0.5 * avg(e) as w0, any_value(w1) + 0.5 * (avg(e * a) - 0.02 * any_value(w1)) as w1, any_value(w2) + 0.5 * (avg(e * b) - 0.02 * any_value(w2)) as w2 from (select w0, w1, w2, a, b, (y = 1)::int - {_P} as e from d, one where doc_id % 2 = 1))
    select feature, round(w, 9) as weight from (select unnest(['constant', 'length', 'marks']) as feature, unnest([w0, w1, w2]) as w from two)""".replace("- 0.02 * any_value(w1))", "- 0.02 * any_value(w1) / (select count(*) from d where doc_id % 2 = 1))").replace("- 0.02 * any_value(w2))", "- 0.02 * any_value(w2) / (select count(*) from d where doc_id % 2 = 1))"))
def online_logistic(spark, sf_dir):
    """A stream of two halves, replayed one a micro-batch, each a step of the trainer. A half is as many files as its tasks write."""
    rows, path = registry.labelled(spark, sf_dir), scratch(spark, "replay")
    trainer = online.OnlineLogistic(spark, features.matrix("a", "b"), "y", 3, step=0.5, penalty=0.01, store=scratch(spark, "trainer"))
    checkpoint = scratch(spark, "replay-state")
    for turn in (0, 1):
        # The stream goes on from its checkpoint, and the trainer from its weights.
        rows.where(F.col("doc_id") % 2 == turn).write.mode("append").parquet(path)
        trainer.run(online.replay(spark, path, "doc_id bigint, y int, a double, b double", files_per_batch=_ALL_FILES), checkpoint)
    return linear.weights_table(spark, ["constant", "length", "marks"], trainer.weights).select("feature", rounded("weight", 9))


@query("select epoch(date_trunc('hour', ts))::bigint as hour, event_type, count(*) as n from events group by all")
def streamed_windows(spark, sf_dir):
    """Counts of event-time windows from a replayed stream, as they stand when it ends."""
    path, out = scratch(spark, "events"), scratch(spark, "windows")
    table(spark, sf_dir, "events").select("ts", "event_type").repartition(3).write.parquet(path)
    counts = online.windowed_counts(online.replay(spark, path, "ts timestamp, event_type string", files_per_batch=1), "ts", ["event_type"], late="3650 days")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.unix_timestamp("window.start").alias("hour"), "event_type", "n").withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, "windows-state")).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema("hour bigint, event_type string, n bigint, batch int").parquet(out)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).select("hour", "event_type", "n")


# ---------------------------------------------------------------- clustering

_E = "e as materialized (select vec_id, embedding::double[] as v from embeddings)"


def _careful_sql(seed: int, k: int) -> str:
    """Tables k<seed>_<j>: the j-th centre (from 1) of a careful start."""
    out = [f"k{seed}_1 as materialized (select 1 as j, v as c from e order by md5('{seed}:' || vec_id), vec_id limit 1)"]
    for j in range(2, k + 1):
        before = " union all ".join(f"select c from k{seed}_{i}" for i in range(1, j))
        u = f"((('0x' || substr(md5('{seed}:{j - 1}:' || vec_id), 1, 13))::bigint + 0.5) / 4503599627370496.0::double)"
        out.append(f"k{seed}_{j} as materialized (select {j} as j, v as c from (select vec_id, any_value(v) as v, min(list_distance(v, c)) ** 2 as d2 from e, ({before}) group by vec_id) where d2 > 0 order by -ln({u}) / d2, vec_id limit 1)")
    return ", ".join(out)


def _lloyd_sql(rounds: int = 100) -> str:
    """Tables lloyd (i, run, cs: its centroids) and spread (run, heterogeneity after the last round), from starts (run, cs)."""
    near = "list_transform(cs, lambda c: list_distance(v, c))"
    return f"""lloyd(i, run, cs) as (select 0, run, cs from starts union all
        select i + 1, run, list(mean order by cl) from (
            select i, run, cl, list(x order by pos) as mean from (
                select i, run, cl, pos, avg(x) as x from (select i, run, list_position(ds, list_min(ds)) as cl, unnest(v) as x, unnest(range(len(v))) as pos from (select i, run, v, {near} as ds from lloyd, e where i < {rounds})) group by i, run, cl, pos)
            group by i, run, cl) group by i, run),
    spread as materialized (select run, sum(list_min({near}) ** 2) as heterogeneity from lloyd, e where i = {rounds} group by run)"""


_SEEDS = tuple(range(0, 140_000, 20_000))


def _start_of(seed: int, k: int) -> str:
    return f"(select list(c order by j) from ({' union all '.join(f'select * from k{seed}_{j}' for j in range(1, k + 1))}))"


@query(f"""with recursive {_E}, {', '.join(_careful_sql(s, 3) for s in _SEEDS)}, starts as materialized ({' union all '.join(f'select {s} as run, {_start_of(s, 3)} as cs' for s in _SEEDS)}), {_lloyd_sql()}
    select run::int as seed, round(heterogeneity, 6) as heterogeneity from spread order by heterogeneity, run limit 1""")
def kmeans_restarts(spark, sf_dir):
    """The best of the reference's seven seeds, each run until its clusters keep their members (500 passes at most)."""
    vectors = table(spark, sf_dir, "embeddings")
    seed, best = kmeans.restarts(vectors, "vec_id", "embedding", 3, seeds=_SEEDS)
    return spark.createDataFrame([(seed, best.heterogeneity)], "seed int, heterogeneity double").select("seed", rounded("heterogeneity"))


def _oversampled_sql(seed: int, m: int, rounds: int) -> str:
    """Tables o0 (the first candidate) and o1.. (those of each round): place, id and vector v."""
    out = [f"o0 as materialized (select 0 as place, vec_id, v from e order by md5('{seed}:' || vec_id), vec_id limit 1)"]
    for r in range(1, rounds + 1):
        before = " union all ".join(f"select v as c from o{i}" for i in range(r))
        u = f"((('0x' || substr(md5('{seed}:{r}:' || vec_id), 1, 13))::bigint + 0.5) / 4503599627370496.0::double)"
        out.append(f"o{r} as materialized (select row_number() over (order by race, vec_id) + {(r - 1) * m} as place, vec_id, v from (select vec_id, v, -ln({u}) / d2 as race from (select vec_id, any_value(v) as v, min(list_distance(v, c)) ** 2 as d2 from e, ({before}) group by vec_id) where d2 > 0) order by place limit {m})")
    return ", ".join(out)


@query(f"""with {_E}, {_oversampled_sql(5, 20, 3)}, o as materialized ({' union all '.join(f'select * from o{r}' for r in range(4))}),
    near as (select vec_id, arg_min(place, (d, place)) as place from (select e.vec_id, o.place, list_distance(e.v, o.v) as d from e, o) group by vec_id)
    select o.place::int as place, o.vec_id, coalesce(n, 0)::bigint as size from o left join (select place, count(*) as n from near group by place) using (place)""")
def kmeans_oversampled(spark, sf_dir):
    """Candidate centres of three rounds of twenty over all vectors, and how many vectors are nearest to each."""
    vectors = table(spark, sf_dir, "embeddings")
    points, sizes = kmeans.oversampled(vectors, "vec_id", "embedding", 20, rounds=3, seed=5)
    rows = spark.createDataFrame([(i, [float(x) for x in p], int(n)) for i, (p, n) in enumerate(zip(points, sizes, strict=True))], "place int, v array<double>, size bigint")
    named = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.join(named.groupBy("v").agg(F.min("vec_id").alias("vec_id")), "v").select("place", "vec_id", "size")


_KS = (2, 3, 5)


@query(f"""with recursive {_E}, {', '.join(_careful_sql(s, 5) for s in _SEEDS[:2])}, starts as materialized ({' union all '.join(f'select {k * 1_000_000 + s} as run, {_start_of(s, k)} as cs' for k in _KS for s in _SEEDS[:2])}), {_lloyd_sql()}
    select (run // 1000000)::int as k, round(min(heterogeneity), 6) as heterogeneity from spread group by 1""")
def heterogeneity_by_k(spark, sf_dir):
    rows = kmeans.heterogeneity_by_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _KS, _SEEDS[:2])
    return spark.createDataFrame([(k, h) for k, _, h in rows], "k int, heterogeneity double").select("k", rounded("heterogeneity"))


def _centre_rows(spark, centres) -> DataFrame:
    rows = [(j, i, float(x)) for j, c in enumerate(centres) for i, x in enumerate(c)]
    return spark.createDataFrame(rows, "place int, component int, value double").select("place", "component", rounded("value", 9))


@query(f"with {_E}, {_careful_sql(7, 4)} select (j - 1)::int as place, unnest(range(len(c)))::int as component, round(unnest(c), 9) as value from ({' union all '.join(f'select * from k7_{j}' for j in range(1, 5))})")
def kmeans_careful_start(spark, sf_dir):
    return _centre_rows(spark, kmeans.careful_start(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, seed=7))


@query(f"with {_E}, f as (select row_number() over (order by md5('3:' || vec_id), vec_id) - 1 as place, v from e order by place limit 4) select place::int as place, unnest(range(len(v)))::int as component, round(unnest(v), 9) as value from f")
def kmeans_random_start(spark, sf_dir):
    return _centre_rows(spark, kmeans.random_start(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, seed=3))


@query(f"""with recursive {_E}, starts as materialized (select 1 as run, list(v order by vec_id) as cs from (select * from e order by vec_id limit 4)), {_lloyd_sql()}
    select (j - 1)::int as place, unnest(range(len(c)))::int as component, round(unnest(c), 9) as value from (select unnest(range(1, 5)) as j, unnest(cs) as c from lloyd where i = 100)""")
def kmeans_converged(spark, sf_dir):
    """The centroids of a run from the first four vectors, once its clusters keep their members."""
    return _centre_rows(spark, kmeans.lloyd(table(spark, sf_dir, "embeddings"), "embedding", registry.first_vectors(spark, sf_dir)).centroids)


_TFIDF = f"""{registry.TOKENS}, bag as (select doc_id, term, count(*) as tf from t group by all), df as (select term, count(*) as df from bag group by term), total as (select count(distinct doc_id) as n from bag),
    x as materialized (select doc_id, term, tf * ln(n / df::double) as value from bag join df using (term), total),
    c as materialized (select 0 as cluster, term, value from x where doc_id = (select min(doc_id) from x) union all select 1, term, value from x where doc_id = (select max(doc_id) from x)),
    own as (select doc_id, sum(value * value) as xx from x group by doc_id), cc as (select cluster, sum(value * value) as cc from c group by cluster), xc as (select doc_id, cluster, sum(x.value * c.value) as xc from x join c using (term) group by doc_id, cluster),
    a as materialized (select doc_id, cluster, d from (select own.doc_id, cc.cluster, greatest(xx - 2 * coalesce(xc, 0) + cc, 0) as d from own cross join cc left join xc on xc.doc_id = own.doc_id and xc.cluster = cc.cluster) qualify row_number() over (partition by doc_id order by d, cluster) = 1),
    r as materialized (select cluster, term, round(sum(value) / any_value(n), 9) as value from x join a using (doc_id) join (select cluster, count(*) as n from a group by cluster) using (cluster) group by cluster, term)"""


def _text_rows(spark, sf_dir) -> tuple[DataFrame, list]:
    """All documents for kmeans.tf_idf_step, and the ids of the first and the last one with a word."""
    documents = table(spark, sf_dir, "documents")
    ends = documents.where(text.has_letter_words(F.col("text"))).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    return text.letter_rows(documents, "doc_id", F.col("text")), [ends["a"], ends["b"]]


def _text_clusters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """One assignment of all documents to the first and the last one by TF-IDF, and the clusters' means."""
    rows, ends = _text_rows(spark, sf_dir)
    assigned, centroids = kmeans.tf_idf_step(rows, "doc_id", ends)
    return assigned, centroids.withColumn("value", F.round("value", 9))


@query(f"with {_TFIDF} select cluster, row_number() over (partition by cluster order by value desc, term)::int as rank, term, round(value, 6) as value from r qualify rank <= 5")
def cluster_terms(spark, sf_dir):
    rows, ends = _text_rows(spark, sf_dir)
    centroids = kmeans.tf_idf_means(rows, "doc_id", ends).withColumn("value", F.round("value", 9))
    return kmeans.top_terms(centroids, 5).select("cluster", "rank", "term", rounded("value"))


@query(f"""with {_TFIDF}, w as (select cluster, array_to_string(list(term order by k), ' ') as terms from (select *, row_number() over (partition by cluster order by value desc, term) as k from r) where k <= 5 group by cluster),
    m as (select cluster, array_to_string(list(title order by k), '|') as members from (select a.cluster, substr(text, 1, 12) as title, row_number() over (partition by a.cluster order by round(d, 6), a.doc_id) as k from a join documents using (doc_id)) where k <= 8 group by cluster)
    select cluster, terms, members from w join m using (cluster)""")
def described_clusters(spark, sf_dir):
    assigned, centroids = _text_clusters(spark, sf_dir)
    titles = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 12).alias("title"))
    told = kmeans.described(centroids, assigned.withColumn("squared_distance", F.round("squared_distance", 6)), titles, "doc_id", "title")
    return told.select("cluster", F.concat_ws(" ", "terms").alias("terms"), F.concat_ws("|", "members").alias("members"))
