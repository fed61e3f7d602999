"""Registered queries over wide one-hot tables: a dictionary of all values, a deep tree and a long ensemble on sparse rows."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features
from ..operators import trees
from ..session import stored, table
from .registry import query, rounded

#: Columns of orders whose values become features, in Spark's and in the other engine's SQL: some 170 values.
_COLUMNS = {
    "priority": ("o_orderpriority", "o_orderpriority"),
    "status": ("o_orderstatus", "o_orderstatus"),
    "month": ("date_format(o_orderdate, 'yyyy-MM')", "strftime(o_orderdate, '%Y-%m')"),
    "day": ("dayofmonth(o_orderdate)", "day(o_orderdate)"),
    "price": ("cast(floor(o_totalprice / 10000) as bigint)", "floor(o_totalprice / 10000)::bigint"),
}
#: Most columns matter, and so does the customer, whom no feature shows.
_LABEL = "o_totalprice / 1000 + case when month(o_orderdate) > 6 then 60 else 0 end + case when o_orderpriority < '3' then 50 else 0 end + 2 * {day}(o_orderdate) + 30 * (o_custkey % 3) > 240"
_DEPTH, _STAGES = 10, 120

_LONG = " union all ".join(f"select o_orderkey as k, '{c}=' || ({sql})::varchar as feature from orders where ({sql}) is not null" for c, (_, sql) in _COLUMNS.items())
_ROWS = f"""long as (select distinct k, feature from ({_LONG})), dict as materialized (select feature, (row_number() over (order by feature) - 1)::int as i from (select distinct feature from long)),
    l as materialized (select k, i from long join dict using (feature)), o as materialized (select o_orderkey as k, case when {_LABEL.format(day="day")} then 1 else -1 end as y from orders)"""


def wide_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """o_orderkey, y and ids of each order, and the names of the features."""
    orders = table(spark, sf_dir, "orders")
    made = orders.select("o_orderkey", *(F.expr(sql).alias(c) for c, (sql, _) in _COLUMNS.items()))
    ids, dictionary = features.one_hot_sparse(made, "o_orderkey", list(_COLUMNS))
    y = orders.select("o_orderkey", F.when(F.expr(_LABEL.format(day="dayofmonth")), 1).otherwise(-1).alias("y"))
    # Some 170 names, as many as the chosen columns have values.
    return stored(ids.join(y, "o_orderkey"), "wide-rows"), [r["feature"] for r in dictionary.orderBy("feature_id").collect()]


@query(f"with {_ROWS} select feature, i as feature_id, count(*) as size from l join dict using (i) group by all")
def one_hot_dictionary(spark, sf_dir):
    """The numbered values of all columns, and how many rows have each."""
    orders = table(spark, sf_dir, "orders")
    made = orders.select("o_orderkey", *(F.expr(sql).alias(c) for c, (sql, _) in _COLUMNS.items()))
    ids, dictionary = features.one_hot_sparse(made, "o_orderkey", list(_COLUMNS))
    sizes = ids.select(F.explode("ids").alias("feature_id")).groupBy("feature_id").agg(F.count(F.lit(1)).alias("size"))
    return dictionary.join(sizes, "feature_id").select("feature", "feature_id", "size")


@lru_cache(maxsize=1)
def _tree_sql() -> str:
    """Tables lv0, lv1, ..: path, p, n and f, the feature that a node asks for (null at a leaf). A feature that no row of a node has cannot split it."""
    out = ["r0 as materialized (select k, y, '' as path, []::int[] as used from o)"]
    for d in range(_DEPTH + 1):
        out.append(f"""t{d} as materialized (select path, any_value(used) as used, count(*) filter (y = 1) as p, count(*) filter (y <> 1) as n from r{d} group by path),
        c{d} as materialized (select path, i, p1, n1, p - p1 as p0, n - n1 as n0, row_number() over (partition by path order by least(p - p1, n - n1) + least(p1, n1), abs((p + n) - 2 * (p1 + n1)), i) as place
            from (select path, i, count(*) filter (y = 1) as p1, count(*) filter (y <> 1) as n1 from r{d} join l using (k) group by path, i) join t{d} using (path) where not list_contains(used, i)),
        lv{d} as materialized (select t{d}.path, p, n, case when {d} < {_DEPTH} and least(p, n) > 0 and p0 + n0 > 0 then i end as f from t{d} left join c{d} on c{d}.path = t{d}.path and place = 1)""")
        if d < _DEPTH:
            out.append(f"r{d + 1} as materialized (select r{d}.k, y, r{d}.path || (case when l.k is null then '0' else '1' end) as path, list_append(used, f) as used from r{d} join lv{d} using (path) left join l on l.k = r{d}.k and l.i = f where f is not null)")
    return ", ".join(out)


@query(f"""with {_ROWS}, {_tree_sql()} select depth::int as depth, path, feature, (case when f is null then case when p > n then 1 else -1 end end)::int as prediction, (p + n)::double as size
    from ({' union all '.join(f'select {d} as depth, path, p, n, f from lv{d}' for d in range(_DEPTH + 1))}) left join dict on i = f""")
def wide_tree_nodes(spark, sf_dir):
    """A tree of depth 10 over all features of all orders."""
    rows, names = wide_rows(spark, sf_dir)
    return trees.grow(rows, "ids", "y", names, max_depth=_DEPTH, sparse=True).table(spark).select("depth", "path", "feature", "prediction", "size")


@lru_cache(maxsize=1)
def _boost_sql() -> str:
    """Tables b<t> (the stump of round t) and g<t> (k, y, s and u: the weighted and plain votes before round t)."""
    out = ["g0 as materialized (select k, y, 0.0::double as s, 0::bigint as u from o), used0 as (select null::int as i where false)"]
    for t in range(_STAGES):
        out.append(f"""w{t} as materialized (select k, y, exp(-y * s) as w from g{t}), m{t} as (select sum(w) filter (y = 1) as p, sum(w) filter (y <> 1) as n from w{t}),
        b{t} as materialized (select i, least(greatest((least(p - p1, n - n1) + least(p1, n1)) / (p + n), 1e-10), 1 - 1e-10) as e, (case when p - p1 >= n - n1 then 1 else -1 end)::int as l, (case when p1 >= n1 then 1 else -1 end)::int as r
            from (select i, coalesce(sum(w) filter (y = 1), 0) as p1, coalesce(sum(w) filter (y <> 1), 0) as n1 from w{t} join l using (k) group by i), m{t} where i not in (select i from used{t}) order by round((least(p - p1, n - n1) + least(p1, n1)) / (p + n), 12), i limit 1),
        used{t + 1} as materialized (select i from used{t} union all select i from b{t}),
        g{t + 1} as materialized (select g{t}.k, y, s + 0.5 * ln((1 - e) / e) * (case when h.k is null then l else r end) as s, u + (case when h.k is null then l else r end) as u from g{t} cross join b{t} left join (select k from l where i = (select i from b{t})) h on h.k = g{t}.k)""")
    return ", ".join(out)


@query(f"with {_ROWS}, {_boost_sql()} " + " union all ".join(f"select {t + 1} as round, feature, round(e, 9) as error, round(0.5 * ln((1 - e) / e), 9) as coefficient, l as left_label, r as right_label from b{t} join dict using (i)" for t in range(_STAGES)))
def wide_boosted_stumps(spark, sf_dir):
    """120 rounds over all features of all orders."""
    rows, names = wide_rows(spark, sf_dir)
    stumps = trees.adaboost(rows, "ids", "y", names, _STAGES, sparse=True)
    told = [(t, names[s.feature], s.error, s.coefficient, s.left, s.right) for t, s in enumerate(stumps, 1)]
    return spark.createDataFrame(told, "round int, feature string, error double, coefficient double, left_label int, right_label int").select("round", "feature", rounded("error", 9), rounded("coefficient", 9), "left_label", "right_label")


@query(f"with {_ROWS}, {_boost_sql()} " + " union all ".join(f"select {t} as stage, round(avg(((case when u > 0 then 1 else -1 end) <> y)::int), 9) as error, round(avg(((case when s > 0 then 1 else -1 end) <> y)::int), 9) as weighted_error from g{t} having count(*) > 0" for t in range(1, _STAGES + 1)))
def wide_staged_error(spark, sf_dir):
    """The error of each of the 120 stages, by plain and by weighted votes."""
    rows, names = wide_rows(spark, sf_dir)
    stumps = trees.adaboost(rows, "ids", "y", names, _STAGES, sparse=True)
    said = [trees.staged_error(rows, stumps, "ids", "y", vote, sparse=True, width=len(names)).select("stage", F.round("error", 9).alias(name)) for vote, name in (("unweighted", "error"), ("weighted", "weighted_error"))]
    return said[0].join(said[1], "stage")
