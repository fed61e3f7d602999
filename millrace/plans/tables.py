"""Registered queries over sources, sinks, row selection, splits, scalars and texts, and the SQL that each has to agree with."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import features, text
from ..operators import linear, metrics, splits, trees
from ..session import scratch, stored, table
from ..sources import io
from . import registry
from .registry import query, rounded

# ---------------------------------------------------------------- sources and sinks

_CSV_COLUMNS = {"p_partkey": int, "p_name": str, "p_type": str, "p_size": int, "p_retailprice": float}
_CSV_ROWS = "p_partkey, concat(p_name, ', \"', p_brand, '\"') as p_name, p_type, p_size::bigint as p_size, case when p_partkey % 7 = 0 then null else p_retailprice end as p_retailprice"


def _csv(spark, sf_dir) -> str:
    """The parts as CSV with quoted commas and quotes, and NaN for a missing price."""
    path = scratch(spark, "parts-csv")
    part = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    price = F.when(F.col("p_partkey") % 7 == 0, float("nan")).otherwise(F.col("p_retailprice"))
    part.select("p_partkey", name.alias("p_name"), "p_type", "p_size", price.alias("p_retailprice")).write.option("header", True).option("escape", '"').csv(path)
    return path


@query(f"select {_CSV_ROWS} from part")
def csv_declared(spark, sf_dir):
    return io.read_csv(spark, _csv(spark, sf_dir), _CSV_COLUMNS, line_breaks=False)


@query(f"select {_CSV_ROWS} from part")
def csv_inferred(spark, sf_dir):
    return io.read_csv(spark, _csv(spark, sf_dir)).select(*(F.col(c).cast("bigint") if c in ("p_partkey", "p_size") else F.col(c) for c in _CSV_COLUMNS))


@query("select n_name as term, n_nationkey::bigint as term_id from nation")
def json_map(spark, sf_dir):
    path = scratch(spark, "nations-json")
    io.write_json(spark, {r["n_name"]: r["n_nationkey"] for r in table(spark, sf_dir, "nation").collect()}, path)
    return io.read_json_map(spark, path)


@query("select o_orderkey, case when o_custkey % 5 < 3 then 'train' else 'validation' end as part from orders where o_custkey % 5 < 4")
def index_file_split(spark, sf_dir):
    """Rows named by two JSON lists of customer keys."""
    orders, parts = table(spark, sf_dir, "orders"), []
    keys = orders.select("o_custkey").distinct()
    for name, wanted in (("train", (0, 1, 2)), ("validation", (3,))):
        path = scratch(spark, f"{name}-json")
        io.write_json_lists(keys.where((F.col("o_custkey") % 5).isin(*wanted)), "o_custkey", path)
        inside, _ = splits.index_split(orders, "o_custkey", io.read_json_list(spark, path, whole=False))
        parts.append(inside.select("o_orderkey", F.lit(name).alias("part")))
    return parts[0].unionByName(parts[1])


@query("select n_nationkey::bigint as doc_id, n_regionkey as term_id, n_nationkey + 0.5::double as value from nation union all select n_nationkey, n_regionkey + 5, 1.0 from nation where n_nationkey % 2 = 0")
def sparse_archive(spark, sf_dir):
    path = scratch(spark, "matrix") + "/matrix.npz"
    data, indices, starts = [], [], [0]
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        data += [r["n_nationkey"] + 0.5] + [1.0] * (r["n_nationkey"] % 2 == 0)
        indices += [r["n_regionkey"]] + [r["n_regionkey"] + 5] * (r["n_nationkey"] % 2 == 0)
        starts.append(len(data))
    io.write_sparse_npz(path, np.array(data), np.array(indices), np.array(starts), (len(starts) - 1, 10))
    return io.read_sparse_npz(spark, path)


@query("""select name, row::int as row, component::int as component, value, true as missing_is_none from (
    select 'means' as name, n_regionkey as row, 0 as component, avg(n_nationkey) as value from nation group by n_regionkey
    union all select 'sizes', n_regionkey, 0, count(*)::double from nation group by n_regionkey)""")
def stored_arrays(spark, sf_dir):
    """Arrays written, found again, and told from a path where there are none."""
    path = scratch(spark, "arrays")
    missing = io.read_arrays(spark, path) is None
    per = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.avg("n_nationkey").alias("m"), F.count(F.lit(1)).alias("n")).orderBy("n_regionkey").collect()
    io.write_arrays(spark, {"means": np.array([[r["m"]] for r in per]), "sizes": np.array([r["n"] for r in per])}, path)
    rows = [(name, i, j, float(v), missing) for name, a in io.read_arrays(spark, path).items() for i, line in enumerate(a) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "name string, row int, component int, value double, missing_is_none boolean")


@query("""select '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' as value from region""")
def json_report(spark, sf_dir):
    return io.to_json_lines(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query(f"""with {registry.FEATURE_COUNTS}, b as (select * from f order by least(p0, n0) + least(p1, n1), abs(p0 + n0 - p1 - n1), i limit 1),
    t as (select unnest(['digraph tree {{', '0 [label="' || name || '"];', '1 [label="' || (case when p0 > n0 then '1' else '-1' end) || '"];', '2 [label="' || (case when p1 > n1 then '1' else '-1' end) || '"];', '0 -> 1;', '0 -> 2;', '}}']) as line from b) select line from t""")
def tree_graph(spark, sf_dir):
    tree = trees.grow(registry.tree_rows(spark, sf_dir), "x", "y", registry.TREE_NAMES, max_depth=1)
    return spark.createDataFrame([(line,) for line in tree.dot().split("\n")], "line string")


@query("""with f as (select regr_intercept(p_retailprice, p_size) as i, regr_slope(p_retailprice, p_size) as s, min(p_size) as lo, max(p_size) as hi from part)
    select k::int as point, round(lo + (hi - lo) * k / 20.0::double, 6) as x, round(i + s * (lo + (hi - lo) * k / 20.0::double), 4) as y from f, range(21) t(k)""")
def regression_line_series(spark, sf_dir):
    """The fitted line as the points of a plot."""
    part = table(spark, sf_dir, "part")
    fit, ends = linear.simple_regression(part, "p_size", "p_retailprice").first(), part.agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi")).first()
    x = F.lit(ends["lo"]) + F.lit(ends["hi"] - ends["lo"]) * F.col("id") / F.lit(20.0)
    return spark.range(21).select(F.col("id").cast("int").alias("point"), F.round(x, 6).alias("x"), F.round(linear.predict_simple(x, fit["intercept"], fit["slope"]), 4).alias("y"))


# ---------------------------------------------------------------- rows

@query("select l_orderkey, l_linenumber, nullif(l_linenumber, 2) as rating from lineitem where nullif(l_linenumber, 2) is distinct from 3")
def neutral_filter(spark, sf_dir):
    """rating != 3, where a missing rating differs from 3."""
    rated = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_linenumber", F.lit(2)).alias("rating"))
    return rated.where(features.differs("rating", 3))


_GAPS = "case when o_orderkey % 3 = 0 then null else o_orderkey end"


@query("select part, rows::bigint as rows from (select 'test' as part, ceil(0.4 * count(*) - 1e-9) as rows from orders union all select 'train', count(*) - ceil(0.4 * count(*) - 1e-9) from orders)")
def split_sizes_with_null_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.expr(_GAPS).alias("id"), "o_totalprice")
    train, test = splits.train_test_split(rows, "id", 0.4)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
    return one(train, "train").unionByName(one(test, "test"))


@query(f"""with s as (select {_GAPS} as id, o_orderkey from orders), r as (select id, row_number() over (order by md5('5:' || coalesce(id::varchar, '')), id nulls first) - 1 as place from s) select place, id from r""")
def shuffle_with_null_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.expr(_GAPS).alias("id"))
    return splits.shuffle_rank(rows, "id", 5, "place").select("place", "id")


@query("select quality, count(*) as rows from (select quality from labels where quality = 0 union all (select quality from labels where quality = 1 limit (select count(*) from labels where quality = 0))) group by quality")
def balanced_with_null_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.expr("case when doc_id % 4 = 0 then null else doc_id end").alias("doc_id"), "quality")
    return splits.balanced(rows, "doc_id", "quality", keep_all=0).groupBy("quality").agg(F.count(F.lit(1)).alias("rows"))


@query("select c_custkey, row_number() over (order by case when c_custkey % 9 = 0 then null else c_mktsegment end nulls first, c_custkey) - 1 as row_id from customer")
def row_ids_by_name(spark, sf_dir):
    """Rows numbered in the order of a string column with few values and nulls."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.expr("case when c_custkey % 9 = 0 then null else c_mktsegment end").alias("segment"))
    return io.with_row_id(customers, ["segment", "c_custkey"]).select("c_custkey", "row_id")


@query("select row_number() over (order by c_mktsegment) - 1 as row_id, c_mktsegment from customer")
def row_ids_of_one_value(spark, sf_dir):
    return io.with_row_id(table(spark, sf_dir, "customer").select("c_mktsegment"), ["c_mktsegment"])


@query("select doc_id, quality, (case when toxic = 0 then 1 else -1 end)::int as safe from labels")
def label_from_flag(spark, sf_dir):
    return features.label_from_flag(table(spark, sf_dir, "labels"), "toxic", "safe")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity <> 5 and l_linenumber <> 1")
def drop_missing(spark, sf_dir):
    gaps = table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(1)).alias("l_linenumber"), F.when(F.col("l_quantity") == 5, float("nan")).otherwise(F.col("l_quantity")).alias("l_quantity"))
    return features.drop_missing(gaps)


@query("select s_suppkey, trunc(s_acctbal)::bigint as whole, trunc(-s_acctbal / 7)::bigint as negative from supplier")
def truncating_cast(spark, sf_dir):
    balance = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", features.truncated(balance).alias("whole"), features.truncated(-balance / 7).alias("negative"))


@query("select r_regionkey, r_name, case when r_regionkey > 2 then 1 end as sparse from region")
def constant_columns_removed(spark, sf_dir):
    wide = table(spark, sf_dir, "region").select("*", F.lit("same").alias("same"), F.lit(None).cast("int").alias("empty"), F.when(F.col("r_regionkey") > 2, 1).alias("sparse"))
    return features.drop_constant(wide)


@query("select unnest(['o_orderstatus', 'o_orderpriority', 'late']) as \"column\", unnest([count(distinct o_orderstatus), count(distinct o_orderpriority), 2]) as n_values from orders")
def distinct_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("late", F.when(F.month("o_orderdate") > 6, 1))
    return features.distinct_values(orders, ["o_orderstatus", "o_orderpriority", "late"])


@query("select o_orderkey, o_custkey % 2 = 0 as listed from orders where o_custkey % 2 = 0 or o_custkey % 3 = 0")
def rows_by_key_list(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    listed, others = splits.index_split(orders, "o_custkey", orders.where("o_custkey % 2 = 0").select("o_custkey").distinct())
    return listed.select("o_orderkey", F.lit(True).alias("listed")).unionByName(others.where("o_custkey % 3 = 0").select("o_orderkey", F.lit(False).alias("listed")))


@query("select t::int as turn, o_orderkey, row_number() over (partition by t order by md5((2000 + t) || ':' || o_orderkey), o_orderkey) - 1 as place from orders, range(3) r(t)")
def pass_permutations(spark, sf_dir):
    return splits.pass_ranks(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3, 2).select("turn", "o_orderkey", "place")


@query("select event_id, round(avg(value) over (order by event_id rows between 29 preceding and current row), 6) as moving_average from events qualify row_number() over (order by event_id) >= 30")
def moving_average_whole(spark, sf_dir):
    """One history over all rows, dealt in chunks."""
    return metrics.moving_average(table(spark, sf_dir, "events"), "event_id", "value", 30, chunk_rows=500).withColumn("moving_average", F.round("moving_average", 6))


# ---------------------------------------------------------------- scalars

@query("""select l_orderkey, l_linenumber, round(log10(l_extendedprice), 9) as log10_price, ceil(l_quantity / 7)::bigint as sevens, round(exp(-l_discount), 9) as kept, round(abs(l_discount - 0.05), 9) as gap,
    isinf(case when l_quantity > 25 then 'inf'::double else l_quantity end) as overflows from lineitem""")
def scalar_functions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.log10("l_extendedprice"), 9).alias("log10_price"), F.ceil(F.col("l_quantity") / 7).alias("sevens"), F.round(F.exp(-F.col("l_discount")), 9).alias("kept"),
        F.round(F.abs(F.col("l_discount") - 0.05), 9).alias("gap"), (F.exp(F.when(F.col("l_quantity") > 25, 800.0).otherwise(1.0)) == float("inf")).alias("overflows"))


@query("select p_partkey, round((p_size / 50.0::double) ** 2, 12) as power_2, round((p_size / 50.0::double) ** 15, 12) as power_15 from part")
def power_arrays(spark, sf_dir):
    made = table(spark, sf_dir, "part").select("p_partkey", features.power_array(F.col("p_size") / 50.0, 15).alias("p"))
    return made.select("p_partkey", F.round(F.col("p")[1], 12).alias("power_2"), F.round(F.col("p")[14], 12).alias("power_15"))


@query("""with p as (select l_quantity, l_discount from lineitem), n as (select sqrt(sum(l_quantity ** 2)) as a, sqrt(sum(l_discount ** 2)) as b from p)
    select l_orderkey, l_linenumber, round(l_quantity / a, 12) as l_quantity, round(l_discount / b, 12) as l_discount from lineitem, n""")
def normalised_columns(spark, sf_dir):
    scaled, _ = features.normalise(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return scaled.select("l_orderkey", "l_linenumber", rounded("l_quantity", 12), rounded("l_discount", 12))


@query("""with e as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 10 as w, max(o_totalprice) as hi from orders),
    b as (select i::int as bin, lo + (i - 1) * w as low, case when i = 10 then hi else lo + i * w end as high from e, range(1, 11) t(i))
    select bin, count(o_orderkey) as rows from b left join orders on o_totalprice >= low and (o_totalprice < high or (bin = 10 and o_totalprice <= high)) group by bin""")
def one_hot_bins_wide(spark, sf_dir):
    """The sums of the ten 0/1 columns of one numeric column."""
    wide, names = features.one_hot_binned(table(spark, sf_dir, "orders"), "o_totalprice")
    sums = wide.agg(*(F.sum(F.col(f"`{n}`")).alias(f"b{i}") for i, n in enumerate(names, 1)))
    return sums.select(F.posexplode(F.array(*(F.col(f"b{i}") for i in range(1, len(names) + 1)))).alias("i", "rows")).select((F.col("i") + 1).alias("bin"), "rows")


@query("select 'o_orderstatus=' || o_orderstatus as feature, count(*) as rows from orders group by o_orderstatus")
def one_hot_wide(spark, sf_dir):
    wide, names = features.one_hot(table(spark, sf_dir, "orders"), ["o_orderstatus"])
    sums = wide.agg(*(F.sum(F.col(f"`{n}`")).alias(n) for n in names)).select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("rows")) for n in names))).alias("r"))
    return sums.select("r.feature", "r.rows")


# ---------------------------------------------------------------- texts

@query("select doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_]+'))::int as n_tokens, regexp_extract(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_]+') as first_token from documents")
def regex_tokens(spark, sf_dir):
    words = text.tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("first_token"))


_VOCABULARY = ("the", "of", "and", "in", "to", "is", "for", "with", "on", "as", "de", "la", "que", "der", "die", "und", "le", "les", "el", "en")


@query(f"""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') as w from documents)
    select doc_id, array_to_string([{', '.join(f"len(list_filter(w, lambda x: x = '{v}'))" for v in _VOCABULARY)}], ' ') as counts from w""")
def fixed_vocabulary_counts(spark, sf_dir):
    counted = text.vectorised(text.letters_only(F.col("text")), _VOCABULARY)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", F.transform(counted, lambda c: c.cast("string"))).alias("counts"))


@query(f"with {registry.TOKENS}, b as (select doc_id, term, count(*) as tf from t group by all) select doc_id, count(*)::int as n_terms, sum(tf)::bigint as total, coalesce(max(tf) filter (term = 'the'), 0)::double as the, coalesce(max(tf) filter (term = 'und'), 0)::double as und from b group by doc_id")
def row_maps(spark, sf_dir):
    """A row's terms as a map, taken apart again, and as a sparse row of two given terms."""
    # Written once: the maps are taken apart, and looked up.
    maps = stored(text.as_maps(registry.bag(spark, sf_dir), "doc_id", "tf"), "maps")
    values = text.sparse_row(F.col("terms"), ["the", "und"])
    lines = text.map_terms(maps, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_terms"), F.sum("value").alias("total"))
    return lines.join(maps.select("doc_id", values[0].alias("the"), values[1].alias("und")), "doc_id")


@query(f"with {registry.TOKENS}, b as (select doc_id, term, count(*) as tf from t group by all), v as (select distinct term from b where doc_id % 2 = 0) select doc_id, count(*) as n_known, sum(tf)::bigint as total from b where doc_id % 2 = 1 and term in (select term from v) group by doc_id")
def learned_vocabulary_applied(spark, sf_dir):
    bag = registry.bag(spark, sf_dir)
    known = text.within_vocabulary(bag.where("doc_id % 2 = 1"), text.vocabulary(bag.where("doc_id % 2 = 0")))
    return known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_known"), F.sum("tf").alias("total"))


@query(f"with {registry.TOKENS}, b as (select doc_id, term, count(*) as tf from t group by all) select doc_id, round(max(tf / n), 9) as greatest, round(sum((tf / n) ** 2), 6) as length from (select *, sqrt(sum(tf ** 2) over (partition by doc_id)) as n from b) group by doc_id")
def normalised_rows(spark, sf_dir):
    scaled = text.row_normalised(registry.bag(spark, sf_dir).withColumn("value", F.col("tf").cast("double")), "doc_id")
    return scaled.groupBy("doc_id").agg(F.round(F.max("value"), 9).alias("greatest"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("length"))


@query(f"with {registry.TOKENS}, i as (select term, row_number() over (order by term) - 1 as term_id from (select distinct term from t)) select term_id, term from i where term_id % 10 = 0")
def inverted_vocabulary(spark, sf_dir):
    inverse = text.inverted(text.term_ids(registry.bag(spark, sf_dir)))
    return inverse.where("term_id % 10 = 0").select(F.col("term_id").cast("bigint").alias("term_id"), "term")
