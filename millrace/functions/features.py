"""Feature columns: labels, indicators, derived numbers, powers, one-hot encodings, constant columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.splits import value_rank


def differs(column: str, value) -> Column:
    """True where the column is not the value, so also where it is null: the rule of data frames whose missing numbers differ from all."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """df without the rows that have a null (or NaN) in any of the columns."""
    return df.na.drop("any", subset=list(columns) if columns is not None else None)


def truncated(column: Column) -> Column:
    """The whole part of a number, towards zero."""
    return column.cast("bigint")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column and how many distinct values it has, null among them."""
    counts = df.agg(*((F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n_values")) for c in columns))).alias("r")).select("r.column", "r.n_values")


def sign_label(condition: Column) -> Column:
    """+1 where the condition holds, else -1 (so also where it is null)."""
    return F.when(condition, 1).otherwise(-1)


def label_from_flag(df: DataFrame, flag: str, name: str) -> DataFrame:
    """+1 where the flag is 0, else -1; the flag goes."""
    return df.withColumn(name, sign_label(F.col(flag) == 0)).drop(flag)


def indicator(count: Column) -> Column:
    """1 where something was counted."""
    return (count > 0).cast("int")


def constant() -> Column:
    return F.lit(1.0)


def matrix(*columns: str, intercept: bool = True) -> Column:
    """The row of a design matrix as one array, the constant first."""
    return F.array(*([constant()] if intercept else []), *(F.col(c).cast("double") for c in columns))


def derived(df: DataFrame, squares: Sequence[str] = (), products: Sequence[tuple[str, str]] = (), logs: Sequence[str] = (), sums: Sequence[tuple[str, str]] = (), roots: Sequence[str] = ()) -> DataFrame:
    """df with squares, products, natural logarithms, sums and square roots of columns; logs and roots out of domain are null."""
    number = lambda c: F.col(c).cast("double")
    made = {f"{c}_squared": number(c) * number(c) for c in squares}
    made |= {f"{a}_times_{b}": number(a) * number(b) for a, b in products}
    made |= {f"log_{c}": F.when(number(c) > 0, F.log(number(c))) for c in logs}
    made |= {f"{a}_plus_{b}": number(a) + number(b) for a, b in sums}
    made |= {f"{c}_sqrt": F.when(number(c) >= 0, F.sqrt(number(c))) for c in roots}
    return df.withColumns(made)


def powers(df: DataFrame, column: str, degree: int) -> DataFrame:
    """df with power_1 .. power_degree of a column."""
    x = F.col(column).cast("double")
    return df.withColumns({f"power_{d}": x if d == 1 else F.pow(x, F.lit(float(d))) for d in range(1, degree + 1)})


def power_array(column: Column, degree: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(degree)), lambda d: F.pow(column.cast("double"), d.cast("double")))


def column_norms(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the 2-norm of each column."""
    return df.agg(*(F.sqrt(F.sum(F.col(c).cast("double") * F.col(c))).alias(c) for c in columns))


def normalise(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """Columns divided by their norms (a zero column stays), and the norms."""
    length = column_norms(df, columns).first().asDict()
    return df.withColumns({c: F.col(c).cast("double") / F.lit(length[c] or 1.0) for c in columns}), length


def drop_constant(df: DataFrame) -> DataFrame:
    """df without the columns of one value; null counts as a value."""
    stats = df.agg(*(F.struct(F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi"), F.count(c).alias("n"), F.count(F.lit(1)).alias("all")).alias(c) for c in df.columns)).first()
    varied = [c for c in df.columns if 0 < stats[c]["n"] < stats[c]["all"] or stats[c]["lo"] != stats[c]["hi"]]
    return df.select(*varied)


# ---------------------------------------------------------------- one-hot

def one_hot_long(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """row_id and feature (``column=value``) of each value that is not null."""
    pairs = F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns))
    return df.select(row_id, F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("feature"))


def one_hot(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df with 0/1 columns ``column=value`` in place of the given ones, and their names in order.

    Values come to the driver: one-hot columns only suit columns of few values.
    """
    values = df.agg(*(F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns)).first()
    made = {f"{c}={v}": F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)) for c in columns for v in values[c]}
    return df.withColumns(made).drop(*columns), list(made)


def one_hot_sparse(df: DataFrame, row_id: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """row_id and ids (the numbers of the features that are set, in order) of each row, and the dictionary (feature, feature_id).

    The dictionary is a table, numbered from 0 by one range exchange of the distinct values, so a column may have any number
    of values and none comes to the driver. An array has as many entries as there are columns at most. row_id names
    a row: rows that share one are one. Rows without any value have an empty array.
    """
    long = one_hot_long(df, row_id, columns)
    dictionary = value_rank(long.select("feature").distinct(), ["feature"], "feature_id").withColumn("feature_id", F.col("feature_id").cast("int"))
    ids = long.join(dictionary, "feature").groupBy(row_id).agg(F.sort_array(F.collect_set("feature_id")).alias("ids"))
    every = df.select(row_id).distinct().join(ids, row_id, "left")
    return every.select(row_id, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")), dictionary


def bin_edges(df: DataFrame, column: str, bins: int = 10) -> list[float]:
    """bins + 1 equal steps from the least to the greatest value."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if ends["lo"] is None:
        return []
    lo, hi = (ends["lo"], ends["hi"]) if ends["hi"] > ends["lo"] else (ends["lo"] - 0.5, ends["hi"] + 0.5)
    return [lo + i * ((hi - lo) / bins) for i in range(bins)] + [hi]


def bin_of(column: Column, edges: Sequence[float]) -> Column:
    """Bin from 1 on, half-open but for the last; null where the value is null or outside."""
    x, out = column.cast("double"), F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        low, high = F.lit(float(edges[i - 1])), F.lit(float(edges[i]))
        inside = (x >= low) & (x <= high if i == len(edges) - 1 else x < high)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def bin_names(column: str, edges: Sequence[float]) -> list[tuple[int, float, float, str]]:
    """Bin, low, high and label of each bin: the label is for people, the numbers are for use."""
    last = len(edges) - 1
    return [(i, edges[i - 1], edges[i], f"{edges[i - 1]} <= {column} {'<=' if i == last else '<'} {edges[i]}") for i in range(1, last + 1)]


def one_hot_binned(df: DataFrame, column: str, bins: int = 10) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each bin in place of the column."""
    edges = bin_edges(df, column, bins)
    which = bin_of(F.col(column), edges)
    made = {f"{column}=bin{i}": F.coalesce((which == i).cast("int"), F.lit(0)) for i, *_ in bin_names(column, edges)}
    return df.withColumns(made).drop(column), list(made)
