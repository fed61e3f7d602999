"""Sources and sinks: CSV, JSON lists and maps, sparse NPZ archives, stored models. Every table gets a row id."""

from __future__ import annotations

import io as bytes_io
import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.splits import value_rank

_TYPES = {"str": T.StringType(), "float": T.DoubleType(), "int": T.LongType(), "bool": T.BooleanType()}


def declared(columns: Mapping[str, str | type]) -> T.StructType:
    """A schema from names and the types str, float, int or bool."""
    return T.StructType([T.StructField(n, _TYPES[t if isinstance(t, str) else t.__name__]) for n, t in columns.items()])


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str | type] | None = None, line_breaks: bool = True) -> DataFrame:
    """CSV with a header. Quoted fields may hold doubled quotes and line breaks. NaN becomes NULL.

    A file whose fields may hold line breaks cannot be cut, so it is one task; with line_breaks=False large files
    are read by many. Without declared columns types are inferred, which reads the file twice.
    """
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').option("nanValue", "NaN")
    df = reader.schema(declared(columns)).csv(path) if columns else reader.option("inferSchema", True).csv(path)
    fractions = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fractions}) if fractions else df


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """df with the place of each row in the order of the given columns."""
    return value_rank(df, order, name)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def read_json_list(spark: SparkSession, path: str, kind: str = "bigint", name: str = "value", whole: bool = True) -> DataFrame:
    """One row for each element of a file that holds a JSON array; with whole=False every line holds one, and lines are dealt to many tasks."""
    rows = _whole(spark, path) if whole else spark.read.text(path)
    return rows.select(F.explode(F.from_json("value", f"array<{kind}>")).alias(name))


def write_json_lists(df: DataFrame, column: str, path: str) -> None:
    """The values of a column as JSON arrays, one a line, written by all tasks: read again by read_json_list with whole=False."""
    df.select(F.to_json(F.array(column)).alias("value")).write.text(path)


def read_json_map(spark: SparkSession, path: str, kind: str = "bigint", key: str = "term", value: str = "term_id") -> DataFrame:
    """One row for each entry of a file that holds a JSON object."""
    return _whole(spark, path).select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias(key, value))


def _archive(batches: Iterator[pa.RecordBatch], rows_at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content").to_pylist():
            with np.load(bytes_io.BytesIO(content)) as z:
                data, indices, indptr = z["data"], z["indices"], z["indptr"]
            for i in range(0, len(indptr) - 1, rows_at_once):
                j = min(i + rows_at_once, len(indptr) - 1)
                a, b = indptr[i], indptr[j]
                doc = np.repeat(np.arange(i, j), np.diff(indptr[i : j + 1]))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(indices[a:b].astype(np.int32)), pa.array(data[a:b].astype(np.float64))], ["doc_id", "term_id", "value"])


def read_sparse_npz(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, term_id, value of each entry of row-compressed archives (data, indices, indptr); one task a file."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_archive, "doc_id bigint, term_id int, value double")


def write_arrays(spark: SparkSession, arrays: Mapping[str, np.ndarray], path: str) -> None:
    """Named arrays of up to two dimensions as one Parquet table of rows."""
    rows = [(name, i, np.atleast_1d(row).astype(float).tolist()) for name, a in arrays.items() for i, row in enumerate(np.asarray(a))]
    spark.createDataFrame(rows, "name string, row int, vector array<double>").write.mode("overwrite").parquet(path)


def read_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray] | None:
    """What write_arrays stored, or None if there is nothing at path."""
    from pyspark.errors import AnalysisException

    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return None
    out: dict[str, list] = {}
    for r in table.orderBy("name", "row").collect():
        out.setdefault(r["name"], []).append(r["vector"])
    return {k: np.array(v) for k, v in out.items()}


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row: a report for consoles and logs."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json(spark: SparkSession, value: list | dict, path: str) -> None:
    """A list or map that fits on the driver as one JSON file in a folder of any store that Spark writes to."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(path)


def write_sparse_npz(path: str, data: np.ndarray, indices: np.ndarray, indptr: np.ndarray, shape: tuple[int, int]) -> None:
    """A row-compressed matrix as an archive that read_sparse_npz takes, in any store that pyarrow reaches."""
    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    made = bytes_io.BytesIO()
    np.savez_compressed(made, data=data, indices=indices, indptr=indptr, shape=np.array(shape), format=np.array(b"csr"))
    with store.open_output_stream(inner) as out:
        out.write(made.getvalue())
