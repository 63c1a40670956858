"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ensure_checkpoint_dir

# words as the problem statements define them
CODE_WORD = re.compile(r"[a-z0-9_]+")


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def schema_of(ddl: str) -> T.StructType:
    """A schema from "name type, ..." over plain types and arrays of them; needs no session."""

    def kind(t: str) -> T.DataType:
        return T.ArrayType(kind(t[6:-1])) if t.startswith("array<") else _TYPES[t]

    return T.StructType([T.StructField(n, kind(t)) for n, t in (x.split() for x in ddl.split(","))])


def arrow_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Apply fn(*values) -> rows to every row of the given columns, in Arrow batches.

    Only these columns travel to Python. A row of None values reaches fn as it is.
    """
    out_schema = schema_of(schema)
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend(fn(*values))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out_schema)


def entity_kind(col: str | Column) -> Column:
    """entity_type trimmed and lower-cased."""
    return F.lower(F.trim(col))


def code_entities(entities: DataFrame) -> DataFrame:
    """Functions and methods."""
    return entities.where(entity_kind("entity_type").isin("function", "method"))


def cut(df: DataFrame) -> DataFrame:
    """The frame as a table written to the shared checkpoint folder, which ends its lineage.

    Repeated hashes are stored once by the column encoding, so such a table is several times smaller than a checkpoint, and
    its size is known to the planner. It goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
