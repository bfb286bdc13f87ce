"""Shared plumbing of the text operators: scratch tables in the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder of spark.checkpoint.dir; a temporary one of this machine only where it is unset and the session is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strainlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Rows that a file of a small table has, and files that one has at most whatever its rows.
ROWS_A_FILE, FEWEST_FILES = 50_000, 8


class Scratch:
    """Parquet tables in the shared folder that cut lineage; ``drop``, or the end of a with block, removes them.

    Executors that are lost later cost nothing, as the tables outlive them.  What is left when the application ends, after a
    failure or as a result that a caller may still read, is removed then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        root = f"{shared_dir(spark)}/strainlake-{uuid.uuid4().hex}"
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.folder)
        self.files.deleteOnExit(self.folder)
        self.root = root
        small_batches(spark)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """The rows of df from a table; ``rows``: about how many there are at most, so that few don't make many files."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        (df if rows is None else df.coalesce(max(FEWEST_FILES, rows // ROWS_A_FILE))).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self.files.delete(self.folder, True)


#: Tables that results read, one list for each open block of ``passing``.
_results: list[list[Scratch]] = []


def lasting(spark: SparkSession) -> Scratch:
    """Tables that a result reads: kept until the application ends, or the innermost block of ``passing``."""
    out = Scratch(spark)
    if _results:
        _results[-1].append(out)
    return out


@contextmanager
def passing() -> Iterator[None]:
    """Results that are made in this block are read in it, and their tables removed at its end."""
    _results.append([])
    try:
        yield
    finally:
        for scratch in _results.pop():
            scratch.drop()


def settled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of a result, held in a table of the shared folder; rows: as in ``Scratch.save``."""
    return lasting(df.sparkSession).save(df, rows)


#: Rows and bytes up to which a table is broadcast.
SMALL_ROWS, SMALL_BYTES = 200_000, 32 << 20


def is_small(df: DataFrame) -> bool:
    """Whether a saved table is within SMALL_ROWS and SMALL_BYTES."""
    got = df.limit(SMALL_ROWS + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return got.n <= SMALL_ROWS and (got.bytes or 0) <= SMALL_BYTES


def small(df: DataFrame) -> DataFrame:
    """The saved table, marked for broadcasting if it is small; else Spark joins by shuffle."""
    return F.broadcast(df) if is_small(df) else df


def extended(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """Schema with new fields at its end; an input column of the same name makes way."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + list(fields))


#: Rows that Spark hands to a Python worker at once, at most: texts can be long, and several copies of a batch are alive at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS; smaller ones stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_texts(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """Adds columns computed from a batch of one column's values; ``make`` runs once in each worker.

    The function gets a list of values and returns one list for each new field.
    """
    small_batches(df.sparkSession)
    schema = extended(df.schema, *fields)
    keep = [f.name for f in schema.fields[: len(schema.fields) - len(fields)]]
    types = [arrow_type(f.dataType) for f in fields]
    if column not in keep:
        raise ValueError(f"{column} is read and may not be replaced")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                new = f(b.column(keep.index(column)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    b.columns + [pa.array(x, t) for x, t in zip(new, types)], names=keep + [f.name for f in fields]
                )

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in t.fields])
    return {
        "string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(),
        "double": pa.float64(), "boolean": pa.bool_(), "float": pa.float32(),
    }[t.simpleString()]


def field(name: str, ddl: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(ddl) if "<" in ddl else {
        "string": T.StringType(), "binary": T.BinaryType(), "long": T.LongType(), "int": T.IntegerType(),
        "double": T.DoubleType(), "boolean": T.BooleanType(),
    }[ddl])
