"""Reading tables, cutting lineage and reading row batches for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes of one Arrow batch handed to Python: texts can be long, so both are bounded.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Session settings that keep a Python worker's memory bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A folder of this machine is set only where the setting is absent and all of Spark is in this process, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="siftlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables written so far, for drop_written.
WRITTEN: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete the tables written so far; to be called once results that read them have been saved."""
    while WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a number of each row, written once, so that all that reads it sees the same numbers."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with names that clash with none of an operator's, and which old name each stands for."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


#: A key is hot if it has more than this share of all rows, and more rows than a task reads in no time.
HOT = 1 / 1024
FEW = 100


def hot_keys(counted: DataFrame, key: str, n: str, rows: int) -> list[int]:
    """Hashes of the hot keys of a table of counts (n rows have a key, of so many): fewer than 1 / HOT, whatever the input.

    Each is a literal in every plan that joins by them, so keys of a small table that have few rows, if a large share, are left out.
    """
    return [r[0] for r in counted.filter(F.col(n) > max(rows * HOT, FEW)).select(F.xxhash64(key)).collect()]


def skew_join(left: DataFrame, right: DataFrame, on: str, hot: list[int], how: str = "inner") -> DataFrame:
    """left joined to right (one row a key) without the rows of a hot key meeting in one task.

    The right side of hot keys is a row for each and is broadcast; all others are shuffled.
    """
    if not hot:
        return left.join(right, on, how)
    is_hot = F.xxhash64(on).isin(hot)
    return left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), on, how).unionByName(left.filter(~is_hot).join(right.filter(~is_hot), on, how))


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of a number's decimal digits, modulo n."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % F.lit(n)


def text_of(col: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of BATCH_BYTES at most, or of a single row."""
    if batch.num_rows <= 1 or batch.nbytes <= BATCH_BYTES:
        yield batch
        return
    half = batch.num_rows // 2
    yield from sliced(batch.slice(0, half))
    yield from sliced(batch.slice(half))


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | T.StructType) -> DataFrame:
    """df through a Python function on batches of columns.

    make() is called once in each task and returns the function: a dict of lists (nulls are None, whatever the type) to a dict
    of lists or arrays of the columns of schema. Batches without rows give nothing.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kinds)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in (piece for whole in batches for piece in sliced(whole)):
            if batch.num_rows:
                got = step({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(scan, kinds)
