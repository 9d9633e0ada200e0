"""What the training-data operators share: words, lineage cuts, and the text of an Arrow batch as bytes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.stored import shared_folder

#: Space and the five ASCII line and tab controls separate words; nothing else does.
SPACES = r"[\x20\x09-\x0D]+"


#: Bytes of an Arrow batch, and what a session has that names none.
BATCH_BYTES, _UNNAMED = "4m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of about BATCH_BYTES, unless the session names a bound of its own: a batch lies
    in memory twice in the executor and twice in the worker, and long texts make 10,000 rows large."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) == _UNNAMED:
        spark.conf.set(bound, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint: for small tables, and once a round in iterations."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: for larger tables that are read more than once."""
    return Scratch(df.sparkSession).written(df)


class Scratch:
    """Parquet tables in the shared folder that go when their job is done with them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/tables/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        """Removes the tables; nothing may read them any more."""
        files = self.spark._jvm.org.apache.hadoop.fs
        for path in self.paths:
            at = files.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string or binary column; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most so many bytes together, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


#: Bytes that a value of each type takes in a broadcast row, about; others count as TEXT_BYTES.
_WIDTH, _TEXT_BYTES = {"bigint": 8, "int": 8, "double": 8, "boolean": 8, "float": 8}, 64


def small(df: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """df, marked for a broadcast if it is counted to take at most so many bytes in memory, about; otherwise joins with it
    shuffle. df is read once more for the count, so it should be a table or a checkpoint."""
    row = 24 + sum(_WIDTH.get(kind, _TEXT_BYTES) for _, kind in df.dtypes)
    return F.broadcast(df) if df.limit(most_bytes // row + 1).count() <= most_bytes // row else df


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows whose doc_id is in gone, a written table with one column id. Rows with a null doc_id stay."""
    return docs.join(small(gone.select(F.col("id").alias("_gone_id"))), docs[doc_id] == F.col("_gone_id"), "left_anti")
