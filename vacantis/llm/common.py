"""Helpers the operators of this folder share.

Texts are handled as UTF-8 bytes.  ``bytes.split()`` cuts at 0x20 and 0x09-0x0D
and ``bytes.lower()`` changes A-Z only, which are the word and case rules here;
a null text is an empty one.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantis.session import new_folder

#: Rows in a batch that goes to Python; Spark bounds its bytes besides.
BATCH_ROWS = 2000


def prepared(spark: SparkSession) -> SparkSession:
    """Session options of these operators (safe to repeat)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, kept when executors are lost."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Whether Spark removes what a query shuffled as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """What is run inside leaves no shuffle files; it must not keep a DataFrame in Spark's cache."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def dropped(df: DataFrame) -> None:
    """Removes the files of a stored table, or of what was selected from it alone, that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bit_table(slots: DataFrame, bits: int) -> bytes:
    """A table of 2**bits bits, set at the column ``slot``; the driver gets 4 kB for each part that has a bit."""
    place = F.col("slot") + 1
    parts = slots.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    table = np.zeros((1 << bits) // 8, np.uint8)
    for part, own in parts.toLocalIterator():
        table[(part - 1) * 4096:(part - 1) * 4096 + len(own)] = np.frombuffer(own, np.uint8)
    return table.tobytes()


def bits_at(table: bytes, slots: np.ndarray) -> np.ndarray:
    """Whether the table's bits are set at these slots (unsigned numbers)."""
    bits = np.frombuffer(table, np.uint8)
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b if b is not None else b"" for b in column.cast(kind).to_pylist()]


def per_batch(fn: Callable[[pa.RecordBatch], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow from one that turns a batch into columns."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch))
    return run


def let_go() -> None:
    """Gives freed memory back, for a worker that stays when its task has ended."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def eased(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that lets go when its task ends."""
    def out(batches):
        yield from run(batches)
        let_go()
    return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5, by which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns; others, whatever their names, play no part."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def sampled_labels(labels: DataFrame, target: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled ids outside the held-out fold, spread by hash: (id, label).

    Ids with a null label or id are left out; an id with several labels takes the largest.
    """
    known = (only(labels, id_col, target).dropna().where(fold(F.col(f"`{id_col}`")) != 0)
             .groupBy(id_col).agg(F.max(target).cast("int").alias("label")))
    return known.orderBy(F.xxhash64(id_col), id_col).limit(most).withColumnRenamed(id_col, "labelled_id")


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, most: int,
                   id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(labelled_id, label, text, …) of the sampled labels; the side that is broadcast has at most ``most`` rows."""
    ids = sampled_labels(labels, target, most, id_col)
    return (only(docs, id_col, text_col, *more).join(F.broadcast(ids), F.col(f"`{id_col}`") == F.col("labelled_id"))
            .select("labelled_id", "label", F.col(f"`{text_col}`").alias("body"), *(F.col(f"`{c}`") for c in more)))
