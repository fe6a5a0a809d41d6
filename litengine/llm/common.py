"""What the corpus operators share: shared-folder tables, bounded key bitmaps, the held-out fold."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch.
BATCH_ROWS = 2000
#: Bits of a key bitmap: 2^25 are at most 2^19 rows of two longs, whatever the size of the input.
BITMAP_BITS = 25


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one is made in local mode (tests) only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        made = spark.sparkContext.getCheckpointDir()
        if not made:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="litengine-"))
            made = spark.sparkContext.getCheckpointDir()
        path = made
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives lost executors.

    The files are deleted when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/litengine-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def modest_batches(df: DataFrame) -> None:
    """Arrow batches of at most 2000 rows for this session, so that a task's memory stays small with long texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of doc_id as text leaves no remainder by 5; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """row (all columns as one struct), so that no name of docs meets one of an operator's own, doc_id as a long, and more."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(name) for name, c in more.items()))


def unpacked(rows: DataFrame, columns: list[str], *more: Column | str) -> DataFrame:
    """The columns of `row` again, whatever their names, and more."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns), *more)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _slot(key: Column, bits: int) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return F.shiftright(at, 6), (at.bitwiseAND(F.lit(63))).cast("int")


def key_bitmap(keys: DataFrame, key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """A bitmap of the hashed values of a column, 64 bits a row: at most 2^bits / 64 rows, however many keys.

    It prunes rows before a shuffle: no key is missed, and a few others may pass, which the join after it removes.
    Columns: bm_word, bm_bits.
    """
    word, bit = _slot(F.col(key), bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    return keys.select(word.alias("bm_word"), bit.alias("bit")).groupBy("bm_word").agg(F.bit_or(one).alias("bm_bits"))


def with_bit(df: DataFrame, key: Column, bitmap: DataFrame, flag: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Add a boolean column: may the key be among those of the bitmap? The bitmap's size is bounded, so it is broadcast."""
    word, bit = _slot(key, bits)
    held = F.call_function("shiftright", F.col("bm_bits"), F.col("_bit")).bitwiseAND(F.lit(1)) == 1
    return (
        df.withColumn("_word", word)
        .withColumn("_bit", bit)
        .join(F.broadcast(bitmap), F.col("_word") == F.col("bm_word"), "left")
        .withColumn(flag, F.coalesce(held, F.lit(False)))
        .drop("_word", "_bit", "bm_word", "bm_bits")
    )
