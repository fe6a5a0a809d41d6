"""SNK3, SNK4: changes of single documents beside a stored lexical index, merged when it is read.

An upsert writes the rows and postings of the changed documents only, and a tombstone for each: which documents what was
stored before no longer holds for. Tombstones are written last, so a change is seen whole or not at all. A later
generation of the index takes the changes in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import store
from .lexical import Index, document_of, stored_tables, unfolded

C = F.col

#: Documents of which tombstones are broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000


def _changes(spark: SparkSession, folder: str) -> DataFrame | None:
    """document_id, seq, name of all committed changes, or None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/tombstones")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("document_id long, seq int, name string").parquet(f"{folder}/tombstones")


def _committed(changes: DataFrame | None) -> list[tuple[int, str]]:
    """(seq, name) of each upsert: one row a change, however many documents it had."""
    return sorted((r.seq, r.name) for r in changes.select("seq", "name").distinct().collect()) if changes is not None else []


def upsert(spark: SparkSession, folder: str, key: str, documents: DataFrame, rows: DataFrame | None) -> str:
    """SNK3: replace what the index holds of these documents (document_id) by rows, all of which have to be of them.

    SNK4: without rows, the documents are deleted. Documents that the index doesn't hold are put in. Returns the change's name.
    One writer at a time; a change that fails leaves what can't be seen.
    """
    seq = max((s for s, _ in _committed(_changes(spark, folder))), default=0) + 1
    name = f"change-{seq:06d}-{uuid.uuid4().hex}"
    if rows is not None:
        store(spark, f"{folder}/{name}", stored_tables(rows, key))
    stones = documents.select(C("document_id").cast("long").alias("document_id")).where("document_id is not null").distinct()
    empty = spark.createDataFrame([(None, seq, name)], "document_id long, seq int, name string")  # marks the change, if it has no document
    stones.select("document_id", F.lit(seq).alias("seq"), F.lit(name).alias("name")).unionByName(empty).coalesce(1).write.mode("append").parquet(f"{folder}/tombstones")
    return name


def merged(base: Index, folder: str, key: str) -> Index:
    """The index as all changes left it: rows and postings of the base and of each change, but for documents changed later.

    Document frequencies and lengths are those of what remains, so scores are those of an index built anew. Filters of tokens reach
    the scans of all parts.
    """
    spark = base.rows.sparkSession
    changes = _changes(spark, folder)
    committed = _committed(changes)
    if not committed:
        return base
    last = changes.where("document_id is not null").groupBy("document_id").agg(F.max("seq").alias("last"))
    if last.limit(BROADCAST + 1).count() <= BROADCAST:
        last = F.broadcast(last)
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(folder), spark._jsc.hadoopConfiguration())

    def live(table: str, first: DataFrame) -> DataFrame:
        every = first.withColumn("_seq", F.lit(0))
        for seq, name in committed:
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/{table}")):
                change = spark.read.parquet(f"{folder}/{name}/{table}")
                change = (change if table == "rows" else unfolded(change, key, base.rows.schema[key].dataType.simpleString())).select(*first.columns)
                every = every.unionByName(change.withColumn("_seq", F.lit(seq)))
        tagged = every.withColumn("_document", document_of(C(key)))
        kept = tagged.join(last.withColumnRenamed("document_id", "_document"), "_document", "left").where("last is null or last <= _seq")
        return kept.select(*first.columns)

    return Index(*(live(table, df) for table, df in base._asdict().items()))
