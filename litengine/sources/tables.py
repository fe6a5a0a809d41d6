"""Reading tables and files as sources, and writing index generations with an atomic pointer."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

#: Rows of a page of a stored table.
PAGE = 1000


def parquet(spark: SparkSession, root: str, name: str) -> DataFrame:
    """SRC1, SRC2, SRC13: an exported table."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC11: a JSON lines file with its schema; lines that don't fit come as nulls in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC8, SRC10, RET47: all Markdown files under a folder: path and text, by lower-case path."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), C("value").alias("text")).orderBy(F.lower("path"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK1, SNK5."""
    df.write.mode("overwrite").json(path)


def invalid_vectors(df: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """SRC12: ids whose vectors are null, of another length, or hold what is not finite; and ids that repeat."""
    odd = C(vector).isNull() | (F.size(vector) != dimensions) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("repeated").alias("reason"))
    return df.where(F.coalesce(odd, F.lit(True))).select(key, F.lit("vector").alias("reason")).unionByName(repeated)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_folder(spark: SparkSession) -> str:
    """Where tables that outlive a query are kept: spark.checkpoint.dir, which driver and executors share; a local one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="litengine-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, which is deleted when the session ends: work is not done twice, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/litengine-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _fs(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in at least two partitions for each core: a small table of few files would be one task's work, whatever is made of it."""
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *by) if df.rdd.getNumPartitions() < n else df


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of a table's files: what a stored index was built from."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    row = files.agg(F.count(F.lit(1)), F.sum("length"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)"))).first()
    return f"{path} {row[0]} {row[1]} {row[2]}"


def store(spark: SparkSession, folder: str, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]) -> dict[str, DataFrame]:
    """Writes tables in their order; one that is a function is made from those that are written. Returns them as stored.

    Pages hold at most PAGE rows, so that a filter of a sorted column reads little."""
    out = {}
    for table, df in tables.items():
        made = df(out) if callable(df) else df
        made.write.option("parquet.page.row.count.limit", PAGE).parquet(f"{folder}/{table}")
        out[table] = spark.read.schema(made.schema).parquet(f"{folder}/{table}")
    return out


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], fingerprint: str) -> str:
    """GEN1, SNK6: write a new generation beside the others, then move the pointer to it by a rename. Returns its name.

    A failure before the rename leaves the old generation in place.
    """
    name = f"gen-{uuid.uuid4().hex}"
    counts = {table: df.count() for table, df in store(spark, f"{root}/{name}", tables).items()}
    manifest = json.dumps({"generation": name, "fingerprint": fingerprint, "rows": counts}, sort_keys=True)
    fs, fresh = _fs(spark, f"{root}/.active-{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(manifest.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = options
    context.rename(fs.makeQualified(fresh), fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/active.json")), kinds)
    return name


def active(spark: SparkSession, root: str, fingerprint: str | None = None) -> dict:
    """GEN2, INT4: the manifest of the active generation, and its state: ready, stale (another fingerprint) or missing."""
    fs, where = _fs(spark, f"{root}/active.json")
    if not fs.exists(where):
        return {"state": "missing"}
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{root}/active.json").collect()))
    return manifest | {"state": "ready" if fingerprint in (None, manifest["fingerprint"]) else "stale"}


def generation(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the generation that is active now; later publications do not change what is read."""
    return spark.read.parquet(f"{root}/{active(spark, root)['generation']}/{table}")
