"""Tables and columns that the operators share: lineage cuts, hidden columns, stable text keys."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of a text: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it. If unset, a temporary one in local
    mode (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tracklark-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    The folder is removed by `drop`, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, files = _folder(spark, path)
    files.deleteOnExit(at)
    made = spark.read.schema(df.schema).parquet(path)
    made._written = path
    return made


def drop(df: DataFrame) -> None:
    """Removes a table that `materialize` gave and that nothing will read again."""
    at, files = _folder(df.sparkSession, df._written)
    files.delete(at, True)


def id_text(column: str = "doc_id") -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: a fold that depends on the id alone."""
    return F.crc32(id_text(column).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest(rows: DataFrame, order: str, most: int, *ties: str) -> DataFrame:
    """The `most` rows with the smallest values of `order`, a 64-bit hash, and then of `ties`.

    Where there are many more rows, a bound from their count leaves about `most` of them before they are put in order, so
    that what reaches the one task that does it doesn't grow. (The bound leaves too few once in 10^9 cases.)
    """
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(F.col(order) < int((most + 6 * math.sqrt(most)) / n * 2**64) - 2**63)
    return rows.orderBy(order, *ties).limit(most)


def smallest_keys(rows: DataFrame, seed: int, most: int, keys: list[str], value: Column) -> DataFrame:
    """`__order`, `keys` and `value` (an aggregate of the rows of a key) for the `most` keys with the smallest `__order`, a
    seeded 64-bit hash of the key.

    As the order is the key's own, rows are left out by it before they are grouped: a bound from an estimate of the number
    of keys (one sketch a task, nothing is shuffled for it) leaves about a fifth more keys than are kept, so that neither
    what is shuffled nor the task that orders them grows with the input. (The estimate has a standard error of 1 %, so
    that the bound doesn't leave too few.) Up to twice `most` keys all rows are grouped.
    """
    rows = rows.withColumn("__order", F.xxhash64(F.lit(seed), *keys))
    n = rows.agg(F.approx_count_distinct("__order", 0.01)).first()[0]
    if n > 2 * most:
        rows = rows.where(F.col("__order") < int((1.2 * most + 6 * math.sqrt(most)) / n * 2**64) - 2**63)
    return rows.groupBy("__order", *keys).agg(value).orderBy("__order", *keys).limit(most)
