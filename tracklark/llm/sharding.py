"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled within each source by a seeded hash and ranked; row r of a source with n rows gets the fractional
rank (2r + 1) / 2n. All rows are then put in order of fractional rank and cut into shards of equal counts, so that any
stretch of the order, and so every shard, holds the sources in the mixture's proportions.

Neither ranking has a window over a whole source or the whole table: rows are dealt into ranges of the hash (of the
fractional rank), each range is ranked alone, and running sums of the ranges' counts give the offsets. A source with a
third of all rows is thus spread over `ranges` groups. Where rows are shuffled by what they hold, so that equal ones stay
beside each other, a range with more than CROWDED rows is dealt further by the rows' keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import id_text, materialize, table

RANGES = 1 << 14
CROWDED = 100_000


def stratified_shards(docs: DataFrame, n_shards: int = 16, seed: int = 17, key: str = "doc_id", source: str = "source", tie: str | None = None, ranges: int = RANGES, together: tuple[str, ...] = (), crowded: int = CROWDED) -> DataFrame:
    """`docs` with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 within the shard).

    Counts of shards differ by one at most. A null source is a source of its own; a null key counts as empty text.
    Rows that share a key are told apart by the column `tie`; rows equal in key, source and tie are interchangeable.
    Rows equal in the columns `together` are neighbours in the shuffle, so that a shard gets all of them but where it ends
    (or where they fill more than a shard). Columns `shard` and `slot` of the input are replaced; other columns pass
    unchanged, however long. An empty table gives an empty table.
    """
    docs = docs.drop("shard", "slot")
    kept = docs.columns  # columns that start with __ are this function's own
    in_source = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    rows = docs.withColumn("__stratum", in_source).withColumn("__row", F.xxhash64(F.lit(seed), id_text(key)))
    rows = rows.withColumn("__hash", F.xxhash64(F.lit(seed), *together) if together else F.col("__row"))
    bits = ranges.bit_length() - 1
    rows = rows.withColumn("__range", F.shiftrightunsigned("__hash", 64 - bits))
    if together:
        crowds = rows.groupBy("__stratum", "__range").agg(F.ceil(F.count("*") / crowded).alias("__parts")).where("__parts > 1")
        rows = rows.join(crowds, ["__stratum", "__range"], "left").withColumn("__range", F.coalesce("__range", F.lit(0)) * (1 << 32) + F.coalesce(F.pmod("__row", "__parts"), F.lit(0))).drop("__parts")
    running = Window.partitionBy("__stratum").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__stratum", "__range").agg(F.count("*").alias("__n"))
    counts = counts.select("__stratum", "__range", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("__stratum")).alias("__of"))
    unsigned = F.shiftrightunsigned("__hash", 1)
    ties = [F.col(tie)] if tie else []
    order = Window.partitionBy("__stratum", "__range").orderBy(unsigned, "__hash", key, *ties)
    ranked = rows.withColumn("__rank", F.row_number().over(order) - 1).join(counts, ["__stratum", "__range"])
    rank2 = 2 * (F.col("__before") + F.col("__rank")) + 1
    ranked = ranked.withColumn("__part", rank2 / (2 * F.col("__of"))).withColumn("__cut", F.expr(f"({ranges}L * (2 * (__before + __rank) + 1)) div (2 * __of)"))
    ranked = materialize(ranked.select(*kept, "__stratum", "__hash", "__part", "__cut"))

    cuts = ranked.groupBy("__cut").agg(F.count("*").alias("__n"))  # at most `ranges` rows
    cuts = cuts.select("__cut", F.coalesce(F.sum("__n").over(Window.orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    order = Window.partitionBy("__cut").orderBy("__part", "__hash", "__stratum", key, *ties)
    placed = ranked.withColumn("__rank", F.row_number().over(order) - 1).join(cuts, "__cut").withColumn("__at", F.col("__before") + F.col("__rank"))
    placed = placed.withColumn("shard", F.expr(f"cast((__at * {n_shards}L) div __all as int)"))
    first = F.expr(f"(shard * __all + {n_shards - 1}L) div {n_shards}L")
    return placed.withColumn("slot", F.col("__at") - first).select(*kept, "shard", "slot")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `rows`."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    shards = stratified_shards(docs, 16, tie="text_crc32", together=("text_crc32", "size"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
