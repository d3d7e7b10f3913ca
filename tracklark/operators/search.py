"""Indexes over a catalogue that are written once and searched often: points by colour, tracks by musical elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points in a file of the colour index, and in a row group of it about a tenth.
FILE_ROWS = 5_000_000
WORD_BITS = 64


def write_color_index(index: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """`index` (color, path and more) in folders by colour, sorted by path and place in files of bounded size.

    Rows are dealt by ranges of colour and path, so that a colour with most of the points is the work of many tasks.
    """
    order = ["color", "path", *(c for c in ("pos", "type") if c in index.columns)]
    rows = index.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.partitionBy("color").option("maxRecordsPerFile", file_rows).parquet(path)


def search_color_index(spark: SparkSession, path: str, color: str, under: str | None = None) -> DataFrame:
    """The points of a colour, of all tracks or of those whose path begins with `under`.

    Other colours' folders are not listed for reading, and row groups without such paths are passed over by their bounds.
    """
    found = spark.read.parquet(path).where(F.col("color") == color)
    if under:
        # as a range too, which the bounds of row groups can answer
        found = found.where((F.col("path") >= under) & F.startswith("path", F.lit(under)))
    return found


def element_index(analyses: DataFrame, number: str) -> DataFrame:
    """(element, word, bits): for each element the tracks that have it in any candidate, as a sparse bitmap.

    `number` is the tracks' column of whole numbers, dense ones at best (`assign_batches` gives such). Bit b of `bits` in
    row `word` stands for track 64 * word + b; words without a bit have no row. Candidates without elements, null
    elements and tracks without a number leave no trace. Bits are put together before the one exchange.
    """
    of = lambda column: F.flatten(F.transform(F.coalesce(column, F.array()), lambda c: F.coalesce(c["elements"], F.array().cast("array<string>"))))
    every = F.array_distinct(F.concat(of(F.col("measure_changes")), of(F.col("loop_segments"))))
    rows = analyses.select(F.col(number).cast("long").alias("__n"), F.explode(every).alias("element")).where(F.col("__n").isNotNull() & F.col("element").isNotNull())
    bit = F.expr(f"shiftleft(1L, cast(pmod(__n, {WORD_BITS}) as int))")
    return rows.select("element", F.floor(F.col("__n") / WORD_BITS).cast("long").alias("word"), bit.alias("bit")).groupBy("element", "word").agg(F.bit_or("bit").alias("bits"))


def write_element_index(index: DataFrame, path: str) -> None:
    """Sorted by element and word, so that a search reads the row groups of its elements alone."""
    index.repartitionByRange("element", "word").sortWithinPartitions("element", "word").write.option("compression", "zstd").parquet(path)


def search_elements(index: DataFrame, every: list[str], none: list[str] = ()) -> DataFrame:
    """(number) of the tracks that have all the elements of `every` and none of `none`.

    Words are intersected, 64 tracks at once, after one exchange; only tracks that are found become rows. `index` has one
    row for an element and word, as `element_index` makes them. An element that no track has
    excludes nothing in `none` and everything in `every`, which can't be empty.
    """
    every, none = sorted(set(every)), sorted(set(none))
    if not every:
        raise ValueError("a search needs an element that tracks must have")
    wanted = F.col("element").isin(every)
    rows = index.where(F.col("element").isin([*every, *none]))
    words = rows.groupBy("word").agg(
        F.count_if(wanted).alias("__n"), F.bit_and(F.when(wanted, F.col("bits"))).alias("__all"),
        F.coalesce(F.bit_or(F.when(F.col("element").isin(none) if none else F.lit(False), F.col("bits"))), F.lit(0).cast("long")).alias("__none"),
    )
    left = words.where(F.col("__n") == len(every)).select("word", F.col("__all").bitwiseAND(F.bitwise_not("__none")).alias("bits")).where("bits <> 0")
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda b: F.getbit(F.col("bits"), b) == 1)
    return left.select(F.explode(F.transform(places, lambda b: F.col("word") * WORD_BITS + b)).alias("number"))
