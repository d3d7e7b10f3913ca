"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

1. Targets: a budget of `ratio` times all words is shared by weight; no source gets more than `cap` times its own
   size, and what it can't take is shared again by weight. The fixed point is min(cap * size, level * weight), so the
   level is found from running sums over the sources in order of cap * size / weight.
2. Blocks: a source's documents, in seeded order, form one stream of words, cut into equal blocks of `block_words`. A
   source of fewer than eight blocks is small: its blocks are single words, so that it too comes near its target, and small
   sources are apportioned among themselves. What a small source has is bounded, and so are the blocks of one word: no row
   has more picks than two for each of its blocks of `block_words`, and 16 * `block_words` more, whatever the sources.
3. Quotas: blocks are given to sources by the highest quotients target / 1, target / 3, target / 5, ... Shard m of the
   mix gets what the first H(m + 1) blocks give beyond the first H(m): whole numbers that never go negative, because
   the method is house-monotone. Quotas at a house H come from rounding target / divisor and then giving (taking back)
   the few blocks that are missing (too many) by the highest (lowest) quotients; no list of all blocks is made.
4. Selection: a seeded permutation of each source's blocks; pick i is block number i modulo the block count, so blocks
   repeat only after all have been taken.

The tables made besides the documents have a row per source, or per source and range of the seeded order. A source
with a third of all rows is spread over `RANGES` ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import WORD, id_text, table

RANGES = 4096  # three hexadecimal digits of the seeded hash
BLOCK_WORDS = 128
#: A source of fewer blocks has blocks of one word instead.
SMALL_BLOCKS = 8
SHARDS = 16
SEED = 29
WEIGHTS = (5, 2, 1)
#: Multipliers of the permutations. The primes next after a million; at least one doesn't divide any count.
PRIMES = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121)


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, ratio: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`sizes` (a row per `source` with `source_size`), with `weight` and `target`.

    Weights repeat over the sources in code-point order, null last. Where all sizes are 0, so are the targets.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("__i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("__i") % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("__cap", cap * F.col("source_size")).withColumn("__fill", F.col("__cap") / F.col("weight"))
    lower = Window.orderBy("__fill", "__i").rowsBetween(Window.unboundedPreceding, -1)
    left = ratio * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(lower), F.lit(0.0))
    held = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0))
    ranked = ranked.withColumn("__level", left / held)
    # the first source that isn't filled at its level sets the level of all
    level = F.min(F.when(F.col("__level") <= F.col("__fill"), F.struct("__fill", "__i", "__level"))).over(everything)["__level"]
    target = F.least("__cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return ranked.withColumn("target", target).drop("__cap", "__fill", "__level")


def apportion(targets: DataFrame, block_words: int | Column = BLOCK_WORDS, n_shards: int = SHARDS) -> DataFrame:
    """`targets` with `n_blocks` and `quotas`: by shard, how many blocks the source has been given up to its end.

    Sources of one size of block share a house.
    """
    t = targets.withColumn("__words", F.lit(block_words).cast("long") if isinstance(block_words, int) else block_words)
    t = t.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("__words")).cast("long"))
    t = t.withColumn("__sum", F.sum("target").over(Window.partitionBy("__words"))).withColumn("__house", F.floor(F.col("__sum") / F.col("__words") + 0.5))
    houses = t.withColumn("__m", F.explode(F.sequence(F.lit(1), F.lit(n_shards)))).withColumn("__h", F.expr(f"__house * __m div {n_shards}"))
    # no source may have more than two passes; a target of cap times the size rounds to no more
    most = 2 * F.col("n_blocks")
    rounded = F.when(F.col("__h") > 0, F.floor(F.col("target") * F.col("__h") / F.col("__sum") + 0.5)).otherwise(0)
    houses = houses.withColumn("__q", F.least(rounded, most)).withColumn("__off", F.col("__h") - F.sum("__q").over(Window.partitionBy("__words", "__m")))
    # quotients of the blocks next to be given, or to be taken back
    k = F.when(F.col("__off") > 0, F.sequence(F.col("__q") + 1, F.least(F.col("__q") + F.col("__off"), F.greatest(most, F.col("__q") + 1))))
    k = k.when((F.col("__off") < 0) & (F.col("__q") > 0), F.sequence(F.col("__q"), F.greatest(F.lit(1), F.col("__q") + F.col("__off") + 1)))
    near = houses.withColumn("__k", F.explode_outer(k)).withColumn("__quotient", F.col("target") / (2 * F.col("__k") - 1))
    near = near.withColumn("__quotient", F.when((F.col("__k") <= most) | (F.col("__off") < 0), F.col("__quotient")))
    rises = F.row_number().over(Window.partitionBy("__words", "__m").orderBy(F.col("__quotient").desc_nulls_last(), "__i"))
    falls = F.row_number().over(Window.partitionBy("__words", "__m").orderBy(F.col("__quotient").asc_nulls_last(), F.desc("__i")))
    near = near.withColumn("__rises", rises).withColumn("__falls", falls)
    step = F.when(F.col("__quotient").isNull(), 0).when((F.col("__off") > 0) & (F.col("__rises") <= F.col("__off")), 1).when((F.col("__off") < 0) & (F.col("__falls") <= -F.col("__off")), -1).otherwise(0)
    by_shard = near.groupBy(*targets.columns, "n_blocks", "__m", "__q").agg((F.col("__q") + F.sum(step)).alias("__got"))
    quotas = F.transform(F.array_sort(F.collect_list(F.struct("__m", "__got"))), lambda x: x["__got"])
    return by_shard.groupBy(*targets.columns, "n_blocks").agg(quotas.alias("quotas"))


def block_size(most: int = BLOCK_WORDS) -> Column:
    """Words in a source's blocks: `most`, or 1 for a source of fewer than eight such blocks."""
    return F.when(F.col("source_size") < SMALL_BLOCKS * most, 1).otherwise(most).cast("long")


def mix_plan(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, n_shards: int = SHARDS, key: str = "doc_id", tie: str | None = None) -> DataFrame:
    """`docs` (with `source` and `size` in words) with `source_size`, `target`, `quotas` and `picks`.

    `picks` holds, in order, structs (start, words, pass, shard): words `start` to `start + words` of the document
    are taken in that pass (0 or 1) into that shard of the mix. A document without words has none. Null sources form
    one source; a null key counts as empty text; repeated rows each take their own place in the stream.
    """
    named = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = docs.withColumn("__named", named).withColumn("__hash", F.md5(F.concat(F.lit(f"{seed}:"), id_text(key)).cast("binary"))).withColumn("__range", F.substring("__hash", 1, 3))
    ranges = rows.groupBy("__named", "source", "__range").agg(F.sum("size").alias("__size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("__size").alias("source_size")))
    plan = apportion(targets.withColumn("__block", block_size(block_words)), F.col("__block"), n_shards)
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit(""))).cast("binary"))
    start = F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") % len(PRIMES)
    primes = F.array(*map(F.lit, PRIMES)).cast("array<bigint>")
    turned = F.concat(F.slice(primes, (start + 1).cast("int"), len(PRIMES)), primes)
    n = F.greatest("n_blocks", F.lit(1))
    plan = plan.withColumn("__n", n).withColumn("__by", F.try_element_at(F.filter(turned, lambda p: p % F.col("__n") != 0), F.lit(1)))
    plan = plan.withColumn("__by", F.coalesce("__by", F.lit(0)) % F.col("__n")).withColumn("__plus", F.conv(F.substring(digest, 5, 12), 16, 10).cast("long") % F.col("__n"))
    plan = plan.withColumn("__named", named).select("__named", "source_size", "target", "quotas", "__block", "__n", "__by", "__plus")
    before = Window.partitionBy("__named").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__named", "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before")).join(plan, "__named")
    within = Window.partitionBy("__named", "__range").orderBy("__hash", "size", *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ranges, ["__named", "__range"]).withColumn("__at", F.col("__at") + F.col("__before"))

    end, t = F.col("__at") + F.col("size"), F.col("__block")
    blocks = F.sequence(F.expr("__at div __block"), F.expr("(__at + size - 1) div __block"))
    blocks = F.when(F.col("size") > 0, blocks).otherwise(F.array().cast("array<bigint>"))
    last = F.element_at("quotas", -1)

    def pick(again: int):
        def made(j: Column) -> Column:
            i = (j * F.col("__by") + F.col("__plus")) % F.col("__n") + again * F.col("__n")
            first = F.greatest(j * t, F.col("__at"))
            return F.struct((first - F.col("__at")).alias("start"), (F.least((j + 1) * t, end) - first).alias("words"), F.lit(again).alias("pass"), F.when(i < last, F.size(F.filter("quotas", lambda q: q <= i))).alias("shard"))

        return F.filter(F.transform(blocks, made), lambda x: x["shard"].isNotNull())

    return rows.withColumn("picks", F.concat(pick(0), pick(1))).drop("__named", "__hash", "__range", "__at", "__before", "__block", "__n", "__by", "__plus")


def words_taken() -> Column:
    return F.aggregate("picks", F.lit(0).cast("long"), lambda total, x: total + x["words"])


def mix_documents(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents with the columns of `docs`: a row for each document and pass in which it has words taken.

    `text` keeps only the words taken, with the white space before each; a document taken whole keeps its text as it
    is. `n_chars` is counted anew. All other columns pass, whatever their names.
    """
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "source", "text", "n_chars")]
    docs = docs.withColumn("__others", F.struct(*others) if others else F.lit(None))
    sized = docs.drop(*others).withColumn("size", n_words("text")).withColumn("__tie", F.crc32(F.col("text").cast("binary")))
    plan = mix_plan(sized, seed, block_words, tie="__tie")
    rows = plan.withColumn("__pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__mine", F.filter("picks", lambda x: x["pass"] == F.col("__pass"))).where(F.size("__mine") > 0)
    total = F.aggregate("__mine", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__mine", lambda x: F.slice(F.col("__pieces"), (x["start"] + 1).cast("int"), x["words"].cast("int")))), "")
    whole = F.col("__whole")
    rows = rows.withColumn("__whole", total == F.col("size")).withColumn("__pieces", F.when(~whole, pieces)).withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(F.col("__others")[c].alias(c) if c in others else c for c in columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, with weights 5, 2, 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size"), F.crc32(F.col("text").cast("binary")).alias("__tie"))
    plan = mix_plan(docs, tie="__tie")
    return plan.select("doc_id", "size", "source_size", "target", words_taken().alias("taken"), "source")
