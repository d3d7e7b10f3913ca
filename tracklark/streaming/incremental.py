"""Incremental annotation: analyses that arrive as files are applied batch by batch; the library table is the state.

The table is dealt into buckets by a hash of the track's key, as many as it was made with, whatever the number of libraries.
A bucket's rows lie in `data/v=<version>/bucket=<number>`, and `state/<version>.json` says for each bucket in which version
it was last written. A micro-batch reads only the buckets that it has responses for, by their paths, and writes only those
that have newer ones; nothing is listed. Songs have two more columns, the place (batch_id, idx) of the response that was applied to them and a hash of it:
an older response changes nothing, in whatever order files arrive and however they are split.

Responses that can't be used go to `rejected/batch=<n>` with a reason, and can be sent again from there. What became of the
responses of a batch is counted on the way, and kept in `reports/<n>.json`.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, CueConfig
from ..operators.tracks import KEY, content_hash, latest_analysis, with_attributes, with_key
from ..plans.jobs import points_of_analyses, put_points
from ..sources.analyses import read_analyses
from ..sources.files import delete, exists, folder_names, read_text, replace_text, without_shuffles

RAW = "library_id string, path string, batch_id long, idx long, raw string"
#: Buckets of a new table; what the state holds on the driver is a number for each.
BUCKETS = 64
MARK = ["applied_batch", "applied_idx", "applied_hash"]
#: Why a response is rejected; bad_time only if the settings ask for strict times.
REASONS = ("unparsable", "empty", "bad_time", "not_in_library")


def bucket_of(buckets: int) -> Column:
    """By the track's key; songs without a path are spread by their place."""
    own = F.when(F.col("nfc_path") == "", F.col("song_ord").cast("string")).otherwise(F.lit(""))
    return F.pmod(F.xxhash64("library_id", "nfc_path", own), F.lit(buckets)).cast("int")


def _state(spark: SparkSession, library: str, version: int) -> list[int]:
    text = read_text(spark, f"{library}/state/{version}.json")
    if text is None:
        raise FileNotFoundError(f"{library} has no version {version}, or no longer")
    return json.loads(text)


def write_first_version(library: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The table as of version 0. `buckets` should make a bucket's rows some hundred MB."""
    none = [F.lit(None).cast("long").alias(c) for c in MARK]
    rows = library.select("*", *none).withColumn("bucket", bucket_of(buckets))
    spark = library.sparkSession
    with without_shuffles(spark):
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/v=0")
    full = {int(n.removeprefix("bucket=")) for n in folder_names(spark, f"{path}/data/v=0")}
    schema = json.loads(library.select("*", *none).schema.json())
    replace_text(spark, f"{path}/schema.json", json.dumps(schema))
    replace_text(spark, f"{path}/state/0.json", json.dumps([0 if b in full else -1 for b in range(buckets)]))


def _buckets(spark: SparkSession, library: str, state: list[int], wanted: list[int] | None = None) -> DataFrame:
    """The rows of buckets (all by default) with `bucket`; the scan lists and reads no other folder."""
    schema = T.StructType.fromJson(json.loads(read_text(spark, f"{library}/schema.json")))
    paths = [f"{library}/data/v={v}/bucket={b}" for b, v in enumerate(state) if v >= 0 and (wanted is None or b in wanted)]
    stored = T.StructType([*schema.fields, T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())])
    if not paths:
        return spark.createDataFrame([], stored).drop("v")
    return spark.read.schema(stored).option("basePath", f"{library}/data").parquet(*paths).drop("v")


def library_at(spark: SparkSession, library: str, version: int) -> DataFrame:
    """The library table as it stood at a version that is still kept, with the columns it was made from."""
    return _buckets(spark, library, _state(spark, library, version)).drop("bucket", *MARK)


def latest_version(spark: SparkSession, library: str) -> DataFrame:
    return library_at(spark, library, int(read_text(spark, f"{library}/state/latest")) if exists(spark, f"{library}/state/latest") else 0)


def newer_points(rows: DataFrame, good: DataFrame, cfg: CueConfig = DEFAULT) -> DataFrame:
    """Of responses (with nfc_path) the last for each track of the library rows (with MARK), if it isn't older than what was
    applied to it, or the same: its points as `points_of_analyses` makes them, with MARK, its own mark.

    Responses are dealt out once, by their track, for all of that; rows are read for what the tracks are asked alone.
    """
    least = F.lit(-(2**63)).cast("long")
    last = latest_analysis(good.withColumn("__hash", content_hash()), tie="__hash")
    own = {"applied_batch": F.coalesce("batch_id", least), "applied_idx": F.coalesce("idx", least), "applied_hash": F.col("__hash")}
    found = with_attributes(last, rows, cfg, MARK)
    old, new = F.struct(*(F.col(c).alias(c) for c in MARK)), F.struct(*(own[c].alias(c) for c in MARK))
    newer = found.where(F.col(MARK[0]).isNull() | (new > old)).withColumns(own)
    return points_of_analyses(newer, cfg, MARK)


def apply_responses(rows: DataFrame, good: DataFrame, cfg: CueConfig = DEFAULT) -> DataFrame:
    """Library rows (with MARK) after responses that may be older than those applied to them, or come twice.

    The mark of a track is kept with its first song, the one that is edited.
    """
    return put_points(rows, newer_points(rows, with_key(good), cfg), MARK)


def annotate_incremental(spark: SparkSession, responses: str, library: str, checkpoint: str, files_per_batch: int = 100, cfg: CueConfig = DEFAULT) -> StreamingQuery:
    """Apply JSON-lines response files (library_id, path, batch_id, idx, raw) under `responses` to the library table.

    Of the responses for a track, in whatever files and order they come, the one of the highest (batch_id, idx) stands, of
    several with the same place that of the highest hash: the table ends as one batch over all responses would leave it.
    Micro-batch n reads version n and writes version n+1 of the buckets that it has newer responses for, so a batch that is
    run again writes the same; one whose responses are all older writes none. Buckets that version n no longer needs are then deleted. A response that can't be used, or is
    for no song of the library, goes to `rejected` with its reason and leaves all as it was. Stops when all files that
    are there have been applied.
    """
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(responses)
    return stream.writeStream.foreachBatch(_applier(library, cfg)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _kept(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """The rows as a batch reads them more than once: a cache would hold texts and lists uncompressed."""
    with without_shuffles(spark):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _applier(library: str, cfg: CueConfig) -> Callable[[DataFrame, int], None]:
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = _state(spark, library, number)
        batch = with_key(batch).withColumn("bucket", bucket_of_track(len(state)))
        work = f"{library}/work/batch={number}"
        kept = lambda df, name: _kept(spark, df, f"{work}/{name}")
        try:
            parsed = kept(read_analyses(batch.withColumn("text", F.col("raw")), strict=cfg.strict_times, reason=True).withColumnRenamed("failure", "why"), "parsed")  # read and parsed once
            touched = sorted(r["bucket"] for r in parsed.where(~F.col("failed")).select("bucket").distinct().collect())  # at most one of each
            rows = _buckets(spark, library, state, touched)
            there = rows.where("nfc_path <> ''").select(*KEY).distinct().withColumn("__there", F.lit(True))
            told = parsed.join(there, KEY, "left")
            reason = F.coalesce("why", F.when(F.col("__there").isNull(), REASONS[-1]))
            counted = Observation(f"responses-{number}")
            told = told.withColumn("reason", reason).observe(counted, F.count("*").alias("responses"), F.count_if(F.col("reason").isNull()).alias("usable"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS))
            bad = told.where(F.col("reason").isNotNull()).select("library_id", "path", "batch_id", "idx", F.col("text").alias("raw"), "reason")
            with without_shuffles(spark):
                bad.write.mode("overwrite").parquet(f"{library}/rejected/batch={number}")
            good = parsed.where(~F.col("failed")).select(*KEY, "path", "batch_id", "idx", "measure_changes", "loop_segments")
            newer = kept(newer_points(rows.drop("bucket"), good, cfg), "newer")
            changed = sorted(r["bucket"] for r in newer.select(bucket_of_track(len(state)).alias("bucket")).distinct().collect())
            if changed:
                rows = _buckets(spark, library, state, changed).drop("bucket")
                done = put_points(rows, newer, MARK).withColumn("bucket", bucket_of(len(state)))
                with without_shuffles(spark):
                    done.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{library}/data/v={number + 1}")
            replace_text(spark, f"{library}/reports/{number}.json", json.dumps(counted.get))
        finally:
            delete(spark, work)
        # a bucket with newer responses has rows, and so a folder
        changed = set(changed)
        replace_text(spark, f"{library}/state/{number + 1}.json", json.dumps([number + 1 if b in changed else v for b, v in enumerate(state)]))
        replace_text(spark, f"{library}/state/latest", str(number + 1))
        _expire(spark, library, number, state)

    return apply


def bucket_of_track(buckets: int) -> Column:
    """The bucket of the song that a response with this key would change; as `bucket_of` for songs with a path."""
    return F.pmod(F.xxhash64("library_id", "nfc_path", F.lit("")), F.lit(buckets)).cast("int")


def _expire(spark: SparkSession, library: str, version: int, state: list[int]) -> None:
    """Deletes buckets that `version` has replaced, and the state before it, which nothing reads any more."""
    if version and exists(spark, f"{library}/state/{version - 1}.json"):
        for b, (old, new) in enumerate(zip(_state(spark, library, version - 1), state, strict=True)):
            if old != new:
                delete(spark, f"{library}/data/v={old}/bucket={b}")
        delete(spark, f"{library}/state/{version - 1}.json")


def rejected(spark: SparkSession, library: str) -> DataFrame:
    """All responses that couldn't be used, with `reason`; without it they can be written to where responses arrive."""
    return spark.read.schema(f"{RAW}, reason string, batch long").parquet(f"{library}/rejected").drop("batch")


def stream_report(spark: SparkSession, library: str) -> DataFrame:
    """What became of the responses of each micro-batch: batch, responses, usable, and those rejected by reason."""
    files = spark.read.schema(f"responses long, usable long, {', '.join(f'{r} long' for r in REASONS)}").json(f"{library}/reports")
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long").alias("batch"), "*")
