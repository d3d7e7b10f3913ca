"""Stored responses of the audio analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import repair_long_decimals, round_time
from ..schemas import ANALYSIS, BATCH


def round_times(analysis: Column, exact: bool = False) -> Column:
    """Times of cues and loops to two decimals."""
    cues = F.transform(analysis["measure_changes"], lambda c: c.withField("timestamp", round_time(c["timestamp"], exact)))
    loops = F.transform(analysis["loop_segments"], lambda c: c.withField("start", round_time(c["start"], exact)))
    return F.struct(cues.alias("measure_changes"), loops.alias("loop_segments"))


#: Where times stand in a response.
TIMES = {"measure_changes": "timestamp", "loop_segments": "start"}
_LISTS = "array<variant>"


def _said_times(v: Column, name: str) -> Column:
    """What the elements of a response's list (a variant) say as time: whether anything, whether null, and the number."""
    time = f"$.{TIMES[name]}"
    said = lambda c: F.try_variant_get(c, time, "variant")
    one = lambda c: F.struct(said(c).isNotNull().alias("said"), F.is_variant_null(said(c)).alias("none"), F.try_variant_get(c, time, "double").alias("number"))
    return F.transform(F.try_variant_get(v, f"$.{name}", _LISTS), one)


def bad_times(v: Column, times: dict[str, Column]) -> Column:
    """Whether a response says a time that is no number: null, a text that isn't one, a list or an object. A time that
    isn't said at all is none. A list of candidates that is null or no list counts as bad too."""
    found = F.lit(False)
    for name, said in times.items():
        bad = F.exists(said, lambda t: t["said"] & (t["none"] | t["number"].isNull()))
        found = found | F.coalesce(bad, F.try_variant_get(v, f"$.{name}", "variant").isNotNull())
    return found


def _why(text: Column, v: Column, times: dict[str, Column] | None) -> Column:
    reason = F.when(v.isNull(), "unparsable").when(F.regexp_replace(text, r"\s", "").isin("{}", "[]", "null"), "empty")
    return reason.when(bad_times(v, times), "bad_time") if times else reason


def failure(raw: Column, strict: bool = False) -> Column:
    """Why a response gives no analysis: unparsable, empty (an empty object or list), or, if `strict`, bad_time; else null."""
    text = repair_long_decimals(raw)
    v = F.try_parse_json(text)
    return _why(text, v, {name: _said_times(v, name) for name in TIMES} if strict else None)


def read_analyses(raw: DataFrame, exact: bool = False, strict: bool = False, reason: bool | None = None) -> DataFrame:
    """Rows with `raw` text, with measure_changes, loop_segments and `failed`; with `reason` (by default if `strict`) also
    `failure`. What isn't JSON, or is an empty object or list, has failed.

    A time that is said to be null, or is no number, becomes null, and is later taken as 0. If `strict`, the response
    fails for it, and a time written as a text is read as the number it is. Each step is a column that the next ones
    ask for, none within a lambda, so that a text is repaired once and parsed once by each parser.
    """
    rows = raw.withColumn("__text", repair_long_decimals(F.col("raw")))
    rows = rows.withColumn("__v", F.try_parse_json("__text"))
    times = None
    if strict:
        rows = rows.withColumns({f"__{name}": _said_times(F.col("__v"), name) for name in TIMES})
        times = {name: F.col(f"__{name}") for name in TIMES}
    rows = rows.withColumn("__why", _why(F.col("__text"), F.col("__v"), times))
    rows = rows.withColumn("__a", F.when(F.col("__why").isNull(), F.from_json("__text", ANALYSIS, {"mode": "PERMISSIVE"})))
    a = F.col("__a")
    if strict:
        of = lambda name: F.zip_with(a[name], times[name], lambda c, t: c.withField(TIMES[name], t["number"]))
        rows = rows.withColumn("__a", F.when(a.isNotNull(), F.struct(*(of(name).alias(name) for name in TIMES))))
    a = round_times(F.col("__a"), exact)
    why = [F.col("__why").alias("failure")] if (strict if reason is None else reason) else []
    return rows.select(*raw.columns, *(a[name].alias(name) for name in TIMES), F.col("__why").isNotNull().alias("failed"), *why).drop("raw")


def read_batch_analyses(raw: DataFrame, exact: bool = False) -> DataFrame:
    """(batch_id, idx, measure_changes, loop_segments) of batch responses: {"analyses": [...]} or a bare list."""
    text = repair_long_decimals(F.col("raw"))
    listed = F.startswith(F.ltrim(text), F.lit("["))
    parsed = F.when(listed, F.from_json(text, f"array<{ANALYSIS}>")).otherwise(F.from_json(text, BATCH)["analyses"])
    rows = raw.select("batch_id", F.posexplode(parsed).alias("idx", "a")).withColumn("a", round_times(F.col("a"), exact))
    return rows.select("batch_id", F.col("idx").cast("long").alias("idx"), "a.measure_changes", "a.loop_segments")


def batch_position_join(files: DataFrame, results: DataFrame) -> DataFrame:
    """The i-th analysis of a batch belongs to its i-th file; `failed` where there is none.

    `files` has batch_id and idx_in_batch.
    """
    r = results.withColumnRenamed("idx", "idx_in_batch").withColumn("__there", F.lit(True))
    return files.join(r, ["batch_id", "idx_in_batch"], "left").withColumn("failed", F.col("__there").isNull()).drop("__there")
