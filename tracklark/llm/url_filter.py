"""URL filters: rules for hosts and paths, and logistic regression on hashed character n-grams for the rest.

A rule names a host (and so its subdomains) and the start of a path; the longest that fits decides. URLs that no rule
fits are judged by a logistic regression on the distinct hashed n-grams (3 to 5 bytes) of host and path. It learns from
a small labelled table: at most TRAIN_URLS URLs, those with the smallest_keys seeded hashes, that the rules decide. One task
fits it; its 2**BITS weights are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import smallest_keys, table

BITS = 16
TRAIN_URLS = 10_000
PASSES = 4
#: The contract's rules: host, path, verdict. Fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null and for URLs without `://`."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ngrams(host: str, path: str) -> np.ndarray:
    """Distinct slots of the n-grams of host and path; the two never share a slot's meaning."""
    slots = []
    for salt, text in ((0x9E3779B97F4A7C15, f"^{host}$"), (0xC2B2AE3D27D4EB4F, f"{path}$")):
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
        for n in (3, 4, 5):
            if len(b) >= n:
                h = np.full(len(b) - n + 1, salt + n & 2**64 - 1, np.uint64)
                for k in range(n):
                    h = (h ^ b[k : k + len(h)]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(32)
                slots.append(h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(slots)).astype(np.int32) if slots else np.zeros(0, np.int32)


def learned(rows: list[tuple[np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """Weights by slot and, last, the bias after `passes` of stochastic gradient steps over (slots, blocked), with rates
    that fall by slot (AdaGrad) and a little L2; zeros unless there are both verdicts."""
    made = [(np.append(slots, 2**BITS), y) for slots, y in rows]
    w, n = np.zeros(2**BITS + 1), np.full(2**BITS + 1, 1e-8)
    for _ in range(passes if len({y for _, y in made}) == 2 else 0):
        for at, y in made:
            g = 1 / (1 + np.exp(-np.clip(w[at].sum(), -35, 35))) - y + 1e-5 * w[at]
            n[at] += g * g
            w[at] -= 0.1 * g / np.sqrt(n[at])
    return w


def train(labelled: DataFrame, urls: int = TRAIN_URLS, passes: int = PASSES, seed: int = 31) -> np.ndarray:
    """Weights by slot and, last, the bias, from (`host`, `path`, `blocked`). Without both verdicts all are 0."""
    sample = labelled.where(F.col("blocked").isNotNull())
    sample = smallest_keys(sample, seed, urls, ["host", "path"], F.max("blocked").cast("int").alias("blocked"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        w = learned([(ngrams(h, p), y) for _, h, p, y in rows], passes)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["weights"])

    made = sample.select("__order", "host", "path", "blocked").coalesce(1).mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(made[0]["weights"]) if made else np.zeros(2**BITS + 1)


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule, verdict (allow or block) and `blocked`, the regression's probability.

    URLs that are null or have no `://` have an empty host and path, fit no rule and are judged by the regression.
    Columns of the input with these names are replaced; repeated rows are judged each, and an empty table gives an empty
    one. Of rules of equal length that fit, the one given last counts. A URL is read in one piece, however long.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "blocked")]
    host, path = host_and_path(url)
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    weights = train(rows.select("host", "path", (F.col("__rule.verdict") == "block").alias("blocked")))
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            x = np.array([w[ngrams(h, p)].sum() for h, p in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist(), strict=True)]) + w[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(x, -500, 500))))], names=[*rows_out, "blocked"])

    rows = rows.withColumn("rule", F.col("__rule.rule")).withColumn("__verdict", F.col("__rule.verdict")).drop("__rule")
    rows_out = rows.columns
    at = rows_out.index("host"), rows_out.index("path")
    judged = rows.mapInArrow(run, rows.withColumn("blocked", F.lit(0.0)).schema)
    verdict = F.coalesce("__verdict", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow"))
    return judged.select(*kept, "host", "path", "rule", verdict.alias("verdict"), "blocked")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
