"""Cached detections: a table keyed by everything that decides them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = 1
MAX_PAYLOAD = 64 * 1024 * 1024


def with_cache_key(sources: DataFrame, config: dict[str, object], model: str) -> DataFrame:
    """``cache_key``: content, hints, settings and model; the file's name is no part of it."""
    settings = F.to_json(F.create_map(*[F.lit(str(x)) for k in sorted(config) for x in (k, config[k])])) if config else F.lit("{}")
    identity = F.struct(F.lit(SCHEMA).alias("schema"), F.col("content_sha").alias("content"), settings.alias("config"), F.col("hints").alias("hints"), F.lit(model).alias("model"))
    return sources.withColumn("cache_key", F.sha2(F.to_json(identity), 256))


def valid_entries(entries: DataFrame) -> DataFrame:
    """Entries of this schema whose payload is whole; others are misses.  Of one key the first by payload counts."""
    ok = (F.col("schema") == SCHEMA) & F.col("payload").isNotNull() & (F.octet_length("payload") <= MAX_PAYLOAD) & (F.sha2("payload", 256) == F.col("checksum"))
    return entries.filter(ok).groupBy("cache_key").agg(F.min("payload").alias("payload"))


def looked_up(sources: DataFrame, entries: DataFrame, enabled: bool = True) -> DataFrame:
    """``cache_status`` and the payload of a hit."""
    if not enabled:
        return sources.withColumn("payload", F.lit(None).cast("string")).withColumn("cache_status", F.lit("disabled"))
    rows = sources.join(valid_entries(entries), "cache_key", "left")
    return rows.withColumn("cache_status", F.when(F.col("payload").isNotNull(), F.lit("hit")).otherwise(F.lit("miss")))


def missed(sources: DataFrame, entries: DataFrame) -> DataFrame:
    return sources.join(valid_entries(entries), "cache_key", "left_anti")


def new_entries(results: DataFrame) -> DataFrame:
    """Entries of (cache_key, payload) rows."""
    return results.select("cache_key", F.lit(SCHEMA).alias("schema"), F.sha2("payload", 256).alias("checksum"), "payload")
