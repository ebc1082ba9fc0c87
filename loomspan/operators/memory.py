"""An agent's memories: recall with boosts, touching, forgetting and pruning. "Now" is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMPORTANCE, REINFORCEMENT, SATURATION, TAU_DAYS, FLOOR = 0.15, 0.15, 10, 30.0, 0.35
PRUNE_BELOW, GRACE_DAYS = 0.5, 30


def age_days(at: Column, now: Column) -> Column:
    """Days between two times with their fractions, never below 0."""
    return F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0), F.lit(0.0))


def reinforcement(count: Column, last: Column, now: Column, tau: float = TAU_DAYS) -> Column:
    """Between 0 and 1: grows with the accesses up to a limit, fades with the time since the last."""
    often = F.least(F.log1p(F.greatest(count, F.lit(0)).cast("double")) / F.log1p(F.lit(float(SATURATION))), F.lit(1.0))
    return often * F.exp(-age_days(last, now) / tau)


def boosted(relevance: Column, importance: Column, count: Column, last: Column, now: Column) -> Column:
    return relevance + F.when(importance, IMPORTANCE).otherwise(0.0) + REINFORCEMENT * reinforcement(count, last, now)


def retention(count: Column, last: Column, now: Column, tau: float = TAU_DAYS) -> Column:
    """What pruning looks at: accesses and one, fading with time."""
    return (1 + F.greatest(count, F.lit(0))) * F.exp(-age_days(last, now) / tau)


def remember(memories: DataFrame, new: DataFrame) -> DataFrame:
    """memories with new ones, whose ids replace those there are."""
    return memories.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def recall(memories: DataFrame, relevance: DataFrame, now: Column, k: int = 5) -> DataFrame:
    """The k memories with the highest final score. relevance: id, score between 0 and 1. Archived ones
    are never recalled; ties go by id."""
    live = memories.filter("archived_at IS NULL").join(relevance, "id")
    final = boosted(F.col("score"), F.col("importance"), F.col("access_count"), F.col("last_accessed_at"), now)
    return live.withColumn("final_score", F.round(final, 9)).orderBy(F.desc("final_score"), "id").limit(k)


def touch(memories: DataFrame, hits: DataFrame, now: Column, floor: float = FLOOR) -> DataFrame:
    """memories with one access more, at `now`, for hits (id, raw_score) at or above the floor."""
    hit = hits.filter(F.col("raw_score") >= floor).select("id", F.lit(True).alias("_hit")).distinct()
    rows = memories.join(hit, "id", "left")
    out = {"access_count": F.col("access_count") + F.when(F.col("_hit"), 1).otherwise(0), "last_accessed_at": F.when(F.col("_hit"), now).otherwise(F.col("last_accessed_at"))}
    return rows.withColumns(out).drop("_hit")


def forget(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id"), "id", "left_anti")


def prune(memories: DataFrame, now: Column, below: float = PRUNE_BELOW, grace_days: int = GRACE_DAYS, tau: float = TAU_DAYS) -> DataFrame:
    """(id, action): archive for faded memories that aren't important, delete for those archived longer
    than the grace time."""
    faded = F.col("archived_at").isNull() & ~F.coalesce("importance", F.lit(False)) & (retention(F.col("access_count"), F.col("last_accessed_at"), now, tau) < below)
    expired = F.col("archived_at") <= now - F.expr(f"INTERVAL {grace_days} DAYS")
    return memories.select("id", F.when(faded, "archive").when(expired, "delete").alias("action")).filter("action IS NOT NULL")


def important(memories: DataFrame) -> DataFrame:
    """Important memories that aren't archived, by time of creation."""
    return memories.filter("archived_at IS NULL AND importance").orderBy("created_at", "id")
