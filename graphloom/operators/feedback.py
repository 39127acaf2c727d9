"""Reviewers' feedback on decisions, and caches of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import cache_key


def latest(feedback: DataFrame, key: str = "decision_id", at: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Last feedback of each decision."""
    rest = [c for c in feedback.columns if c != key]
    return feedback.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("x")).select(key, "x.*")


def updated(decisions: DataFrame, feedback: DataFrame, key: str = "decision_id") -> DataFrame:
    """Decisions with their last feedback; those without keep what they had."""
    f = latest(feedback, key).select(key, F.col("feedback").alias("__feedback"))
    status = F.when(F.col("__feedback").isNotNull(), "reviewed").otherwise(F.lit("open"))
    return decisions.join(f, key, "left").withColumns({"teacher_feedback": F.col("__feedback"), "status": status, "resolved": F.col("__feedback").isNotNull()}).drop("__feedback")


def resolution(feedback: Column, at: Column) -> Column:
    """The note on a decision that a reviewer has settled."""
    return F.concat(F.lit("教师反馈 ("), F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit("): "), F.substring(feedback, 1, 120))


def misses(requests: DataFrame, cache: DataFrame, *parts: str) -> DataFrame:
    """Requests whose key the cache lacks, with the key."""
    keyed = requests.withColumn("key", cache_key(*(F.col(p) for p in parts)))
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")
