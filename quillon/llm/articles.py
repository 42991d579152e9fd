"""What the operators on articles share: one row per live article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_articles(articles: DataFrame, *columns: str) -> DataFrame:
    """One row per ``doc_id`` (the row updated last where several differ), with ``columns``; null ids are no articles."""
    newest = F.struct(F.coalesce("updated_at", "created_at"), F.xxhash64(*columns))
    picked = F.max_by(F.struct(*columns), newest).alias("r")
    return articles.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(picked).select("doc_id", *(F.col(f"r.{c}").alias(c) for c in columns))


def live_ids(articles: DataFrame) -> DataFrame:
    return articles.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
