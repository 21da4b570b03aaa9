"""Headline feeds: JSON arrays in two shapes, flattened to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import schemas

HEADLINES = 5


def _first_items(news: DataFrame, n: int) -> DataFrame:
    items = F.from_json("items", schemas.NEWS_ITEMS)
    return news.select("ticker", F.posexplode(F.slice(items, 1, n)).alias("pos", "item"))


def headlines(news: DataFrame, n: int = HEADLINES) -> DataFrame:
    """First n items per ticker, then untitled ones dropped, nested or flat."""
    rows = _first_items(news, n)
    nested = F.col("item.content").isNotNull()

    def pick(path):
        return F.when(nested, F.col(f"item.content.{path}")).otherwise(F.col(f"item.{path}"))

    link = F.coalesce(pick("canonicalUrl.url"), pick("clickThroughUrl.url"))
    flat = rows.select(
        "ticker", "pos", pick("title").alias("title"),
        pick("provider.displayName").alias("publisher"), link.alias("link"),
        pick("pubDate").alias("published_at"),
    )
    return flat.filter(F.length("title") > 0)


def search_feed(news: DataFrame, n: int = HEADLINES) -> DataFrame:
    """The flat feed with its publication time in epoch seconds."""
    rows = _first_items(news, n).filter(F.length("item.title") > 0)
    return rows.select(
        "ticker", "pos", F.col("item.title").alias("title"),
        F.col("item.publisher").alias("publisher"), F.col("item.link").alias("link"),
        F.timestamp_seconds("item.providerPublishTime").alias("published_at"),
    )


def ticker_context(lines: DataFrame, macro: DataFrame) -> DataFrame:
    """Headlines per ticker next to the macro readings (one row, read as scalars)."""
    story = F.struct("pos", "title", "publisher", "link", "published_at")
    per = lines.groupBy("ticker").agg(F.array_sort(F.collect_list(story)).alias("headlines"))
    return per.withColumns({c: macro.select(c).scalar() for c in macro.columns})
