"""Landed files: feeds and sitemaps (XML), and lines of labelled JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files and entries of Atom files: id (guid, link or title), title, link, published, summary; those without a title or a link go."""
    rss = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, pubDate string, description string").load(path)
    atom = spark.read.format("xml").option("rowTag", "entry").schema("title string, id string, link struct<_href:string>, updated string, published string, summary string").load(path)
    both = rss.select("title", "link", "guid", F.col("pubDate").alias("published"), F.col("description").alias("summary")).unionByName(
        atom.select("title", F.col("link._href").alias("link"), F.col("id").alias("guid"), F.coalesce("published", "updated").alias("published"), "summary")
    )
    items = both.where((F.trim("title") != "") & (F.trim("link") != ""))
    return items.select(F.coalesce("guid", "link", "title").alias("id"), F.trim("title").alias("title"), F.trim("link").alias("link"), "published", "summary")


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """url, lastmod of sitemap files, each URL once with its newest date."""
    urls = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return urls.where(F.trim("loc") != "").groupBy(F.trim("loc").alias("url")).agg(F.max("lastmod").alias("lastmod"))


def labelled_lines(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame:
    """file, line, value, outcome for lines of JSON that are neither blank nor comments: ok, bad_json or bad_label."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("value"))
    rows = raw.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    parsed = F.from_json("value", "id string, label string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    outcome = F.when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "bad_json").when(~F.coalesce(F.col("r.label").isin(*labels), F.lit(False)), "bad_label").otherwise("ok")
    return rows.withColumn("r", parsed).select("file", "value", "r.id", "r.label", outcome.alias("outcome"))
