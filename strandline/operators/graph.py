"""Connected components of predicted pairs, in rounds whose number follows the logarithm of the longest chain."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session without that setting, as in tests, uses a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("strandline.local.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("strandline.local.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, codec: str | None = None, folders: str | None = None) -> DataFrame:
    """df written to the shared folder and read back, so that lost executors cost no history; in folders by a column's values if one is named."""
    spark = df.sparkSession
    path = f"{shared(spark)}/cut-{uuid.uuid4().hex}"
    out = df.write.option("compression", codec) if codec else df.write
    (out.partitionBy(folders) if folders else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of pairs.

    Each round takes the least label over neighbours, combined before the shuffle, and then the label of that label.
    """
    both = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = cut(both.union(both.select("y", "x")).where("x <> y").distinct())
    labels = cut(both.select(F.explode(F.array("x", "y")).alias("node")).distinct().select("node", F.col("node").alias("component")))
    while True:
        least = edges.join(labels, edges.y == labels.node).groupBy("x").agg(F.min("component").alias("least"))
        low = labels.join(least, labels.node == least.x, "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("least", "component")).alias("component"))
        up = low.select(F.col("node").alias("root"), F.col("component").alias("above"))
        after = cut(low.join(up, low.component == up.root, "left").select("node", "was", F.least("component", F.coalesce("above", "component")).alias("component")))
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels
