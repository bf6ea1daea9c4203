"""Keyed tables on Parquet: upserts that a replayed batch leaves unchanged, from batches and from streams.

A table is dealt into buckets by a hash of its identity. An upsert reads the buckets that a batch touches, works out what every
row of the batch does, stages the new buckets in the shared folder and then overwrites just those partitions. Rows are shuffled
once, by bucket and a part of it, and stay in that order to the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.graph import cut

# Buckets of a table, parts in which a bucket is dealt over tasks, and how staged and stored rows are packed.
BUCKETS, PARTS, CODEC = 16, 4, "zstd"


def identity(source: str = "source_id", external: str = "external_id", url: str = "url") -> Column:
    """A row's identity: source and external id, or source and URL where there is none."""
    known = F.coalesce(F.col(external).cast("string"), F.lit("")) != ""
    key = F.when(known, F.concat(F.lit("id:"), F.col(external))).otherwise(F.concat(F.lit("url:"), F.coalesce(url, F.lit(""))))
    return F.concat_ws("\x1f", F.coalesce(F.col(source).cast("string"), F.lit("")), key)


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _merged(maps: Column) -> Column:
    return F.aggregate(maps, F.lit(None).cast("map<string,string>"), lambda a, b: F.when(a.isNull(), b).otherwise(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)))


def upsert(path: str, batch: DataFrame, key: Column, fields: Sequence[str], substantive: Sequence[str] = (), metadata: str | None = None, order: str = "id", keep_old: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """Writes a batch into the table and returns a row for each of the batch: identity, order and outcome.

    Rows of one identity act one after the other, by `order`: `saved` for the first of an unknown identity, then
    substantive_update, non_substantive_update or unchanged. A null does not replace a value (with keep_old=False it does);
    a map in `metadata` is merged key by key. Rows with equal order are taken by their values. An empty batch changes nothing.
    """
    spark = batch.sparkSession
    named = [*fields, *([metadata] if metadata else [])]
    new = batch.select(key.alias("_key"), F.col(order).cast("long").alias("_at"), *named, F.lit(1).alias("_new"))
    bucket = F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int")
    new = new.withColumn("_bucket", bucket)
    if _there(spark, path):
        new = cut(new, CODEC)  # read twice
        table = spark.read.schema(new.drop("_new", "_at").schema).parquet(path)
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # as many as there are buckets at most
        old = table.where(F.col("_bucket").isin(touched)).select("_key", F.lit(None).cast("long").alias("_at"), *named, F.lit(0).alias("_new"), "_bucket")
        rows = old.unionByName(new)
    else:
        rows = new
    rows = rows.withColumn("_part", F.pmod(F.hash("_key"), F.lit(PARTS))).repartition("_bucket", "_part")
    w = Window.partitionBy("_bucket", "_part", "_key").orderBy("_new", F.asc_nulls_first("_at"), *fields)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = {f: F.last(f, ignorenulls=keep_old).over(upto) for f in fields}
    if metadata:
        value[metadata] = _merged(F.collect_list(metadata).over(upto))
    rows = rows.select("_key", "_at", "_new", "_bucket", "_part", *(c.alias(f) for f, c in value.items()), F.row_number().over(w).alias("_n"), F.lead("_new").over(w).isNull().alias("_final"))
    shown = lambda f: F.array_sort(F.map_entries(f)) if f == metadata else F.col(f)
    differs = {f: ~shown(f).eqNullSafe(F.lag(shown(f)).over(w)) for f in named}
    changed = [F.coalesce(d, F.lit(False)) for d in differs.values()]
    deep = [F.coalesce(differs[f], F.lit(False)) for f in (substantive or fields)]
    some = lambda tests: F.exists(F.array(*tests), lambda x: x)
    outcome = F.when(F.col("_n") == 1, "saved").when(some(deep), "substantive_update").when(some(changed), "non_substantive_update").otherwise("unchanged")
    # values are needed of the last row of an identity only
    kept = [F.when(F.col("_final"), F.col(f)).alias(f) for f in named]
    done = cut(rows.withColumn("_outcome", outcome).select("_key", "_at", "_new", "_final", "_outcome", *kept, "_bucket"), CODEC, "_bucket")
    final = done.where("_final").select("_key", *named, "_bucket")
    final.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC).partitionBy("_bucket").parquet(path)
    return done.where("_new = 1").select(F.col("_key").alias("identity"), F.col("_at").alias("at"), F.col("_outcome").alias("outcome"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table, without its bookkeeping columns but the identity."""
    return spark.read.parquet(path).drop("_bucket").withColumnRenamed("_key", "identity")


def upserting(path: str, key: Column, fields: Sequence[str], **options) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a micro-batch that is run again after a failure finds its rows unchanged."""

    def write(batch: DataFrame, _: int) -> None:
        upsert(path, batch, key, fields, **options)

    return write
