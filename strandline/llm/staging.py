"""Cutting lineage with tables written to the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset (a local session, as in tests) a temporary one."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("strandline.local.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="strandline-")
    spark.conf.set("strandline.local.dir", made)
    return made


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (open_ := _scratch.get()):
        open_[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths staged within each open scratch() of this thread, innermost last; other threads have their own.
_scratch: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was staged within, except for tables (fresh from staged) passed to the function it gives."""
    before, made = _scratch.get(), []
    token = _scratch.set((*before, made))
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles())
        return df

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for path in made:
            if path.rsplit("/", 1)[-1] in kept:
                if before:
                    before[-1].append(path)
            else:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2048) -> Iterator[None]:
    """Arrow batches of fewer rows for what is staged within: long texts then take little memory outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of df has it (case does not count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
