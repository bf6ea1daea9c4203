"""Percentile bootstrap with the draws of one seeded generator, dealt over tasks by blocks of values."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS, CONFIDENCE, SEED = 500, 0.95, 20260722


#: Values that a task holds at a time, and words of the generator made at a time.
BLOCK, WORDS = 1 << 19, 1 << 20


def places(n: int, rounds: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(round, places) in order, several times a round: what randrange(n) of Python's generator draws, made in arrays.

    randrange takes the upper bits of a word of the generator and rejects what is too large, so that words can be judged together.
    """
    bits = n.bit_length()
    if bits > 32:
        raise ValueError("more values than one word of the generator can number")
    state = random.Random(seed).getstate()[1]
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    done, total = 0, n * rounds
    while done < total:
        drawn = words.random_raw(min(WORDS, 2 * (total - done) + 64)) >> np.uint64(32 - bits)
        drawn = drawn[drawn < n][: total - done].astype(np.int64)
        at = 0
        while at < len(drawn):
            r, behind = divmod(done, n)
            part = drawn[at : at + n - behind]
            yield r, part
            at, done = at + len(part), done + len(part)


def draws(spark, n: int, rounds: int = ROUNDS, seed: int = SEED, tasks: int = 8) -> DataFrame:
    """(round, at, times): how often each of n places is drawn in each round.

    The generator is sequential, so a task runs it up to its rounds and keeps only theirs; rounds are dealt in runs.
    """

    def told(r: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        at, times = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r, np.int64)), pa.array(at), pa.array(times.astype(np.int64))], ["round", "at", "times"])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {r for b in batches for r in b.column(0).to_pylist()}
        now, parts = -1, []
        for r, at in places(n, max(wanted, default=-1) + 1, seed):
            if r != now and parts:
                yield told(now, parts)
                parts = []
            now = r
            if r in wanted:
                parts.append(at)
        if parts:
            yield told(now, parts)

    return spark.range(0, rounds, 1, min(rounds, tasks)).mapInArrow(drawn, "round long, at long, times long")


def numbered(known: DataFrame) -> DataFrame:
    """v, at: values with their places in the order of o, counted from 0 without bringing all to one task."""
    return known.orderBy("o").rdd.zipWithIndex().map(lambda x: (x[0]["v"], x[1])).toDF("v double, at long")


def round_sums(placed: DataFrame, n: int, rounds: int, seed: int, block: int = BLOCK) -> DataFrame:
    """round, s: the sum of the values drawn in each round.

    A task holds a block of values at a time and runs the generator once over them, so that draws are neither kept nor shuffled.
    """

    def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = key[0].as_py() * block
        held = np.zeros(min(block, n - low))
        for b in batches:
            held[b.column("at").to_numpy() - low] = b.column("v").to_numpy()
        sums = np.zeros(rounds)
        for r, at in places(n, rounds, seed):
            at = at[(at >= low) & (at < low + len(held))] if len(held) < n else at
            sums[r] += held[at - low].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds, dtype=np.int64)), pa.array(sums)], ["round", "s"])

    blocks = placed.select("v", "at", F.floor(F.col("at") / block).cast("long").alias("block")).groupBy("block")
    return blocks.applyInArrow(summed, "round long, s double").groupBy("round").agg(F.sum("s").alias("s"))


def interval(values: DataFrame, value: str, order: str, rounds: int = ROUNDS, confidence: float = CONFIDENCE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """value, low and high of the mean of a column (null values left out), one row; all null for no values.

    Places are given by `order`, which should not tie. Values are dealt over tasks in blocks, each of which meets all draws; the
    rounds' means are as many as there are rounds.
    """
    if rounds <= 0 or not 0 < confidence < 1:
        raise ValueError("rounds must be positive and confidence between 0 and 1")
    known = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(order).alias("o"))
    n = known.count()
    mean = known.agg(F.round(F.avg("v"), 6).alias("value"))
    if not n:
        return mean.select("value", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    sampled = round_sums(numbered(known), n, rounds, seed, block).select((F.col("s") / n).alias("m"))
    tail = (1 - confidence) / 2
    low = max(0, min(rounds - 1, math.floor(tail * rounds)))
    high = max(0, min(rounds - 1, math.ceil((1 - tail) * rounds) - 1))
    ends = sampled.agg(F.array_sort(F.collect_list("m")).alias("m")).select(F.round(F.get("m", low), 6).alias("low"), F.round(F.get("m", high), 6).alias("high"))
    return mean.crossJoin(ends)  # one row each
