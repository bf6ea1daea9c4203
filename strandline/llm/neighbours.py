"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy graph search, in Spark rounds.

Equal vectors are one node. First lists come from brute force inside random-projection buckets. In each NN-descent
round, nodes are taken in blocks that lie together; a block gets the vectors of its nodes' neighbours and reverse
neighbours once, compares neighbours of neighbours as small matrix products, and sends the best of each back. Queries
walk the graph: in each round every query opens its best unopened nodes, scores their neighbours and keeps a beam.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

_LISTS = "node long, ids array<long>, scores array<float>"


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().astype(np.float32).reshape(-1, dim) if len(column) else np.zeros((0, dim), np.float32)


def _lists(nodes: np.ndarray, ids: list[np.ndarray], scores: list[np.ndarray]) -> pa.Table:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat_i = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
    flat_s = np.concatenate([*scores, np.zeros(0, np.float32)]).astype(np.float32)
    return pa.table({"node": pa.array(nodes.astype(np.int64)), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat_i)), "scores": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat_s))})


def _best(lists: DataFrame, k: int) -> DataFrame:
    """The k best different neighbours of each node from several lists."""
    rows = lists.select("node", F.arrays_zip("scores", "ids").alias("z"))
    merged = rows.groupBy("node").agg(F.flatten(F.collect_list("z")).alias("z"))
    ordered = F.sort_array(F.array_distinct("z"), asc=False)
    return merged.select("node", F.slice(ordered, 1, k).alias("z")).select("node", F.col("z.ids").alias("ids"), F.col("z.scores").alias("scores"))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vec of vectors that take part: not null, without null or non-finite components, not zero, of the most common length."""
    v = F.col(embedding)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("vec")).where("vec is not null and vec_id is not null")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("vec") == (common.dim if common else -1))


def build_graph(nodes: DataFrame, dim: int, total: int, k: int, trees: int, bucket: int, rounds: int, reverse: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """node, ids, scores, and node, region (nodes that lie together): for each of nodes (node, vec) about its k nearest others, after `rounds` of NN-descent."""
    bits = max(0, int(np.ceil(np.log2(max(1, total) / (bucket / 2)))))
    planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((trees, bits, dim))
    mean = np.array([r[0] for r in nodes.select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").select("m").collect()])

    def codes(batches):
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column("vec")]), dim) - mean
            out = np.zeros((len(x), trees), np.int64)
            for t in range(trees):
                out[:, t] = ((x @ planes[t].T > 0) @ (1 << np.arange(bits))) if bits else 0
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), trees).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("vec"), lists], ["node", "vec", "codes"])

    coded = nodes.mapInArrow(codes, "node long, vec array<float>, codes array<long>").select("node", "vec", F.posexplode("codes").alias("tree", "code"))
    coded = staged(coded)
    sizes = coded.groupBy("tree", "code").agg(F.ceil(F.count("*") / bucket).alias("slices"))
    placed = staged(coded.join(sizes, ["tree", "code"]).select("node", "vec", "tree", F.xxhash64("tree", "code", F.pmod(F.xxhash64("node"), "slices")).alias("block"), F.xxhash64(F.shiftright("code", 2), F.pmod(F.xxhash64("node"), "slices")).alias("region")))

    def brute(table: pa.Table) -> pa.Table:
        ids, x = table.column("node").to_numpy(), _matrix(table.column("vec"), dim)
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        m = min(k, len(ids) - 1)
        near = np.argpartition(-s, m - 1, axis=1)[:, :m] if 0 < m < len(ids) - 1 else np.argsort(-s, axis=1)[:, :m]
        return _lists(ids, list(ids[near]), list(np.take_along_axis(s, near, 1)))

    graph = staged(_best(placed.groupBy("block").applyInArrow(brute, _LISTS), k))
    home = placed.where("tree = 0").select("node", "block", "region")

    def local_join(edges: pa.Table, vecs: pa.Table) -> pa.Table:
        names, x = vecs.column("node").to_numpy(), _matrix(vecs.column("vec"), dim)
        order = np.argsort(names)
        names, x = names[order], x[order]
        v, u = edges.column("node").to_numpy(), np.searchsorted(names, edges.column("other").to_numpy())
        sort = np.argsort(v, kind="stable")
        u = u[sort]
        cuts = np.flatnonzero(np.r_[True, v[sort][1:] != v[sort][:-1], True])
        left, right, score = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            group = np.unique(u[a:b])
            s = x[group] @ x[group].T
            np.fill_diagonal(s, -np.inf)
            m = min(k // 2, len(group) - 1)
            if m > 0:
                near = np.argpartition(-s, m - 1, axis=1)[:, :m]
                left.append(np.repeat(group, m))
                right.append(group[near].ravel())
                score.append(np.take_along_axis(s, near, 1).ravel())
        if not left:
            return _lists(np.zeros(0, np.int64), [], [])
        left, right, score = np.concatenate(left), np.concatenate(right), np.concatenate(score)
        pair = np.unique(left * len(names) + right, return_index=True)[1]
        left, right, score = left[pair], right[pair], score[pair]
        sort = np.lexsort((-score, left))
        left, right, score = left[sort], right[sort], score[sort]
        first = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
        keep = np.arange(len(left)) - np.repeat(first, np.diff(np.r_[first, len(left)])) < k
        left, right, score = left[keep], right[keep], score[keep]
        cuts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])[1:]
        return _lists(names[np.unique(left)], np.split(names[right], cuts), np.split(score, cuts))

    for _ in range(rounds):
        forward = graph.select("node", F.explode("ids").alias("other"))
        back = Window.partitionBy("node").orderBy(F.xxhash64("node", "other"))
        reversed_ = forward.select(F.col("other").alias("node"), F.col("node").alias("other")).withColumn("n", F.row_number().over(back)).where(F.col("n") <= reverse).drop("n")
        edges = staged(forward.union(reversed_).distinct().join(home.select("node", "block"), "node").select("block", "node", "other"))
        wanted = edges.select(F.col("block").alias("place"), F.col("other").alias("node")).distinct().join(nodes, "node").select("place", "node", "vec")
        joined = edges.groupBy("block").cogroup(wanted.groupBy("place")).applyInArrow(local_join, _LISTS)
        graph = staged(_best(graph.unionByName(joined), k))
    return graph, home.select("node", "region")


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, dim: int, beam: int, width: int, hops: int) -> DataFrame:
    """For each of queries (node, region) its beam: ids. Queries are nodes of the graph and start from their own lists.

    Queries of a region are searched together, so that a vector is sent once to a region and round.
    """
    back = Window.partitionBy("node").orderBy(F.xxhash64("node", "other"))
    forward = graph.select("node", F.explode("ids").alias("other"))
    reverse = forward.select(F.col("other").alias("node"), F.col("node").alias("other")).withColumn("n", F.row_number().over(back)).where("n <= 16").drop("n")
    links = staged(forward.union(reverse).groupBy("node").agg(F.collect_set("other").alias("near")))
    vectors = nodes.withColumnRenamed("vec", "query")
    state = graph.join(queries, "node").join(vectors, "node").select("node", "region", "query", "ids", "scores", F.array("node").alias("opened"))

    def step(held: pa.Table, found: pa.Table) -> pa.Table:
        names, x = found.column("other").to_numpy(), _matrix(found.column("vec"), dim)
        order = np.argsort(names)
        names, x = names[order], x[order]
        ids, scores = [], []
        for row in held.select(["query", "ids", "scores", "new"]).to_pylist():
            new = np.array(row["new"], np.int64)
            score = np.concatenate([np.array(row["scores"], np.float32), x[np.searchsorted(names, new)] @ np.array(row["query"], np.float32)])
            every = np.concatenate([np.array(row["ids"], np.int64), new])
            best = np.lexsort((every, -score))[:beam]
            ids.append(every[best].tolist())
            scores.append(score[best].tolist())
        out = held.select(["node", "region", "query", "opened"])
        out = out.append_column("ids", pa.array(ids, pa.list_(pa.int64()))).append_column("scores", pa.array(scores, pa.list_(pa.float32())))
        return out.select(["node", "region", "query", "ids", "scores", "opened"])

    schema = "node long, region long, query array<float>, ids array<long>, scores array<float>, opened array<long>"
    for _ in range(hops):
        fresh = F.slice(F.array_except("ids", "opened"), 1, width)
        state = staged(state.withColumn("fresh", fresh).withColumn("opened", F.concat("opened", "fresh")))
        if state.where("size(fresh) > 0").isEmpty():
            break
        frontier = state.select(F.col("node").alias("q"), F.explode("fresh").alias("node"))
        met = frontier.join(links, "node").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        held = state.join(met, state.node == met.q, "left").withColumn("new", F.array_except(F.coalesce("near", F.array().cast("array<long>")), F.concat("ids", F.array("node"))))
        held = staged(held.select("node", "region", "query", "ids", "scores", "opened", "new"))
        wanted = held.select(F.col("region").alias("place"), F.explode("new").alias("other")).distinct()
        wanted = wanted.join(nodes.withColumnRenamed("node", "other"), "other").select("place", "other", "vec")
        state = held.groupBy("region").cogroup(wanted.groupBy("place")).applyInArrow(step, schema)
    return staged(state.select("node", "ids"))


def nearest(
    vectors: DataFrame, every: int = 20, top: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
    k: int = 32, trees: int = 4, bucket: int = 512, rounds: int = 2, reverse: int = 16, beam: int = 160, width: int = 32, hops: int = 5, seed: int = 11,
) -> DataFrame:
    """For rows whose id is divisible by `every`: their `top` nearest others found: query_id, rank, vec_id, score.

    Nearest is the largest inner product in double precision, ties to the smaller id. Every usable row is indexed;
    equal vectors are one node, of which the top + 1 smallest ids can appear in a result. Null ids and unusable vectors
    (see usable) take no part; an id that repeats stands for the smallest of its vectors. k, rounds, beam, width
    and hops are the search effort.
    """
    rows = usable(vectors, vec_id, embedding).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    rows = staged(rows.withColumn("node", F.xxhash64("vec")))
    if rows.isEmpty():
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    order = Window.partitionBy("node").orderBy("vec_id")
    members = staged(rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top + 1).select("node", "vec_id", "nth", "vec"))
    nodes = staged(members.where("nth = 1").select("node", F.col("vec").cast("array<float>").alias("vec")))
    first = nodes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    graph, home = build_graph(nodes, first.dim, first.n, k, trees, bucket, rounds, reverse, seed)
    asked = rows.where(F.col("vec_id") % every == 0).select("node", "vec_id")
    queries = asked.select("node").distinct()
    found = search(graph, nodes, queries.join(home, "node"), first.dim, beam, width, hops)
    # a query's own node is a candidate too: copies of its vector
    pairs = found.select(F.col("node").alias("q"), F.explode(F.array_union(F.array("node"), "ids")).alias("node")).union(queries.select(F.col("node").alias("q"), "node")).distinct()
    vec_of = members.where("nth = 1").select(F.col("node").alias("q"), F.col("vec").alias("query"))
    dot = F.aggregate(F.zip_with("query", "vec", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.join(members, "node").join(vec_of, "q").select("q", "vec_id", dot.alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = scored.withColumn("at", F.row_number().over(best)).where(F.col("at") <= top + 1)
    lists = lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
    results = asked.select(F.col("node").alias("q"), F.col("vec_id").alias("query_id")).join(lists, "q")
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, top)
    return results.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
