"""Approximate nearest neighbours: an inverted file of product-quantised residuals, reranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Numbers in the sample that the index is fitted on, at most (every vector is indexed), and vectors of the sample to a centroid at least.
SAMPLE_NUMBERS, SAMPLE_A_LIST = 1 << 23, 32
#: Lists beyond which they are fitted in two levels, and vectors of the sample that codebooks are fitted on at most.
FLAT, CODED = 512, 1 << 14
#: Subspaces of the quantiser, and its codes to a subspace at most.
SUBSPACES, CODES = 16, 256
#: Share of the neighbours that lie in the lists a query reads, as measured against all vectors, and the queries for that.
RECALL, TRIALS = 0.97, 256
#: Candidates of a list that are compared exactly at first for each neighbour asked for; all that may be better follow.
RERANK = 3
#: Vectors of a list that are searched by one task at once; longer lists are split.
LIST_ROWS = 8192
#: Queries that read a list at once, about; those of a list that more read are dealt out, each share with a copy of the list's parts.
QUERY_ROWS = 1 << 15


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """``k`` centres of ``x``; a centre that loses all its vectors is put on the one farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].astype(np.float64)
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if empty := np.flatnonzero(counts == 0).tolist():
            far = np.argsort(-((x - centres[own]) ** 2).sum(1), kind="stable")[: len(empty)]
            centres[empty[: len(far)]] = x[far]
    return centres


def two_levels(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """About ``k`` centres of ``x``: of root ``k`` groups, and within each as many as its share of the vectors; work grows with the root of ``k``."""
    if k <= FLAT:
        return k_means(x, k, seed)
    groups = k_means(x, round(k**0.5), seed)
    own = _nearest(x, groups)
    out = []
    for g in range(len(groups)):
        if len(part := x[own == g]):
            out.append(k_means(part, min(len(part), max(1, round(k * len(part) / len(x)))), seed + 1 + g))
    return np.concatenate(out)


@dataclass
class Index:
    """Coarse centroids, and the quantiser's codebook for each subspace."""

    centres: np.ndarray
    edges: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int) -> Index:
        centres = two_levels(sample, lists, seed)
        sample = sample[:CODED]
        rest = sample - centres[_nearest(sample, centres)]
        edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        books = [k_means(rest[:, a:b], min(CODES, len(rest)), seed + 1 + k, 8) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        return cls(centres, edges, books)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector and the codes of its residual."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        return own, np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)], 1).astype(np.uint8)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The lists whose centres have the largest inner products with each query."""
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :n]

    def probes_for(self, q: np.ndarray, trial: np.ndarray, lists: np.ndarray, recall: float) -> int:
        """How many lists a query has to read so that ``recall`` of the neighbours lie in them; ``trial`` and ``lists``: for each of the true neighbours of
        the queries ``q`` the query's place and the list that holds it."""
        if not len(trial):
            return len(self.centres)
        place = np.argsort(self.probes(q, len(self.centres)), axis=1)
        at = np.sort(place[trial, lists])
        return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))))]) + 1

    def search(self, q: np.ndarray, x: np.ndarray, codes: np.ndarray, ids: np.ndarray, k: int, rerank: int, centre: np.ndarray):
        """For each query the places of the best ``k`` of a list's ``x`` and their inner products; ties to smaller ids. The tables of the query's products
        with each code tell every product but for an error, at most the query's length times that of what the codes leave of the vector. Of the ``k * rerank``
        first by table the ``k``-th product is a bound, and all vectors that may reach it are compared exactly, so that codes too coarse for a list lose nothing."""
        parts = list(zip(self.edges, self.edges[1:], self.books, strict=False))
        rough = sum((q[:, a:b] @ book.T)[:, codes[:, j]] for j, (a, b, book) in enumerate(parts)) + (q @ centre)[:, None]
        n = min(k * rerank, len(x))
        if n < len(x):
            near = np.argpartition(-rough, n - 1, axis=1)[:, :n]
            first = (x[near] * q[:, None, :]).sum(axis=2)
            bound = -np.partition(-first, k - 1, axis=1)[:, k - 1]
            left = x - centre - np.concatenate([book[codes[:, j]] for j, (*_, book) in enumerate(parts)], axis=1)
            lengths = np.linalg.norm(q, axis=1)
            # rounding of sums is far below this share of the lengths
            slack = np.linalg.norm(left, axis=1) + 1e-12 * (np.linalg.norm(x, axis=1) + np.linalg.norm(centre))
            chosen = np.flatnonzero((rough + lengths[:, None] * slack >= bound[:, None]).any(axis=0))
            products = q @ x[chosen].T
            last = -np.partition(-products, k - 1, axis=1)[:, k - 1] - 1e-12 * lengths * np.linalg.norm(x, axis=1).max()
            n = int((products >= last[:, None]).sum(axis=1).max())
            near = chosen[np.argpartition(-products, n - 1, axis=1)[:, :n]] if n < len(chosen) else np.broadcast_to(chosen, products.shape)
        else:
            near = np.broadcast_to(np.arange(len(x)), rough.shape)
        exact = (x[near] * q[:, None, :]).sum(axis=2)
        best = np.lexsort((ids[near], -exact), axis=1)[:, :k]
        return np.take_along_axis(near, best, 1), np.take_along_axis(exact, best, 1)


def _matrix(column, dims: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or zero, all components there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = RECALL,
    rerank: int = RERANK,
    seed: int = 42,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) that ``is_query`` holds for, the ``k`` rows of
    another vec_id with the largest inner products found, in double precision; ties to smaller ids.

    Rows of equal vectors are one node of the index, which keeps the ``k + 1`` smallest of their ids: no other can be in a
    result. The index is fitted on at most ``SAMPLE_NUMBERS`` numbers of different vectors (or ``CODED`` vectors), in an order of hashes, and holds all. Lists grow as the root of the number of vectors
    until the sample bounds them, many in two levels; a list of over ``LIST_ROWS`` vectors is split, each part searched by a task of its own, and so are the
    queries of a list that over ``QUERY_ROWS`` read. A query reads
    its best lists, as many as hold ``recall`` of the true neighbours of ``TRIALS`` of the queries among all vectors, and more until they hold ``k + 1`` vectors; products by table choose
    candidates, as many as may be among the best given what the codes leave of each vector, and these
    are reranked by the original vectors, which lie with the codes, so that only ``k + 1`` rows a list leave a task.

    Vectors that are null, zero, hold null or non-finite components, or are of another length than most, take no part, nor do rows with
    a null id; a repeated id counts once for each of its vectors; an empty table gives no rows; fewer than ``k``
    other rows are all returned.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    told = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("asks"))
    told = told.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    length = told.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    dims = length.d
    told = told.where(F.size("v") == dims).dropDuplicates(["vec_id", "v"])
    at = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    low = told.withColumn("at", at).where(F.col("at") <= k + 1)
    nodes = low.groupBy("v").agg(F.min("vec_id").alias("low"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # a vec_id with several vectors is the lowest of several nodes; the hash tells them apart
    nodes = checkpoint(nodes.select(F.xxhash64("low", "v").alias("node"), "v", "low", "ids"))
    n = nodes.count()
    most = max(CODED, SAMPLE_NUMBERS // dims)
    lists = max(1, min(1 << max(0, round(np.log2(n) / 2 - 1)), min(n, most) // SAMPLE_A_LIST))
    most = min(most, max(CODED, 2 * SAMPLE_A_LIST * lists))
    sample = _matrix(nodes.orderBy(F.xxhash64("v", F.lit(seed))).limit(most).select("v").toArrow().column("v"), dims)
    index = Index.fit(sample, lists, seed)
    lists = len(index.centres)
    shared = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, codes = shared.value.encode(_matrix(batch.column("v"), dims))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(batch.column(c) for c in ("node", "low", "v")), packed], names=["list", "node", "low", "v", "codes"])

    kind = nodes.schema["v"].dataType.simpleString()
    indexed = checkpoint(nodes.select("node", "low", "v").mapInArrow(encode, f"list int, node long, low long, v {kind}, codes binary"))
    sizes = {r.list: r["count"] for r in indexed.groupBy("list").count().collect()}
    held = np.array([sizes.get(j, 0) for j in range(lists)])
    parts = -(-held // LIST_ROWS)
    split = F.element_at(F.array(*(F.lit(int(max(1, p))) for p in parts)), F.col("list") + 1)
    indexed = indexed.withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), split).cast("int"))

    asking = told.where("asks").select("v", F.col("vec_id").alias("query_id")).distinct()
    asking = checkpoint(asking.join(nodes.select("node", "v"), "v").select("query_id", "node"))
    queries = asking.select("node").distinct().join(nodes, "node").select("node", "v")
    some = queries.orderBy(F.xxhash64("node", F.lit(seed + 2))).limit(TRIALS).toArrow()
    trials, own = _matrix(some.column("v"), dims), some.column("node").to_numpy()

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``k`` vectors of a partition nearest to each of the ``trials`` but itself, and the lists they are in."""
        scores, held_by = np.empty((len(own), 0)), np.empty((len(own), 0), np.int32)
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                products = trials @ _matrix(batch.column("v"), dims).T
                products[own[:, None] == batch.column("node").to_numpy()] = -np.inf
                scores = np.concatenate([scores, products], axis=1)
                held_by = np.concatenate([held_by, np.broadcast_to(batch.column("list").to_numpy(), products.shape)], axis=1)
                if scores.shape[1] > k:
                    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    scores, held_by = np.take_along_axis(scores, best, 1), np.take_along_axis(held_by, best, 1)
        q, at = np.nonzero(scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(scores[q, at]), pa.array(held_by[q, at])], names=["q", "score", "list"])

    order = Window.partitionBy("q").orderBy(F.desc("score"))
    nearest = indexed.select("list", "node", "v").mapInArrow(true, "q long, score double, list int").withColumn("at", F.row_number().over(order))
    nearest = nearest.where(F.col("at") <= k).select("q", "list").toArrow()
    probes = index.probes_for(trials, nearest.column("q").to_numpy(), nearest.column("list").to_numpy(), recall)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part of each list that a query reads: its first ``probes``, and on until they hold ``k + 1`` vectors."""
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                ordered = shared.value.probes(_matrix(batch.column("v"), dims), lists)
                before = np.cumsum(held[ordered], axis=1) - held[ordered]
                row, place = np.nonzero((np.arange(ordered.shape[1]) < probes) | (before < k + 1))
                chosen = ordered[row, place]
                each = parts[chosen]
                row, read = np.repeat(row, each), np.repeat(chosen, each)
                part = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                columns = [pa.array(read.astype(np.int32)), pa.array(part.astype(np.int32)), batch.column("node").take(pa.array(row)), batch.column("v").take(pa.array(row))]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "part", "node", "v"])

    dealt = checkpoint(queries.mapInArrow(deal, f"list int, part int, node long, v {kind}"))
    readers = {r.list: r["count"] for r in dealt.where("part = 0").groupBy("list").count().collect()}
    shares = F.element_at(F.array(*(F.lit(max(1, -(-readers.get(j, 0) // QUERY_ROWS))) for j in range(lists))), F.col("list") + 1)
    dealt = dealt.withColumn("share", F.pmod(F.xxhash64("node", F.lit(seed + 1)), shares).cast("int"))
    copies = indexed.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        x = _matrix(right.column("v"), dims)
        if not len(x) or not left.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "low": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        nodes_here, lows = right.column("node").to_numpy(), right.column("low").to_numpy()
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
        centre = shared.value.centres[right.column("list")[0].as_py()]
        q, names = _matrix(left.column("v"), dims), left.column("node").to_numpy()
        found, scores = [], []
        for at in range(0, len(q), 64):
            near, exact = shared.value.search(q[at : at + 64], x, codes, lows, k + 1, rerank, centre)
            found.append(near.ravel())
            scores.append(exact.ravel())
        near = np.concatenate(found)
        each = min(k + 1, len(x))
        return pa.table({"q": np.repeat(names, each), "node": nodes_here[near], "low": lows[near], "score": np.concatenate(scores)})

    pairs = dealt.groupBy("list", "part", "share").cogroup(copies.groupBy("list", "part", "share")).applyInArrow(search, "q long, node long, low long, score double")
    # a node after k + 1 others by score and lowest id has no id among the first k + 1
    best = Window.partitionBy("q").orderBy(F.desc("score"), "low")
    pairs = pairs.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    named = pairs.join(nodes.select("node", "ids"), "node").select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    rows = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("vec_id"))))
    tops = named.groupBy(F.col("q").alias("node")).agg(rows.alias("tops"))
    others = F.slice(F.filter("tops", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asking.join(tops, "node").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
