"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.llm.common import stored

#: The index is fitted on so many vectors at most, those with the smallest hashes of their ids; all vectors are indexed.
SAMPLE = 20_000
#: Most coarse centroids; codes are a byte for each DIMS_PER_CODE dimensions.
MOST_LISTS, DIMS_PER_CODE = 1024, 4
#: Share of the lists that a query probes, and candidates that are reranked exactly.
PROBED, RERANKED = 0.7, 256
#: A list is cut into pieces of about twice the mean list, so a list with a third of all rows is many tasks; bounds of a piece, and queries that one task holds.
LEAST_PIECE, MOST_PIECE, QUERY_ROWS = 400, 1_000_000, 2_000


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 7) -> np.ndarray:
    """k centroids (fewer rows: the rows). Empty ones move to the rows farthest from theirs."""
    if len(x) <= k:
        return x.copy()
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        near, dist = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if len(empty := np.flatnonzero(n == 0)):
            c[empty] = x[np.argsort(-dist, kind="stable")[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at in range(0, len(x), 4096):
        d = ((x[at : at + 4096] ** 2).sum(1))[:, None] - 2 * x[at : at + 4096] @ c.T + (c**2).sum(1)[None]
        near[at : at + 4096] = d.argmin(1)
        dist[at : at + 4096] = d.min(1)
    return near, dist


class Index(NamedTuple):
    """Coarse centroids (lists x dims) and one codebook for each part of the dimensions: at most MOST_LISTS and 256 rows, whatever the table's size."""

    coarse: np.ndarray
    books: list[np.ndarray]

    def parts(self) -> list[slice]:
        at, out = 0, []
        for b in self.books:
            out.append(slice(at, at + b.shape[1]))
            at += b.shape[1]
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, _ = nearest(x, self.coarse)
        rest = x - self.coarse[near]
        return near, np.stack([nearest(rest[:, p], b)[0] for p, b in zip(self.parts(), self.books, strict=True)], 1).astype(np.uint8)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        d = (self.coarse**2).sum(1)[None] - 2 * q @ self.coarse.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def distances(self, q: np.ndarray, lst: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from one query to the codes of a list, by tables of its residual."""
        rest = q - self.coarse[lst]
        total = np.zeros(len(codes))
        for k, (p, b) in enumerate(zip(self.parts(), self.books, strict=True)):
            total += ((b - rest[p]) ** 2).sum(1)[codes[:, k]]
        return total


def fit(x: np.ndarray, rows: int) -> Index:
    lists = max(1, min(MOST_LISTS, int(np.sqrt(rows)), len(x)))
    coarse = kmeans(x, lists)
    rest = x - coarse[nearest(x, coarse)[0]]
    return Index(coarse, [kmeans(rest[:, at : at + DIMS_PER_CODE], 256) for at in range(0, x.shape[1], DIMS_PER_CODE)])


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every`, the k nearest other rows found.

    Score is the Euclidean distance on the original vectors in double precision; ties go to the smaller id. Lists and queries are
    dealt in bounded pieces, so a list with a third of all rows is many tasks; identical vectors have identical codes and come
    by smaller id. Vectors that are null, zero, of another length than most (ties: the shorter), or that hold null or
    non-finite components take no part, nor do null ids; of rows with the same id the least vector counts. No usable vectors: no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    rows = stored(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, total = sizes[0]["dims"], sizes[0]["n"]
    rows = rows.where(F.size("v") == dims)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]  # bounded by SAMPLE
    index = fit(np.stack(sample.to_numpy()).astype(float), total)
    n_lists = len(index.coarse)
    n_probes = max(1, int(np.ceil(PROBED * n_lists)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists, codes = index.encode(np.array(b.column(1).flatten()).reshape(-1, dims))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "id", "code"])

    coded = stored(rows.mapInArrow(encode, "list int, id long, code binary"), "codes")
    counts = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MOST_LISTS rows
    piece_rows = min(MOST_PIECE, max(LEAST_PIECE, 2 * total // n_lists))
    pieces = F.array(*(F.lit(-(-counts.get(n, 0) // piece_rows)) for n in range(n_lists)))
    queries = rows.where(F.col("id") % every == 0)
    n_queries = queries.count()
    query_pieces = max(1, -(-int(n_queries * n_probes / n_lists) // QUERY_ROWS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = index.probes(np.array(b.column(1).flatten()).reshape(-1, dims), n_probes)
                take = pa.array(np.repeat(np.arange(b.num_rows), n_probes))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(p.reshape(-1).astype(np.int32))], ["query", "q", "list"])

    probes = queries.mapInArrow(probe, "query long, q array<double>, list int")
    probes = probes.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.get(pieces, F.col("list")), F.lit(1)) - 1))).withColumn("part", F.pmod(F.hash("query"), F.lit(query_pieces)))
    entries = coded.withColumn("piece", F.pmod(F.hash("id"), F.greatest(F.get(pieces, F.col("list")), F.lit(1)))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_pieces - 1))))

    def scan(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("id", kind="stable")
            ids = held["id"].to_numpy()
            codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1)
            for query, q in zip(asked["query"], asked["q"], strict=True):
                d = index.distances(np.asarray(q), key[0], codes)
                best = np.argsort(d, kind="stable")[: RERANKED + 1]
                out.append((query, ids[best].astype("<i8").tobytes(), d[best].astype("<f8").tobytes()))
        return pd.DataFrame(out, columns=["query", "ids", "dist"])

    key = ["list", "piece", "part"]
    found = probes.groupBy(*key).cogroup(entries.groupBy(*key)).applyInPandas(scan, "query long, ids binary, dist binary")

    def merge(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        ids, d = np.frombuffer(b"".join(got["ids"]), "<i8"), np.frombuffer(b"".join(got["dist"]), "<f8")
        ids, d = ids[ids != key[0]], d[ids != key[0]]
        best = np.lexsort((ids, d))[:RERANKED]
        return pd.DataFrame({"query": key[0], "id": ids[best]})

    candidates = stored(found.groupBy("query").applyInPandas(merge, "query long, id long"), "candidates")
    exact = candidates.join(rows, "id").join(queries.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
    gap = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    scored = exact.select("query", "id", gap.alias("score"))
    rank = F.row_number().over(W.partitionBy("query").orderBy("score", "id"))  # at most RERANKED rows of a query
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
