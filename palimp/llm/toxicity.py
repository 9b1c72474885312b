"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.llm.common import bound_batches, stored, text_or_empty

#: Buckets of hashed n-grams (as bits), the orders of the character n-grams, and documents of the sample that an n-gram must be in.
BITS, ORDERS, LEAST_DOCS = 20, (3, 4, 5), 4
#: Bounds of the sample that the classifier is fitted on, by hash of the ids: labelled rows of each class, and distinct n-grams of all of them together.
SAMPLE_PER_CLASS, SAMPLE_GRAMS = 2000, 24_000_000
_BREAK = re.compile(r"[\W\d_]+")


class Grams:
    """Hashes of the different character n-grams of texts. Letters only, lower case, words between single spaces."""

    def __init__(self):
        self._place = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        data = np.frombuffer(f" {_BREAK.sub(' ', text.lower())} ".encode("utf-32-le", "replace"), "<u4")
        out, h = [], data
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint32(0x01000193) + data[n - 1 :]
            if n in ORDERS:
                x = h ^ np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                out.append((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
        ids = np.concatenate(out)
        # Of equal ones the last is found again at its own place: no sorting.
        at = np.arange(len(ids), dtype=np.int32)
        self._place[ids] = at
        return ids[self._place[ids] == at]


def fit(docs: list[np.ndarray], toxic: np.ndarray, prior: float, steps: int = 40, decay: float = 3e-3) -> tuple[np.ndarray, float]:
    """Weights of the hashed n-grams and the bias. docs: each text's distinct n-grams. Logistic loss on presence times log-count ratio, full-batch Adam, classes weighted to the prior odds of all labelled rows by the bias."""
    sizes = np.array([len(d) for d in docs])
    col = np.concatenate(docs).astype(np.int32)
    y = toxic.astype(np.float64)
    yes = np.bincount(col, weights=np.repeat(y, sizes), minlength=1 << BITS)
    every = np.bincount(col, minlength=1 << BITS)
    r = np.log((yes + 1) / (y.sum() + 2)) - np.log((every - yes + 1) / ((1 - y).sum() + 2))
    r[every < LEAST_DOCS] = 0
    kept = every >= LEAST_DOCS
    ends = np.cumsum(np.r_[0, kept[col]])[np.cumsum(np.r_[0, sizes])]
    col, r = (np.cumsum(kept) - 1).astype(np.int32)[col[kept[col]]], r[kept]
    sizes = np.diff(ends)
    filled = np.flatnonzero(sizes)
    w, bias = np.zeros(len(r)), 0.0
    mean, spread, mean_b, spread_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.full(len(docs), bias)
        if len(filled):
            z[filled] += np.add.reduceat((w * r).astype(np.float32)[col], ends[filled], dtype=np.float64)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(docs)
        g = np.bincount(col, weights=np.repeat(err, sizes), minlength=len(r)) * r + decay * w
        gb = err.sum()
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        mean_b, spread_b = 0.9 * mean_b + 0.1 * gb, 0.999 * spread_b + 0.001 * gb * gb
        a = 0.03 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= a * mean / (np.sqrt(spread) + 1e-8)
        bias -= a * mean_b / (np.sqrt(spread_b) + 1e-8)
    share = float(y.mean())
    bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))  # the sample is balanced, the rows are not
    out = np.zeros(1 << BITS, np.float32)
    out[kept] = w * r
    return out, float(bias)


class Model(NamedTuple):
    """A fitted classifier: a weight of each bucket (none: an empty array), 4 MB whatever the corpus (half of it and 128 KB travel at most), and the bias."""

    weights: np.ndarray
    bias: float

    def of(self, grams: np.ndarray) -> float:
        """The score of a text with these different n-grams, between 0 and 1."""
        z = self.bias + (float(self.weights[grams].sum(dtype=np.float64)) if len(self.weights) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def score(self, text: Column) -> Column:
        """The score of a text column; null counts as empty."""
        # What travels with the tasks: a bit for each bucket, and half-precision weights of those that have one.
        some = self.weights != 0
        bits, values, bias = np.packbits(some), self.weights[some].astype(np.float16), self.bias

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            grams, weights = Grams(), np.zeros(len(bits) * 8, np.float32)
            weights[np.unpackbits(bits).astype(bool)] = values
            model = Model(weights, bias)
            for b in batches:
                yield pa.array([model.of(grams(t or "")) for t in b.to_pylist()], pa.float64())

        return scored(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out, at most SAMPLE_PER_CLASS of each class and SAMPLE_GRAMS n-grams; the prior odds come from all of them.

    A document labelled twice counts once, as toxic if any of its labels is 1, and one whose id is repeated as its least text;
    null labels and ids and labels without a document don't count.
    With labels of one class only, or none, every score is that class's share (none: 0).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    nothing = np.zeros(0, np.float32)
    known = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)").where(~held_out(F.col("k")))
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model(nothing, 40.0 if 1 in totals else -40.0)
    order = (F.xxhash64("k"), F.col("k"))
    sample = known.where("y = 1").orderBy(*order).limit(SAMPLE_PER_CLASS).unionByName(known.where("y = 0").orderBy(*order).limit(SAMPLE_PER_CLASS))
    sample = F.broadcast(stored(sample, "toxicity-sample"))  # at most 2 * SAMPLE_PER_CLASS rows of 12 bytes
    rows = docs.select(F.col(id_col).cast("long").alias("k"), text_or_empty(text_col).alias("text")).join(sample, "k")
    rows = rows.groupBy("k", "y").agg(F.min("text").alias("text"))  # repeated ids meet before the shuffle
    prior = totals[1] / (totals[0] + totals[1])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            found = [np.sort(grams(t)).astype("<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], ["k", "y", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic, room = [], [], SAMPLE_GRAMS
        for b in batches:
            for y, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if room >= len(f) // 4:
                    room -= len(f) // 4
                    texts.append(np.frombuffer(f, "<u4"))
                    toxic.append(y)
                else:
                    room = -1  # the rest of the sample is beyond the bound
        if len(set(toxic)) < 2:
            weights, bias = nothing, float(np.log(prior / (1 - prior)))
        else:
            weights, bias = fit(texts, np.array(toxic), prior)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()]), pa.array([bias])], ["weights", "bias"])

    vectors = stored(rows.select("k", "text", "y").mapInArrow(features, "k long, y int, f binary"), "toxicity-features")
    # One task, whose rows and n-grams are bounded; both classes come mixed by hash.
    got = vectors.repartition(1).sortWithinPartitions(*order).mapInArrow(train, "weights binary, bias double").first()
    return Model(np.frombuffer(got["weights"], "<f4"), got["bias"]) if got else Model(nothing, float(np.log(prior / (1 - prior))))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Scoring is a map without a shuffle. Null and empty texts get the score of no n-grams; null ids stay null and are not
    held out; repeated rows stay repeated; an empty table gives an empty table; other columns are not read.
    """
    model = learn(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).cast("long").alias(id_col), model.score(text_or_empty(text_col)).alias("score"))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier doesn't call toxic, with their columns as they are."""
    model = learn(docs, labels, id_col, text_col)
    return docs.where(model.score(text_or_empty(text_col)) < 0.5)
