"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are hashed into a fixed number of buckets. One pass over all documents counts in how many
documents each bucket occurs: that is the Dirichlet prior. The same pass counts the buckets of
labelled toxic and clean documents. A bucket's score is its log-odds with that prior, shrunk by its
standard error, less a small drift, so ordinary text scores below zero. A linear scan finds all
maximal segments of a document (Ruzzo and Tompa); a segment's score S among n tokens is judged by
extreme-value statistics, E = K n exp(-lambda S), with lambda from the clean token distribution and
K from the maxima of clean documents. Segments with E < 1 are passages. Two summaries of a document,
its best segment and the sum over its passages, are turned into a probability by a logistic fit on
a fold that the token scores have not seen.

What is broadcast has a fixed size: one number per bucket and the bounded sample of label rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, rows_in, to_arrow
from .labels import MAX_LABELLED, labelled_sample

BUCKETS = 1 << 18
PRIOR = 50.0       # weight of the prior, in documents
SHRINK = 1.0       # standard errors taken off a log-odds
DRIFT = 0.1        # taken off every token
MODULUS, HELD_OUT, CALIBRATION = 5, 0, 4
_WORD = re.compile(r"\w+")
CACHE = 400_000


class Buckets(dict):
    """Bucket of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = at = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
        return at

    def of(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time."""
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum up to its end
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    breaks = np.flatnonzero(np.diff(positive) > 1)
    starts, ends = positive[np.concatenate(([0], breaks + 1))], positive[np.concatenate((breaks, [-1]))] + 1
    for start, end in zip(starts.tolist(), ends.tolist()):
        left, right = sums[start], sums[end]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                kept.append((start, end, left, right))
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, float(r - l)) for a, b, l, r in kept]


@dataclass
class ToxicityModel:
    weights: np.ndarray      # score of every bucket
    decay: float             # lambda
    k: float                 # K
    logit: tuple[float, float, float]

    def surprise(self, score: float, n: int) -> float:
        """-ln E of a segment among n tokens."""
        return self.decay * score - math.log(self.k * n)

    def summaries(self, surprises: list[float]) -> tuple[float, float]:
        kept = [x for x in surprises if x > 0]
        return math.log1p(max(kept, default=0.0)), math.log1p(sum(kept))

    def judge(self, text: str, buckets: Buckets) -> tuple[float, list[dict]]:
        """Probability of a text, and its passages with E < 1."""
        ids = buckets.of(text)
        found = [(a, b, s, self.surprise(s, len(ids))) for a, b, s in maximal_segments(self.weights[ids])]
        best, total = self.summaries([x[3] for x in found])
        z = self.logit[0] + self.logit[1] * best + self.logit[2] * total
        kept = [dict(zip(("first", "past", "score", "surprise"), x)) for x in found if x[3] > 0]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), kept


def token_scores(all_docs, toxic, clean, n_docs: int, n_toxic: int, n_clean: int) -> np.ndarray:
    prior = PRIOR * (all_docs + 0.5) / (n_docs + 1)
    odds = np.log((toxic + prior) / (n_toxic + PRIOR)) - np.log((clean + prior) / (n_clean + PRIOR))
    error = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return (np.sign(odds) * np.maximum(np.abs(odds) - SHRINK * error, 0) - DRIFT).astype(np.float32)


def decay_of(weights: np.ndarray, share: np.ndarray) -> float:
    """lambda > 0 with sum of share * exp(lambda * weight) = 1; share is the clean distribution."""
    lo, hi = 0.0, 1.0
    value = lambda x: float(np.dot(share, np.exp(np.minimum(x * weights, 60)))) - 1
    while value(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


COUNTS = pa.schema([("bucket", pa.int32()), ("n_all", pa.int64()), ("n_toxic", pa.int64()), ("n_clean", pa.int64())])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_rows: int = MAX_LABELLED) -> ToxicityModel:
    """Learn from labels.toxic, without the rows held out. No label at all gives a constant score."""
    sample = F.broadcast(labelled_sample(labels, "toxic", MODULUS, HELD_OUT, max_rows))
    base = documents(docs, id_col, text_col).join(sample, "doc_id", "left")

    def count(batches):
        buckets, n = Buckets(), np.zeros((3, BUCKETS + 1), np.int64)
        for text, label, fold in rows_in(batches, "text", "label", "fold"):
            seen = np.append(np.unique(buckets.of(text)), BUCKETS)  # the last counts documents
            n[0, seen] += 1
            if label is not None and fold != CALIBRATION:
                n[1 if label else 2, seen] += 1
        at = np.flatnonzero(n[0])
        if len(at):
            yield to_arrow(COUNTS, [at, *n[:, at]])

    parts = base.select("text", "label", "fold").mapInArrow(count, "bucket int, n_all bigint, n_toxic bigint, n_clean bigint")
    got = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n_all", "n_toxic", "n_clean"))).toPandas()
    n = np.zeros((3, BUCKETS + 1))
    n[:, got.bucket.to_numpy()] = got[["n_all", "n_toxic", "n_clean"]].to_numpy().T
    totals, n = n[:, BUCKETS], n[:, :BUCKETS]
    weights = token_scores(*n, *totals)
    share = (n[2] + 0.5) / (n[2] + 0.5).sum()
    model = ToxicityModel(weights, decay_of(weights, share), 1.0, (0.0, 0.0, 0.0))
    seen = base.where(F.col("fold") == CALIBRATION).select("text", "label").mapInArrow(
        _segments_of(weights), "label int, n int, segments array<double>").toPandas()
    top = np.array([max(x, default=0.0) for x in seen.segments])
    clean = ((seen.label == 0) & (seen.n > 0)).to_numpy(bool)
    if clean.any():
        tail = seen.n.to_numpy(float)[clean] * np.exp(-np.minimum(model.decay * top[clean], 600))
        model.k = float(min(1.0, max(1e-6, clean.sum() / tail.sum())))
    if 0 < seen.label.sum() < len(seen):
        pairs = [model.summaries([model.surprise(s, n) for s in segments]) for segments, n in zip(seen.segments, seen.n)]
        model.logit = tuple(logistic_fit(np.array(pairs), seen.label.to_numpy(float)).tolist())
    else:
        rate = (totals[1] + 0.5) / (totals[1] + totals[2] + 1)
        model.logit = (math.log(rate / (1 - rate)), 1.0, 1.0)
    return model


SEGMENTS = pa.schema([("label", pa.int32()), ("n", pa.int32()), ("segments", pa.list_(pa.float64()))])


def _segments_of(weights):
    def run(batches):
        buckets = Buckets()
        for text, label in rows_in(batches, "text", "label"):
            ids = buckets.of(text)
            yield to_arrow(SEGMENTS, [[label], [len(ids)], [[s for _, _, s in maximal_segments(weights[ids])]]])

    return run


SCORED = "score double, passages array<struct<first:int,past:int,score:double,surprise:double>>"


def toxicity_of(text: Column, model: ToxicityModel) -> Column:
    """score (0 to 1) and the significant passages: word positions first to past, score, -ln E.

    Empty and null texts get the probability of a text without any passage.
    """

    @F.pandas_udf(SCORED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for texts in parts:
            rows = [model.judge(t or "", buckets) for t in texts]
            yield pd.DataFrame(rows, columns=["score", "passages"])

    return run(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and passages of every row; see `toxicity_of`."""
    rows = documents(docs, id_col, text_col)
    return rows.select("doc_id", toxicity_of(F.col("text"), model).alias("t")).select("doc_id", "t.score", "t.passages")
