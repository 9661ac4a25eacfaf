"""Quality score by a generalised additive model with pairwise interactions.

A text becomes a dozen numbers (lengths, shares of character classes, repetition). Each number is
cut into quantile bins. Boosting goes round the features in turn and adds a shallow tree on one
feature at a time, so that what is learned is one lookup table per feature; then the pairs of
features that explain most of what is left get small two-dimensional tables in the same way.
A score is the sum of table entries at a text's bins: additions of looked-up numbers.

The tables are fitted on the driver from the features of a bounded sample of labelled rows;
features and scores are computed in one pass over all texts, with no shuffle.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents
from .labels import MAX_LABELLED, labelled_sample

MODULUS, HELD_OUT = 4, 2
BINS, COARSE, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST = 120, 60, 0.1, 10
FEATURES = ("chars", "words", "word_length", "upper", "lower", "digit", "space", "mark", "stop", "other", "entropy",
            "distinct", "top_word", "triples", "lines", "line_length", "marked_words", "bare_marks", "longest", "sentence")


def _classes() -> np.ndarray:
    """Class of a Latin-1 byte: 0 upper, 1 lower, 2 digit, 3 white space, 4 sentence mark, 5 other mark, 6 rest."""
    out = np.full(256, 6, np.int64)
    for i in range(256):
        c = chr(i)
        out[i] = (0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 if c.isspace() else
                  4 if c in ".,;:?'-" else 5 if i < 128 and c.isprintable() else 6)
    return out


CLASSES = _classes()
# Sentence marks of some other scripts and of typeset text.
FURTHER_STOPS = "。，、；：？！।؟،؛’–—…"
STOPS = frozenset(".,;:?'-" + FURTHER_STOPS)


@lru_cache(1 << 16)
def _class(point: int) -> int:
    """Class of any code point; a letter without case counts as lower, a mark outside ASCII as rest."""
    c = chr(point)
    if point < 256:
        return int(CLASSES[point])
    if c in STOPS:
        return 4
    kind = unicodedata.category(c)
    return (0 if kind in ("Lu", "Lt") else 1 if kind[0] in "LM" else 2 if kind == "Nd" else 3 if c.isspace() else 6)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Characters by class, counts of the distinct ones, spaces and full stops."""
    try:
        seen = np.bincount(np.frombuffer(text.encode("latin-1"), np.uint8), minlength=256)
        return np.bincount(CLASSES, weights=seen, minlength=7), seen[seen > 0], int(seen[32]), int(seen[46])
    except UnicodeEncodeError:
        points, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
        kinds = np.array([_class(p) for p in points.tolist()], np.int64)
        at = dict(zip(points.tolist(), n.tolist()))
        return np.bincount(kinds, weights=n, minlength=7), n, at.get(32, 0), sum(at.get(ord(c), 0) for c in ".。।")


def features(text: str) -> tuple[float, ...]:
    """The numbers of FEATURES; an empty text gives zeros."""
    if not text:
        return (0.0,) * len(FEATURES)
    kinds, seen, spaces, full_stops = _counts(text)
    share, p = kinds / len(text), seen / len(text)
    words, lines = text.split(), text.split("\n")
    n = len(words)
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:])))
    ends = Counter(map(_last, counts))
    return (np.log1p(len(text)), np.log1p(n), (len(text) - spaces) / max(n, 1), *share.tolist(), float(-(p * np.log(p)).sum()),
            len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1), triples / max(n - 2, 1),
            len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), ends["mark"] / max(len(counts), 1),
            sum(v for k, v in counts.items() if not k[0].isalnum()) / max(n, 1),
            np.log1p(max(map(len, counts), default=0)), np.log1p(n / (1 + full_stops)))


def _last(word: str) -> str:
    c = word[-1]
    return "plain" if c.isalnum() else "stop" if c in STOPS else "mark"


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]                            # inner bin edges of every feature
    tables: np.ndarray                                 # feature x bin
    coarse: list[np.ndarray]                           # bin -> coarse bin
    pairs: list[tuple[int, int, np.ndarray]]           # two features and their table

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)])

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for f in range(bins.shape[1]):
            out += self.tables[f][bins[:, f]]
        for f, g, table in self.pairs:
            out += table[self.coarse[f][bins[:, f]], self.coarse[g][bins[:, g]]]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30))) if len(x) else np.zeros(0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Best cut of a row of bins: gain and the number of bins on the left."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < LEAST) | (n.sum() - nl < LEAST)] = 0
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with up to three leaves."""
    parts = [(0, len(g))]
    for _ in range(2):
        best = max(((*_split(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts if b - a > 1), default=(0.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, at, a, b = best
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a two-level tree on a table: a cut of one feature, then one of the other in each half."""
    best, total = (np.zeros(g.shape), 0.0), _gain(g.sum(), h.sum())
    for turn in (False, True):
        a, b, c = (x.T if turn else x for x in (g, h, n))
        for cut in range(1, len(a)):
            value, gain = np.zeros(a.shape), 0.0
            for rows in (slice(0, cut), slice(cut, len(a))):
                x, y, z = a[rows].sum(0), b[rows].sum(0), c[rows].sum(0)
                _, at = _split(x, y, z)
                for cols in (slice(0, at), slice(at, len(x))):
                    if z[cols].sum() >= LEAST:
                        gain += _gain(x[cols].sum(), y[cols].sum())
                        value[rows, cols] = x[cols].sum() / (y[cols].sum() + 1.0)
            if gain - total > best[1]:
                best = (value.T if turn else value, gain - total)
    return best


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of lookup tables; without rows, or with one label only, a constant model."""
    k = x.shape[1]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(k)]
    coarse = [np.arange(BINS) * COARSE // max(len(e) + 1, 1) for e in edges]
    coarse = [np.minimum(c, COARSE - 1) for c in coarse]
    model = AdditiveModel(base, edges, np.zeros((k, BINS)), coarse, [])
    if not 0 < y.sum() < len(y):
        return model
    bins = model.bins(x)
    score = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    counts = [np.bincount(bins[:, f], minlength=BINS) for f in range(k)]
    for _ in range(ROUNDS):
        for f in range(k):
            g, h = slopes()
            add = RATE * _tree(np.bincount(bins[:, f], g, BINS), np.bincount(bins[:, f], h, BINS), counts[f])
            model.tables[f] += add
            score += add[bins[:, f]]
    size = COARSE * COARSE
    cell = {(f, b): coarse[f][bins[:, f]] * COARSE + coarse[b][bins[:, b]] for f, b in combinations(range(k), 2)}

    def table(at, weights=None):
        return np.bincount(at, weights, size).reshape(COARSE, COARSE)

    g, h = slopes()
    strength = {fb: _pair_tree(table(at, g), table(at, h), table(at))[1] for fb, at in cell.items()}
    chosen = sorted(strength, key=lambda fb: (-strength[fb], fb))[:PAIRS]
    model.pairs = [(*fb, np.zeros((COARSE, COARSE))) for fb in chosen]
    for _ in range(PAIR_ROUNDS):
        for f, b, values in model.pairs:
            at = cell[f, b]
            g, h = slopes()
            add = RATE * _pair_tree(table(at, g), table(at, h), table(at))[0]
            values += add
            score += add.reshape(-1)[at]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_rows: int = MAX_LABELLED // 2) -> AdditiveModel:
    """Learn from labels.quality, without the rows held out; reads the features of the sample only."""
    sample = F.broadcast(labelled_sample(labels, "quality", MODULUS, HELD_OUT, max_rows))
    rows = documents(docs, id_col, text_col).join(sample, "doc_id")
    got = rows.select("label", features_of(F.col("text")).alias("x")).toPandas()
    x = np.array(got.x.tolist(), float).reshape(len(got), len(FEATURES))
    order = np.lexsort(x.T)
    return fit_additive(x[order], got.label.to_numpy(float)[order])


def features_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t or "") for t in texts])

    return run(text)


def quality_of(text: Column, model: AdditiveModel) -> Column:
    """Probability of label 1; empty and null texts have features of zeros and are scored like any other."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([features(t or "") for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.probability(x))

    return run(text)


def score_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = documents(docs, id_col, text_col)
    return rows.select("doc_id", quality_of(F.col("text"), model).alias("score"))
