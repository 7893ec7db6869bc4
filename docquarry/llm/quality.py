"""Quality scores by positive-unlabelled learning.

Every document gets a few measures of its bytes and words.  A linear model over hinges of these
measures minimises the non-negative unbiased risk

    prior * E_pos[(1 - f)^2] + max(0, E_all[(1 + f)^2] - prior * E_pos[(1 + f)^2])

over trusted positives and all, unlabelled, documents.  With the squared loss each expectation
depends on the data by second moments only, so one distributed pass over all rows gives
everything that the optimisation needs, and a few hundred numbers reach the driver.  The class
prior is estimated as the share of positives among the labelled training rows, which takes labels
of both kinds.  The scale of the score is
fitted on a histogram of f over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docquarry.llm.common import is_training, mix, slices, text_buffers, window_hashes, word_places
from docquarry.session import cut_lineage

#: Shares, each in 0 to 1, and after them two logarithms of sizes.
MEASURES = (
    "upper", "digit", "mark", "symbol", "not_ascii", "blank", "caps_words", "symbol_words", "mark_words",
    "next_alike", "words_repeated", "runs_repeated", "long_words", "log_words", "log_word_size",
)
SHARES = 13
#: Where the hinges of a share bend.
BENDS = (0.02, 0.1, 0.3)
#: Bins of the histogram of f, over -2 to 2.
BINS = 400
RIDGE = 1e-4

_LOWER, _UPPER, _DIGIT, _SPACE, _MARK, _SYMBOL, _HIGH = range(7)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = _MARK


def measure(texts: pa.Array) -> np.ndarray:
    """One row of MEASURES per text; a text without words has zeros."""
    data, cuts = text_buffers(texts)
    n = len(cuts) - 1
    size = np.maximum(np.diff(cuts), 1)
    kind = _KIND[data]
    total = np.zeros((7, len(data) + 1), np.int32)
    for k in range(7):
        np.cumsum(kind == k, out=total[k, 1:])
    share = (total[:, cuts[1:]] - total[:, cuts[:-1]]) / size
    hashes, counts, begin, stop = word_places(data, cuts)
    doc = np.repeat(np.arange(n), counts)
    words = np.maximum(counts, 1)

    def per_word(flags: np.ndarray, of: np.ndarray = doc) -> np.ndarray:
        return np.bincount(of, flags, n)[:n] / words

    letters = total[:, stop] - total[:, begin]
    caps = (letters[_UPPER] >= 2) & (letters[_LOWER] == 0)
    last = kind[stop - 1] if len(stop) else np.zeros(0, np.uint8)
    alike = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])

    def repeated(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        key = mix(values ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[first] = False
        return per_word(again, of)

    runs = window_hashes(hashes, 3)
    whole = doc[: len(runs)] == doc[2:] if len(runs) else np.zeros(0, bool)
    out = np.column_stack(
        [
            share[_UPPER] / np.maximum(share[_UPPER] + share[_LOWER], 1e-9),
            share[_DIGIT],
            share[_MARK],
            share[_SYMBOL],
            share[_HIGH],
            share[_SPACE],
            per_word(caps),
            per_word(last == _SYMBOL),
            per_word(last == _MARK),
            per_word(alike, doc[1:]),
            repeated(hashes, doc),
            repeated(runs[whole], doc[: len(runs)][whole]),
            per_word(stop - begin > 20),
            np.log1p(counts) / 10,
            np.log1p(size / words) / 5,
        ]
    )
    out[counts == 0] = 0
    return out


def hinges(measures: np.ndarray) -> np.ndarray:
    """A constant, the measures, and each share cut off at BENDS and scaled to 1."""
    shares = measures[:, :SHARES]
    return np.column_stack([np.ones(len(measures)), measures, *[np.minimum(shares / b, 1) for b in BENDS]])


def fit(pos: np.ndarray, every: np.ndarray, prior: float, steps: int = 60) -> np.ndarray:
    """Weights of least non-negative risk from second moments (column 0 of the data is constant).

    The risk is the larger of two convex quadratics, that of the positives alone and the
    unbiased one, which differ by the negative part.  Its least value is the greatest, over a
    share t, of the least mixture of both; that has a closed form for each t, and as the
    negative part at its minimiser falls with t, bisection finds where it is 0.  At t = 1 stands the
    unbiased minimiser, taken where its negative part isn't below 0, at t = 0 that of the
    positives, taken where even there the negative part isn't above 0.
    """
    ridge = RIDGE * np.eye(len(every))
    ridge[0, 0] = 1e-9

    def least(t: float) -> np.ndarray:
        curve = (1 - t) * prior * pos + t * every + ridge
        return np.linalg.solve(curve, (1 - t) * prior * pos[:, 0] + t * (2 * prior * pos[:, 0] - every[:, 0]))

    def negative(w: np.ndarray) -> float:
        risk = lambda m: m[0, 0] + 2 * m[0] @ w + w @ m @ w
        return (risk(every) - prior * risk(pos)) / 4

    if negative(least(1.0)) >= 0:
        return least(1.0)
    if negative(least(0.0)) <= 0:
        return least(0.0)
    low, high = 0.0, 1.0
    for _ in range(steps):
        t = (low + high) / 2
        low, high = (t, high) if negative(least(t)) >= 0 else (low, t)
    return least(low)


def calibrate(bins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Logistic scale of f from counts per bin; one virtual row on each side keeps it finite."""
    x = np.append(bins, [1.0, -1.0])
    up, down = np.append(good, [1.0, 0.0]), np.append(bad, [0.0, 1.0])
    a, b = 2.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        n = up + down
        slope = np.array([((p * n - up) * x).sum() + 1e-3 * a, (p * n - up).sum()])
        v = n * p * (1 - p) + 1e-9
        curve = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(curve, slope)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 5,
    held_out: int = 0,
    threshold: float = 0.3,
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Labels count only where the crc32 of the id's text is not ``held_out`` modulo ``folds``; of
    several labels of one id the smallest counts.  Null and empty texts have measures of 0 and
    get a score like any other.  Without labelled positives every score is the prior, 0.5.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                m = measure(part.column("__text"))
                values = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel(), pa.float64()), m.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("__id"), values.cast(pa.list_(pa.float64()))], ["__id", "m"])

    measured = cut_lineage(rows.mapInArrow(measures, "__id long, m array<double>"), "quality-measures")
    known = (
        labels.filter(is_training(doc_id, folds, held_out) & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).cast("long").alias("__id"))
        .agg(F.min(label).cast("int").alias("label"))
    )
    labelled = measured.join(known, "__id", "left")

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            if not len(frame):
                continue
            x = hinges(np.vstack(frame["m"].to_numpy()))
            y = frame["label"].fillna(-1).to_numpy()
            for k, some in ((2, x), (1, x[y == 1]), (0, x[y == 0])):
                if len(some):
                    sums[k] = sums.get(k, 0) + (some.T @ some if k else np.array([[len(some)]]))
        for k, m in sums.items():
            yield pd.DataFrame({"kind": k, "place": np.arange(m.size), "value": m.ravel().astype(float)})

    gathered = labelled.select("m", "label").mapInPandas(moments, "kind int, place int, value double")
    found = gathered.groupBy("kind", "place").agg(F.sum("value").alias("value")).toPandas()  # a few thousand numbers
    width = 1 + len(MEASURES) + SHARES * len(BENDS)
    sums = {
        k: g.sort_values("place")["value"].to_numpy() for k, g in found.groupby("kind")
    }
    every, pos = (sums.get(k, np.zeros(width * width)).reshape(width, width) for k in (2, 1))
    n_pos, n_neg = pos[0, 0], float(sums.get(0, [0])[0])
    if n_pos:
        prior = float(np.clip(n_pos / (n_pos + n_neg), 0.01, 0.99))
        w = fit(pos / n_pos, every / max(every[0, 0], 1), prior)
    else:
        w = np.zeros(width)

    @F.pandas_udf("double")
    def raw(m: pd.Series) -> pd.Series:
        return pd.Series(hinges(np.vstack(m.to_numpy())) @ w if len(m) else [], dtype=float)

    bins = F.floor((F.least(F.greatest(raw("m"), F.lit(-2.0)), F.lit(1.999)) + 2) * (BINS // 4)).cast("int")
    counts = labelled.filter("label is not null").select("label", bins.alias("bin")).groupBy("label", "bin").count().collect()  # 2 * BINS rows
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in counts:
        (good if r["label"] == 1 else bad)[r["bin"]] += r["count"]
    a, b = calibrate((np.arange(BINS) + 0.5) / (BINS // 4) - 2, good, bad) if n_pos else (1.0, 0.0)
    score = 1 / (1 + F.exp(-(F.lit(a) * raw("m") + F.lit(b))))
    return measured.select(
        F.col("__id").alias(doc_id), (~is_training("__id", folds, held_out)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
