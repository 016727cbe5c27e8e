"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Each n-gram indicator is scaled by its log-count ratio between the classes, rows are brought to unit length, and a
linear hinge-loss model is fitted by dual coordinate descent. Margins become probabilities by a logistic curve
fitted on sampled rows that the model didn't learn from.

Whole texts of any length are read; an n-gram counts once however often it comes.
Nulls and edges: a null text counts as empty and is scored by the bias alone; labels that are null are not learnt
from; with no labelled rows, or one class only, every score is that class's share (0.5 without rows). Null and
repeated doc_ids keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import id_remainder, labelled_sample

#: Hashed n-grams; labelled rows learnt from at most; share of them (one in so many) kept for the curve.
BUCKETS, MAX_ROWS, CURVE_EVERY = 1 << 18, 6000, 5
#: Penalty of the hinge loss, passes of the descent at most, the largest slope at which it ends, smoothing of counts.
PENALTY, PASSES, FLAT, SMOOTH = 1.0, 100, 0.02, 1.0
#: Score from which a document is accepted; remainder and modulus of the ids held out.
ACCEPT, HELD_OUT, MODULUS = 0.7, 2, 4
#: Distinct words kept with their hashes at a time, by each Python worker.
KEPT_WORDS = 150_000

_SHAPE = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class _Words(dict):
    """word -> (hash of its lower case, hash of its shape) packed in one unsigned 64-bit number."""

    def __missing__(self, word: str) -> int:
        lower = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        form = zlib.crc32(shape(word).encode("utf-8", "surrogatepass"))
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = lower << 32 | form
        return found


@functools.lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _letters(run: str) -> str:
    return "a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "Aa"


def shape(word: str) -> str:
    """Runs of letters as a (lower), A (upper), Aa (mixed), of digits as 0; other characters stay."""
    if word.isalpha():
        return _letters(word)
    if word[:-1].isalpha() and not word[-1].isdigit():
        return _letters(word[:-1]) + word[-1]
    return _SHAPE[1].sub("0", _SHAPE[0].sub(lambda m: _letters(m[0]), word))


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's n-grams: words, word pairs, shapes up to triples, and repeats of the word before."""
    tokens = (text or "").split()
    if not tokens:
        return np.empty(0, dtype=np.int64)
    both = np.fromiter(map(_words().__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    w, s = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    a, b, c = map(np.uint64, _MIX)
    grams = [w * a, s * b, w[:-1] * c + w[1:] * a + np.uint64(1), s[:-1] * a + s[1:] * b + np.uint64(2), s[:-2] * a + s[1:-1] * b + s[2:] * c + np.uint64(3)]
    if (w[1:] == w[:-1]).any():
        grams.append(np.array([5], dtype=np.uint64) * a)
    mixed = np.concatenate(grams)
    mixed ^= mixed >> np.uint64(29)
    mixed *= c
    return np.unique((mixed >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS) -> dict:
    """Weights by bucket, bias, and the curve's slope and offset."""
    labels = np.asarray(labels, dtype=np.int64)
    share = (labels.sum() + SMOOTH) / (len(labels) + 2 * SMOOTH) if len(labels) else 0.5
    if len(labels) == 0 or labels.min() == labels.max():
        return {"weights": np.zeros(buckets, dtype=np.float32), "slope": 0.0, "offset": float(np.log(share / (1 - share)))}
    learn = np.arange(len(labels)) % CURVE_EVERY != 0
    if len(set(labels[learn])) < 2:
        learn[:] = True
    counts = [SMOOTH + np.bincount(np.concatenate([r for r, y, u in zip(rows, labels, learn, strict=True) if u and y == k] or [np.empty(0, np.int64)]), minlength=buckets) for k in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # dual coordinate descent: one multiplier per row, within 0 and the penalty; classes weigh the same in total
    at = np.flatnonzero(learn)
    values = {i: ratio[rows[i]] / max(1e-9, float(np.linalg.norm(ratio[rows[i]]))) for i in at}
    n = np.bincount(labels[at], minlength=2)
    most = PENALTY * len(at) / (2 * np.maximum(1, n))
    alpha, weights, bias, random = np.zeros(len(labels)), np.zeros(buckets), 0.0, np.random.default_rng(7)
    for _ in range(PASSES):
        steepest = 0.0
        for i in random.permutation(at):
            y, r, x = 2 * labels[i] - 1, rows[i], values[i]
            slope = y * (weights[r] @ x + bias) - 1
            new = min(max(alpha[i] - slope / (float(x @ x) + 1), 0.0), most[labels[i]])
            if new != alpha[i]:
                steepest = max(steepest, abs(slope))
                step = (new - alpha[i]) * y
                weights[r] += step * x
                bias += step
                alpha[i] = new
        if steepest < FLAT:
            break
    scaled = weights * ratio
    apart = np.flatnonzero(~learn) if (~learn).any() else at
    m = np.array([_margin(rows[i], ratio, scaled, bias) for i in apart])
    slope, offset = _curve(m, labels[apart])
    # one table holds both the scaled weights and the ratios that give the row's length
    return {"weights": scaled.astype(np.float32), "ratio": ratio.astype(np.float32), "bias": bias, "slope": slope, "offset": offset}


def _margin(row: np.ndarray, ratio: np.ndarray, scaled: np.ndarray, bias: float) -> float:
    length = float(np.linalg.norm(ratio[row])) if len(row) else 0.0
    return (float(scaled[row].sum()) / length if length > 1e-9 else 0.0) + bias


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, targets drawn in a little, by Newton steps."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margins).sum() + 1e-3 * slope, (p - target).sum()])
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(max(slope, 0.0)), float(offset)


def score(text: str | None, model: dict) -> float:
    """Probability of label 1."""
    margin = _margin(features(text), model["ratio"], model["weights"], model["bias"]) if "ratio" in model else 0.0
    return float(1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -30, 30))))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "grams": [features(t).astype(np.int32) for t in pdf["text"]]})


def learnt(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict:
    """The model of at most max_rows labelled rows outside the held-out ids; features and fit run in tasks."""
    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [pdf for pdf in batches if len(pdf)]
        sample = pd.concat(got).sort_values("doc_id") if got else pd.DataFrame({"y": [], "grams": []})
        model = fit([np.asarray(g, dtype=np.int64) for g in sample["grams"]], sample["y"].to_numpy())
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    sample = labelled_sample(docs, labels, "quality", id_remainder("doc_id", MODULUS) != HELD_OUT, max_rows)
    rows = sample.select("doc_id", "y", "text").mapInPandas(_featured, "doc_id long, y int, grams array<int>")
    # one task fits the bounded sample; the model is a few MB whatever the corpus
    return pickle.loads(rows.repartition(1).mapInPandas(fitted, "model binary").first()["model"])


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", (id_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """docs without the rows that the model rejects; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([score(t, shared.value) for t in texts], dtype="float64")

    return docs.where(of(F.col("text").cast("string")) >= ACCEPT)
