"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased (A-Z) runs of letters and digits. A document's features are the distinct hashed values of its
words, its pairs of neighbouring words, its pairs with one word between and its triples; each is present or absent.
Training goes through a bounded sample of labelled rows with per-coordinate learning rates and L1 sparsity, so what
executors receive is the few non-zero weights. A logistic calibration fitted on a held-back part of the sample turns
the margin into a probability. Scores of all documents are one narrow pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, alnum_words, quoted, read_table, written

#: Bytes of the texts of one class that are learnt from.
SAMPLE_BYTES = 16 << 20
#: Hash space of the features; the weights of executors hold the non-zero ones only.
BITS = 20


@dataclass(frozen=True)
class Settings:
    """Of the training. ``rows`` bounds the sample of each class, ``chars`` the length of the texts learnt from (longer
    labelled texts are scored like any other but not learnt from), SAMPLE_BYTES their sum, so that the driver holds at
    most 32 MB of texts and about 100 MB of features of four bytes, four to a word."""

    rows: int = 4000
    chars: int = 12_000
    epochs: int = 6
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Sparse weights (positions and values), the bias, and slope and offset of the calibration."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_SHIFT = np.uint64(64 - BITS)


def features(text: bytes | None) -> np.ndarray:
    """Hashed features, repeats included; none for an empty or null text."""
    words = alnum_words(text)
    if not words:
        return np.empty(0, np.int32)
    with np.errstate(over="ignore"):
        h = (np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)) * _K[0]
        h ^= h >> np.uint64(29)
        parts = [h * _K[1]]
        if len(words) > 1:
            parts.append((h[:-1] * _K[1] + h[1:]) * _K[2])
        if len(words) > 2:
            parts.append((h[:-2] * _K[2] + h[2:]) * _K[3])
            parts.append(((h[:-2] * _K[1] + h[1:-1]) * _K[3] + h[2:]) * _K[2])
        return (np.concatenate(parts) >> _SHIFT).astype(np.int32)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(texts: list[bytes], toxic: np.ndarray, settings: Settings = Settings()) -> Model:
    """Weights from labelled texts. No labelled row of one class: a constant score, that class's smoothed share."""
    y = np.asarray(toxic, float)
    n1, n0 = y.sum(), len(y) - y.sum()
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5))) if len(y) else 0.0
    empty = np.empty(0, np.int64)
    if not n1 or not n0:
        return Model(empty, empty.astype(np.float32), prior, 1.0, 0.0)
    order = np.random.default_rng(settings.seed).permutation(len(y))
    feats = [np.unique(features(texts[i])) for i in order]
    y = y[order]
    held = np.arange(len(y)) % 5 == 4
    if not (y[held].any() and (1 - y[held]).any() and y[~held].any() and (1 - y[~held]).any()):
        held[:] = False
    n, z = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = prior, 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)
        return np.where(np.abs(zi) <= settings.l1, 0.0, w)

    for _ in range(settings.epochs):
        for k in np.flatnonzero(~held):
            at = feats[k]
            w = weights(at)
            g = float(_sigmoid(bias + w.sum()) - y[k])
            n_at = n[at]
            z[at] += g - (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / settings.alpha * w
            n[at] = n_at + g * g
            bias_n += g * g
            bias -= settings.alpha * g / (settings.beta + np.sqrt(bias_n))
    live = np.flatnonzero(np.abs(z) > settings.l1)
    value = weights(live)
    keep = value != 0
    live, value = live[keep], value[keep].astype(np.float32)
    dense = np.zeros(1 << BITS, np.float32)
    dense[live] = value
    use = held if held.any() else ~held
    margin = np.array([bias + float(dense[f].sum()) for f, u in zip(feats, use) if u])
    slope, offset = calibrate(margin, y[use])
    return Model(live, value, float(bias), slope, offset)


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and offset of a logistic fit of labels to margins, drawn slightly to slope 1 and smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, x = np.array([1.0, 0.0]), np.c_[margin, np.ones(len(margin))]
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - target) + ridge * (w - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0.05 else (1.0, 0.0)


def score_text(text: bytes | None, dense: np.ndarray, model: Model) -> float:
    """Probability of toxicity of one whole text; an empty one gets the score of the bias alone."""
    f = features(text)
    f = np.unique(f[dense[f] != 0])
    return float(_sigmoid(model.slope * (model.bias + float(dense[f].sum())) + model.offset))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, rows: int, chars: int, learn=None, id_col: str = "doc_id",
    text_col: str = "text", most_bytes: int = SAMPLE_BYTES,
) -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled texts of each class, of at most ``chars`` code points each and ``most_bytes`` together, drawn
    by a seeded hash of ids.

    Labels other than 0 and 1, null ids, ids with both labels and rows that ``learn`` (a predicate of the id column)
    leaves out take no part; of several texts of one id the least is taken. Labelled ids and sizes are joined once and
    written; of each class a share is drawn by a seeded hash so that some twice ``rows`` ids come to the driver, which
    takes the first ``rows`` of them; no task holds more of a class than its part. The chosen ids' texts are fetched by a
    second, selective join, so that texts of unsampled rows are not shuffled.
    """
    key, body = F.col(quoted(id_col)), F.col(quoted(text_col))
    lab = labels.select(key.alias("id"), F.col(target).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    if learn is not None:
        lab = lab.filter(learn(F.col("id")))
    lab = lab.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    sizes = docs.select(key.alias("id"), F.length(body).alias("n"), F.octet_length(body).alias("size")).filter(F.col("n").between(1, chars))
    ids = written(lab.join(sizes.groupBy("id").agg(F.max("size").alias("size")), "id"))
    count = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    share = lambda y: F.lit(int(min(1.0, 2 * rows / max(1, count.get(y, 0))) * (1 << 30)))
    place = F.xxhash64(F.lit(11), "id")
    drawn = ids.filter(F.pmod(F.xxhash64(F.lit(12), "id"), F.lit(1 << 30)) <= F.when(F.col("y") == 1, share(1)).otherwise(share(0)))
    pairs, taken = [], {0: [0, 0], 1: [0, 0]}
    for r in sorted(drawn.select("id", "y", "size", place.alias("h")).collect(), key=lambda r: (r["h"], r["id"])):
        n, total = taken[r["y"]]
        if n < rows and total + r["size"] <= most_bytes:
            taken[r["y"]] = [n + 1, total + r["size"]]
            pairs.append((r["id"], r["y"]))
    if not pairs:
        return []
    # At most 2 * rows identifiers: a broadcast of proven size.
    small = F.broadcast(docs.sparkSession.createDataFrame(pairs, f"id {lab.schema['id'].dataType.simpleString()}, y int"))
    text = docs.select(key.alias("id"), body.cast("binary").alias("text"), F.length(body).alias("n"))
    got = text.filter(F.col("n").between(1, chars)).join(small, "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    return [(bytes(r["text"]), r["y"]) for r in sorted(got.collect(), key=lambda r: r["id"])]


def train(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), learn=None, target: str = "toxic",
    id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """A model from the rows of ``docs`` that ``labels`` marks, at most ``settings.rows`` of each class."""
    sample = labelled_sample(docs, labels, target, settings.rows, settings.chars, learn, id_col, text_col)
    return fit([t for t, _ in sample], np.array([y for _, y in sample]), settings)


def score_column(model: Model):
    """Arrow function of a binary text column: the score."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = model.dense()
        for batch in texts:
            got: list[float] = []
            for at in range(0, len(batch), SLICE_ROWS):
                got += [score_text(t, dense, model) for t in batch.slice(at, SLICE_ROWS).to_pylist()]
            yield pa.array(got, pa.float64())

    return score


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """``(id, score)`` for every row; nulls in the id stay, a null text is an empty one, repeated rows are scored each."""
    return docs.select(F.col(quoted(id_col)), score_column(model)(F.col(quoted(text_col)).cast("binary")).alias(out))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns unchanged."""
    return docs.filter(score_column(model)(F.col(quoted(text_col)).cast("binary")) < threshold)


def held_out(key):
    """The contract's fold: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's score; labels of held-out rows are never learnt from."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels, learn=lambda k: ~held_out(k))
    return scores(docs, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
