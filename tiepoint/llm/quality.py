"""Quality scores by positive-unlabelled learning.

A linear model on shares of character-class pairs and a few counts of a whole text is fitted with the
non-negative unbiased risk (Kiryo et al. 2017): trusted positives stand for the positive class, unlabelled
web text for the mixture, and the class prior weighs them. Labels that say "not good" are never used.

The prior is estimated from the same samples: for the texts above any score, their share of the
unlabelled is at least the prior times their share of the positives, so the least ratio of the two over
scores, on halves that the ranking model wasn't fitted to, bounds it from above (Scott 2015).

Both samples are bounded: at most ``SAMPLE`` rows each, chosen by a hash of ``doc_id``; the model is
``len(weights)`` numbers. Every document is scored over its whole text.

Cases: null text is empty; an empty text is scored as the model scores zero features; a null ``doc_id`` is
scored and never sampled; rows that repeat get the same score; without any positive or unlabelled row
every score is the prior 0.5; an empty table gives no rows; further columns are ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, table
from .words import PIECE, word_chunks

SAMPLE = 6_000  # rows of each sample
THRESHOLD = 0.3
STEPS, RATE, DECAY = 300, 0.05, 1e-4

# Character classes: letters of either case, digits, spaces, line ends, each sort of mark, other scripts' bytes.
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _group in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r\x0b\x0c", b".,", b";:!?", b"'\"", b"()[]{}<>", b"|/\\", b"*#$%&@~^_=+-`", range(128, 256))):
    _CLASS[list(_group)] = _k + 1
CLASSES = int(_CLASS.max()) + 1
FEATURES = CLASSES * CLASSES + CLASSES + 5


def features(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of each class and pair of classes; length, word and line length, repeated words."""
    return np.concatenate([np.zeros((0, FEATURES), np.float32), *_features(texts)])


def _features(texts: pa.Array) -> Iterator[np.ndarray]:
    """``features`` of the rows of one piece of text after another."""
    for part in word_chunks(texts, most=PIECE):
        n = part.hi - part.lo
        x = np.zeros((n, FEATURES), dtype=np.float32)
        kinds = _CLASS[part.data]
        # row of each byte, from the byte offsets of the rows
        sizes = _sizes(texts, part.lo, part.hi)
        row = np.repeat(np.arange(n), sizes)
        total = np.maximum(sizes, 1)[:, None]
        one = np.bincount(row * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES)
        same = row[1:] == row[:-1] if len(row) else np.zeros(0, dtype=bool)
        pairs = (row[:-1] * CLASSES + kinds[:-1]) * CLASSES + kinds[1:]
        two = np.bincount(pairs[same], minlength=n * CLASSES * CLASSES).reshape(n, CLASSES * CLASSES)
        x[:, : CLASSES * CLASSES] = np.sqrt(two / total)
        x[:, CLASSES * CLASSES : -5] = np.sqrt(one / total)
        words = np.diff(part.first)
        x[:, -4] = np.log1p(sizes) / 10
        x[:, -3] = np.minimum(sizes / np.maximum(words, 1), 40) / 10
        lines = one[:, 5]
        x[:, -2] = np.minimum(words / (lines + 1), 200) / 100
        for k in np.flatnonzero(words):
            own = part.hash[part.first[k] : part.first[k + 1]]
            x[k, -1] = 1 - len(np.unique(own)) / len(own)
            x[k, -5] = (own[1:] == own[:-1]).sum() / len(own)
        yield x


def _sizes(texts: pa.Array, lo: int, hi: int) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(texts.slice(lo, hi - lo)), 0), dtype=np.int64)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, size: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Adam from zero; ``gradient(w, b)`` gives both derivatives."""
    w, m, v = (np.zeros(size + 1) for _ in range(3))
    for t in range(1, steps + 1):
        gw, gb = gradient(w[:-1].astype(np.float32), np.float32(w[-1]))
        g = np.append(gw + DECAY * w[:-1], gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among ``unlabelled``, from a ranking fitted to one half of both and judged on the other."""
    p, u = positive[::2], unlabelled[::2]

    def gradient(w, b):
        a, c = _sigmoid(p @ w + b) - 1, _sigmoid(u @ w + b)
        return (p.T @ a / len(p) + u.T @ c / len(u)) / 2, (a.mean() + c.mean()) / 2

    w, b = _descend(gradient, positive.shape[1], STEPS // 2)
    sp, su = np.sort(positive[1::2] @ w + b), np.sort(unlabelled[1::2] @ w + b)
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.quantile(sp, np.linspace(0, 0.9, 91))
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    return float(np.clip((above_u / np.maximum(above_p, 1e-9)).min(), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.5)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.02
    p, u = (((x - mean) / scale).astype(np.float32) for x in (positive, unlabelled))
    prior = estimate_prior(p, u)

    def gradient(w, b):
        zp, zu = p @ w + b, u @ w + b
        # logistic loss: positives as positives, and the negatives' risk as unlabelled less positives as negatives
        ap, np_, nu = _sigmoid(zp) - 1, _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp = prior * (p.T @ ap) / len(p), prior * ap.mean()
        gn = u.T @ nu / len(u) - prior * (p.T @ np_) / len(p), nu.mean() - prior * np_.mean()
        if negative < 0:  # the estimate of a risk can't be below zero: step the other way
            return -gn[0], -gn[1]
        return gp[0] + gn[0], gp[1] + gn[1]

    w, b = _descend(gradient, FEATURES)
    return Model(mean, scale, w, b, prior)


def fold(doc_id: Column) -> Column:
    """0 for held-out rows."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5))


def _pick(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ids, by hash."""
    return rows.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled positives and on documents as such, of the training folds only."""
    training = fold(F.col("doc_id")) != 0
    good = labels.where((F.col("quality") == 1) & training).select(F.col("doc_id").cast("long").alias("doc_id")).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    good = _pick(good.distinct(), sample).withColumn("positive", F.lit(True))
    web = _pick(docs.where(training).select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), sample).withColumn("positive", F.lit(False))
    picked = materialize(good.unionByName(web), "sample-ids")

    def run(batches):
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], names=["positive", "x"])

    # at most 2 * sample rows, so this side may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("positive", "text")
    got = texts.mapInArrow(run, "positive boolean, x binary").toPandas()
    x = np.frombuffer(b"".join(got["x"]), dtype="<f2").reshape(-1, FEATURES).astype(np.float32)
    positive = got["positive"].to_numpy(dtype=bool)
    order = np.lexsort((x.sum(1), positive))
    x, positive = x[order], positive[order]
    shuffled = np.random.default_rng(7).permutation(len(x))
    x, positive = x[shuffled], positive[shuffled]
    return fit(x[positive], x[~positive])


def scores_of(texts: pa.Array, model: Model) -> pa.Array:
    """The score of each text; features are held for one piece of text only."""
    return pa.array(np.concatenate([np.zeros(0), *map(model.score, _features(texts))]), pa.float64())


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score``. Only texts go to Python, and only scores come back."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield scores_of(texts, model)

    return docs.select(*keep, scored("text").alias("_q_score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score below ``threshold``, columns unchanged."""
    model = train(docs, labels)
    return score(docs, model, *docs.columns).where(F.col("_q_score") >= threshold).drop("_q_score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        F.col("_q_score").alias("score"),
        (F.col("_q_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
