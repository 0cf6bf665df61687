"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; unlabelled text is any training document, whatever its
label.  A small network on measures of a text's form minimises the non-negative unbiased risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the logistic loss; where the second part is negative, its gradient is followed backwards.  The class prior
is estimated from positives and unlabelled text alone: a network that tells them apart is learned on one half of the
sample, and on the other half the share of unlabelled texts above a score is divided by that of positives, at the
score where the bound of that ratio is least.  Rows labelled bad serve nothing.

Learning reads at most ``FIT_POSITIVE`` positives and ``FIT_UNLABELLED`` other texts, chosen by a hash of the id, one
for each id; scoring reads all whole texts.

Defined results: null or empty texts have measures of 0 and a score like any other; rows that repeat an id are
scored one by one, and the least of their measures is learned from; without positives all scores are 0.5; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vecwords as v
from .scratch import materialise, python_ready

FIT_POSITIVE = 15_000
FIT_UNLABELLED = 15_000
HIDDEN = 16
THRESHOLD = 0.3

#: Bytes counted together, as shares of a text's bytes.
CLASSES = (b"#", b"$", b"%", b"*", b"&", b"|", b"<>", b"!", b"?", b".", b",", b"\n", b"0123456789", b"@_~^=+", b"(){}[]/\\", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
N_MEASURES = len(CLASSES) + 8


def measures(raw: bytes, h: np.ndarray) -> list[float]:
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    out = [float(np.log1p(100 * counts[list(c)].sum() / n)) for c in CLASSES]
    out.append(float(np.log1p(100 * counts[128:].sum() / n)))
    out.append(float(np.log1p(100 * counts[:32].sum() / n)))
    words = max(len(h), 1)
    grams = v.ngrams(h, 3)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out.append(float(np.log1p(len(h))))
    out.append(len(raw) / words / 10)
    out.append(len(np.unique(h)) / words)
    out.append(1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0)
    out.append(1 - len(set(lines)) / len(lines) if lines else 0.0)
    out.append(float(np.log1p(len(h) / max(len(lines), 1))))
    return out


SCHEMA = "doc_id bigint, x array<double>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = v.buffers(batch.column("text"))
        rows = [measures(raw[off[i] : off[i + 1]].tobytes(), h) for i, h in v.word_hashes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


class Network:
    """One hidden layer of tanh units; inputs standardised and clipped."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, sd
        self.p = [rng.normal(0, 1 / len(mean) ** 0.5, (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.25, HIDDEN), np.zeros(1)]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.tanh(z @ self.p[0] + self.p[1])
        return a, a @ self.p[2] + self.p[3]

    def gradient(self, z: np.ndarray, a: np.ndarray, dg: np.ndarray) -> list[np.ndarray]:
        back = dg[:, None] * self.p[2] * (1 - a * a)
        return [z.T @ back, back.sum(0), a.T @ dg, np.array([dg.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.inputs(x))[1], -30, 30)))


def fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = 60, batch: int = 512, rate: float = 0.01, decay: float = 1e-4
) -> Network:
    """Adam on the non-negative risk; without a prior, on the risk of telling positives from unlabelled texts."""
    both = np.vstack([positive, unlabelled])
    net = Network(both.mean(0), both.std(0) + 1e-3)
    zp, zu = net.inputs(positive), net.inputs(unlabelled)
    rng = np.random.default_rng(6)
    m = [np.zeros_like(x) for x in net.p]
    s = [np.zeros_like(x) for x in net.p]
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    step = 0
    rounds = max(1, -(-len(zu) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(zu))
        for k in range(rounds):
            u = zu[order[k * batch : (k + 1) * batch]]
            p = zp[rng.integers(0, len(zp), min(batch, len(zp)))]
            ap, gp = net.forward(p)
            au, gu = net.forward(u)
            part = prior or 0.0
            risk = np.logaddexp(0, gu).mean() - part * np.logaddexp(0, gp).mean()  # of the negatives, unbiased
            minus = [x - y for x, y in zip(net.gradient(u, au, sigmoid(gu) / len(u)), net.gradient(p, ap, part * sigmoid(gp) / len(p)))]
            if risk >= 0:
                plus = net.gradient(p, ap, -(prior or 1.0) * sigmoid(-gp) / len(p))
                grad = [x + y for x, y in zip(plus, minus)]
            else:
                grad = [-x for x in minus]
            step += 1
            for i, g in enumerate(grad):
                g = g + decay * net.p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                net.p[i] = net.p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        rate *= 0.96
    return net


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among unlabelled texts, less two standard errors: too high a prior turns negatives into
    positives, too low a one costs little."""
    rng = np.random.default_rng(8)
    p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
    halves = lambda x, at: (x[at[: len(at) // 2]], x[at[len(at) // 2 :]])
    (p1, p2), (u1, u2) = halves(positive, p), halves(unlabelled, u)
    if not len(p1) or not len(u1):
        return 0.5
    net = fit(p1, u1, None, epochs=20)
    sp, su = np.sort(net.score(p2)), np.sort(net.score(u2))
    above = lambda s, at: 1 - np.searchsorted(s, at, side="left") / len(s)
    at = sp[: max(1, int(0.99 * len(sp)))]
    ratio = above(su, at) / above(sp, at)
    slack = ((np.log(4 / confidence) / 2) ** 0.5 * (len(su) ** -0.5 + len(sp) ** -0.5)) / above(sp, at)
    best = float(ratio[np.argmin(ratio + slack)])
    below = 2 * (max(best * (1 - best), 0) / len(su)) ** 0.5
    return min(max(best - below, best / 2, 0.01), 0.98)


def scored(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, score, predicted, class_prior for every row; rows where ``held_out`` holds are never learned from."""
    with python_ready(docs.sparkSession):
        return materialise(_scored(docs, labels, held_out), "scores")


def _scored(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id is not null and good is not null")
    good = marks.where(~held_out).groupBy("doc_id").agg(F.max("good").alias("good")).where("good = 1")
    ids = texts.where("doc_id is not null").where(~held_out).select("doc_id").distinct()
    positive = ids.join(good, "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(FIT_POSITIVE).select("doc_id", F.lit(1).alias("p"))
    unlabelled = ids.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(FIT_UNLABELLED).select("doc_id", F.lit(0).alias("p"))
    chosen = materialise(positive.unionByName(unlabelled), "chosen")
    picked = texts.join(chosen.select("doc_id").distinct(), "doc_id")
    learned = picked.mapInArrow(_measured, SCHEMA).groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = learned.join(chosen, "doc_id").select("p", "x").toPandas()  # at most FIT_POSITIVE + FIT_UNLABELLED rows
    x, p = np.array(rows["x"].tolist()).reshape(-1, N_MEASURES), rows["p"].to_numpy()
    able = (p == 1).any() and (p == 0).any()
    prior = estimated_prior(x[p == 1], x[p == 0]) if able else 0.5
    net = fit(x[p == 1], x[p == 0], prior) if able else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _measured(batches):
            own = np.array(batch.column("x").to_pylist()).reshape(-1, N_MEASURES)
            out = net.score(own) if net is not None else np.full(len(own), prior)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    done = texts.mapInArrow(score, "doc_id bigint, score double")
    return done.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), F.lit(prior).alias("class_prior")
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored(docs, labels, held_out)
