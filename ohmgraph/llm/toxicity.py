"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams (``NGRAMS`` code points, lower case, white space runs as one space) of a whole text,
hashed to ``BUCKETS``. Partitions count, for each bucket, the toxic and the other documents that hold it; r, the log of the ratio of the smoothed rates,
scales each feature. The ``KEPT`` buckets whose counts tell most (largest chi-square) enter a logistic
regression on r-scaled presence. Presence, not frequency, so that a short insult in a long text counts as much as in a
short one.

The fit uses at most ``SAMPLE`` labelled rows outside the held-out quarter, chosen by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.llm.common import BATCH, Scratch, batches_of, held_out, labelled_sample, small, table

NGRAMS = (3, 4, 5, 6)
BUCKETS, KEPT, SAMPLE = 1 << 18, 4096, 12_000
#: A document of at least this score is called toxic.
THRESHOLD = 0.3
ALPHA = 0.5
_CHUNK = 1 << 18


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of a text, one array for each n and each stretch of the text; stretches overlap by an n-gram."""
    x = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for a in range(0, max(len(x), 1), _CHUNK):
        c = x[a : a + _CHUNK + max(NGRAMS) - 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        acc = c ^ (c >> np.uint64(29))
        h = acc
        for n in range(2, max(NGRAMS) + 1):
            if len(c) < n:
                break
            h = h[:-1] * np.uint64(0xBF58476D1CE4E5B9) + acc[n - 1 :]
            if n in NGRAMS:
                yield ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - 18))[:_CHUNK].astype(np.int32)


def present(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text, or those of them that ``wanted`` marks."""
    got = [g if wanted is None else g[wanted[g]] for g in buckets(text)]
    return np.unique(np.concatenate(got)) if got else np.empty(0, np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int32)
    n = [0, 0]
    for batch in small(batches):
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            total[y][present(text)] += 1
            n[y] += 1
    at = np.flatnonzero(total.sum(axis=0))
    yield pa.record_batch([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[0][at], n[0]).astype(np.int64)), pa.array(np.append(total[1][at], n[1]).astype(np.int64))], names=["bucket", "n0", "n1"])


def _features(column: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = column >= 0
        for batch in small(batches):
            rows = [column[present(t, wanted)].tolist() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("y"), pa.array(rows, pa.list_(pa.int32()))], names=["y", "f"])

    return run


def logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, r: np.ndarray, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights on the r-scaled features and a bias, by gradient descent with Adam on all rows at once."""
    n, d = len(y), len(r)
    w, b = np.zeros(d), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    value = r[cols]
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=value * w[cols], minlength=n) + b
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.append(np.bincount(cols, weights=value * g[rows], minlength=d) / n + l2 * w, g.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Model:
    """weight: of each bucket, already scaled by r; 0 for those not used."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias
        self.wanted = weight != 0

    def score(self, texts: list[str]) -> np.ndarray:
        z = np.array([self.weight[present(t, self.wanted)].sum() + self.bias for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Without labelled rows of both kinds the model scores every text by the share of label 1, smoothed."""
    tmp = Scratch(docs.sparkSession, "toxicity")
    sample = tmp.keep(labelled_sample(docs, labels, label, SAMPLE).select("text", "y"), "sample")
    with batches_of(docs.sparkSession, BATCH):
        counts = sample.mapInArrow(_counts, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas().set_index("bucket")
    n0, n1 = (float(counts[c].get(-1, 0)) for c in ("n0", "n1"))
    counts = counts.drop(index=-1, errors="ignore")
    if not n0 or not n1:
        return Model(np.zeros(BUCKETS), float(np.log((n1 + 1) / (n0 + 1))))
    a, b = counts.n1.to_numpy(float), counts.n0.to_numpy(float)
    r = np.log((a + ALPHA) / (n1 + 2 * ALPHA)) - np.log((b + ALPHA) / (n0 + 2 * ALPHA))
    share, n = (a + b) / (n0 + n1), n0 + n1
    chi = (a - n1 * share) ** 2 / np.maximum(n1 * share * (1 - share), 1e-9) * n / n0
    best = np.lexsort((counts.index.to_numpy(), -chi))[:KEPT]
    bucket, r = counts.index.to_numpy()[best], r[best]
    column = np.full(BUCKETS, -1, np.int32)
    column[bucket] = np.arange(len(bucket))
    with batches_of(docs.sparkSession, BATCH):
        got = sample.mapInArrow(_features(column), "y int, f array<int>").toPandas()
    size = got.f.map(len).to_numpy()
    rows, cols = np.repeat(np.arange(len(got)), size), np.concatenate([*got.f, np.empty(0, np.int32)]).astype(np.int64)
    w, bias = logistic(rows, cols, got.y.to_numpy(float), r)
    weight = np.zeros(BUCKETS)
    weight[bucket] = w * r
    weight[np.abs(weight) < 1e-4] = 0
    return Model(weight, bias)


def _scores(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            s = model.score(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, from the whole text alone.

    A null or empty text has no n-gram but that of two spaces and gets the bias alone; a null id is never held out. Rows of equal id
    are scored each for itself; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with batches_of(docs.sparkSession, BATCH):
        return Scratch(docs.sparkSession, "toxicity").finish(rows.mapInArrow(_scores(model, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int"), "scores")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
