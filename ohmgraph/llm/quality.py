"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every document is reduced to ``len(NAMES)`` statistics of its whole text. Their standardised vector goes through ``DIM`` random cosines,
whose inner products approximate a Gaussian kernel; ridge regression on them needs only X'X and X'y,
which each partition sums for itself and for each of ``FOLDS`` folds. Leaving a fold out is a subtraction, so scores
of rows that the fit has not seen come for free, and isotonic regression (pool adjacent violators) of the labels on
these scores turns a score into a probability.

The fit uses at most ``SAMPLE`` labelled rows outside the held-out quarter, chosen by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.llm import textops
from ohmgraph.llm.common import BATCH, Scratch, batches_of, held_out, labelled_sample, small, table

SAMPLE, DIM, FOLDS, SEED, RIDGE = 20_000, 256, 5, 7, 1e-3
#: Tasks that write the sample, and so its files, at most; on a local file system an executor starts a process for each file.
PARTS = 8
#: A document of at least this score passes.
THRESHOLD = 0.7

# classes of bytes
_LOWER, _UPPER, _DIGIT, _SPACE, _NEWLINE, _HIGH, _STOP, _COMMA, _BANG, _BAR, _DASH, _BRACKET, _QUOTE, _SLASH, _SYMBOL, _CONTROL = range(16)
_CLASS = [_CONTROL] * 256
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", _LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("0123456789", _DIGIT), (" \t\v\f\r", _SPACE), ("\n", _NEWLINE), (".", _STOP), (",;:", _COMMA), ("!?", _BANG), ("|", _BAR), ("-_", _DASH), ("()[]{}<>", _BRACKET), ("'\"`", _QUOTE), ("/\\@=+", _SLASH), ("#$%&*~^", _SYMBOL)):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
for _c in range(128, 256):
    _CLASS[_c] = _HIGH
_CLASS = bytes(_CLASS)
_CLASS_NAMES = ("lower", "upper", "digit", "space", "newline", "high", "stop", "comma", "bang", "bar", "dash", "bracket", "quote", "slash", "symbol", "control")
NAMES = (*_CLASS_NAMES, "bytes", "words", "word_len", "word_len_sd", "distinct", "distinct_pairs", "same_as_last", "upper_words", "odd_words", "lines", "line_len", "distinct_lines", "short_words", "words_a_stop")


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each text has."""
    if not len(key):
        return np.zeros(n)
    with np.errstate(over="ignore"):
        both = np.sort(textops.mix(key + doc.astype(np.uint64) * textops.MUL) >> np.uint64(20) | doc.astype(np.uint64) << np.uint64(44))
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    return np.bincount((both[first] >> np.uint64(44)).astype(np.int64), minlength=n).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text; an empty or null text has zeros."""
    parts = []
    for a, b, data, off in textops.chunks(column):
        n = b - a
        size = np.diff(off)
        cls = np.frombuffer(data.tobytes().translate(_CLASS), np.uint8)
        count = np.bincount(np.repeat(np.arange(n) * 16, size) + cls, minlength=16 * n).reshape(n, 16).astype(float)
        word = (cls != _SPACE) & (cls != _NEWLINE)
        s, e, doc = textops.runs(word, off)
        h, length = textops.hashes(data, s, e), (e - s).astype(float)
        words = np.bincount(doc, minlength=n).astype(float)
        per = lambda x, doc=doc, n=n: np.bincount(doc, weights=x, minlength=n)
        up, odd = (np.concatenate([[0], np.cumsum(np.isin(cls, k))]) for k in ([_UPPER], [_BANG, _BAR, _DASH, _BRACKET, _QUOTE, _SLASH, _SYMBOL, _CONTROL]))
        w = np.maximum(words, 1)
        mean = per(length) / w
        pair = np.zeros(len(h), bool)
        pair[1:] = doc[1:] == doc[:-1]
        with np.errstate(over="ignore"):
            two = np.empty_like(h)
            two[1:] = h[1:] * textops.MUL + h[:-1]
        same = np.zeros(len(h))
        same[1:] = pair[1:] & (h[1:] == h[:-1])
        ls, le, ldoc = textops.runs(cls != _NEWLINE, off)
        lines = np.bincount(ldoc, minlength=n).astype(float)
        ln = np.maximum(lines, 1)
        total = np.maximum(size, 1)[:, None]
        parts.append(
            np.column_stack([
                np.sqrt(count / total), np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(per(length**2) / w - mean**2, 0)),
                _distinct(h, doc, n) / w, _distinct(two[pair], doc[pair], n) / np.maximum(per(pair.astype(float)), 1), per(same) / w,
                per((up[e] - up[s]) * 2 > length) / w, per(odd[e] > odd[s]) / w, np.log1p(lines), np.log1p(size / ln), _distinct(textops.hashes(data, ls, le), ldoc, n) / ln,
                per(length <= 3) / w, np.log1p(words / np.maximum(count[:, _STOP], 1)),
            ])
        )
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        x = statistics(batch.column("text"))
        yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


class Fourier:
    """Random cosines of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, dim: int = DIM, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(size=(len(mean), dim)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, dim)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(x))])


def _folds(doc_id: np.ndarray) -> np.ndarray:
    return (textops.mix(doc_id.astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _gram(fourier: Fourier):
    """One row for each partition: for each fold the sums of f'f and f'y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(fourier.b) + 1
        total = np.zeros((FOLDS, d, d + 1))
        for batch in batches:
            f, y, k = fourier(_rows(batch)), batch.column("y").to_numpy(), _folds(batch.column("doc_id").to_numpy())
            for j in range(FOLDS):
                g = f[k == j]
                total[j] += g.T @ np.column_stack([g, y[k == j]])
        yield pa.record_batch([pa.array([total.tobytes()])], names=["sums"])

    return run


def _unseen(fourier: Fourier, betas: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.einsum("ij,ij->i", fourier(_rows(batch)), betas[_folds(batch.column("doc_id").to_numpy())])
            yield pa.record_batch([pa.array(s), batch.column("y")], names=["s", "y"])

    return run


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the increasing least-squares fit; between knots the fit is interpolated."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([1.0, float(v), float(s)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, a, b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + a, blocks[-1][2] + b]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def solve(total: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    a = total[:, :-1].copy()
    n = max(a[-1, -1], 1.0)
    penalty = np.full(len(a), ridge * n)
    penalty[-1] = 1e-9 * n
    return np.linalg.solve(a + np.diag(penalty), total[:, -1])


class Model:
    def __init__(self, fourier: Fourier, beta: np.ndarray, knots: np.ndarray, values: np.ndarray):
        self.fourier, self.beta, self.knots, self.values = fourier, beta, knots, values

    def score(self, column: pa.Array) -> np.ndarray:
        x = statistics(column)
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.fourier(x) @ self.beta, self.knots, self.values), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Without any labelled row the model scores every text 0.5."""
    tmp = Scratch(docs.sparkSession, "quality")
    with batches_of(docs.sparkSession, BATCH):
        sample = tmp.keep(labelled_sample(docs, labels, label, SAMPLE).coalesce(PARTS).mapInArrow(_sampled, "doc_id long, y int, x array<double>"), "sample")
    stats = sample.select([F.avg(F.col("x")[i]) for i in range(len(NAMES))] + [F.stddev_pop(F.col("x")[i]) for i in range(len(NAMES))]).first()
    if stats[0] is None:
        return Model(Fourier(np.zeros(len(NAMES)), np.ones(len(NAMES))), np.zeros(DIM + 1), np.array([]), np.array([]))
    fourier = Fourier(np.array(stats[: len(NAMES)]), np.array(stats[len(NAMES) :]))
    sums = [np.frombuffer(r.sums).reshape(FOLDS, DIM + 1, DIM + 2) for r in sample.mapInArrow(_gram(fourier), "sums binary").collect()]
    folds = np.sum(sums, axis=0)
    total = folds.sum(axis=0)
    betas = np.array([solve(total - f) for f in folds])
    seen = sample.mapInArrow(_unseen(fourier, betas), "s double, y int").toPandas()
    return Model(fourier, solve(total), *isotonic(seen.s.to_numpy(), seen.y.to_numpy()))


def _scores(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            s = model.score(batch.column("text"))
            rest = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*rest, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, from the whole text alone.

    A null or empty text is scored as a text without any character; a null id is never held out. Rows of equal id are
    scored each for itself; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with batches_of(docs.sparkSession, BATCH):
        return Scratch(docs.sparkSession, "quality").finish(rows.mapInArrow(_scores(model, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int"), "scores")


def _passing(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array(model.score(batch.column("text")) >= threshold))

    return run


def passing(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, unchanged; nothing is shuffled."""
    with batches_of(docs.sparkSession, BATCH):
        return Scratch(docs.sparkSession, "quality").finish(docs.mapInArrow(_passing(model, threshold), docs.schema), "passing")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
