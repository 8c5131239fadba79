"""Document quality: random Fourier features, ridge from partition-summed normal equations, isotonic calibration."""
from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage_table
from .common import map_arrow, small_batches

STATISTICS = ("log_words", "log_chars", "word_length", "upper", "digit", "punctuation", "symbol", "white", "non_ascii", "entropy", "distinct_words",
              "repeated_word", "top_word", "upper_words", "symbol_words", "sentence_ends", "pipes", "exclaims", "distinct_lines", "log_line", "short_words", "longest_word")
FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-4
BINS = 400
LOW, HIGH = -0.5, 1.5  # range of ridge scores that the calibration bins cover; scores beyond fall into the end bins
CUT = 0.7


def byte_classes() -> np.ndarray:
    """256 x 6: which bytes are upper case, digits, punctuation, symbols, white space, beyond ASCII."""
    out = np.zeros((256, 6))
    for b in range(256):
        c = chr(b)
        k = 5 if b > 127 else 0 if c.isupper() else 1 if c.isdigit() else 2 if c in ".,;:!?'\"()-" else 4 if c.isspace() else 3 if not c.isalnum() else None
        if k is not None:
            out[b, k] = 1
    return out


CLASSES = byte_classes()
SYMBOLS = set("#$%&*@|~^<>=+_/\\{}[]")


def statistics_of(text: str) -> list[float]:
    """The STATISTICS of one whole text; all zero but for defined ones if it has no word."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist @ CLASSES / len(raw)
    p = hist[hist > 0] / len(raw)
    counts = Counter(words)
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, n)
    last = Counter([w[-1] for w in words])
    return [np.log1p(n), np.log1p(len(text)), min(lengths.mean(), 30.0), *share, float(-(p * np.log(p)).sum()), len(counts) / n,
            sum(map(operator.eq, words, words[1:])) / n, max(counts.values()) / n, sum(map(str.isupper, words)) / n,
            sum(k for c, k in last.items() if c in SYMBOLS) / n, sum(last[c] for c in ".?!") / n, counts["|"] / n, text.count("!!") / n,
            len(set(lines)) / len(lines), np.log1p(n / len(lines)), float((lengths <= 3).mean()), float(np.log1p(lengths.max()))]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats): an array of the STATISTICS of each whole text; null counts as empty."""
    def run(batches):
        for batch in small_batches(batches, "_text"):
            rows = np.array([statistics_of(t) for t in batch.column(1).to_pylist()], np.float32).reshape(batch.num_rows, len(STATISTICS))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], [id_col, "stats"])

    return map_arrow(docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, stats array<float>")


def matrix(column, width: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width) if column.offset == 0 and len(column.values) == len(column) * width \
        else np.array(column.to_pylist(), np.float64).reshape(len(column), width)


def summed(df: DataFrame, of_batch, size: int, partials: int = 16) -> np.ndarray:
    """Sum of ``of_batch(record batch) -> float64 vector`` over all rows: one vector a partition, then ``partials`` vectors to the driver."""
    def first(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def second(batches):
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts = df.mapInArrow(first, "v binary").repartition(partials).mapInArrow(second, "v binary").collect()
    return sum((np.frombuffer(r[0]) for r in parts), np.zeros(size))


@dataclass
class QualityModel:
    """Centre and scale of the statistics, the random features, the ridge weights and the calibration steps."""
    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.centre) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / self.directions.shape[1])
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean x, share) of the blocks of the best non-decreasing fit."""
    blocks: list[list[float]] = []
    for a, p, n in zip(x, positives, counts):
        blocks.append([a * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def bucket_of(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; a null id has none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", features: int = FEATURES, seed: int = 7) -> QualityModel:
    """Fit on all labelled rows whose bucket isn't 2: buckets 0 and 1 give the ridge weights, bucket 3 the calibration.

    Every sum runs over all of these rows in the tasks; the driver gets a few vectors of (features + 1)^2 numbers and at
    most BINS counts. Without labels of both classes the score is the share of ones (0.5 if there is no label). Null labels
    and ids that have no document are ignored; a label given twice counts twice.
    """
    d, k = len(STATISTICS), features + 1
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    rows = stats.select(F.col(id_col).alias("_id"), "stats").join(known, "_id").select("stats", "_y", bucket_of("_id").cast("int").alias("_bucket")).where("_bucket <> 2")
    rows = stage_table(rows)

    def moments(batch):
        x = matrix(batch.column(0), d)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    sums = summed(rows.select("stats"), moments, 1 + 2 * d)
    n = max(sums[0], 1.0)
    centre = sums[1:1 + d] / n
    scale = np.sqrt(np.maximum(sums[1 + d:] / n - centre ** 2, 1e-8))
    rng = np.random.default_rng(seed)
    model = QualityModel(centre, scale, rng.normal(size=(d, features)) / (WIDTH * np.sqrt(d) / 2), rng.uniform(0, 2 * np.pi, features), np.zeros(k), np.array([0.0]), np.array([0.5]))

    def normal(batch):
        z, y = model.features(matrix(batch.column(0), d)), batch.column(1).to_numpy()
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y), y.sum()]])

    sums = summed(rows.where("_bucket < 2").select("stats", "_y"), normal, k * k + k + 2)
    n, ones = sums[-2:]
    if n:
        penalty = np.full(k, RIDGE * n)
        penalty[-1] = 0
        model.weights = np.linalg.lstsq(sums[:k * k].reshape(k, k) + np.diag(penalty), sums[k * k:k * k + k], rcond=None)[0]
        model.levels = np.array([ones / n])

    def binned(batch):
        s, y = model.raw(matrix(batch.column(0), d)), batch.column(1).to_numpy()
        at = np.clip(((s - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, s, BINS)])

    counts, ones, total = summed(rows.where("_bucket = 3").select("stats", "_y"), binned, 3 * BINS).reshape(3, BINS)
    full = counts > 0
    if full.any() and 0 < ones.sum() < counts.sum():
        model.knots, model.levels = isotonic(total[full] / counts[full], ones[full], counts[full])
    return model


def score(stats: DataFrame, model: QualityModel, id_col: str = "doc_id", cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) from the statistics alone."""
    d = len(STATISTICS)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1), d)))], [id_col, "score"])

    out = stats.select(id_col, "stats").mapInArrow(run, f"`{id_col}` {dict(stats.dtypes)[id_col]}, score double")
    return out.select(id_col, F.coalesce(bucket_of(id_col) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Learn from ``labels`` and score every document; labels and the other columns are never inputs of a score."""
    stats = stage_table(statistics(docs, id_col, text_col))
    return score(stats, fit(stats, labels, id_col), id_col, cut)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``cut``; documents of no word are scored like others.

    The texts aren't shuffled: the statistics are taken once to learn and once more beside the rows to filter.
    """
    model = fit(stage_table(statistics(docs, id_col, text_col)), labels, id_col)
    names = docs.columns
    at = names.index(text_col)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def run(batches):
        for batch in small_batches(batches, text_col):
            rows = np.array([statistics_of(t or "") for t in batch.column(at).to_pylist()], np.float32)
            yield batch.filter(pa.array(model.score(rows.astype(np.float64)) >= cut))

    return map_arrow(docs, run, schema)
