"""Toxicity by a classifier chain: category after category, earlier probabilities as inputs of later linear models."""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage_table
from .common import map_arrow, small_batches
from .quality import bucket_of, summed

SAMPLE = 20_000  # labelled rows that the models are fitted on, at most
CANDIDATES = 20_000  # features that are counted in all sampled rows: the most frequent ones of toxic rows
FEATURES = 96
FOLDS = 3
PREFIXES = (3, 4, 5, 6)
RIDGE = 0.5
CATEGORY_ROWS = 20  # toxic rows that a category needs
CATEGORIES = 8
CUT = 0.5
TOKEN = re.compile(r"\w+")


def features_of(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its prefixes; prefixes carry a mark, so that they differ from whole words."""
    import xxhash
    h = xxhash.xxh64_intdigest
    return [h(word) >> 1, *[h(word[:k] + "*") >> 1 for k in PREFIXES if len(word) > k]]


def document_features(text: str) -> set[int]:
    return {f for w in set(TOKEN.findall(text.lower())) for f in features_of(w)}


@dataclass
class ChainModel:
    """The chosen features, and per category (in chain order) its name and weights: features, earlier probabilities, constant."""
    chosen: list[int]
    names: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        earlier = np.zeros((len(x), 0))
        for w in self.weights:
            earlier = np.concatenate([earlier, predict(inputs(x, earlier), w)[:, None]], 1)
        return earlier

    def rows(self, texts: list[str], cache: dict) -> np.ndarray:
        """Presence of the chosen features in each whole text."""
        at = {f: i for i, f in enumerate(self.chosen)}
        x = np.zeros((len(texts), len(self.chosen)))
        if len(cache) > 200_000:
            cache.clear()
        for i, text in enumerate(texts):
            for w in set(TOKEN.findall(text.lower())):
                hit = cache.get(w)
                if hit is None:
                    hit = cache[w] = tuple(at[f] for f in features_of(w) if f in at)
                if hit:
                    x[i, list(hit)] = 1
        return x


def inputs(x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.concatenate([x, earlier, np.ones((len(x), 1))], 1)


def predict(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))


def fit_linear(z: np.ndarray, y: np.ndarray, steps: int = 12) -> np.ndarray:
    """Logistic weights with a ridge penalty (not on the constant), by reweighted least squares; one class gives a constant."""
    w = np.zeros(z.shape[1])
    if not len(y):
        return w
    if y.min() == y.max():
        w[-1] = 8.0 if y[0] else -8.0
        return w
    penalty = np.full(z.shape[1], RIDGE)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = predict(z, w)
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(x: np.ndarray, targets: list[tuple[str, np.ndarray]], fold: np.ndarray, chosen: list[int]) -> ChainModel:
    """One linear model per target. The earlier probabilities that a later model learns from are out-of-fold: each row's
    come from models that haven't seen it, as they will be for new documents."""
    model, earlier = ChainModel(chosen), np.zeros((len(x), 0))
    for name, y in targets:
        z = inputs(x, earlier)
        out = np.zeros(len(x))
        for k in range(FOLDS):
            out[fold == k] = predict(z[fold == k], fit_linear(z[fold != k], y[fold != k]))
        model.names.append(name)
        model.weights.append(fit_linear(z, y))
        earlier = np.concatenate([earlier, out[:, None]], 1)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", category_col: str = "lang",
        sample: int = SAMPLE) -> ChainModel:
    """Learn from at most ``sample`` labelled rows (those with the smallest hash of the id) outside bucket 2.

    The categories are toxicity within each value of ``category_col`` that has enough toxic rows, most frequent first; the
    last link of the chain is toxicity as such. ``category_col`` is a target only, never an input. Features are words and
    word prefixes that tell toxic rows from others; the candidates are the CANDIDATES features found in most toxic
    rows. Without a label of both classes every probability is constant (0 without any label).
    """
    known = labels.where(F.col(label_col).isNotNull() & (F.coalesce(bucket_of(id_col), F.lit(2)) != 2))
    known = known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    kind = dict(docs.dtypes)[id_col]
    # at most `sample` rows: small enough to go to every task, so that the texts needn't be shuffled
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.col(category_col).cast("string").alias("_category")).join(F.broadcast(known), "_id")

    def count(batches):
        for batch in small_batches(batches, "_text"):
            lines = [sorted(document_features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(lines, pa.list_(pa.int64()))], ["_id", "_category", "_y", "_f"])

    rows = stage_table(map_arrow(rows.select("_id", "_text", "_category", "_y"), count, f"_id {kind}, _category string, _y int, _f array<bigint>"))
    top = rows.where("_y = 1").select(F.explode("_f").alias("f")).groupBy("f").count().where("count > 1").orderBy(F.col("count").desc(), "f").limit(CANDIDATES)
    candidates = np.sort(np.array([r[0] for r in top.select("f").collect()], np.int64))
    if not len(candidates):
        share = rows.agg(F.avg("_y")).first()[0]
        return ChainModel([], ["toxic"], [np.array([8.0 if share else -8.0])])

    def presence(lists):
        flat = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(candidates, flat), len(candidates) - 1)
        return at, candidates[at] == flat, np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))

    def counts(batch):
        at, hit, row = presence(batch.column(1))
        y = batch.column(0).to_numpy()
        one = y[row] == 1
        n = len(candidates)
        return np.concatenate([np.bincount(at[hit & one], minlength=n), np.bincount(at[hit & ~one], minlength=n), [y.sum(), len(y) - y.sum()]])

    sums = summed(rows.select("_y", "_f"), counts, 2 * len(candidates) + 2, 4)
    n1, n0 = np.maximum(sums[-2:], 1)
    a, b = sums[:len(candidates)], sums[len(candidates):-2]
    share = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    best = candidates[np.sort(np.argsort(-z, kind="stable")[:FEATURES])]

    def dense(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            flat = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(best, flat), len(best) - 1)
            hit = best[at] == flat
            x = np.zeros((batch.num_rows, len(best)), np.uint8)
            x[np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))[hit], at[hit]] = 1
            bits = np.packbits(x, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in bits], pa.binary())], ["_id", "_category", "_y", "_x"])

    learn = map_arrow(rows.select("_id", "_category", "_y", "_f"), dense, f"_id {kind}, _category string, _y int, _x binary")
    learn = learn.select(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"), "_category", "_y", "_x").toPandas()  # bits of at most `sample` rows
    x = np.unpackbits(np.frombuffer(b"".join(learn["_x"]), np.uint8).reshape(len(learn), -1), axis=1)[:, :len(best)].astype(np.float64)
    y, category = learn["_y"].to_numpy(float), learn["_category"]
    toxic = category[y == 1].value_counts()
    names = sorted((c for c in toxic.index if toxic[c] >= CATEGORY_ROWS), key=lambda c: (-toxic[c], c))[:CATEGORIES]
    targets = [(f"toxic:{c}", y * (category == c).to_numpy()) for c in names] + [("toxic", y)]
    return fit_chain(x, targets, learn["fold"].to_numpy(), best.tolist())


def score(docs: DataFrame, model: ChainModel, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted, categories) of every whole text; null counts as empty."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        cache: dict = {}
        for batch in small_batches(batches, "_text"):
            p = model.probabilities(model.rows(batch.column(1).to_pylist(), cache))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ascontiguousarray(p[:, -1])), lists], [id_col, "score", "_p"])

    out = map_arrow(docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")), run, f"`{id_col}` {kind}, score double, _p array<double>")
    names = F.array(*[F.lit(n) for n in model.names])
    return out.select(id_col, F.coalesce(bucket_of(id_col) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"),
                      F.zip_with(names, "_p", lambda n, p: F.struct(n.alias("category"), p.alias("probability"))).alias("categories"))
