"""Language of a text: TF-IDF vectors of character n-grams, several clustered centroids per language, nearest by cosine."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_arrow, ragged, small_batches, worker_cache
from .quality import summed

SIZES = (1, 2, 3)
BUCKETS = 8192  # n-grams are hashed into so many features
CENTROIDS = 4
ROUNDS = 8
LEAST_SHARE = 0.1  # of a language's training rows that a cluster needs
PER_LANGUAGE = 2000  # training rows of each language that the clusters are fitted on, at most
UNKNOWN = "und"
DISTANCE = 0.8  # cosine distance beyond which a text counts as unlike every learned language
BLOCK = 64  # texts whose features are held as one dense matrix


def letter_table() -> np.ndarray:
    """For every code point the code point of its small letter; 0 for what is no letter. Letters without a single small form stay."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x BUCKETS counts of hashed n-grams, whether a text has a letter).

    Runs of letters are lower-cased and set apart by one border on each side; n-grams of SIZES code points lie within a run and its borders,
    and a border alone is none. Whole texts count.
    """
    small = worker_cache("letters", letter_table)
    counts, lettered = np.zeros((len(texts), BUCKETS), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        code = small[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        code = np.concatenate([[np.uint32(0)], code, [np.uint32(0)]])
        code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])].astype(np.uint64)  # one border between runs
        if len(code) < 2:
            continue
        lettered[i] = True
        key, places = np.zeros(len(code), np.uint64), []
        for n in range(1, max(SIZES) + 1):
            key = key[:len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:] + np.uint64(n)
            if n in SIZES:
                keep = code != 0 if n == 1 else np.ones(len(key), bool)
                for k in range(1, n - 1):  # no border strictly inside
                    keep &= code[k:k + len(key)] != 0
                places.append((key[keep] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(65 - BUCKETS.bit_length()))
        counts[i] = np.bincount(np.concatenate(places).astype(np.int64), minlength=BUCKETS)
    return counts, lettered


def vectors(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of count * weight, scaled to length 1; rows without a feature stay zero. Plain counts let the longer part of a text decide."""
    x = counts * weights
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clusters(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS, least: float = LEAST_SHARE) -> np.ndarray:
    """Spherical k-means of unit rows: the first centre is the row nearest to the mean, each next one the row farthest from the
    centres so far; fewer than ``k`` where rows coincide. Clusters below a share ``least`` of the rows are given up with
    their rows: a few rows that carry the wrong language must not get a centroid of their own. Ties go to the first row."""
    centres = x[[int(np.argmax(np.round(x @ x.mean(0), 9)))]]
    while len(centres) < min(k, len(x)):
        near = np.round((x @ centres.T).max(1), 9)
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        centres = np.concatenate([centres, x[[far]]])

    for _ in range(rounds):
        mine = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            total = x[mine == c].sum(0)
            if np.linalg.norm(total) > 0:
                centres[c] = total / np.linalg.norm(total)
    share = np.bincount(np.argmax(x @ centres.T, axis=1), minlength=len(centres)) / len(x)
    return centres[(share >= least) | (share == share.max())]


@dataclass
class LanguageModel:
    """IDF weights of the features and the centroids with their languages, in ascending order of the language."""
    weights: np.ndarray
    names: list[str]
    centroids: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the best centroid, its cosine) of every row; ties go to the first language."""
        cosine = vectors(counts, self.weights) @ self.centroids.T
        best = np.argmax(np.round(cosine, 6), axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1)


def bucket_of(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3; a null id has none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(_id, _lang, _text) of the rows to learn from: a language, a text and an id outside bucket 1."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.coalesce(bucket_of(id_col), F.lit(1)) != 1))
    return rows.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))


def bounded_sample(rows: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` rows of each language: those with the smallest hash of the id.

    How many rows a language has tells below which hash enough of them lie; only those few are ranked, so no task sees a whole language.
    """
    counts = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}  # one row per language
    if not counts:
        return rows
    spread = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * per_language / n + 50.0 / n)))])
    few = rows.withColumn("_h", spread).where(F.col("_h") <= share[F.col("_lang")])
    order = Window.partitionBy("_lang").orderBy("_h", "_id", "_text")
    return few.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_language).select("_id", "_lang", "_text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", centroids: int = CENTROIDS, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Document frequencies over all training rows; clusters of each language over at most ``per_language`` of them.

    The frequencies are summed in the tasks (one vector of BUCKETS numbers a partition). A language is clustered in one task, which holds
    ``per_language`` sparse vectors. Rows without a letter teach nothing; without any other row the model knows no language.
    The driver gets the frequencies and ``centroids`` vectors for each language.
    """
    rows = training_rows(docs, id_col, text_col, lang_col)

    def frequencies(batch):
        total = np.zeros(BUCKETS + 1)
        texts = batch.column(0).to_pylist()
        for at in range(0, len(texts), BLOCK):
            counts, lettered = gram_counts(texts[at:at + BLOCK])
            total[:-1] += (counts > 0).sum(0)
            total[-1] += lettered.sum()
        return total

    sums = summed(rows.select("_text"), frequencies, BUCKETS + 1)
    weights = np.log((1 + sums[-1]) / (1 + sums[:-1])) + 1

    def sparse(batches):
        for batch in small_batches(batches, "_text"):
            texts, langs = batch.column(1).to_pylist(), batch.column(0)
            for at in range(0, len(texts), BLOCK):
                counts, lettered = gram_counts(texts[at:at + BLOCK])
                row, place = np.nonzero(counts)
                sizes = np.bincount(row, minlength=len(counts))
                yield pa.RecordBatch.from_arrays([langs.slice(at, len(counts)), ragged(place.astype(np.int32), sizes), ragged(counts[row, place], sizes)],
                                                 ["lang", "place", "n"]).filter(pa.array(lettered))

    def cluster(table: pa.Table) -> pa.Table:
        place, n = table["place"].to_pylist(), table["n"].to_pylist()
        counts = np.zeros((len(place), BUCKETS), np.float32)
        for i, (p, v) in enumerate(zip(place, n)):
            counts[i, p] = v
        x = vectors(counts, weights).astype(np.float32)
        found = clusters(x[np.lexsort(np.round(x[:, :8].T, 6))], centroids)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(found)), "v": pa.array([c.astype("<f4").tobytes() for c in found], pa.binary())})

    sample = bounded_sample(rows, per_language)
    lines = map_arrow(sample.select("_lang", "_text"), sparse, "lang string, place array<int>, n array<float>")
    found = lines.groupBy("lang").applyInArrow(cluster, "lang string, v binary").collect()
    found = sorted((r["lang"], bytes(r["v"])) for r in found)
    matrix = np.array([np.frombuffer(v, "<f4") for _, v in found], np.float32).reshape(len(found), BUCKETS)
    return LanguageModel(weights.astype(np.float32), [lang for lang, _ in found], matrix)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", distance: float | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected): the language of the nearest centroid and its cosine.

    A null text, one without a letter, and any text if nothing has been learned are ``und`` with score 0. ``rejected`` tells that the
    nearest centroid is farther than ``distance`` (DISTANCE by default); with a ``distance`` given, such texts are ``und`` too. Only the text decides.
    """
    limit = DISTANCE if distance is None else distance

    def run(batches):
        for batch in small_batches(batches, "_text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            names, scores = [], []
            for at in range(0, len(texts), BLOCK):
                counts, lettered = gram_counts(texts[at:at + BLOCK])
                if not model.names:
                    lettered[:] = False
                    best, cosine = np.zeros(len(counts), np.int64), np.zeros(len(counts))
                else:
                    best, cosine = model.nearest(counts)
                far = 1 - cosine > limit
                names += [(UNKNOWN if distance is not None and f else model.names[b]) if x else UNKNOWN for x, b, f in zip(lettered.tolist(), best.tolist(), far.tolist())]
                scores.append(np.where(lettered, cosine, 0.0))
            score = np.concatenate(scores).astype(float) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(1 - score > limit)], [id_col, "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)[id_col]
    out = map_arrow(docs.select(id_col, F.col(text_col).cast("string").alias("_text")), run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
    return out.select(id_col, F.coalesce(bucket_of(id_col) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Learn from the rows outside bucket 1 and predict every row."""
    return predict(docs, fit(docs, id_col, text_col, lang_col, **how), id_col, text_col)
