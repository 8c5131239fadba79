"""Quality classifier and toxicity chain: parts against direct formulas, the whole by held-out accuracy."""
import zlib
from pathlib import Path

import numpy as np
import pytest

from hiemal.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = rng.integers(1, 6, 12).astype(float)
        p = np.floor(rng.uniform(0, n + 1)).clip(0, n)
        x, level = quality.isotonic(np.arange(12.0), p, n)
        assert (np.diff(level) > 0).all()
        # min-max formula
        mean = lambda a, b: p[a:b + 1].sum() / n[a:b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(sorted(set(np.round(want, 9))), level)


def test_statistics():
    s = dict(zip(quality.STATISTICS, quality.statistics_of("The The cat!! | SAT 12 on# é\nthe end.")))
    assert s["upper_words"] == 1 / 10 and s["repeated_word"] == 1 / 10 and s["pipes"] == 1 / 10 and s["exclaims"] == 1 / 10 and s["log_words"] == np.log1p(10)
    assert quality.statistics_of(" \n") == [0.0] * len(quality.STATISTICS) == quality.statistics_of("")


def bucket(i):
    return zlib.crc32(str(i).encode()) % 4


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < .7
        w = [f"{'abcdefgh'[k % 8]}{k % 89}x" for k in rng.integers(0, 10 ** 4, int(rng.integers(20, 60)))]
        if not good:
            w = [x for x in w[:10] for _ in range(6)]
        toxic = rng.random() < .3
        lang = "en" if i % 3 else "de"
        if toxic:
            w.insert(3, "vile" if lang == "en" else f"schuft{rng.integers(9)}")
        rows.append((i, " ".join(w), lang, "s", 1))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def made(spark):
    rows, labels = corpus(np.random.default_rng(1), 900)
    odd = [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, " ".join(["word"] * 50_000), "en", "s", 0), (None, "no id", "en", "s", 0), (5, rows[5][1], "en", "s", 1)]
    return spark.createDataFrame(rows + odd, DOCS).repartition(5), spark.createDataFrame(labels + [(2000, None, None), (9999, 1, 1), (None, 1, 1), (3, labels[3][1], labels[3][2])], LABELS), labels


def test_quality_learns(spark, made):
    docs, labels, truth = made
    got = quality.score_documents(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= .7) for r in got)
    held = [(by[i].predicted, y) for i, y, _ in truth if bucket(i) == 2]
    assert all(by[i].held_out == (bucket(i) == 2) for i, _, _ in truth) and np.mean([a == b for a, b in held]) > .95
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in got if r.predicted} and quality.keep_good(docs, labels).columns == docs.columns


def test_held_out_labels_are_not_used(spark, made):
    """Turning the labels of bucket 2 around changes no score."""
    docs, labels, truth = made
    turned = spark.createDataFrame([(i, 1 - q if bucket(i) == 2 else q, 1 - t if bucket(i) == 2 else t) for i, q, t in truth], LABELS)
    plain = spark.createDataFrame(truth, LABELS)
    a, b = ({r.doc_id: r.score for r in quality.score_documents(docs, x).collect()} for x in (plain, turned))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()} for x in (plain, turned))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_normal_equations_sum_over_partitions(spark, made):
    docs, labels, _ = made
    stats = quality.statistics(docs)
    one, two = (quality.fit(stats.repartition(n), labels, features=32) for n in (1, 9))
    assert np.allclose(one.centre, two.centre) and np.allclose(one.weights, two.weights, atol=1e-6)


def test_quality_without_labels(spark, made):
    docs, labels, truth = made
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i, _, _ in truth], LABELS)
    assert {round(r.score, 9) for r in quality.score_documents(docs, ones).collect()} == {1.0}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


def test_linear_model_has_no_gradient_left():
    rng = np.random.default_rng(3)
    z = toxicity.inputs(rng.integers(0, 2, (200, 5)).astype(float), np.zeros((200, 0)))
    y = (rng.random(200) < .3).astype(float)
    w = toxicity.fit_linear(z, y, 50)
    penalty = np.array([toxicity.RIDGE] * 5 + [1e-6])
    assert np.abs(z.T @ (y - toxicity.predict(z, w)) - penalty * w).max() < 1e-5


def test_chain_uses_out_of_fold_probabilities():
    """The second link sees what models that haven't seen a row say of it."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (300, 6)).astype(float)
    a, b = (x[:, 0] * (rng.random(300) < .8)), np.maximum(x[:, 0], x[:, 1]) * 1.0
    fold = np.arange(300) % toxicity.FOLDS
    model = toxicity.fit_chain(x, [("a", a), ("b", b)], fold, list(range(6)))
    out, z = np.zeros(300), toxicity.inputs(x, np.zeros((300, 0)))
    for k in range(toxicity.FOLDS):
        out[fold == k] = toxicity.predict(z[fold == k], toxicity.fit_linear(z[fold != k], a[fold != k]))
    assert np.allclose(model.weights[1], toxicity.fit_linear(toxicity.inputs(x, out[:, None]), b)) and len(model.weights[1]) == 8
    assert model.probabilities(x).shape == (300, 2)


def test_toxicity_learns(spark, made):
    docs, labels, truth = made
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count()
    assert np.mean([by[i].predicted == t for i, _, t in truth if bucket(i) == 2]) > .97
    assert [c.category for c in got[0].categories] == ["toxic:en", "toxic:de", "toxic"] and got[0].categories[-1].probability == got[0].score
    assert by[2000].predicted == by[2001].predicted == by[2002].predicted == 0


def test_toxicity_without_labels(spark, made):
    docs, labels, truth = made
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name,label,least", [("op1_quality_fourier_ridge", "quality", .97), ("op5_toxicity_chain", "toxic", .9)])
def test_held_out_accuracy(spark, name, label, least):
    import __spark_entry__ as entry
    out = entry.queries()[name](spark, SF)
    rows = out.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("predicted", label, "score").collect()
    assert len(rows) > 50 and np.mean([r[0] == r[1] for r in rows]) > least
