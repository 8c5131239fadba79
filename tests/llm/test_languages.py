"""Language identification: features against direct counting, parts against formulas, the whole by held-out accuracy."""
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from hiemal.llm import languages as lg

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, score double, _lang string, held_out int"
SOUNDS = {"aa": ["tha", "ing", "on", "ersh"], "bb": ["ungé", "sch", "ein", "öß"], "cc": ["ión", "do", "ñal", "ell"]}


def bucket(i):
    return zlib.crc32(str(i).encode()) % 3


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng, lang := rng.choice(list(SOUNDS)), rng.randint(6, 60)), lang, "s", .5, "x", 1) for i in range(600)]
    rows += [(i, text_of(rng, "aa", 20), "cc", "s", .5, "x", 1) for i in range(600, 610)]  # wrong languages
    odd = [(1000, None, "aa", None, None, None, None), (1001, "", "aa", "s", 0.0, "", 0), (1002, "12 $ \n\t", "bb", "s", 0.0, "", 0), (1003, text_of(rng, "cc", 60_000), None, "s", 0.0, "", 0),
           (None, text_of(rng, "bb", 40), "aa", "s", 0.0, "", 0), (5, rows[5][1], rows[5][2], "s", 0.0, "", 0), (1004, "日本語", None, "s", 0.0, "", 0)]
    return spark.createDataFrame(rows + odd, DOCS).repartition(5), rows


def direct(text):
    """Counts of n-grams by walking over the runs of letters."""
    out, run = Counter(), ""
    for c in text + " ":
        if c.isalpha():
            run += c.lower() if len(c.lower()) == 1 else c
        elif run:
            line = "\0" + run + "\0"
            out.update(line[i:i + n] for n in lg.SIZES for i in range(len(line) - n + 1) if line[i:i + n] != "\0")
            run = ""
    return out


def test_grams_as_direct_counts():
    texts = ["", " ", "Ab c", "été\nÉTÉ 12x", "a", "İx ßs", "\U00010400a b", "x" * 5000]
    counts, lettered = lg.gram_counts(texts)
    assert lettered.tolist() == [any(map(str.isalpha, t)) for t in texts]
    place = {}
    for t, row in zip(texts, counts):
        want = direct(t)
        assert row.sum() == sum(want.values())
        for g in want:  # one gram's own feature
            if g not in place:
                run = g.strip("\0")
                one, _ = lg.gram_counts([run])
                place[g] = set(np.flatnonzero(one[0]).tolist())
    a, b = lg.gram_counts(["ab"])[0][0], lg.gram_counts(["AB"])[0][0]
    assert (a == b).all() and a.sum() == 2 + 3 + 2  # a b, -a ab b-, -ab ab-


def test_clusters():
    rng = np.random.default_rng(2)
    base = np.eye(6)[:3]
    x = np.abs(base[rng.integers(0, 3, 300)] + rng.normal(0, .05, (300, 6)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = lg.clusters(x, 3)
    assert sorted((found @ base.T).argmax(1).tolist()) == [0, 1, 2] and np.allclose(np.linalg.norm(found, axis=1), 1)
    odd = np.concatenate([x, np.eye(6)[[5] * 4]])  # too few rows for a centroid of their own
    assert (lg.clusters(odd, 4) @ np.eye(6)[5]).max() < .5
    assert len(lg.clusters(np.repeat(x[:1], 5, 0), 4)) == 1


def test_learns(spark, made):
    docs, rows = made
    got = lg.languages(docs, per_language=100).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(by[i].held_out == (bucket(i) == 1) for i, *_ in rows) and not by[None].held_out
    assert all(by[i].lang_pred == lang for i, _, lang, *_ in rows[:600])
    assert all(by[i].lang_pred == "aa" for i in range(600, 610))
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred == "cc" and by[None].lang_pred == "bb"
    assert by[1004].lang_pred in SOUNDS and by[1004].rejected  # unlike every language
    model = lg.fit(docs, per_language=100)
    assert {r.doc_id: r.lang_pred for r in lg.predict(docs, model, distance=.8).collect()}[1004] == "und"


def test_held_out_rows_and_other_columns_are_not_used(spark, made):
    docs, rows = made
    plain = spark.createDataFrame(rows, DOCS)
    turned = spark.createDataFrame([(i, t, "zz" if bucket(i) == 1 else lang, "other", 0.1, "y", 2) for i, t, lang, *_ in rows], DOCS)
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 5)) for r in lg.languages(x, per_language=100).collect()} for x in (plain, turned))
    assert a == b


def test_frequencies_cover_all_rows(spark, made):
    docs, rows = made
    model = lg.fit(docs, per_language=10)
    known = [t for i, t, *_ in rows if bucket(i) != 1] + ([rows[5][1]] if bucket(5) != 1 else [])
    counts, _ = lg.gram_counts(known)
    assert np.allclose(model.weights, np.log((1 + len(known)) / (1 + (counts > 0).sum(0))) + 1, atol=1e-4)


def test_nothing_learned(spark, made):
    docs, _ = made
    assert {r.lang_pred for r in lg.predict(docs, lg.fit(docs.limit(0))).collect()} == {"und"}
    assert lg.languages(docs.limit(0)).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
def test_held_out_accuracy(spark):
    import __spark_entry__ as entry
    out = entry.queries()["op11_nearest_centroid_language"](spark, SF)
    rows = out.where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.lang == r.lang_pred for r in rows]) > .98
