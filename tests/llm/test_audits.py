"""Filter audit and source divergence against direct counting."""
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hiemal.llm import divergence, filter_audit

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, mask int, part string, _first bigint, n bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def made(rng, n):
    """Texts that fail every mix of filters, with copies, nulls, repeated and missing ids, odd white space and clashing columns."""
    words = ["alpha", "Beta", "été", "GAMMA", "x1y", "x y", "\u001fz", "日本", "o'neil", "ẞig"]
    rows = []
    for i in range(n):
        k = rng.choice([0, 1, 3, 40, 199, 200, 260])
        pool = words if rng.random() < .5 else [f"w{j}v" for j in range(400)]
        text = rng.choice([" ", "\n", "\t ", "\u000b"]).join(rng.choice(pool) for _ in range(k)) + rng.choice(["", "", "$", " | "])
        rows.append([i, rng.choice([text, text.lower(), None] if rng.random() < .2 else [text]), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None, "é", "z"])])
    for _ in range(n // 2):
        r = rng.choice(rows)
        rows.append([rng.choice([None, r[0], rng.randrange(2 * n)]), r[1], rng.choice(["en", "fr"]), r[3]])
    rows.append([7_000_000, " ".join(["long"] * 60_000), "en", "a"])
    return [tuple(r) + (1, 31, "x", 5, 9) for r in rows]


def failures(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        yield i, lang or "", "".join(f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t),
                                                               i is not None and i > first.get(t, i))) if bad)


def test_filter_audit_as_walking_every_order(spark):
    rows = made(random.Random(1), 300)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (10 ** 9, 1, 1)]
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    want = defaultdict(lambda: [0] * 6)
    shapley = Counter()
    for i, part, fails in failures(rows):
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for s, f in enumerate(order, 1):
                row = want[part, order, s]
                if f in fails:
                    row[3] += fails == f
                    if gone:
                        row[2] += 1
                    else:
                        row[1] += 1
                        row[4] += i in good
                        row[5] += i in toxic
                        shapley[part, f] += 1
                        gone = True
                row[0] += not gone
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * len({p for p, _, _ in want})
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == {
        (p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in want.items()}


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(docs, labels).count() == 0
    one = filter_audit.filter_audit(spark.createDataFrame([(None, None, None, None, 0, 0, "", 0, 0)], DOCS), labels).where("filter_order = 'EDCBA'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed) for r in one] == [("", 1, 0)] * 4 + [("", 0, 1)]


def test_removal_intervals_cover_each_order_once():
    for letters in ("A", "ABC", "ABCD"):
        orders = list(itertools.permutations(range(len(letters))))
        for mask in range(1, 1 << len(letters)):
            seen = Counter((r, step) for m, step, a, b in filter_audit.removal_intervals(letters) if m == mask for r in range(a, b + 1))
            assert seen == Counter((r, next(s for s, f in enumerate(p, 1) if mask >> f & 1)) for r, p in enumerate(orders))


def divergences(rows, least=3, top=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source, *_ in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")
        terms = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in terms]
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    p = {}
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = [g for g in counts if g[0] == lang]
        whole = sum((counts[g] for g in groups), Counter())
        for key, c in [((lang, None), whole)] + [(g, counts[g]) for g in groups]:
            n = sum(c[t] for t in kept)
            p[key] = {t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        for g in groups:
            pairs = [(h[1], sum((p[g][t] - p[h][t]) ** 2 // p[h][t] for t in kept)) for h in groups if h != g]
            terms = [(t, (p[g][t] - q) ** 2 // q) for t, q in p[lang, None].items() if counts[g][t] and p[g][t] > q]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                out += [(*g, part, i, v, k) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"chunk_rows": 7, "side": 2, "top": 5}])
def test_divergence_as_direct_sums(spark, how):
    rows = made(random.Random(2), 240)
    got = divergence.source_divergence(spark.createDataFrame(rows, DOCS).repartition(6), **how).collect()
    assert sorted(map(tuple, got)) == divergences(rows, top=how.get("top", 200))


def test_divergence_without_terms(spark):
    row = lambda i, t, lang, s: (i, t, lang, s, 0, 0, "", 0, 0)
    rows = [row(1, None, None, None), row(1, "12 34", "", "b"), row(2, "one two", "x", "a")]
    got = divergence.source_divergence(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_skyband_as_counting_dominators():
    rng = np.random.default_rng(3)
    for n, k in ((0, 3), (1, 1), (50, 1), (700, 3), (1500, 20)):
        count, base = rng.integers(1, 30, n), rng.integers(1, 60, n)
        over = [((count[:i] >= count[i]) & (base[:i] <= base[i])).sum() for i in range(n)]
        assert divergence.skyband(count, base, k).tolist() == [i for i in range(n) if over[i] < k]


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    big = 9 * 10 ** 15
    df = spark.createDataFrame([(big, big + 5, 7)], "c bigint, n bigint, v bigint")
    assert df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10 ** 9 * (big + 1) // (big + 12)
