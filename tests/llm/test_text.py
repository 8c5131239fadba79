"""SimHash, byte-level BPE, token files and repeated passages against brute force."""
import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from hiemal.llm import byte_bpe, passages, simhash, token_files
from hiemal.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def doc(i, text, source="a", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


def words(rng, n, prefix="w"):
    return [f"{prefix}{rng.integers(0, 10 ** 6)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, odd characters."""
    rng = np.random.default_rng(0)
    long = " ".join(words(rng, 30_000))
    rows = [doc(0, "the cat sat on the mat"), doc(1, ""), doc(2, None), doc(3, " \t\n "), doc(4, long), doc(5, "the cat sat on the mat"), doc(5, "the cat sat on the mat"),
            doc(6, "The CAT sat on the mat"), doc(7, "one two"), doc(8, "'s don't  WE'LL　x\x1cy İΣ. <|endoftext|> 12½"), doc(None, "no id"), doc(9, long + " end"), (10, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def tiktoken_encoding():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---------------------------------------------------------------- byte-level BPE
@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(RANKS), tiktoken_encoding()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aabst'' \n\tréevVldm1²,!日\u0085\x1c😀ǅ\x00")), max_size=40), min_size=1, max_size=8))
def test_pieces_as_the_pattern(texts):
    import regex
    kinds = test_pieces_as_the_pattern.__dict__.setdefault("kinds", byte_bpe.codepoint_classes())
    pieces, counts = byte_bpe.split_pieces(texts, (kinds, byte_bpe.transitions()))
    want = [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    assert pieces == [p for w in want for p in w] and counts.tolist() == [len(w) for w in want]


def test_scan_composes_blocks():
    """Any block length finds the same borders, also where functions don't become constant."""
    rng = np.random.default_rng(1)
    table = byte_bpe.transitions()
    sym = np.concatenate([[byte_bpe.START], rng.integers(0, 8, 3000), np.full(300, byte_bpe.OTHER)]).astype(np.uint8)
    state, want = byte_bpe.FREE, []
    for s in sym.tolist():
        got = table[s * byte_bpe.STATES + state]
        want.append(got >= byte_bpe.OPENS)
        state = got & (byte_bpe.STATES - 1)
    for block in (1, 2, 3, 64, 5000):
        assert byte_bpe.scan(sym, table, block).tolist() == want


def test_ids_as_tiktoken(coder):
    own, enc = coder
    rng = random.Random(3)
    texts = ["", "a" * 3000, " " * 500, "####" * 200, "xyz'" * 300] + ["".join(rng.choice("aabst' \nréevldm12,!日") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    ids, counts = own.encode(texts)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == enc.encode_ordinary(t)


def test_bpe_frames(spark, odd_docs, coder):
    got = byte_bpe.encode(odd_docs, RANKS)
    back = byte_bpe.decode(got, RANKS, ["doc_id", "ids", "offsets"]).collect()
    want = sorted((str(r.doc_id), r.text or "") for r in odd_docs.collect())
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back) == want
    for r in back:
        sizes = [len(coder[1].decode_single_token_bytes(i)) for i in r.ids]
        assert r.offsets == [sum(sizes[:k]) for k in range(len(sizes))] if len(sizes) < 500 else r.offsets[-1] + sizes[-1] == len(bytes(r.decoded))
    assert byte_bpe.encode(odd_docs.limit(0), RANKS).count() == 0


def test_op10(spark, tmp_path, odd_docs):
    import __spark_entry__ as entry
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    enc, h = tiktoken_encoding(), lambda b: hashlib.sha256(b).hexdigest()
    want = [(r.doc_id, len(i := enc.encode_ordinary(r.text or "")), h(" ".join(map(str, i)).encode()), h((r.text or "").encode())) for r in odd_docs.collect()]
    assert sorted(map(tuple, entry.queries()["op10_byte_level_bpe"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- token files
def test_op3(spark, tmp_path, odd_docs):
    import __spark_entry__ as entry
    from tokenizers import Tokenizer
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    t, start, want = Tokenizer.from_file(WORDS), 0, []
    for r in sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = list(map(tuple, entry.queries()["op3_token_parquet"](spark, str(tmp_path)).collect()))
    assert sorted(got, key=lambda r: r[1]) == want


def test_added_tokens_as_the_library():
    """Added tokens in every case, alone, glued to words, cut short and repeated: only their exact spelling is one."""
    from tokenizers import Tokenizer
    library, own = Tokenizer.from_file(WORDS), token_files.WordCoder(WORDS)
    names = [t.content for t in library.get_added_tokens_decoder().values()]
    forms = [f(n) for n in names for f in (str, str.upper, str.title, str.swapcase, lambda n: n[:-1], lambda n: n[1:], lambda n: n + n, lambda n: n.replace("|", " | "))]
    rng = random.Random(5)
    rest = ["word", "W\u00d6RT", " ", "\n", "'s", "12", "e\u0301", "\u0301", "\u03a3", "<|", "|>", "!?"]
    texts = [*forms, *(a + f + b for f in forms for a in ("", "ab", "A ", "9") for b in ("", "ab", " Z", "."))]
    texts += ["".join(rng.choice(forms + rest) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    ids, counts = own.encode(texts, None)
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_token_file_format(spark, tmp_path, odd_docs):
    import glob
    import pyarrow.parquet as pq
    rows = odd_docs.where("doc_id is not null")
    token_files.write_tokens(rows, f"{tmp_path}/t", WORDS, page_rows=2)
    one = token_files.read_tokens(spark, f"{tmp_path}/t", (4, 5))
    assert sorted(r.doc_id for r in one.select("doc_id").collect()) == [4, 5, 5]
    plan = one.select("doc_id", "n_tokens")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(doc_id,4)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    encodings, indexed = set(), False
    for f in glob.glob(f"{tmp_path}/t/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                encodings |= {(col.path_in_schema.split(".")[0], e) for e in col.encodings}
                indexed |= col.has_column_index
    assert ("ids", "RLE_DICTIONARY") in encodings and ("n_tokens", "DELTA_BINARY_PACKED") in encodings and indexed
    empty = f"{tmp_path}/e"
    token_files.write_tokens(rows.limit(0), empty, WORDS)
    assert token_files.places(token_files.read_tokens(spark, empty)).count() == 0


# ---------------------------------------------------------------- SimHash
def brute_components(marks, radius):
    up = list(range(len(marks)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(marks))]


@pytest.mark.parametrize("bucket", [4, 512])
def test_near_links(spark, bucket):
    """All levels of splitting find the same components as all pairs, dense groups included."""
    rng = np.random.default_rng(5)
    marks = {0}
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63)) * 2
        marks.add(x)
        for _ in range(12):
            x ^= 1 << int(rng.integers(64))
            if rng.random() < .7:
                x ^= 1 << int(rng.integers(64))
            if rng.random() < .3:
                x ^= 1 << int(rng.integers(64))
            marks.add(x)
    marks = sorted(marks)
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint bigint")
    got = {r.node: r.root for r in components(simhash.near_links(df, 2, bucket)).collect()}
    want = brute_components(marks, 2)
    groups = lambda names: sorted(sorted(s) for s in {n: [i for i in range(len(marks)) if names[i] == n] for n in names}.values())
    assert groups([got.get(s, s) for s in signed]) == groups(want)
    assert 1 < len(set(want)) < len(marks)


def test_masks_cover_every_pair():
    rng = np.random.default_rng(2)
    for level in (1, 2, 3):
        masks = simhash.bit_masks(2, level)
        for _ in range(50):
            d = 0
            for b in rng.integers(0, 64, 2):
                d |= 1 << int(b)
            assert any(not d & m for m in masks)
    assert all(64 - m.bit_count() <= 14 for m in simhash.bit_masks(2, 4))


def test_simhash_documents(spark, odd_docs):
    import xxhash
    rows = simhash.simhash_components(odd_docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    h = lambda s: xxhash.xxh64_intdigest(s.encode(), 42)
    assert len(rows) == odd_docs.count()
    assert by[7][0].fingerprint == format(h("one two"), "016x") and by[1][0].fingerprint == "0" * 16
    assert {by[i][0].component_id for i in (1, 2, 3, 10)} == {1}  # no words: fingerprint zero, linked like any other
    assert {r.component_id for i in (0, 5, 6) for r in by[i]} == {0} and by[4][0].component_id == 4
    text = "the cat sat on the mat".split()
    hs = [h(" ".join(text[i:i + 3])) for i in range(4)]
    assert by[0][0].fingerprint == format(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > 4), "016x")
    kept = simhash.drop_near_copies(odd_docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 4, 7, 8] and sum(r.doc_id is None for r in kept) == 1
    assert simhash.simhash_components(odd_docs.limit(0)).count() == 0


def test_components(spark):
    """A long chain, a hub and a clique; loops, repeats and nulls don't matter."""
    chain = [(i, i + 1) for i in range(100, 220)]
    hub = [(1, 1000 + i) for i in range(300)]
    clique = [(a, b) for a in range(10, 15) for b in range(10, 15)]
    df = spark.createDataFrame(chain + hub + clique + clique + [(7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).collect()}
    assert len({got[i] for i in range(100, 221)}) == 1 and len({got[1], *(got[1000 + i] for i in range(300))}) == 1
    assert len({got[i] for i in range(10, 15)}) == 1 and len(set(got.values())) == 3 and 7 not in got
    assert components(df.limit(0)).count() == 0


def test_salted_lookup(spark):
    from hiemal.llm.common import salted_lookup
    probe = spark.createDataFrame([(i, 1 if i < 600 else i % 7) for i in range(1000)] + [(2000, None)], "id bigint, k int")
    table = spark.createDataFrame([(1, "hot"), (2, "two")], "k int, v string")
    a, b = (sorted(map(tuple, salted_lookup(probe, "k", table, "id", hot_rows=n).select("id", "k", "v").collect())) for n in (50, 10 ** 6))
    assert a == b and len(a) == 1001


def test_ranked(spark):
    from pyspark.sql import functions as F
    from hiemal.llm.common import ranked
    rng = np.random.default_rng(4)
    rows = [(int(i), None if rng.random() < .1 else ("hot" if rng.random() < .5 else f"s{rng.integers(4)}"), int(rng.integers(1, 50))) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "id bigint, g string, x bigint").repartition(7), [F.col("x").asc(), F.col("id").asc()], ["g"], {"x": "before"}).collect()
    for g in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        have = sorted((r for r in got if r.g == g), key=lambda r: r._rank)
        assert [r.id for r in have] == [r[0] for r in mine] and [r._rank for r in have] == list(range(len(mine))) and {r._rows for r in have} == {len(mine)}
        assert [r.before for r in have] == [sum(m[2] for m in mine[:i]) for i in range(len(mine))]


# ---------------------------------------------------------------- repeated passages
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(2, 8))
def test_compact_windows_part_all_stretches(values, width):
    """Every stretch of width or more that crosses no zero lies in exactly one window, with its minimum at the centre."""
    v = np.array([0, *values, 0], np.uint64)
    seen = set()
    for left, centre, right in zip(*passages.compact_windows(v, width)):
        for i in range(left, centre + 1):
            for j in range(max(centre, i + width - 1), right + 1):
                assert (i, j) not in seen and v[i:j + 1].min() == v[centre] > 0
                seen.add((i, j))
    assert seen == {(i, j) for i in range(len(v)) for j in range(i + width - 1, len(v)) if v[i:j + 1].min() > 0}


def exact_repeats(texts, n):
    """{doc: words covered by runs of n words that an earlier document has too}, by all pairs of runs."""
    out, seen = {}, {}
    for i, t in sorted(texts.items()):
        w = t.lower().split()
        hit = set()
        runs = [tuple(w[k:k + n]) for k in range(len(w) - n + 1)]
        for k, r in enumerate(runs):
            if r in seen:
                hit |= set(range(k, k + n))
        for r in runs:
            seen.setdefault(r, i)
        out[i] = hit
    return out


def test_repeated_passages(spark):
    rng = np.random.default_rng(8)
    shared = [words(rng, n) for n in (51, 60, 200)]
    texts = {}
    for i in range(60):
        w = words(rng, int(rng.integers(0, 150)))
        if i % 3 == 0:
            p = shared[i // 3 % 3]
            at = int(rng.integers(0, len(w) + 1))
            w = w[:at] + p + w[at:]
        texts[i] = " ".join(w)
    texts[60] = " ".join(words(rng, 80) + shared[0][:40])  # too short a repeat
    near = list(shared[2])
    near[100] = "changed"
    texts[61] = " ".join(words(rng, 30) + near)  # one word of 200 differs
    df = spark.createDataFrame([doc(i, t) for i, t in texts.items()] + [doc(70, None), doc(71, ""), doc(None, texts[0])], DOCS).repartition(5)
    got = passages.repeated_passages(df).collect()
    cover = {}
    for r in got:
        assert r.other_id < r.doc_id and r.similarity >= .8
        a, b = texts[r.doc_id].split()[r.start_word:r.stop_word], texts[r.other_id].split()[r.other_start:r.other_stop]
        assert len(set(a) & set(b)) / len(set(a) | set(b)) > .7
        cover.setdefault(r.doc_id, set()).update(range(r.start_word, r.stop_word))
    want = exact_repeats({i: t for i, t in texts.items() if i < 61}, 51)
    for i, w in want.items():
        assert w <= cover.get(i, set()) and (w or i not in cover)
    assert len(cover[61]) == 200 and 60 not in cover
    left = {r.doc_id: r for r in passages.drop_repeated_passages(df).collect() if r.doc_id is not None}
    assert left[3].text == texts[3] and left[0].text == texts[0] and left[70].text is None and left[71].text == ""
    assert "w" + left[9].text.strip()[1:] == " ".join(x for k, x in enumerate(texts[9].split()) if k not in cover[9]) and left[9].n_chars == len(left[9].text)
    assert passages.drop_repeated_passages(df).columns == df.columns
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_phrase_of_many_documents(spark):
    """Repeats that lie mostly in a phrase of 40, 45 or 48 words of many documents, their holders far apart in id order."""
    rng = np.random.default_rng(21)
    texts = {}
    for k, (n, more) in enumerate([(40, 12), (45, 10), (48, 6)]):
        phrase, tails = words(rng, n), [words(rng, more) for _ in range(150)]
        for i in range(600):
            tail = tails[i % 150] if i % 2 else words(rng, more)
            texts[1000 * k + i] = " ".join(words(rng, 8) + (phrase + tail if i % 4 == 1 else tail + phrase) + words(rng, 8))
    df = spark.createDataFrame([doc(i, t) for i, t in texts.items()], DOCS).repartition(6)
    cover = {}
    for r in passages.repeated_passages(df).collect():
        cover.setdefault(r.doc_id, set()).update(range(r.start_word, r.stop_word))
    want = {i: w for i, w in exact_repeats(texts, 50).items() if w}
    assert len(want) > 300 and sum(not w <= cover.get(i, set()) for i, w in want.items()) == 0


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    rng = np.random.default_rng(31)
    one, two, clean = words(rng, 90), words(rng, 70), words(rng, 81)
    rows = [doc(1, " ".join(one)), doc(2, " ".join(words(rng, 9) + one)), doc(2, " ".join(clean)), doc(2, " ".join(clean)), doc(3, " ".join(clean)), doc(4, " ".join(two)), doc(4, " ".join(two + words(rng, 60)))]
    clashing = DOCS + ", _cut int, _spans string, _row int, _digest string, doc struct<a:int>, `_doc` int, c1 string"
    df = spark.createDataFrame([r + (1, "s", 2, "d", (3,), 4, "c") for r in rows], clashing)
    left = sorted((r.doc_id, len(r.text.split()), r._cut, r._spans, r._row, r.doc.a, r.c1) for r in passages.drop_repeated_passages(df).collect())
    same = (1, "s", 2, 3, "c")
    assert left in ([(1, 90, *same), (2, 9, *same), (2, 81, *same), (2, 81, *same), (4, 60, *same), (4, 70, *same)], [(1, 90, *same), (2, 9, *same), (2, 81, *same), (2, 81, *same), (4, 130, *same)])
    found = sorted((r.doc_id, r.start_word, r.stop_word, r.other_id) for r in passages.repeated_passages(df).collect() if r.doc_id < 4)
    assert found == [(2, 9, 99, 1), (3, 0, 81, 2)]


def test_pairs_at_once_as_one_by_one():
    rng = np.random.default_rng(33)
    pairs = []
    for _ in range(300):
        x = rng.integers(1, 1 << 62, int(rng.integers(0, 200))).astype(np.uint64)
        y = rng.integers(1, 1 << 62, int(rng.integers(0, 200))).astype(np.uint64)
        for _ in range(int(rng.integers(0, 4))):
            if len(x) and len(y):
                a, b, n = int(rng.integers(len(x))), int(rng.integers(len(y))), int(rng.integers(1, 120))
                n = min(n, len(x) - a, len(y) - b)
                y[b:b + n] = x[a:a + n]
        if len(x) > 9:
            x[rng.integers(0, len(x), 4)] = x[0]
        pairs.append((x, y))
    got = passages.shared_in_pairs(pairs, 46, .8)
    assert got == [passages.shared_passages(x, y, 46, .8) if len(x) and len(y) else [] for x, y in pairs] and sum(map(len, got)) > 20
    texts = ["", "one", "a b c d e", "A  b\tc d e f", " ".join(map(str, range(999)))]
    assert all((a == passages.shingle_hashes(t)).all() and len(a) == len(passages.shingle_hashes(t)) for t, a in zip(texts, passages.many_shingle_hashes(texts)))


def test_runs_join_from_both_sides():
    x = np.arange(1, 107, dtype=np.uint64)
    y = x.copy()
    y[21:26] = y[41:46] = np.arange(1000, 1005, dtype=np.uint64)
    (s, e, p, q, j), = passages.shared_passages(x, y, 46, .8)
    assert (s, e, p, q) == (0, 106, 0, 106) and j > .8


def test_passages_of_a_very_long_text(spark):
    rng = np.random.default_rng(34)
    long, near, far = words(rng, 60_000), words(rng, 60), words(rng, 55)
    df = spark.createDataFrame([doc(1, " ".join(near + words(rng, 5000) + far)), doc(2, " ".join(long[:30_000] + near + long[30_000:] + far))], DOCS)
    got = sorted((r.doc_id, r.start_word, r.stop_word, r.other_start, r.other_stop) for r in passages.repeated_passages(df).collect())
    assert got == [(2, 30_000, 30_060, 0, 60), (2, 60_060, 60_115, 5060, 5115)]


@pytest.mark.parametrize("length,changes", [(56, 1), (100, 2), (150, 4)])
def test_passages_with_changed_words(spark, length, changes):
    """Recall of passages at a similarity of 0.8 to 0.85 against all planted ones."""
    rng = np.random.default_rng(35)
    texts = {}
    for i in range(200):
        p = words(rng, length)
        q = list(p)
        for c in range(changes):
            q[(c + 1) * length // (changes + 1)] = f"changed{i}x{c}"
        texts[2 * i], texts[2 * i + 1] = words(rng, 20) + p + words(rng, 20), words(rng, 25) + q + words(rng, 15)
    df = spark.createDataFrame([doc(i, " ".join(t)) for i, t in texts.items()], DOCS).repartition(6)
    found = {r.doc_id for r in passages.repeated_passages(df).collect() if r.other_id == r.doc_id - 1}
    assert len(found) >= .9 * 200


def crowded_fixture(spark):
    """72 texts with a phrase of 42 words; the later 16 of 32 hold a passage of 52 words round it, one word of them changed, that one of the others holds."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    phrase = word(42)
    tails = [word(9) for _ in range(16)]
    rows = [(i, " ".join(word(30) + phrase + word(1) + (tails[i % 100] if i % 100 < 16 else word(9)) + word(30))) for i in [*range(16), *range(20, 60), *range(100, 116)]]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_changed_words_round_a_phrase_of_many_documents(spark):
    """Groups that stay crowded after the split: links that the first and the previous rows don't make."""
    found = {r.doc_id for r in passages.repeated_passages(crowded_fixture(spark)).collect() if r.other_id == r.doc_id - 100 and r.stop_word - r.start_word >= 50}
    assert found == set(range(100, 116))


def test_open_words_beside_a_passage_of_many_documents(spark):
    """A phrase beside a passage of 150 words, one word of it changed in each text: too far from it for a passage of any two texts. Passages that are known don't come again with it."""
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    phrase, passage = word(9), word(150)
    texts = [phrase + word(9) + passage[:30 + i] + word(1) + passage[31 + i:] for i in range(70)]
    found = passages.repeated_passages(spark.createDataFrame([doc(i, " ".join(t)) for i, t in enumerate(texts)], DOCS).repartition(3)).collect()
    cover = {}
    for r in found:
        cover.setdefault(r.doc_id, set()).update(range(r.start_word, r.stop_word))
    assert all(set(range(18, 168)) <= cover[i] for i in range(1, 70)) and len(found) == len({(r.doc_id, r.other_id) for r in found})


def test_rare_places_meet_every_passage():
    """A text that holds none of the places has no passage of 12 through a place asked for."""
    rng, asked = np.random.default_rng(6), 0
    for _ in range(150):
        holders = rng.integers(1, 60, int(rng.integers(12, 40))) * 1
        holders[rng.random(len(holders)) < .05] = 0
        use = (rng.random(len(holders)) < .2) & (holders > 0)
        rare = passages.rare_places(holders, use, 12, 8 / 9)
        for _ in range(6):
            hit = (holders > 0) & ~rare & (rng.random(len(holders)) < .97)
            assert not (passages.dense(hit, 12, 8 / 9) & use & hit).any()
        asked += bool(use.any() and rare.sum() < (holders > 0).sum())
    assert asked > 100


def test_dense_stretches():
    rng = np.random.default_rng(5)
    for part in (.3, .8, .95):
        hit, want = rng.random(60) < part, np.zeros(60, bool)
        for i, j in itertools.combinations(range(61), 2):
            if j - i >= 12 and hit[i:j].sum() >= 8 / 9 * (j - i) - 1e-9:
                want[i:j] = True
        assert (passages.dense(hit, 12, 8 / 9) == want).all()


def test_whole_copies_go(spark):
    rng = np.random.default_rng(9)
    t = " ".join(words(rng, 90))
    df = spark.createDataFrame([(i, t, "en", "a", len(t), "x", 1) for i in range(40)], DOCS + ", _text string, key int")
    out = passages.drop_repeated_passages(df).collect()
    assert [r.doc_id for r in out] == [0] and out[0].text == t


def test_cut_words():
    assert passages.cut_words("a b  c\nd e", [(1, 3)]) == "a d e" and passages.cut_words("a b c", [(0, 2), (1, 3)]) == "" and passages.cut_words("a b c", [(0, 1), (2, 3)]) == "b "


def test_words_between_are_slices(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        text = "".join(rng.choice(["ab", "É", "c", " ", "  ", "\t", "\n\x0b", "\x0c\r", "\u00a0", "\x1c"], int(rng.integers(0, 40))))
        rows.append((text, int(rng.integers(0, 12)), int(rng.integers(12, 24))))
    df = spark.createDataFrame(rows, "t string, s int, e int")
    got = df.select("t", "s", "e", passages.words_between(passages.spaced(df.t), df.s, df.e).alias("part")).collect()
    assert [r.part.encode().split() for r in got] == [r.t.encode().split()[r.s:r.e] for r in got]
    plan = passages.verified(spark.createDataFrame([(1, 0, 0, 9, 0, 9)], "a bigint, b bigint, la int, ra int, lb int, rb int"),
                             spark.createDataFrame([(0, "x"), (1, "y")], "_id bigint, _text string"), 46, .8)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan  # whole texts aren't cut into words for each pair
