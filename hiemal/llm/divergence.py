"""How the sources of a language differ in their words: smoothed term shares, exact divergences, top terms by skyband."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage_table
from .common import gather_ranges, map_arrow, small_batches

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Bytes of terms: letters of ASCII, lower-cased, and all of UTF-8 beyond it; every other byte separates.
TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c > 0x7F else 0x20 for c in range(256))
#: Distinct terms that a task holds before it sends its counts on.
HELD_TERMS = 600_000
#: Counts of one group of terms that are compared in one task, and sources on each side of it.
CHUNK_ROWS = 50_000
SIDE_SOURCES = 256
PAIRS_AT_ONCE = 1 << 20


class Codes(dict):
    """Numbers in order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class TermCounts:
    """Occurrences of terms in groups and documents that hold them, for the texts a task has seen since it last sent them on."""

    def __init__(self):
        self.terms, self.groups = Codes(), Codes()
        self.keys, self.n, self.d = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        group = np.fromiter(map(self.groups.__getitem__, zip(langs, sources)), np.int64, len(langs))
        words, sizes = [], []
        for text in texts:
            w = text.translate(TERM_BYTES).split()
            words += w
            sizes.append(len(w))
        place = np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words))
        in_doc, n = np.unique(np.repeat(np.arange(len(texts)), sizes) << 32 | place, return_counts=True)
        keys = group[in_doc >> 32] << 32 | in_doc & 0xFFFFFFFF
        self.merge(np.concatenate([self.keys, keys]), np.concatenate([self.n, n]), np.concatenate([self.d, np.ones(len(n), np.int64)]))

    def merge(self, keys, n, d) -> None:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys = keys[first]
        self.n, self.d = (np.add.reduceat(v[order], first) if len(first) else v for v in (n, d))

    def batches(self):
        """One row for each group and term, and one with the empty term for each group."""
        terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for at in range(0, len(self.keys), 50_000):
            part = slice(at, at + 50_000)
            group, term = pa.array(self.keys[part] >> 32), pa.array(self.keys[part] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), terms.take(term), pa.array(self.n[part]), pa.array(self.d[part])], COUNTED)
        none = pa.array(np.zeros(len(langs), np.int64))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.array([""] * len(langs), pa.string()), none, none], COUNTED)


COUNTED = ["lang", "source", "term", "count", "docs"]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, count, docs): occurrences of each term in each group and the documents that hold it.

    Each row counts as a document, whatever its id. A group without any term has one row with the empty term, so that no group is lost. Tasks
    count in memory and send their sums on when they hold HELD_TERMS of them, so a term that every document holds leaves a
    task as one row for each group.
    """
    def run(batches):
        held = TermCounts()
        for batch in small_batches(batches, "_text", 4 << 20):
            held.add(*(c.to_pylist() for c in batch.columns))
            if len(held.keys) > HELD_TERMS:
                yield from held.batches()
                held = TermCounts()
        yield from held.batches()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("_text"))
    local = map_arrow(rows, run, "lang string, source string, term string, count bigint, docs bigint")
    return local.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


#: Counts below this stay within 64 bits when multiplied by SCALE.
SMALL = 9_000_000_000


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)) in whole numbers of any size; at most SCALE + 1. Null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    div = lambda x, y: F.call_function("div", x, y)
    below = F.nullif(total + terms, F.lit(0).cast("long"))
    plain = div((count + 1) * F.lit(SCALE).cast("long"), below)
    return F.lit(1).cast("long") + F.when(count < SMALL, plain).otherwise(div(wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(below)).cast("long"))


def shares(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """``share`` of arrays of 64-bit integers; there are terms."""
    if not len(count) or count.max() < SMALL:
        return 1 + (count + 1) * SCALE // (total + terms)
    return np.array([1 + (c + 1) * SCALE // (n + v) for c, n, v in zip(count.tolist(), total.tolist(), terms.tolist())], np.int64)


def divergence(p, q):
    """floor((p - q) ** 2 / q) of arrays of whole numbers below 2 ** 31; signed, as it is added and taken off."""
    d = p - q
    return ((d * d).astype(np.uint64) // q.astype(np.uint64)).astype(np.int64)


def skyband(count: np.ndarray, base: np.ndarray, k: int = TOP) -> np.ndarray:
    """Places of the terms, given in ascending order, that fewer than ``k`` others dominate.

    A term dominates the later ones that have no larger count in the group and no smaller one in the language. Later rows can't dominate
    earlier ones, and dominance is transitive, so comparing a row with the members found so far is enough: of ``k``
    dominators or more, ``k`` are members themselves.
    """
    n = len(count)
    cell = np.lexsort((np.arange(n), base, count))  # of rows with equal counts only the first k can stay
    new = np.ones(n, bool)
    new[1:] = (count[cell][1:] != count[cell][:-1]) | (base[cell][1:] != base[cell][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    left = np.sort(cell[np.arange(n) - first < k])
    held_c, held_b, members = np.zeros(0, count.dtype), np.zeros(0, base.dtype), []
    for at in range(0, len(left), 256):
        part = left[at:at + 256]
        c, b = count[part], base[part]
        over = ((held_c >= c[:, None]) & (held_b <= b[:, None])).sum(1) if len(held_c) else np.zeros(len(part), np.int64)
        inside = np.tril((c >= c[:, None]) & (b <= b[:, None]), -1)
        keep = over + inside.sum(1) < k  # dominators among members and earlier rows of this part
        part = part[keep]
        members.append(part)
        held_c, held_b = np.concatenate([held_c, count[part]]), np.concatenate([held_b, base[part]])
    return np.concatenate(members) if members else np.zeros(0, np.int64)


BAND_ROWS = 50_000
BAND = "lang string, source string, term string, count bigint, base bigint"


def skybands(rows: DataFrame, k: int = TOP) -> DataFrame:
    """The rows of every partition that belong to the ``k``-skyband of their (lang, source); ``rows`` are sorted by both and the term.

    Rows of a group are held until they are BAND_ROWS more than twice its members so far, then reduced to these.
    """
    names = [x.split()[0] for x in BAND.split(", ")]

    def run(batches):
        held, rows, members, key = [], 0, 0, None

        def reduced():
            table = pa.Table.from_batches(held).combine_chunks()
            return table.take(pa.array(skyband(table["count"].to_numpy(), table["base"].to_numpy(), k))).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, source = batch.column(0), batch.column(1)
            change = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.not_equal(source.slice(1), source.slice(0, len(lang) - 1)))
            cuts = [0, *(np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1).tolist(), len(lang)]
            for a, b in zip(cuts, cuts[1:]):
                if key != (lang[a].as_py(), source[a].as_py()):
                    if held:
                        yield from reduced()
                    held, rows, members, key = [], 0, 0, (lang[a].as_py(), source[a].as_py())
                held.append(batch.slice(a, b - a))
                rows += b - a
                if rows > BAND_ROWS + 2 * members:
                    held = reduced()
                    rows = members = sum(x.num_rows for x in held)
        if held:
            yield from reduced()

    return map_arrow(rows.select(*names), run, BAND)


def top_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms of each group whose share in the group is above that in its language.

    The value grows with the count in the group and falls with that in the language where the group's share is larger, and ties go
    by UTF-8, so what ``top`` others dominate in all three can't be among the first. Partitions reduce their rows to skybands,
    16 parts of each group merge theirs, and what is left is ranked exactly; of each part only the first ``top`` rows meet.
    """
    key = ["lang", "source"]
    over = kept.join(groups.select(*key, "total", "lang_total", "terms"), key).where("count > 0")
    p, q = share(F.col("count"), F.col("total"), F.col("terms")), share(F.col("base"), F.col("lang_total"), F.col("terms"))
    over = over.where(p > q).select(*key, "term", "count", "base")
    band = skybands(over.sortWithinPartitions(*key, "term"), top)
    band = skybands(band.repartition(*key, F.pmod(F.xxhash64("term"), F.lit(16))).sortWithinPartitions(*key, "term"), top)
    last = band.join(groups.select(*key, "total", "lang_total", "terms"), key).select(*key, F.col("term").alias("item"), p.alias("_p"), q.alias("_q"))
    value = F.expr("((_p - _q) * (_p - _q)) div _q")
    order = Window.partitionBy(*key).orderBy(F.col("value").desc(), "item")
    return last.select(*key, "item", value.alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def codes(column) -> tuple[list, np.ndarray]:
    """Distinct values of an Arrow column and each row's place among them."""
    coded = column.combine_chunks().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def one_sided(at, zero, p, n, grid) -> None:
    """Add to ``grid`` what the terms of each source add to its pairs, the other side at its zero share; ``n`` terms have the share ``p``."""
    nothing = divergence(zero[:, None], zero[None, :])
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(len(zero) + 1))
    for k in range(len(zero)):
        m = order[edges[k]:edges[k + 1]]
        value, times = p[m][:, None], n[m][:, None]
        grid[k] += ((divergence(value, zero[None, :]) - nothing[[k]]) * times).sum(0)
        grid[:, k] += ((divergence(zero[None, :], value) - nothing[:, k][None, :]) * times).sum(0)


def common_terms(at, zero, p, terms, grid) -> None:
    """Add to ``grid`` what terms of two sources add beyond that: each row meets each other row of its term, PAIRS_AT_ONCE at a time."""
    order = np.argsort(terms, kind="stable")
    at, p, terms = at[order], p[order], terms[order]
    first, last = np.searchsorted(terms, terms, "left"), np.searchsorted(terms, terms, "right")
    total = np.cumsum(last - first)
    start = 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        n = (last - first)[start:stop]
        a, b = np.repeat(np.arange(start, stop), n), gather_ranges(first[start:stop], n)
        x, y, x0, y0 = p[a], p[b], zero[at[a]], zero[at[b]]
        np.add.at(grid, (at[a], at[b]), divergence(x, y) - divergence(x, y0) - divergence(x0, y) + divergence(x0, y0))
        start = stop


def compare(table: pa.Table) -> pa.Table:
    """Sums of the pairs of sources of two blocks: by histograms of counts (chunk -1) or over the common terms of one chunk."""
    names, at = codes(table["source"])
    block, total, terms = (np.zeros(len(names), np.int64) for _ in range(3))
    for v, c in ((block, "_block"), (total, "total"), (terms, "terms")):
        v[at] = table[c].to_numpy()
    count, n = table["count"].to_numpy(), table["n"].to_numpy()
    zero, p = shares(np.zeros(len(names), np.int64), total, terms), shares(count, total[at], terms[at])
    grid = np.zeros((len(names), len(names)), np.int64)
    if table["_chunk"][0].as_py() < 0:
        one_sided(at, zero, p, np.where(count > 0, n, 0), grid)
    else:
        common_terms(at, zero, p, table["term"].to_numpy(), grid)
    apart = table["_i"][0].as_py() != table["_j"][0].as_py()  # pairs inside a block have a task of their own
    i, j = np.nonzero((grid != 0) & ~np.eye(len(names), dtype=bool) & ((block[:, None] != block[None, :]) | (not apart)))
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(i), pa.string()), "source": pa.array([names[k] for k in i.tolist()], pa.string()),
                     "item": pa.array([names[k] for k in j.tolist()], pa.string()), "extra": pa.array(grid[i, j])})


def pair_sums(kept: DataFrame, groups: DataFrame, chunk_rows: int = CHUNK_ROWS, side: int = SIDE_SOURCES) -> DataFrame:
    """(lang, source, item, extra): what the terms that source or item hold add to the divergence of a pair beyond V times that of a
    term which neither holds.

    With x, y the shares of a term in both groups and 0 the share of a term that comes nowhere, f(x, y) - f(0, 0) is the
    sum of f(x, 0) - f(0, 0), of f(0, y) - f(0, 0) and, for common terms, of f(x, y) - f(x, 0) - f(0, y) + f(0, 0). The first two
    follow from how many terms of a group have which count; only sources that share a term are compared term by term.
    Terms are dealt to chunks of about ``chunk_rows`` counts and the sources of a large language to blocks of
    about ``side``: a task compares two blocks over one chunk and returns one sum for each pair of sources.
    """
    key = ["lang", "source"]
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks, chunks = -(-most // side), -(-(kept.count() or 1) // chunk_rows)
    facts = groups.where("terms > 0").select(*key, "total", "terms", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("_block"))
    chunk = F.pmod(F.xxhash64("term_id"), F.lit(chunks)).cast("int")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = kept.where("count > 0").select(*key, "count", one.alias("n"), F.col("term_id").alias("term"), chunk.alias("_chunk"))
    counts = kept.where("count > 0").groupBy(*key, "count").agg(F.count(F.lit(1)).alias("n")).unionByName(facts.select(*key, none.alias("count"), none.alias("n")))
    rows = rows.unionByName(counts.select("*", none.alias("term"), F.lit(-1).alias("_chunk"))).join(facts, key)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")).select(
        "*", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))
    parts = rows.groupBy("lang", "_chunk", "_i", "_j").applyInArrow(compare, "lang string, source string, item string, extra bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("extra").alias("extra"))


def source_pairs(kept: DataFrame, groups: DataFrame, **how) -> DataFrame:
    """(lang, source, item, value, rank): the divergence of each group from each other source of its language, all ranks.

    A language without kept terms has divergence 0 between all its sources.
    """
    key = ["lang", "source"]
    zero = share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))
    facts = groups.select(*key, "terms", zero.alias("zero"))
    both = facts.withColumnRenamed("zero", "_p").join(facts.select("lang", F.col("source").alias("item"), F.col("zero").alias("_q")), "lang").where("source <> item")
    both = both.join(pair_sums(kept, groups, **how), ["lang", "source", "item"], "left")
    value = F.when(F.col("terms") > 0, F.expr("terms * (((_p - _q) * (_p - _q)) div _q)") + F.coalesce("extra", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    order = Window.partitionBy(*key).orderBy(F.col("value").desc(), "item")
    return both.select(*key, "item", value.alias("value")).withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP,
                      chunk_rows: int = CHUNK_ROWS, side: int = SIDE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (each other source of the language) and ``term`` (the first ``top`` terms).

    Null text, language and source are the empty string. A language keeps the terms of at least ``least_docs`` of its rows; each row is
    a document. Shares and divergences are whole numbers, computed exactly; every group that occurs takes part, without terms too. An empty
    table gives no row.
    """
    every = term_counts(docs, text_col, lang_col, source_col)
    of_term = Window.partitionBy("lang", "term")  # one row per source
    every = every.repartition("lang", "term").withColumn("_m", F.monotonically_increasing_id()).select(
        "lang", "source", "term", "count", F.sum("count").over(of_term).alias("base"), F.sum("docs").over(of_term).alias("_docs"), F.min("_m").over(of_term).alias("term_id"))
    every = stage_table(every.where((F.col("_docs") >= least_docs) | (F.col("term") == "")).drop("_docs"))
    kept = every.where("term <> ''")
    zero = F.lit(0).cast("long")
    of_lang = kept.groupBy("lang", "term_id").agg(F.max("base").alias("base")).groupBy("lang").agg(F.sum("base").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = every.where("term = ''").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = stage_table(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "terms")]))
    pairs = source_pairs(kept, groups, chunk_rows=chunk_rows, side=side).withColumn("part", F.lit("pair"))
    terms = top_terms(kept, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
