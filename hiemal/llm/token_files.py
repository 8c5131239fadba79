"""Token ids as Parquet files: written once in document order, read back by column and by document."""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .byte_bpe import WHITE_SPACE
from .common import map_arrow, ragged, small_batches, worker_cache
from .ragged import PieceTable

#: Columns of a token table. ``part`` and ``row`` give a document's place: parts follow each other in document order.
COLUMNS = ("part", "row", "doc_id", "n_tokens", "ids")
NOT_WHITE = re.compile("[^%s]+" % "".join(map(chr, WHITE_SPACE)))
#: White space for str.split() only, not for the tokenizer.
SPLIT_ONLY = re.compile("[\x1c-\x1f]")


#: Common marks at the end of a word, after a letter or number: the tokenizer's pieces part there in any case.
TAIL = re.compile(r"""(?<=[^\W_])([.,;:!?"()%#&*$-]+)(?=\s|$)""")


class WordCoder:
    """A tokenizer that lower-cases, drops white space and treats the stretches between it one by one.

    Each distinct stretch is encoded once, by a table of stretches over a table of words: text is lower-cased, and the marks at
    the end of a new stretch are set apart, which can't change the ids and makes more words equal. Words of letters alone
    are one piece each for the tokenizer, so many go through it in one call and are told apart by their last token,
    which ends a word. Added tokens are matched on the raw text, before it is lower-cased, and by their exact spelling; the
    stretches between them never are added tokens, whatever they look like in lower case.
    """
    END = "</w>"

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.END)]] = True
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip or not t.special for t in added.values()):
            raise ValueError("only special added tokens that are matched as they stand are supported")
        self.tokenizer.encode_special_tokens = True  # the library then reads them as ordinary text
        #: keys of added tokens in the table of pieces: with a space in front, which no stretch has
        self.added = {f" {t.content}": i for i, t in added.items()}
        self.names = [t.content for t in added.values()]
        self.marks = re.compile("|".join(map(re.escape, sorted(self.names, key=len, reverse=True)))) if self.names else None
        self.words = PieceTable(self.encode_words, 400_000)
        self.table = PieceTable(self.encode_stretches, 600_000)

    def stretches(self, text: str) -> list[str]:
        """Lower-case stretches of a text without added tokens."""
        # a capital sigma at the end of a word has a small form of its own only for str.lower()
        text = text.replace("\u03a3", "\u03c3").lower()
        return NOT_WHITE.findall(text) if SPLIT_ONLY.search(text) else text.split()

    def pieces(self, text: str) -> list[str]:
        """The stretches of a text and the keys of its added tokens, in order."""
        if not any(t in text for t in self.names):
            return self.stretches(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.stretches(text[at:m.start()])
            out.append(f" {m.group()}")
            at = m.end()
        return out + self.stretches(text[at:])

    def encode_stretches(self, stretches: list[str]):
        """Flat ids and counts of stretches from those of their parts: a word and the marks behind it."""
        parts, sizes = [], []
        for w in stretches:
            p = [w] if w[-1].isalnum() or w in self.added else TAIL.sub(r" \1", w).split(" ")
            parts += p
            sizes.append(len(p))
        ids, counts = self.words.encode(parts)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *sizes])]
        return ids, np.diff(ends)

    def encode_words(self, words: list[str]):
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        many = [w for w, p in zip(words, plain.tolist()) if p]
        joined = self.tokenizer.encode_batch_fast([" ".join(many[i:i + 1000]) for i in range(0, len(many), 1000)], add_special_tokens=False)
        flat = np.array([x for e in joined for x in e.ids], np.int32)
        last = np.flatnonzero(self.ends[flat])
        if len(last) != len(many):
            raise ValueError("the tokenizer doesn't close each word with one end token")
        counts = np.zeros(len(words), np.int64)
        counts[plain] = np.diff(np.append(-1, last))
        if plain.all():
            return flat, counts
        others = [w for w, p in zip(words, plain.tolist()) if not p]
        rest = [[self.added[w]] if w in self.added else e.ids for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False))]
        counts[~plain] = [len(x) for x in rest]
        out = np.zeros(int(counts.sum()), np.int32)
        of_plain = np.repeat(plain, counts)
        out[of_plain] = flat
        out[~of_plain] = np.array([x for line in rest for x in line], np.int32)
        return out, counts

    def encode(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each closed with ``end_id``, and the number of ids of each."""
        words, sizes = [], []
        for t in texts:
            w = self.pieces(t)
            words += w
            sizes.append(len(w))
        ids, per_word = self.table.encode(words)
        edges = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        counts = np.diff(edges)
        if end_id is None:
            return ids, counts
        out = np.full(len(ids) + len(texts), end_id, np.int32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(counts + 1) - 1] = False
        out[inside] = ids
        return out, counts + 1


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
                 row_group_bytes: int = 32 << 20, page_rows: int = 1000) -> None:
    """Encode whole texts and write them as Parquet list columns in ascending id order (null ids first, ties by text).

    The texts are range-partitioned by id before they are encoded, so text (not ids) is shuffled and each task writes one
    file of consecutive documents. Ids are dictionary encoded as long as their dictionary pays, else plain; the small
    columns are delta encoded (writer version 2). Row groups have a size bound, pages a row bound, and the page index
    that the writer adds lets a reader of few documents skip pages. Null texts are empty documents. The tokenizer has to
    treat white space as a border of tokens that belongs to none.
    """
    def run(batches):
        coder = worker_cache(("words", tokenizer_path), lambda: WordCoder(tokenizer_path))
        for batch in small_batches(batches, "_text"):
            ids, counts = coder.encode(batch.column(2).to_pylist(), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), ragged(ids, counts)], ["_m", "doc_id", "n_tokens", "ids"])

    kind = dict(docs.dtypes)[id_col]
    placed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    placed = placed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text")
    coded = map_arrow(placed.select(F.monotonically_increasing_id().alias("_m"), "doc_id", "_text"), run, f"_m bigint, doc_id {kind}, n_tokens bigint, ids array<int>")
    coded.select(F.shiftright("_m", 33).cast("int").alias("part"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "doc_id", "n_tokens", "ids").write.options(**{
        "compression": "zstd", "parquet.block.size": row_group_bytes, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "v2",
        "parquet.enable.dictionary#ids.list.element": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#row": "false",
        "parquet.enable.dictionary#n_tokens": "false"}).parquet(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: tuple | None = None) -> DataFrame:
    """The token table, or the documents of an inclusive id range: the range reaches the scan, which skips row groups and pages."""
    df = spark.read.parquet(path)
    return df if doc_ids is None else df.where(F.col("doc_id").between(*doc_ids))


def places(tokens: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(part, row, doc_id, n_tokens, start): number of ids before each document; reads only the small columns.

    ``rows``, if given, are the documents of ``tokens`` with further columns, which are kept.
    """
    small = tokens.select("part", "row", "doc_id", "n_tokens") if rows is None else rows
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row per file
    zero = F.lit(0).cast("long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("_n").over(before), zero).alias("_base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return small.join(sums, "part").withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), zero) + F.col("_base")).drop("_base")


def checksums(tokens: DataFrame) -> DataFrame:
    """(part, row, doc_id, n_tokens, ids_crc32): CRC32 of the ids of each document as little-endian unsigned 32-bit integers."""
    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            flat = np.asarray(lists.values).astype("<u4", copy=False)
            at = lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], ["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    kinds = dict(tokens.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in COLUMNS[:4]) + ", ids_crc32 bigint"
    return map_arrow(tokens.select(*COLUMNS), run, schema)
