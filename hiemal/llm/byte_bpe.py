"""Byte-level BPE encoding and decoding without a regular expression."""
from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, ragged, small_batches, worker_cache
from .ragged import PieceTable

# What a character means for the split: letter, number, other, white space before white space or the end of the text,
# a blank before something else, other white space before something else, an apostrophe that opens a suffix of one or
# of two letters, start of a text.
LETTER, NUMBER, OTHER, WHITE, BLANK, LAST, SHORT, LONG, START = range(9)
# What the piece is in that a character ends up in: runs, a blank that waits for its run, letters of a suffix still to
# come (two, one), nothing (the next character opens a piece).
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, WAITS, TWO, ONE, FREE = range(8)
STATES = 8
OPENS = 8  # set beside the next state where the character opens a piece


def transitions() -> bytes:
    """Table of 256 entries: [symbol * 8 + state] -> next state, plus OPENS where a piece begins."""
    table = bytearray(range(256))
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, WHITE: IN_WHITE}
    for symbol in range(9):
        for state in range(STATES):
            if symbol == START:
                to = FREE
            elif state in (TWO, ONE):
                to = ONE if state == TWO else FREE
            elif symbol in run and state == run[symbol]:
                to = state
            elif symbol in (SHORT, LONG) and state in (IN_OTHER, WAITS):
                to = IN_OTHER
            elif symbol in (LETTER, NUMBER, OTHER) and state == WAITS:
                to = run[symbol]
            else:
                to = OPENS + {**run, BLANK: WAITS, LAST: FREE, SHORT: ONE, LONG: TWO}[symbol]
            table[symbol * STATES + state] = to
    return bytes(table)


WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def codepoint_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE of every code point, by general category and the White_Space property."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    first = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        k = first.get(unicodedata.category(chr(c))[0])
        if k is not None:
            kinds[c] = k
    kinds[WHITE_SPACE] = WHITE
    return kinds


def symbols(codes: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Symbol of every character; ``starts`` are the places of the line feeds that were put before each text."""
    sym = kinds[codes]
    white = sym == WHITE
    before_text = np.zeros(len(codes), bool)
    np.logical_and(white[:-1], ~white[1:], out=before_text[:-1])
    sym[before_text] = np.where(codes[before_text] == 32, BLANK, LAST)
    at = np.flatnonzero(codes == 39)
    if len(at):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = padded[at + 1], padded[at + 2]
        sym[at[np.isin(a, [ord(x) for x in "stmd"])]] = SHORT
        sym[at[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]] = LONG
    sym[starts] = START
    return sym


def scan(sym: np.ndarray, table: bytes, block: int = 128) -> np.ndarray:
    """Boolean: which characters open a piece, by a scan over composed transition functions.

    The symbols are cut into blocks. First every block is reduced to one function (state before -> state after), all
    blocks at once, column by column; composition is associative, so the functions of the blocks are scanned by
    doubling; then each block runs again from its true first state.
    """
    n = len(sym)
    blocks = -(-n // block)
    cols = np.full(blocks * block, START, np.uint8)
    cols[:n] = sym
    cols = np.ascontiguousarray(cols.reshape(blocks, block).T) * STATES
    step = lambda state, col: np.frombuffer((state + col).tobytes().translate(table), np.uint8)
    ends = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], blocks, 1)
    for col in cols:
        ends = (step(ends, col) & (STATES - 1)).reshape(ends.shape)
        if len(ends) > 1 and (ends == ends[0]).all():
            ends = ends[:1]  # every function is constant by now and stays so
    if len(ends) > 1:
        fn, d = np.ascontiguousarray(ends.T), 1
        while d < blocks:
            fn = np.concatenate([fn[:d], np.take_along_axis(fn[d:], fn[:-d], 1)])
            d *= 2
        ends = fn[:, FREE][None]
    state = np.concatenate([[FREE], ends[0, :-1]]).astype(np.uint8)
    out = np.empty_like(cols)
    for i, col in enumerate(cols):
        out[i] = state = step(state, col)
        state = state & (STATES - 1)
    return np.ascontiguousarray(out.T).reshape(-1)[:n] >= OPENS


def split_pieces(texts: list[str], tools: tuple) -> tuple[list[str], np.ndarray]:
    """All pieces of all texts in order, and the number of pieces of each text."""
    kinds, table = tools
    joined = "".join(["\n" + t for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(lengths) - lengths
    opens = scan(symbols(codes, starts, kinds), table)
    places = np.flatnonzero(opens)
    counts = np.diff(np.searchsorted(places, np.append(starts, len(codes))))
    stops = np.append(places[1:], len(codes))
    last = np.cumsum(counts)[counts > 0] - 1
    stops[last] = (starts + lengths)[counts > 0]
    return [joined[a:b] for a, b in zip(places.tolist(), stops.tolist())], counts


class Merges:
    """Ranks of a byte-level BPE: joins the two neighbours whose bytes together have the lowest rank, leftmost first."""

    def __init__(self, ranks: dict[bytes, int], long_piece: int = 48):
        self.ranks, self.long_piece = ranks, long_piece
        self.none = max(ranks.values()) + 1
        self.bytes = [b""] * self.none
        for token, i in ranks.items():
            self.bytes[i] = token
        self.size = np.zeros(self.none, np.int64)
        self.size[list(ranks.values())] = [len(b) for b in ranks]
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, i))
        pairs.sort()
        self.bits = max(20, (4 * len(pairs)).bit_length())
        keys, joined = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        # open addressing: a slot holds a pair and its rank, the next slots are tried in turn
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int64)
        slot, left = self.slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.key[slot[left]] == -1
            took, first = np.unique(slot[left][free], return_index=True)
            who = left[free][first]
            self.key[took], self.rank[took] = keys[who], joined[who]
            left = np.setdiff1d(left, who, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair joined, ``none`` where the bytes together are no token."""
        keys = a << 32 | b
        slot = self.slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.rank[slot], self.none)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode_many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for distinct pieces; equally long pieces are merged side by side, a merge each a step."""
        raw = [p.encode() for p in pieces]
        found: list = [None] * len(raw)
        by_length: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            whole = self.ranks.get(b)
            if whole is not None:
                found[i] = (whole,)
            elif len(b) > self.long_piece:
                found[i] = self.merge_long(b)
            else:
                by_length.setdefault(len(b), []).append(i)
        for length, at in by_length.items():
            ids = self.single[np.frombuffer(b"".join([raw[i] for i in at]), np.uint8)].reshape(-1, length)
            ranks = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, length - 1)
            rows = np.array(at)
            while len(rows):
                where = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), where]
                over = best == self.none
                for r, line in zip(rows[over].tolist(), ids[over].tolist()):
                    found[r] = line
                go = ~over
                rows, ids, ranks, where, best = rows[go], ids[go], ranks[go], where[go], best[go]
                if not len(rows):
                    break
                width, each = ids.shape[1], np.arange(len(rows))
                ids[each, where] = best
                keep = np.ones(ids.shape, bool)
                keep[each, where + 1] = False
                ids = ids[keep].reshape(-1, width - 1)
                if width == 2:
                    for r, line in zip(rows.tolist(), ids.tolist()):
                        found[r] = line
                    break
                # the pair that was joined leaves; the pairs on both sides of it are new
                keep = np.ones(ranks.shape, bool)
                keep[each, where] = False
                ranks = ranks[keep].reshape(-1, width - 2)
                left, right = where > 0, where < width - 2
                ranks[each[left], where[left] - 1] = self.pair_rank(ids[each[left], where[left] - 1], best[left])
                ranks[each[right], where[right]] = self.pair_rank(best[right], ids[each[right], where[right] + 1])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((x for line in found for x in line), np.int32, int(counts.sum())), counts

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece of any length: linked neighbours and a heap of (rank, place)."""
        n = len(piece)
        start, after, before = list(range(n)), [*range(1, n), -1], list(range(-1, n - 1))
        stop = list(range(1, n + 1))
        rank_at: list[int | None] = [None] * n
        heap: list[tuple[int, int]] = []

        def offer(i):
            j = after[i]
            rank_at[i] = None if j < 0 else self.ranks.get(piece[start[i]:stop[j]])
            if rank_at[i] is not None:
                heapq.heappush(heap, (rank_at[i], i))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i = heapq.heappop(heap)
            if rank_at[i] != r or stop[i] == 0:
                continue
            j = after[i]
            stop[i], after[i], stop[j] = stop[j], after[j], 0
            rank_at[j] = None
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i >= 0:
            out.append(self.ranks[piece[start[i]:stop[i]]])
            i = after[i]
        return out


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, a blank, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id; decoding needs no more."""
    with open(path, "rb") as f:
        ranks = load_ranks(f.read())
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


class Coder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.merges = Merges(load_ranks(f.read()))
        self.split = codepoint_classes(), transitions()
        self.table = PieceTable(self.merges.encode_many)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        pieces, per_text = split_pieces(texts, self.split)
        ids, per_piece = self.table.encode(pieces)
        ends = np.concatenate([[0], np.cumsum(per_piece)])
        edges = ends[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(edges)

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """First byte of each token in its text."""
        size = self.merges.size[ids]
        ends = np.cumsum(size)
        first = np.cumsum(counts) - counts
        base = np.concatenate([[0], ends])[first]
        return (ends - size - np.repeat(base, counts)).astype(np.int32)


def decode_lists(lists: pa.ListArray, names: list[bytes]) -> list[bytes | None]:
    """The bytes of each list of ids."""
    flat, at = lists.values.to_numpy().tolist(), lists.offsets.to_numpy().tolist()
    known = lists.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [b"".join([names[i] for i in flat[a:b]]) if k else None for a, b, k in zip(at, at[1:], known)]


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids, offsets): token ids of every whole text and the byte of the text at which each token starts.

    With ``decoded`` the bytes that the ids stand for follow, taken from the ids by the same task: a second pass of ``decode``
    behind this one would keep twice as many Python workers. Null and empty texts give empty lists. ``ranks_path`` is
    read by the workers (a file that is installed on every machine).
    """
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>, offsets array<int>" + ", decoded binary" * decoded

    def run(batches):
        coder = worker_cache(("byte_bpe", ranks_path), lambda: Coder(ranks_path))
        for batch in small_batches(batches, "_text", 1 << 20):
            ids, counts = coder.encode(batch.column(1).to_pylist())
            columns = [batch.column(0), ragged(ids, counts), ragged(coder.offsets(ids, counts), counts)]
            if decoded:
                columns.append(pa.array(decode_lists(columns[1], coder.merges.bytes), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "offsets", "decoded"][:len(columns)])

    return map_arrow(docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")), run, schema)


def decode(encoded: DataFrame, ranks_path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` of ``encoded`` and ``decoded``: the bytes of each list of ids (null: null; an unknown id is an error)."""
    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "decoded binary"])

    def run(batches):
        names = worker_cache(("token_bytes", ranks_path), lambda: token_bytes(ranks_path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(decode_lists(batch.column(len(keep)), names), pa.binary())], [*keep, "decoded"])

    return map_arrow(encoded.select(*keep, F.col(ids_col).alias("_ids")), run, schema)
