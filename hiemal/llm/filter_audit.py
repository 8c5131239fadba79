"""What each filter removes under every order of the filters: difference arrays over the Lehmer ranks of the orders."""
from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage_table
from .common import salted_lookup

#: Separators of words; a word is a longest stretch without one.
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "ABCDE"
MIN_WORDS = 200


def text_failures(text: Column) -> list[tuple[str, Column]]:
    """(filter, fails) of the filters that look at one whole text, which must not be null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [("A", count < MIN_WORDS), ("B", 100 * distinct.cast("long") < 50 * count.cast("long")), ("C", 100 * capitals.cast("long") > 3 * F.length(text).cast("long")),
            ("D", text.rlike(r"[#$%&*|]"))]


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask): bit i of the mask is set if the document fails filter i of LETTERS.

    Texts are whole; a null text is an empty one, a null part the empty string. A document fails E if a smaller id has the same
    text anywhere in the table: equal texts meet as SHA-256 digests with the smallest id of each, which partial
    aggregation finds inside the map tasks, and only digests that come more than once are looked up. Rows that repeat
    id and text don't make each other fail; a row without an id never fails E and makes no other row fail.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), text.alias("_text"))
    fails = text_failures(F.col("_text"))
    bits = [F.when(condition, F.lit(1 << LETTERS.index(name))).otherwise(F.lit(0)) for name, condition in fails]
    rows = stage_table(rows.select("_id", "_part", F.sha2("_text", 256).alias("_digest"), sum(bits[1:], bits[0]).alias("_mask")))
    first = rows.groupBy("_digest").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").select("_digest", "_first")
    found = salted_lookup(rows, "_digest", first, "_id")
    again = F.when(F.col("_id") > F.col("_first"), F.lit(1 << LETTERS.index("E"))).otherwise(F.lit(0))
    return found.select(F.col("_id").alias(id_col), F.col("_part").alias("part"), (F.col("_mask") + again).alias("mask"))


def removal_intervals(letters: str = LETTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, first, last): the ranks of the orders in which a document with that mask of failures goes at that step.

    Orders are ranked lexicographically. Orders that begin alike follow each other, so each beginning of passed filters that
    ends with a failed one is one interval of ranks; its start is the beginning's Lehmer code in the factorial number system.
    """
    n, out = len(letters), []
    for mask in range(1, 1 << n):
        for step in range(1, n + 1):
            for begin in permutations(range(n), step):
                if mask >> begin[-1] & 1 and not any(mask >> f & 1 for f in begin[:-1]):
                    rank = sum(sum(g < f and g not in begin[:i] for g in range(n)) * factorial(n - 1 - i) for i, f in enumerate(begin))
                    out.append((mask, step, rank, rank + factorial(n - step) - 1))
    return out


def order_audit(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id", letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part of
    ``masks``, every order of the filters and every step of it, zeros included.

    ``masks`` has (id, part, mask). Documents are reduced to counts per part, mask and label before anything else; each count is added to
    a difference array at the first rank of its interval and taken off behind the last one, and prefix sums over the
    ranks give what goes at each step of each order. No window holds more rows than there are orders. A document is good or toxic if
    any of its labels says 1; labels of unknown ids, null ids and null labels say nothing. An empty table has no part and no row.
    """
    spark, n = masks.sparkSession, len(letters)
    known = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    known = known.where("_good = 1 or _toxic = 1")
    marked = masks.join(known, masks[id_col] == known["_id"], "left")
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long"))
    counts = stage_table(marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), one("_good").alias("good"), one("_toxic").alias("toxic")))
    totals = counts.groupBy("part").agg(F.sum("n").alias("_all"), *[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << f)) != 0, F.col("n")).otherwise(F.lit(0).cast("long"))).alias(f"_fails_{f}") for f in range(n)],
                                        *[F.sum(F.when(F.col("mask") == 1 << f, F.col("n")).otherwise(F.lit(0).cast("long"))).alias(f"_only_{f}") for f in range(n)])
    # three fixed tables, a few thousand rows for five filters whatever the input
    spans = spark.createDataFrame(removal_intervals(letters), "mask int, step int, first int, last int")
    orders = [(r, "".join(letters[f] for f in p), s + 1, f) for r, p in enumerate(permutations(range(n))) for s, f in enumerate(p)]
    orders = spark.createDataFrame(orders, "rank int, filter_order string, step int, _filter int")
    ends = counts.join(F.broadcast(spans), "mask").select("part", "step", F.inline(F.array(
        F.struct(F.col("first").alias("rank"), F.lit(1).alias("_sign")), F.struct((F.col("last") + 1).alias("rank"), F.lit(-1).alias("_sign")))), "n", "good", "toxic")
    steps = ends.groupBy("part", "step", "rank").agg(*[F.sum(F.col(c) * F.col("_sign")).alias(f"_d_{c}") for c in ("n", "good", "toxic")])
    grid = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank")).join(F.broadcast(orders), "rank")
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    lost = grid.join(steps, ["part", "step", "rank"], "left").select("*", *[F.coalesce(F.sum(f"_d_{c}").over(upto), F.lit(0).cast("long")).alias(name)
                                                                           for c, name in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))])
    of_filter = lambda stem: F.element_at(F.array(*[F.col(f"_{stem}_{f}") for f in range(n)]), F.col("_filter") + 1)
    along = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return lost.select("part", "filter_order", "step", (F.col("_all") - F.sum("removed").over(along)).alias("kept"), "removed", (of_filter("fails") - F.col("removed")).alias("redundant"),
                       of_filter("only").alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "_filter")).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``order_audit`` of the five filters over whole documents."""
    return order_audit(failure_masks(docs, id_col, text_col, part_col), labels, id_col)
