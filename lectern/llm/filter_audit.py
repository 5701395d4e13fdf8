"""How a set of filters interact, whatever their order: every order's removals from one table of joint failures.

For each part of the documents the number of rows that fail all filters of a subset is summed up as a product of flags, for
all 32 subsets (and so for good and for toxic rows). Everything else follows from these by inclusion and exclusion: survivors
of a set of filters are a signed sum over its subsets (the Möbius inverse), a filter's removals after others are a difference
of survivors, unique failures a signed sum over the supersets, and the Shapley value a share of each subset's Harsanyi
dividend, which is a joint count with a sign. No order is applied to documents, so a part is one row until orders are listed.

Filter E (a text that a smaller doc_id has as well) needs no join of all copies: all rows count as failing it, then the rows
of each text's least doc_id are taken back. Texts meet by SHA-256 digests. Equal rows are counted before they meet others, so a
hot text or a row that repeats itself is a few rows for each task.

Defined cases: null text counts as empty, null source as the empty string; rows without doc_id never fail E, make no other
row fail it and have no labels; repeated rows of the least doc_id all pass E; a document is good (toxic) if any of its labels says
so; null labels say nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written
from .mix import BLANKS

#: The filters by letter, in the order of their bits.
LETTERS = "ABCDE"
#: Least words, least share of distinct words and most capitals (in hundredths), and symbols of filters A to D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
_SUBSETS = range(1 << len(LETTERS))
_WEIGHTS = ("all", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D as flags of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(f"[^{BLANKS}]+"), F.lit(0))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic, n): how many documents have these flags; of several rows with equal flags the n add up
    (some are negative: documents that are not E after all)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), *(c.alias(x) for x, c in text_failures(text).items()))
    shared = ["part", *"ABCD"]
    rows = written(base.groupBy("doc_id", "digest", *shared).agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1)).alias("good"), F.max((F.col("toxic") == 1)).alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    least = rows.groupBy(F.col("digest").alias("text")).agg(F.min("doc_id").alias("least"))
    # Both joins are by unique keys; rows without doc_id stay out of them, as they are all first and unlabelled.
    named = rows.where(F.col("doc_id").isNotNull()).join(known, F.col("doc_id") == F.col("of"), "left").join(least, (F.col("digest") == F.col("text")) & (F.col("doc_id") == F.col("least")), "left")
    counted = [*shared, "good", "toxic", "first"]
    named = named.select(*shared, flag("good"), flag("toxic"), F.col("least").isNotNull().alias("first"), "n")
    nameless = rows.where(F.col("doc_id").isNull()).select(*shared, F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(True).alias("first"), "n")
    return named.unionByName(nameless).groupBy(*counted).agg(F.sum("n").alias("n")).withColumn("E", ~F.col("first"))


def joint_failures(flags: DataFrame) -> DataFrame:
    """(part, all, good, toxic): for each part arrays over the 32 subsets, how many rows fail every filter of the subset. A subset
    is the number that its letters' bits make."""
    bit = {x: F.col(x).cast("long") for x in LETTERS}

    def product(subset: int) -> Column:
        out = F.col("n")
        for k, x in enumerate(LETTERS):
            out = out * bit[x] if subset >> k & 1 else out
        return out

    weight = {"all": F.lit(1), "good": F.col("good").cast("long"), "toxic": F.col("toxic").cast("long")}
    return flags.groupBy("part").agg(*(F.array(*(F.sum(product(s) * weight[w]) for s in _SUBSETS)).alias(w) for w in _WEIGHTS))


def _signed(joint: str, of: str, term: str) -> str:
    """SQL for the sum of the joint counts of the subsets ``s`` that ``of`` picks, each times ``term``."""
    return f"aggregate(sequence(0, {len(_SUBSETS) - 1}), 0L, (total, s) -> total + if({of}, {joint}[s] * ({term}), 0L))"


def survivors(joint: str) -> Column:
    """Array over sets of filters: rows that pass all of the set, from the column of joint failures (Möbius inversion)."""
    return F.expr(f"transform(sequence(0, {len(_SUBSETS) - 1}), p -> {_signed(joint, '(s & p) = s', '1 - 2 * (bit_count(s) % 2)')})")


def single_values(joint: str, orders: int) -> tuple[Column, Column, Column]:
    """Arrays over filters: rows that fail it, rows that fail nothing else, and its removals over all ``orders``: the dividend of a
    subset (its joint count, with a sign) is shared equally by its filters. ``orders`` is divisible by all sizes of subsets."""
    each = lambda body: F.expr(f"transform(sequence(0, {len(LETTERS) - 1}), k -> {body})")
    holds, sign = "(s & shiftleft(1, k)) > 0", "(2 * (bit_count(s) % 2) - 1)"
    return each(f"{joint}[shiftleft(1, k)]"), each(_signed(joint, holds, sign)), each(_signed(joint, holds, f"{sign} * ({orders} div bit_count(s))"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each part,
    order of the filters and step of that order."""
    orders = ["".join(p) for p in permutations(LETTERS)]
    joint = written(joint_failures(flagged(docs, labels, id_col, text_col, part_col)), "audit-joint")
    failing, alone, shares = single_values("all", len(orders))
    left = joint.select("part", failing.alias("failing"), alone.alias("alone"), shares.alias("shares"), *(survivors(w).alias(w) for w in _WEIGHTS))
    steps = left.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.expr(f"sequence(1, {len(LETTERS)})")))
    at = F.expr(f"instr('{LETTERS}', substring(filter_order, step, 1)) - 1")
    before = sum((F.expr(f"if(instr(substring(filter_order, 1, step - 1), '{x}') > 0, {1 << k}, 0)") for k, x in enumerate(LETTERS)), F.lit(0))
    steps = steps.withColumn("at", at).withColumn("before", before).withColumn("after", F.expr("before + shiftleft(1, at)"))
    lost = {w: F.col(w)[F.col("before")] - F.col(w)[F.col("after")] for w in _WEIGHTS}
    return steps.select("part", "filter_order", "step", F.col("all")[F.col("after")].alias("kept"), lost["all"].alias("removed"), (F.col("failing")[F.col("at")] - lost["all"]).alias("redundant"),
                        F.col("alone")[F.col("at")].alias("unique_fails"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), F.col("shares")[F.col("at")].alias("shapley"))
