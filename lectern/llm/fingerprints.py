"""Merkle trees of documents with DataFrame operations only: equal roots mean equal texts, differing branches show where.

A text is split at blank lines into sections, these at line ends into paragraphs, these after the ends of clauses (and after
at most ``LEAF_CHARS`` code points) into leaves. Each leaf has a digest and its length, each paragraph a digest of its leaves, each
section one of its paragraphs, and the root is one of the sections. Splits lose nothing, so unequal texts have unequal roots
(up to collisions of MD5 below and SHA-256 at the root). The likeness of two trees is the share of code points that lie in
distinct leaves of both; two trees are compared from the root down, and branches of equal digest are not entered.

Neighbours in the order of ids come from a narrow table: ids and keys of rows are sorted by ranges, borders of ranges are joined,
and then rows move to groups of ``GROUP_ROWS`` neighbours, the first of each group also to the group before it. So each text
is shuffled twice, and no task sees more than its range or its group.

Defined cases: null text counts as empty; the tree of an empty text has one section of one paragraph without leaves, and its
likeness to another empty one is 1; ids descend with null ones last; rows of one doc_id with unlike texts follow each other by
key; equal rows follow each other, so all but one of them have their own text as next; a single document is its own next;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import written

#: Code points of a leaf before the end of its clause.
LEAF_CHARS = 64
#: Rows that a group of neighbours holds; a power of two.
GROUP_ROWS = 64
#: Rows of a range of ids, and equal rows that one task makes.
RANGE_ROWS, COPIES = 100_000, 100_000


def leaves(text: Column) -> Column:
    """Sections of paragraphs of leaves: each leaf is its digest, a colon and its length."""
    pattern = F.lit(f"[^.!?,;]{{1,{LEAF_CHARS}}}[.!?,;]*|[.!?,;]+")
    leaf = lambda x: F.concat(F.md5(x), F.lit(":"), F.length(x))
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, pattern, F.lit(0)), leaf)
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), paragraph))


def with_tree(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Adds the tree of a text that is not null: ``name`` with fields root, sections, paragraphs and leaves."""
    digest = lambda parts: F.md5(F.array_join(parts, ","))
    f = F.col(name)
    df = df.withColumn(name, F.struct(leaves(F.col(text_col)).alias("leaves")))
    df = df.withColumn(name, F.struct(f["leaves"].alias("leaves"), F.transform(f["leaves"], lambda s: F.transform(s, digest)).alias("paragraphs")))
    df = df.withColumn(name, F.struct(F.transform(f["paragraphs"], digest).alias("sections"), f["paragraphs"].alias("paragraphs"), f["leaves"].alias("leaves")))
    return df.withColumn(name, F.struct(F.sha2(F.array_join(f["sections"], ","), 256).alias("root"), f["sections"].alias("sections"), f["paragraphs"].alias("paragraphs"), f["leaves"].alias("leaves")))


def _distinct(tree: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(tree["leaves"])))


def _length(leaf_set: Column) -> Column:
    return F.aggregate(leaf_set, F.lit(0).cast("long"), lambda n, x: n + F.substring_index(x, ":", -1).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: twice the code points of the distinct leaves that both trees have, of those that each has."""
    x, y = _distinct(a), _distinct(b)
    whole = F.greatest(_length(x) + _length(y), F.lit(1))  # line ends alone have no leaves
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(2.0 * _length(F.array_intersect(x, y)) / whole)


def differing(a: Column, b: Column) -> Column:
    """Places of paragraphs that differ, as structs of section and paragraph from 1 on, found from the root down."""
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    most = lambda x, y: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.coalesce(F.size(y), F.lit(0)))
    unlike = lambda x, y: lambda k: ~F.get(x, k - 1).eqNullSafe(F.get(y, k - 1))

    def within(s: Column) -> Column:
        x, y = F.get(a["paragraphs"], s - 1), F.get(b["paragraphs"], s - 1)
        # An absent section has no size, which is as good as none.
        n = F.greatest(F.when(x.isNull(), 0).otherwise(F.size(x)), F.when(y.isNull(), 0).otherwise(F.size(y)))
        return F.transform(F.filter(upto(n), unlike(x, y)), lambda p: F.struct(s.alias("section"), p.alias("paragraph")))

    sections = F.filter(upto(most(a["sections"], b["sections"])), unlike(a["sections"], b["sections"]))
    return F.when(a["root"] == b["root"], F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.flatten(F.transform(sections, within)))


def neighbours(narrow: DataFrame, ranges: int) -> DataFrame:
    """The rows (of doc_id and row_key) with pos, the place of each in the order of descending ids (ascending, with gaps between
    ranges), and before, the pos of the row before it; before the first row stands the last."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("row_key")]
    # Within a partition these numbers count up by one; the partition is in their high bits.
    ordered = written(narrow.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "prints-order")
    part = F.shiftright("pos", 33)
    # As many rows as ranges.
    ends = ordered.groupBy(part.alias("part")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    w = W.orderBy("part")
    ends = ends.select("first", F.coalesce(F.lag("last").over(w), F.max("last").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("end_before"))
    out = ordered.join(ends, F.col("pos") == F.col("first"), "left")
    return out.select(*ordered.columns, F.coalesce("end_before", F.col("pos") - 1).alias("before"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text, copies): the distinct rows, each with the text of the next one by descending id; a row that
    repeats itself has copies more than one, all but one of which are followed by themselves."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # One key that is never null, so that grouping and joining by it share one shuffle of the texts.
    base = base.withColumn("row_key", F.unhex(F.sha2(F.concat(F.coalesce(F.concat(F.lit("1"), F.col("doc_id")), F.lit("0")), F.lit(":"), F.col("text")), 256)))
    narrow = written(base.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "prints")
    link = written(neighbours(narrow, max(1, -(-narrow.count() // RANGE_ROWS))), "prints-links")
    one = base.groupBy("row_key").agg(F.first("text").alias("text"))
    group = lambda c: F.expr(f"{c} div {GROUP_ROWS}")
    own = F.struct(group("pos").alias("group"), F.lit(True).alias("own"))
    ahead = F.struct(group("before").alias("group"), F.lit(False).alias("own"))
    first = (group("before") != group("pos")) | (F.col("before") >= F.col("pos"))
    dealt = one.join(link, "row_key").select("doc_id", "text", "copies", "pos", F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own))).alias("to"))
    w = W.partitionBy("group").orderBy(F.col("own").desc(), "pos")
    dealt = dealt.select("doc_id", "text", "copies", "pos", "to.*").withColumn("next_text", F.lead("text").over(w))
    return dealt.where("own").select("doc_id", "text", "next_text", "copies")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many first code points of the other one, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - half), following.substr(F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits (how many paragraphs of the
    edited text differ, by place) and first_edit (the first of them, as section:paragraph; empty where none)."""
    rows = with_next(docs, id_col, text_col)
    # All copies but the last have themselves as next.
    last = F.struct(F.col("next_text").alias("next_text"), F.lit(1).cast("long").alias("rows"))
    same = F.struct(F.col("text").alias("next_text"), (F.col("copies") - 1).alias("rows"))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("copies") > 1, F.array(last, same)).otherwise(F.array(last))).alias("to")).select("doc_id", "text", "to.*")
    rows = rows.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    for c, name in (("text", "own"), ("edited_text", "other"), ("next_text", "next")):
        rows = with_tree(rows, c, name)
    own, other, following = F.col("own"), F.col("other"), F.col("next")
    rows = rows.withColumn("places", differing(own, other))
    start = F.get("places", 0)
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), own["root"].alias("fingerprint"), other["root"].alias("edited_fingerprint"),
                       likeness(own, other).alias("near_edited"), likeness(own, following).alias("near_next"), F.size("places").cast("long").alias("edits"),
                       F.coalesce(F.concat_ws(":", start["section"], start["paragraph"]), F.lit("")).alias("first_edit"), "rows")
    batches = F.explode(F.expr(f"sequence(0L, (rows - 1) div {COPIES})"))
    rows = rows.withColumn("batch", batches).withColumn("copy", F.explode(F.expr(f"sequence(1L, least(rows - batch * {COPIES}, {COPIES}))")))
    return rows.drop("rows", "batch", "copy")
