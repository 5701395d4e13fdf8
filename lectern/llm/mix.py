"""Mixing sources to target weights with DataFrame operations only.

Each document gets a hash-random key; within its source documents are range-partitioned and sorted by it, token counts
are summed up per range and the sums are turned into distributed prefix sums, and each source is cut at its exact
budget, in whole epochs first and then in the order of the keys. Prefix sums have three levels (rows of a range, ranges of
a stretch, stretches of a source), so no task has to hold many rows or sums of one source at any size;
those over sources go through ranges of their order.

Equal rows (of doc_id, source and text) share their key. They are one row with a number of copies until the cut is known,
so a row that repeats itself is no hot range.

Defined cases: null text counts as empty (size 0, taken 0); a null source is a source of its own, after all others;
repeated rows are separate documents that share their key, in any order among themselves; rows without doc_id are documents
like others; an empty table gives no rows; other columns are ignored. Reruns agree, as keys depend on the row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import SENT_BYTES, aside, bounded, written

#: Characters that end a word, as a class for Java's and RE2's regular expressions.
BLANKS = r"\x20\x09-\x0D"
#: Weights of the sources, in code-point order and repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Rows that a range of keys should hold, and ranges of a stretch.
RANGE_ROWS, STRETCH = 256, 4096
#: Copies of a row that one task makes; sources (of SENT_BYTES in all) up to which their cuts are broadcast, after a count.
COPIES, SENT_SOURCES = 100_000, 50_000
_KEYS = 1 << 62


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``sums``, its total over all rows before in the (total) order: distributed, by ranges."""
    parted = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "mix-order")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    totals = parted.groupBy("__range").agg(*(F.sum(c).alias("__" + n) for n, c in sums.items()))
    # As many rows as partitions.
    totals = totals.select("__range", *(F.coalesce(F.sum("__" + n).over(before(W.orderBy("__range"))), F.lit(0)).alias("__" + n) for n in sums))
    inside = before(W.partitionBy("__range").orderBy(*order))
    out = parted.join(bounded(written(totals, "mix-totals")), "__range")
    return out.select(*rows.columns, *((F.col("__" + n) + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()))


def source_targets(sizes: DataFrame, share: float = 1.0, most: float = 3.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source_key, source_size) to target: ``share`` of all sizes by weight, no target above ``most`` times its source;
    the excess is dealt out again by weight until none is above.

    The fixed point is found without a loop: sources fill up in the order of cap / weight, so the k-th is full exactly if
    the level that remains after the k - 1 before it (rest of the budget / rest of the weights) reaches its ratio."""
    named = running(sizes.select("source_key", "source_size"), ["source_key"], {"place": F.lit(1)})
    s = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = running(s, ["ratio", "source_key"], {"cap_before": F.col("cap"), "weight_before": F.col("weight")})
    s = written(s, "mix-sources")
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = float(share) * (whole["size"] or 0)
    s = s.withColumn("level", (F.lit(budget) - F.col("cap_before")) / (F.lit(whole["weight"] or 0.0) - F.col("weight_before")))
    # Full sources form a prefix of this order; the others share one level, that of the first of them.
    open_ = s.where(F.col("ratio") > F.col("level")).agg(F.min(F.struct("ratio", "source_key", "level")).alias("first")).first()["first"]
    level = F.lit(open_["level"] if open_ else 0.0)
    return s.select("source_key", "source_size", F.when(F.col("ratio") <= F.col("level"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, share: float = 1.0, most: float = 3.0, weights: tuple = WEIGHTS, boundary: str = "word", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Returns doc_id, source, size, source_size, target, taken, copies, one row per document.

    ``boundary="word"`` cuts at the exact budget, so the last document of a source may be taken in part;
    ``boundary="document"`` takes that document whole. copies is the number of (started) passes over the document."""
    rows, most_rows = _mixed(docs, share, most, weights, id_col, text_col, source_col)
    # Copies of a row are made in batches, which are dealt out where a row has several.
    rows = rows.withColumn("batch", F.explode(F.expr(f"sequence(0L, (rows - 1) div {COPIES})")))
    if most_rows > COPIES:
        rows = rows.repartition("doc_id", "source", "key", "batch")
    rows = rows.withColumn("at", F.explode(F.expr(f"sequence(batch * {COPIES}, least(rows, (batch + 1) * {COPIES}) - 1)")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("at") * F.col("size")))
    if boundary == "document":
        part = F.when(part > 0, F.col("size")).otherwise(F.lit(0))
    copies = F.when(F.col("size") > 0, F.col("epochs")).otherwise(F.lit(0)) + (part > 0).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), copies.alias("copies"))


def mix_key(id_col: str, text_col: str, source_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_col, source_col, text_col), 2)


def _mixed(docs: DataFrame, share: float, most: float, weights: tuple, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, int]:
    """doc_id, source, key, rows (how many share these), size, source_size, target, start (words of the source before them),
    epochs and rest (whole passes over the source, and words of the last one); and the most rows that share a key."""
    source = F.col(source_col)
    source_key = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
    base = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), source_key.alias("source_key"), word_count(text_col).alias("size"), mix_key(id_col, text_col, source_col).alias("key"))
    # A partial count comes first, so equal rows are few before they meet.
    base = written(base.groupBy(*base.columns).agg(F.count(F.lit(1)).alias("rows")), "mix")
    count = base.agg(F.count(F.lit(1)).alias("all"), F.max("rows").alias("most")).first()
    ranges = max(1, -(-count["all"] // RANGE_ROWS))
    base = base.withColumn("range", F.expr(f"key div {-(-_KEYS // ranges)}L"))
    per_range = written(base.groupBy("source_key", "range").agg(F.sum(F.col("size") * F.col("rows")).alias("sum")).withColumn("stretch", F.expr(f"range div {STRETCH}L")), "mix-ranges")
    per_stretch = written(per_range.groupBy("source_key", "stretch").agg(F.sum("sum").alias("sum")), "mix-stretches")
    targets = source_targets(per_stretch.groupBy("source_key").agg(F.sum("sum").alias("source_size")), share, most, weights)

    def before(value: Column, order: str, *within: str) -> Column:
        return F.coalesce(F.sum(value).over(W.partitionBy("source_key", *within).orderBy(*order.split()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    stretches = per_stretch.select("source_key", "stretch", before(F.col("sum"), "stretch").alias("stretch_start")).join(targets, "source_key")
    stretches = written(stretches, "mix-starts")
    starts = per_range.withColumn("inner_start", before(F.col("sum"), "range", "stretch")).join(stretches, ["source_key", "stretch"])
    starts = starts.select("source_key", "range", (F.col("stretch_start") + F.col("inner_start")).alias("range_start"), "source_size", "target")
    words = F.col("size") * F.col("rows")
    out = base.join(starts, ["source_key", "range"]).withColumn("start", F.col("range_start") + before(words, "key doc_id", "range"))
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("epochs", epochs).withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    return out.drop("source_key", "range", "range_start"), count["most"] or 0


def mixed_rows(docs: DataFrame, share: float = 1.0, most: float = 3.0, weights: tuple = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as many times as the mix starts a pass over it. Documents are
    whole, so a source may exceed its budget by less than one document. Rows without words are in no budget and are left
    out; of equal rows that the cut falls between, as many as fit start the last pass.

    Each source has one cut in the order of keys, so texts stay where they are: only cuts are sent to them."""
    docs, back = aside(docs, id_col, text_col, source_col)
    rows, _ = _mixed(docs, share, most, weights, id_col, text_col, source_col)
    started = F.expr("least(rows, cast(ceil((rest - start) / size) as bigint))")
    last = F.max(F.when((F.col("size") > 0) & (F.col("start") < F.col("rest")), F.struct("key", "doc_id", started.alias("started"), "rows")))
    cuts = written(rows.groupBy(F.col("source").alias("__source")).agg(F.first("epochs").alias("__epochs"), last.alias("__cut")), "mix-cuts")
    size = cuts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("__source")).alias("bytes")).first()
    if size["rows"] <= SENT_SOURCES and (size["bytes"] or 0) <= SENT_BYTES:
        cuts = F.broadcast(cuts)
    docs_at = docs.where(F.col(text_col).rlike(f"[^{BLANKS}]")).withColumn("__at", F.struct(mix_key(id_col, text_col, source_col).alias("key"), F.col(id_col).alias("doc_id")))
    joined = docs_at.join(cuts, F.col(source_col).eqNullSafe(F.col("__source")))
    cut_at = F.struct(F.col("__cut.key").alias("key"), F.col("__cut.doc_id").alias("doc_id"))
    joined = joined.withColumn("__before", F.coalesce(F.col("__cut").isNotNull() & (F.col("__at") <= cut_at), F.lit(False)))
    split = F.coalesce((F.col("__at") == cut_at) & (F.col("__cut.started") < F.col("__cut.rows")), F.lit(False))
    out = joined.where(~split).withColumn("__n", F.col("__epochs") + F.col("__before").cast("long"))
    if not cuts.where("__cut.started < __cut.rows").isEmpty():
        # The rows at a cut that are equal are numbered by ranges, as they may be many.
        some = joined.where(split).select(*docs.columns, "__source", "__epochs", F.col("__cut.started").alias("__started"), F.monotonically_increasing_id().alias("__row"))
        some = written(running(some, ["__source", "__row"], {"__place": F.lit(1)}), "mix-cut")
        firsts = some.groupBy(F.col("__source").alias("__of")).agg(F.min("__place").alias("__first"))
        some = some.join(firsts, F.col("__source").eqNullSafe(F.col("__of"))).withColumn("__n", F.col("__epochs") + (F.col("__place") - F.col("__first") < F.col("__started")).cast("long"))
        out = out.select(*docs.columns, "__n").unionByName(some.select(*docs.columns, "__n"))
    return back(out.where("__n > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, __n)"))))
