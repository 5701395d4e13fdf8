"""Overviews: what each chapter has, how far each stage is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import byte_prefix
from .vocab import counts_by_chapter

#: Bytes below which a chapter is short, of stripped text above which it is marked, and of a title in the table.
SHORT, LARGE, TITLE = 1500, 300, 40
STAGES = {"source": ".epub", "extracted": "", "chapters": ".json", "ai": ".json", "translation": ".txt", "memory": ".txt", "tts": ".ssml", "audio": ""}


def chapter_sizes(chapters: DataFrame) -> DataFrame:
    """chapters with size, diff (bytes stripped; null if nothing was), short and large."""
    size = (F.octet_length("title") + F.octet_length("source")).cast("long")
    rows = chapters.withColumn("size", size).withColumn("diff", F.when(F.col("raw_size") > 0, F.col("raw_size") - F.col("size")))
    return rows.withColumn("short", F.col("size") < SHORT).withColumn("large", F.coalesce(F.col("diff") > LARGE, F.lit(False)))


def chapter_overview(chapters: DataFrame, terms: DataFrame, characters: DataFrame, stress: DataFrame, translations: DataFrame, ssml: DataFrame, audio: DataFrame) -> DataFrame:
    """One row for each chapter: sizes, entries tagged with it, bytes of its translation, whether speech and audio exist."""
    rows = chapter_sizes(chapters).select("id", "title", "raw_size", "size", "diff", "short", "large")
    for name, table in (("terms", terms), ("characters", characters), ("stress", stress)):
        rows = rows.join(counts_by_chapter(table, name), rows["id"] == F.col("chapter_id"), "left").drop("chapter_id").fillna(0, [name])
    t = translations.groupBy("chapter_id").agg(F.max(F.octet_length("text")).cast("long").alias("translated"))
    rows = rows.join(t, rows["id"] == t["chapter_id"], "left").drop("chapter_id")
    for name, table in (("ssml", ssml), ("audio", audio)):
        have = table.select(F.col("chapter_id").alias("k")).distinct().withColumn(name, F.lit(True))
        rows = rows.join(have, rows["id"] == have["k"], "left").drop("k").fillna(False, [name])
    return rows


def totals(overview: DataFrame) -> DataFrame:
    mark = lambda c: F.count_if(c)
    return overview.agg(F.count(F.lit(1)).alias("chapters"), mark(F.col("short")).alias("short"), mark(F.col("large")).alias("stripped"), mark(F.col("translated").isNotNull()).alias("translated"), mark(F.col("ssml")).alias("ssml"), mark(F.col("audio")).alias("audio"))


def table_lines(overview: DataFrame) -> DataFrame:
    """id, line: fixed-width rows of the overview."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    yes = lambda c: F.when(c, "yes").otherwise("-")
    raw = F.when(F.col("raw_size") > 0, F.col("raw_size").cast("string")).otherwise("-")
    size = F.concat(F.col("size").cast("string"), F.when(F.col("short"), " (!)").otherwise(""))
    diff = F.concat(text(F.col("diff")), F.when(F.col("large"), "!").otherwise(""))
    columns: list[Column] = [F.col("id"), raw, size, diff, F.col("terms"), F.col("characters"), F.col("stress"), text(F.col("translated")), yes(F.col("ssml")), yes(F.col("audio")), byte_prefix(F.col("title"), TITLE)]
    return overview.select("id", F.format_string("%-4d  %-8s  %-8s  %-7s  %-6d  %-6d  %-7d  %-9s  %-5s  %-5s  %s", *columns).alias("line"))


def stage_counts(spark: SparkSession, root: str) -> DataFrame:
    """stage, files: visible files below each stage's folder with the stage's extension, from a listing (contents unread)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/*/").select("path")
    below = F.regexp_extract("path", r".*?/(" + "|".join(STAGES) + r")/", 1)
    ext = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    rows = files.withColumn("stage", below).withColumn("ext", F.element_at(ext, F.col("stage")))
    rows = rows.where((F.col("stage") != "") & ~F.startswith(name, F.lit(".")) & F.endswith(name, F.coalesce("ext", F.lit(""))))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("files"))
