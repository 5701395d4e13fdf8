"""Inputs of the registered queries, made from the driver's tables, as DataFrames and as DuckDB SQL.

The tables stand in for books: documents are chapters, their lines blocks, words of benchmark items vocabularies, rounds
of conversations summaries, events log lines, orders batch states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = ("Chapter {id}", "Copyright", "Prologue", "{line}", "Part iv of the book", "Table of Contents", "chapter two", "About the Author")
TRIGGERS = ["Released under", "Licensed under"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts in fewer pieces than there are cores (one small file) are dealt out first, as work on them is heavy."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    line, id_ = F.substring_index("text", "\n", 1), (F.col("doc_id") + 1)
    title = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("Chapter "), id_.cast("string")))
    for k, t in enumerate(TITLES[1:], 1):
        title = title.when(F.col("doc_id") % 8 == k, line if t == "{line}" else F.lit(t))
    return d.select(id_.alias("id"), title.alias("title"), F.col("text").alias("source"), F.lit(0).cast("long").alias("raw_size"), F.col("lang"), F.col("source").alias("book"))


CHAPTERS = (
    "(SELECT doc_id + 1 AS id, CASE doc_id % 8 WHEN 0 THEN 'Chapter ' || (doc_id + 1)::VARCHAR "
    + " ".join(f"WHEN {k} THEN " + ("split_part(text, chr(10), 1)" if t == "{line}" else f"'{t}'") for k, t in enumerate(TITLES[1:], 1))
    + " END AS title, text AS source, 0::BIGINT AS raw_size, lang, source AS book FROM documents)"
)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks; each source is a book, each document an item; every ninth line is a heading of level 1, 2
    or 3, with a title that is kept or not."""
    d = read(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("book"), F.col("doc_id").alias("spine_index"), F.posexplode(F.split("text", "\n")).alias("block_index", "line"))
    head = F.col("block_index") % 9 == 0
    n = F.col("spine_index") + F.col("block_index")
    title = F.when(n % 3 == 0, F.concat(F.lit("Chapter "), n.cast("string"))).when(n % 3 == 1, "Notes").otherwise(F.col("line"))
    b = F.struct(F.when(head, "heading").otherwise("paragraph").alias("kind"), F.when(head, (n % 3 + 1).cast("int")).otherwise(0).alias("level"), F.lit("").alias("anchor"), F.when(head, title).otherwise(F.col("line")).alias("text"), F.lit("").alias("alt"))
    return rows.select("book", "spine_index", "block_index", b.alias("b"))


BLOCKS = """(SELECT book, spine_index, block_index, CASE WHEN block_index % 9 = 0 THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE WHEN block_index % 9 = 0 THEN (spine_index + block_index) % 3 + 1 ELSE 0 END AS level,
  CASE WHEN block_index % 9 <> 0 THEN line WHEN (spine_index + block_index) % 3 = 0 THEN 'Chapter ' || (spine_index + block_index)::VARCHAR
       WHEN (spine_index + block_index) % 3 = 1 THEN 'Notes' ELSE line END AS text
  FROM (SELECT source AS book, doc_id AS spine_index, unnest(range(len(l))) AS block_index, unnest(l) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).groupBy("book", "spine_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "b"))), lambda x: x["b"]).alias("blocks"))
    name = F.concat(F.lit("item"), F.col("spine_index").cast("string"))
    return rows.select("book", "spine_index", name.alias("id"), F.concat(F.lit("text/"), name, F.lit(".xhtml")).alias("href"), "blocks")


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third item has an entry; some entries name files that are not there."""
    from pyspark.sql import Window as W

    d = chapters(spark, sf_dir).where("id % 3 = 0")
    file = F.concat(F.lit("item"), F.when(F.col("id") % 10 == 0, F.lit("x")).otherwise((F.col("id") - 1).cast("string")), F.lit(".xhtml"))
    place = F.row_number().over(W.partitionBy("book").orderBy("id")) - 1
    return d.select("book", place.alias("toc_index"), F.col("title").alias("Title"), F.concat(F.lit("OEBPS/"), file).alias("SrcFile"), F.lit("").alias("SrcAnchor"))


TOC = f"""(SELECT book, row_number() OVER (PARTITION BY book ORDER BY id) - 1 AS toc_index, title,
  'item' || CASE WHEN id % 10 = 0 THEN 'x' ELSE (id - 1)::VARCHAR END || '.xhtml' AS file FROM {CHAPTERS} WHERE id % 3 = 0)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, k, word): letters of benchmark items, words of six or more."""
    b = read(spark, sf_dir, "benchmark")
    rows = b.select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("k", "word"))
    return rows.where(F.length("word") >= 6)


WORDS = r"(SELECT item_id, k, word FROM (SELECT item_id, unnest(range(len(l))) AS k, unnest(l) AS word FROM (SELECT item_id, regexp_extract_all(text, '\pL+') AS l FROM benchmark)) WHERE length(word) >= 6)"
_KIND = ("character", "place", "organization", "title", "term", "other", "object")


def found_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted terms: item is the chapter; ord the place; types by length."""
    w = words(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, _KIND)), (F.length("word") % 7 + 1).cast("int"))
    return w.select((F.col("item_id") + 1).cast("int").alias("chapter_id"), (F.col("item_id") * 10000 + F.col("k")).cast("long").alias("ord"), F.col("word").alias("source"), F.when(F.col("k") % 5 == 4, "").otherwise(F.concat(F.lit("t-"), "word")).alias("target"), kind.alias("type"))


FOUND = f"""(SELECT item_id + 1 AS chapter_id, item_id * 10000 + k AS ord, word AS source, CASE WHEN k % 5 = 4 THEN '' ELSE 't-' || word END AS target,
  ['{"','".join(_KIND)}'][length(word) % 7 + 1] AS type FROM {WORDS})"""


def stress_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary entries with marked forms: merge 0 for items divisible by four, else the item's number; the mark's place varies."""
    w = words(spark, sf_dir)
    merge = F.when(F.col("item_id") % 4 == 0, 0).otherwise(F.col("item_id")).cast("int")
    at = (F.col("item_id") % 3 + 1).cast("int")
    form = F.concat(F.substr("word", F.lit(1), at), F.lit("+"), F.substr("word", at + 1))
    return w.select(merge.alias("merge"), (F.col("item_id") * 10000 + F.col("k")).cast("long").alias("ord"), F.col("word").alias("term"), form.alias("stressed"), ((F.col("item_id") % 8 == 0) & (F.col("k") % 2 == 0)).alias("approved"), F.array((F.col("item_id") + 1).cast("int")).alias("chapters"))


STRESS = f"""(SELECT CASE WHEN item_id % 4 = 0 THEN 0 ELSE item_id END AS merge, item_id * 10000 + k AS ord, word AS term,
  substr(word, 1, (item_id % 3 + 1)::INT) || '+' || substr(word, (item_id % 3 + 2)::INT) AS stressed, item_id % 8 = 0 AND k % 2 = 0 AS approved, item_id + 1 AS chapter_id FROM {WORDS})"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary for each turn of a conversation; every fifth is empty, every seventh missing."""
    c = read(spark, sf_dir, "conversations").where("(conv_id + turn) % 7 <> 0")
    text = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "").otherwise(F.regexp_extract("text", r"^([^.!?\n]*)", 1))
    return c.select("conv_id", F.col("turn").cast("int").alias("chapter_id"), text.alias("summary"))


SUMMARIES = r"(SELECT conv_id, turn::INT AS chapter_id, CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE regexp_extract(text, '^([^.!?\n]*)', 1) END AS summary FROM conversations WHERE (conv_id + turn) % 7 <> 0)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: errors are warnings about a text, signups marks of other entries, the rest goes on."""
    e = read(spark, sf_dir, "events")
    text = F.concat(F.lit("parsing failed for text '<speak><s>"), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit("</s></speak>', skipped"))
    line = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.concat(F.lit("\x1b[33m[WARN] "), text, F.lit("\x1b[0m"))).when(F.col("event_type") == "error", F.concat(F.lit("[ERROR] "), text)).when(F.col("event_type") == "signup", F.lit("[INFO] ready")).when(F.col("event_type") == "purchase", F.lit("  INFO: served")).otherwise(F.concat(F.lit("at "), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")))
    return e.select(F.col("event_id").alias("line_no"), line.alias("line"))


LOG = """(SELECT event_id AS line_no, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN chr(27) || '[33m[WARN] ' || t || chr(27) || '[0m' WHEN event_type = 'error' THEN '[ERROR] ' || t
  WHEN event_type = 'signup' THEN '[INFO] ready' WHEN event_type = 'purchase' THEN '  INFO: served' ELSE 'at ' || event_type || ' ' || event_id::VARCHAR END AS line
  FROM (SELECT *, 'parsing failed for text ''<speak><s>' || event_id::VARCHAR || ' ' || event_type || '</s></speak>'', skipped' AS t FROM events))"""


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a batch's output file, by doc_id % 6: good, error, no response, status 500, no text, unknown id."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("t"))
    k = F.col("doc_id") % 6
    body = F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), F.when(k == 4, "").otherwise(F.col("t")).alias("text"))).alias("content"))).alias("output"))
    response = F.when(~k.isin(1, 2), F.struct(F.when(k == 3, 500).otherwise(200).alias("status_code"), body.alias("body")))
    error = F.when(k == 1, F.struct(F.lit("limit").alias("code"), F.lit("too many").alias("message")))
    id_ = F.concat(F.when(k == 5, "other-").otherwise("translate-chapter-"), (F.col("doc_id") + 1).cast("string"))
    return d.select("doc_id", F.to_json(F.struct(id_.alias("custom_id"), response.alias("response"), error.alias("error"))).alias("value"))


def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def empty_like(df: DataFrame) -> DataFrame:
    return df.where("false")
