"""Registered queries of a project's stored tables and stages, of unusual archives and of forced strategies, with their DuckDB
twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import space_split, vocabulary_applied
from ..operators import overview, segment, vocab
from ..shared import kept
from ..sources import epub
from ..streaming import batches
from . import run_queries as R
from . import table_queries as T
from . import views as V
from .commands import Project
from .project import Config, copy_files, write_chapters


def project(s: SparkSession, provider: batches.Provider | None = None) -> Project:
    """A new project without tables."""
    return Project(s, R.scratch(s), provider, Config())


def forced_index(s: SparkSession, d: str) -> DataFrame:
    """The index of each strategy, forced on all books."""
    items, toc = kept(V.items(s, d)), V.toc(s, d)
    every = vocab.union_all([segment.split(items, toc, force=name)[2] for name in ("toc", "heading", "per-item")])
    return every.select("book", "strategy", "chapter_count", F.size("warnings").alias("warnings"))


def character_chapters(s: SparkSession, d: str) -> DataFrame:
    found = V.found_terms(s, d).select("chapter_id", "ord", F.col("source").alias("name"))
    return vocab.chapters_of(found, T.characters(s, d), "name").select("key", T.joined(F.col("chapters")).alias("chapters"))


def tagged_vocabulary(s: SparkSession, d: str) -> DataFrame:
    """Terms and characters of a project, both tagged with the chapters in which they were found now."""
    found = V.found_terms(s, d)
    terms = vocab.tagged(T.glossary(s, d), vocab.chapters_of(found, T.existing(s, d).where("false"), "source"), "source")
    people = vocab.merged_characters(T.characters(s, d), T.characters(s, d, "chapter_id % 3 <> 1"))
    people = vocab.tagged(people, vocab.chapters_of(found.withColumnRenamed("source", "name"), people, "name"), "name")
    out = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), T.joined(F.col("chapters")).alias("chapters"))
    return out(terms, "term", "source").unionByName(out(people, "character", "name"))


def second_rootfile(s: SparkSession, d: str) -> DataFrame:
    """Title and items of books whose first rootfile is none of theirs."""
    packed = kept(R.archives(s, d, odd=True))
    rows = epub.books(packed, "metadata").select("path", "title").join(epub.books(packed, "spine").select("path", "spine_index", "media_type"), "path")
    return rows.select(F.col("path").cast("long").alias("doc_id"), "title", "spine_index", "media_type")


def html_items(s: SparkSession, d: str) -> DataFrame:
    """Blocks of items that are pages by their type; their entries are found in any case."""
    rows = epub.books(R.archives(s, d, odd=True), "blocks")
    return rows.select(F.col("path").cast("long").alias("doc_id"), "item_id", "raw_file", F.size("blocks").cast("long").alias("n"), F.md5(segment.blocks_text(F.col("blocks"))).alias("text"))


def stored_status(s: SparkSession, d: str) -> DataFrame:
    """How far each chapter of a stored project is; nothing has been spoken yet."""
    p, t = project(s), T.translations(s, d)
    write_chapters(V.chapters(s, d).select("book", "id", "title", "source"), p.path("chapters", "chapters"))
    p.save(t, "translation", p.config.languages.target)
    p.save(t.where("chapter_id % 2 = 0").select("chapter_id", F.col("text").alias("ssml")), "tts", "ssml")
    return p.status()


def loaded_chapters(s: SparkSession, d: str) -> DataFrame:
    p = project(s)
    write_chapters(V.chapters(s, d).select("book", "id", "title", "source", "raw_size"), p.path("chapters", "chapters"))
    return p.chapters().select("book", "id", "title", F.md5("source").alias("source"), "raw_size")


def loaded_vocabularies(s: SparkSession, d: str) -> DataFrame:
    """Terms and stress forms that are stored, and characters, which are not: an absent table is empty."""
    p = project(s)
    p.save(T.glossary(s, d).orderBy(F.lower("source"), "ord"), "ai", "glossary")
    store = vocab.merged_stress(V.stress_forms(s, d))[0].select(F.col("ord").cast("int").alias("ord"), "term", "stressed", "approved", "chapters")
    p.save(vocab.stored_order(store), "ai", "stress")
    out = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).alias("value"), "ord")
    rows = [out(p.glossary(), "term", "source", "target"), out(p.stress(), "stress", "term", "stressed"), out(p.characters(), "character", "name", "translation")]
    return vocab.union_all(rows)


def known_summaries(s: SparkSession, d: str) -> DataFrame:
    """Summaries of every third chapter are missing."""
    p, c = project(s), V.chapters(s, d)
    write_chapters(c.select("book", "id", "title", "source"), p.path("chapters", "chapters"))
    p.save(c.where("id % 3 <> 0").select(F.col("id").alias("chapter_id"), F.col("title").alias("summary")), "memory", "summaries")
    return p.known_summaries()


def replaced_table(s: SparkSession, d: str) -> DataFrame:
    """A stored table that is replaced by rows read from itself."""
    p = project(s)
    p.save(T.translations(s, d), "translation", "ru")
    p.save(p.translations().withColumn("text", F.concat(F.lit("again "), "text")), "translation", "ru")
    return p.translations().select("chapter_id", F.md5("text").alias("text"))


def replaced_violations(s: SparkSession, d: str) -> DataFrame:
    """The findings of a second run, after some translations are gone, replace those of the first."""
    p, t = project(s), T.translations(s, d)
    p.save(T.glossary(s, d), "ai", "glossary")
    p.save(t, "translation", p.config.languages.target)
    p.verify_glossary()
    p.save(t.where("chapter_id % 3 = 1"), "translation", p.config.languages.target)
    return p.verify_glossary().select("chapter_id", "source_term", "expected_target")


def copied_files(s: SparkSession, d: str) -> DataFrame:
    root = R.scratch(s)
    V.log_lines(s, d).write.json(f"{root}/from")
    copy_files(s, f"{root}/from/*.json", f"{root}/to")
    return s.read.schema("line_no long, line string").json(f"{root}/to").select("line_no", F.md5("line").alias("line"))


def stage_files(s: SparkSession, d: str) -> DataFrame:
    """A file of chapters for each nation and one of speech for each region, in folders below the stage's."""
    root = R.scratch(s)
    for stage, fmt, name in (("chapters/a/b", "json", "nation"), ("extracted", "text", "region"), ("tts", "json", "region")):
        n = V.read(s, d, name).count()
        s.range(0, n, 1, n).select(F.col("id").cast("string").alias("value")).write.format(fmt).save(f"{root}/{stage}")
    return overview.stage_counts(s, root)


def override_entries(s: SparkSession, d: str) -> DataFrame:
    rows = V.found_terms(s, d).select("ord", F.when(F.col("ord") % 3 == 0, "").otherwise(F.col("source")).alias("term"), F.col("target").alias("phonemes"))
    return vocab.override_entries(rows).select("ord", "term", "stressed", "approved", F.size("chapters").alias("chapters"))


def stressed_by_vocabulary(s: SparkSession, d: str) -> DataFrame:
    """Texts with a stored vocabulary applied, and a fixed word of the configuration on top."""
    entries = V.words(s, d).groupBy(F.lower("word").alias("term")).agg(F.min(F.col("item_id") * 10000 + F.col("k")).alias("ord"))
    rows = vocab.applied(V.text_parts(s, d), entries.select("ord", "term", F.concat(F.lit("+"), "term").alias("stressed")))
    return rows.select("doc_id", F.md5(vocabulary_applied(F.col("text"), [("the", "th+e"), ("of", "of")])).alias("text"))


def answered(lines: DataFrame) -> DataFrame:
    """A stand-in for a model: each chapter has two terms and a character, shared with every seventh and every third, and a
    summary."""
    id_ = F.get_json_object("value", "$.custom_id")
    n = F.regexp_extract(id_, r"([0-9]+)\z", 1).cast("long")
    mark = lambda name, m: F.concat(F.lit(name), (n % m).cast("string"))
    term = lambda name, m: F.struct(mark(name, m).alias("source"), F.concat(F.lit("t"), n.cast("string")).alias("target"), F.lit("place").alias("type"))
    who = F.struct(mark("Person", 3).alias("name"), F.concat(F.lit("p"), n.cast("string")).alias("translation"), F.lit("").alias("role"), F.lit("").alias("description"))
    content = F.to_json(F.struct(F.array(who).alias("characters"), F.array(term("Term", 7), term("TERM", 5)).alias("terms"), F.concat(F.lit(" S "), n.cast("string"), F.lit(" ")).alias("summary")))
    body = F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), content.alias("text"))).alias("content"))).alias("output"))
    return lines.select(F.to_json(F.struct(id_.alias("custom_id"), F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response"))).alias("value"))


def analyzed(s: SparkSession, d: str) -> DataFrame:
    """Lists from all chapters become one vocabulary: names in any case once, with the first translation and all chapters."""
    p = project(s, batches.FakeProvider(answered))
    write_chapters(V.chapters(s, d).select("book", "id", "title", "source"), p.path("chapters", "chapters"))
    p.analyze()
    out = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).alias("value"), F.md5(T.joined(F.col("chapters"))).alias("chapters"))
    rows = [out(p.glossary(), "term", "source", "target"), out(p.characters(), "character", "name", "translation")]
    told = p.summaries().select(F.lit("summary").alias("kind"), F.col("chapter_id").cast("string").alias("name"), F.col("summary").alias("value"), F.lit("").alias("chapters"))
    return vocab.union_all([*rows, told])


QUERIES = {
    "g5_forced_index": forced_index,
    "a2_character_chapters": character_chapters,
    "a4_tagged_vocabulary": tagged_vocabulary,
    "s3_second_rootfile": second_rootfile,
    "p8_html_items": html_items,
    "s5_split_spaces": lambda s, d: V.text_parts(s, d).select("doc_id", F.size(space_split(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(space_split(F.col("text")), "/")).alias("parts")),
    "s14_loaded_chapters": loaded_chapters,
    "s15_loaded_vocabularies": loaded_vocabularies,
    "s16_known_summaries": known_summaries,
    "s17_stored_status": stored_status,
    "k1_replaced_table": replaced_table,
    "k12_replaced_violations": replaced_violations,
    "k15_copied_files": copied_files,
    "a15_stage_files": stage_files,
    "t23_override_entries": override_entries,
    "x11_stressed_by_vocabulary": stressed_by_vocabulary,
    "a21_analyzed": analyzed,
}

_BOOKS = f"(SELECT DISTINCT book FROM {V.CHAPTERS})"
_FOUND_PEOPLE = "(SELECT lower(source) AS key, chapter_id, ord, side FROM (SELECT *, 0 AS side FROM {0} UNION ALL SELECT *, 1 FROM {0} WHERE {1}))"


def _people(had: str) -> str:
    """Chapters of names: those found, in their order, then those they had."""
    rows = _FOUND_PEOPLE.replace("{0}", V.FOUND).replace("{1}", had)
    return f"SELECT key, string_agg(chapter_id::VARCHAR, ',' ORDER BY side, o) AS chapters FROM (SELECT key, chapter_id, min(side) AS side, arg_min(ord, side * 10000000000 + ord) AS o FROM {rows} GROUP BY ALL) GROUP BY key"


_STATUS = "CASE WHEN id % 3 = 0 THEN 'raw' WHEN id % 2 = 0 THEN 'ssml' ELSE 'translated' END"
_KNOWN = f"(SELECT DISTINCT lower(word) AS term FROM {V.WORDS})"
_PARTS = "(SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS part FROM (SELECT doc_id, regexp_extract_all(text, '[\\pL\\pN]+|[^\\pL\\pN]+') AS l FROM documents))"
_NUMBERED = "(SELECT doc_id + 1 AS id FROM documents)"
_NAMES = f"""(SELECT 'term' AS kind, 'Term' || (id % 7)::VARCHAR AS name, 't' || id::VARCHAR AS value, id, 0 AS k FROM {_NUMBERED}
  UNION ALL SELECT 'term', 'TERM' || (id % 5)::VARCHAR, 't' || id::VARCHAR, id, 1 FROM {_NUMBERED} UNION ALL SELECT 'character', 'Person' || (id % 3)::VARCHAR, 'p' || id::VARCHAR, id, 0 FROM {_NUMBERED})"""

ORACLE_SQL = {
    "g5_forced_index": " UNION ALL ".join(f"SELECT b.book AS book, '{name}' AS strategy, coalesce(n, 0)::INT AS chapter_count, 0 AS warnings FROM {_BOOKS} b LEFT JOIN (SELECT book, count(*) AS n FROM ({T.ORACLE_SQL[query]}) GROUP BY book) x ON b.book = x.book" for name, query in (("toc", "g2_by_toc"), ("heading", "g3_by_headings"), ("per-item", "g4_per_item"))),
    "a2_character_chapters": _people("chapter_id % 3 = 1"),
    "a4_tagged_vocabulary": f"""SELECT 'term' AS kind, source AS name, array_to_string(chapters, ',') AS chapters FROM {T.GLOSSARY}
  UNION ALL SELECT 'character', name, found FROM ({T.ORACLE_SQL['a6_merged_characters']}) c JOIN (SELECT key, string_agg(chapter_id::VARCHAR, ',' ORDER BY o) AS found FROM (SELECT lower(source) AS key, chapter_id, min(ord) AS o FROM {V.FOUND} GROUP BY ALL) GROUP BY key) f ON lower(c.name) = f.key""",
    "s3_second_rootfile": f"SELECT doc_id, 'Book ' || doc_id::VARCHAR AS title, 0 AS spine_index, ['{"','".join(R.MEDIA)}'][doc_id % 4 + 1] AS media_type FROM documents",
    "p8_html_items": f"SELECT doc_id, 'a' AS item_id, 'item000.xhtml' AS raw_file, len(l)::BIGINT AS n, md5(array_to_string(l, chr(10) || chr(10))) AS text FROM (SELECT doc_id, {R._LINES} AS l FROM documents WHERE doc_id % 4 <> 3)",
    "s5_split_spaces": "SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, '/')) AS parts FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM documents)",
    "s14_loaded_chapters": f"SELECT book, id::INT AS id, title, md5(source) AS source, raw_size FROM {V.CHAPTERS}",
    "s15_loaded_vocabularies": f"SELECT 'term' AS kind, source AS name, target AS value, ord FROM {T.GLOSSARY} UNION ALL SELECT 'stress', term, stressed, ord FROM (SELECT s.term AS term, s.stressed AS stressed, o.ord AS ord FROM ({T.ORACLE_SQL['a7_stress_store']}) s JOIN ({T.ORACLE_SQL['a9_stored_order']}) o ON s.term = o.term)",
    "s16_known_summaries": f"SELECT id::INT AS chapter_id, CASE WHEN id % 3 <> 0 THEN title ELSE '' END AS summary FROM {V.CHAPTERS}",
    "s17_stored_status": f"SELECT id::INT AS id, {_STATUS} AS status FROM {V.CHAPTERS}",
    "k1_replaced_table": f"SELECT id::INT AS chapter_id, md5('again ' || source) AS text FROM {V.CHAPTERS} WHERE id % 3 <> 0",
    "k12_replaced_violations": f"SELECT v.chapter_id::INT AS chapter_id, source_term, expected_target FROM ({T.ORACLE_SQL['j9_violations']}) v JOIN {T.GLOSSARY} g ON g.source = source_term AND g.type <> 'character' WHERE v.chapter_id % 3 = 1",
    "k15_copied_files": f"SELECT line_no, md5(line) AS line FROM {V.LOG}",
    "a15_stage_files": "SELECT 'chapters' AS stage, count(*) AS files FROM nation UNION ALL SELECT 'extracted', count(*) FROM region",
    "t23_override_entries": f"SELECT ord, source AS term, target AS stressed, false AS approved, 0 AS chapters FROM {V.FOUND} WHERE ord % 3 <> 0 AND target <> ''",
    "x11_stressed_by_vocabulary": f"SELECT doc_id, md5(string_agg(CASE WHEN term IS NOT NULL THEN '+' || term WHEN lower(part) = 'the' THEN 'th+e' ELSE part END, '' ORDER BY k)) AS text FROM {_PARTS} LEFT JOIN {_KNOWN} ON lower(part) = term GROUP BY doc_id",
    "a21_analyzed": f"""SELECT kind, arg_min(name, 2 * id + k) AS name, arg_min(value, 2 * id + k) AS value, md5(string_agg(id::VARCHAR, ',' ORDER BY id)) AS chapters
  FROM (SELECT kind, lower(name) AS key, id, arg_min(name, k) AS name, arg_min(value, k) AS value, min(k) AS k FROM {_NAMES} GROUP BY ALL) GROUP BY kind, key UNION ALL SELECT 'summary', id::VARCHAR, 'S ' || id::VARCHAR, '' FROM {_NUMBERED}""",
}
