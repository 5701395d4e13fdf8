"""Registered queries of segmentation, vocabularies, context, checks, states and overviews, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import basename, custom_id
from ..operators import context, overview, qa, segment, vocab
from ..sources import batches as batch_files
from ..sources.html import exploded, with_blocks
from ..streaming import batches
from . import views as V
from .project import chapter_filter, within
from .text_queries import TRIM, Sql

joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---- segmentation


def split_chapters(part):
    """A query of the chapters of one strategy: their number for each book, and a digest of each text."""

    def run(s, d):
        items = V.items(s, d)
        rows = {"toc": lambda: segment.by_toc(items, V.toc(s, d))[0], "heading": lambda: segment.by_headings(items, 100)[0], "per-item": lambda: segment.per_item(items)}[part]()
        return rows.select("book", "id", "title", F.md5("source").alias("source"), joined(F.col("section_ids")).alias("section_ids"))

    return run


def skipped(s, d):
    items = V.items(s, d)
    return segment.by_toc(items, V.toc(s, d))[1].unionByName(segment.by_headings(items)[1]).groupBy("book", "strategy", "reason").agg(F.count(F.lit(1)).alias("n"))


def split_index(s, d):
    return segment.split(V.items(s, d), V.toc(s, d))[2].select("book", "chapter_count", "start_id", "strategy", F.size("warnings").cast("int").alias("warnings"))


_STARTS = f"""(SELECT *, sum(starts::INT) OVER (PARTITION BY book ORDER BY spine_index, block_index) AS segment FROM (SELECT *, kind = 'heading' AND level IN (1, 2) AND (regexp_matches(text, '(?i)^chapter') AND NOT regexp_matches(text, '(?i)copyright')
  OR regexp_matches(text, '(?i)^(prologue|epilogue|preface|introduction|foreword|afterword|appendix)\\b')) AS starts FROM {V.BLOCKS}))"""
_TEXT = "string_agg(text, chr(10) || chr(10) ORDER BY spine_index, block_index) FILTER (text <> '')"
_ITEM = "'item' || spine_index::VARCHAR"
_KEPT_TOC = f"(SELECT *, row_number() OVER (PARTITION BY book ORDER BY toc_index) AS number FROM (SELECT *, {{0}} AS c FROM {V.TOC}) WHERE c LIKE 'KEEP/%')"


def _toc_sql() -> str:
    from ..functions.titles import classify_sql

    kept = _KEPT_TOC.replace("{0}", classify_sql("title"))
    return f"SELECT t.book, number::INT AS id, title, md5(coalesce({_TEXT}, '')) AS source, 'item' || any_value(spine_index)::VARCHAR AS section_ids FROM {kept} t JOIN {V.BLOCKS} b ON t.book = b.book AND t.file = 'item' || b.spine_index::VARCHAR || '.xhtml' GROUP BY t.book, number, title"


# ---- vocabularies


def existing(s, d):
    """Terms that were there before: those of items divisible by three, tagged with their own chapters."""
    rows = V.found_terms(s, d).where("(chapter_id - 1) % 3 = 0")
    return rows.select("ord", "source", "target", "type", F.lit(0).alias("first_seen_chapter"), F.array("chapter_id").alias("chapters"))


def new_terms(s, d):
    rows = V.found_terms(s, d).where("(chapter_id - 1) % 3 <> 0")
    return rows.select("ord", "source", "target", "type", F.lit(0).alias("first_seen_chapter"), F.array("chapter_id").alias("chapters"))


def glossary(s, d):
    """Each distinct term once, tagged with all its chapters."""
    merged = vocab.merged_terms(existing(s, d), new_terms(s, d)).drop("added")
    tags = vocab.chapters_of(V.found_terms(s, d), existing(s, d).where("false"), "source")
    return vocab.tagged(merged, tags, "source")


_FIRST = f"(SELECT arg_min(source, p) AS source, arg_min(target, p) AS target, arg_min(type, p) AS type, arg_min(chapter_id, p) AS chapter_id, min(p) AS p FROM (SELECT *, ((chapter_id - 1) % 3 <> 0)::BIGINT * 1000000000 + ord AS p FROM {V.FOUND} WHERE (chapter_id - 1) % 3 = 0 OR target <> '') GROUP BY lower(source))"
_TAGS = f"(SELECT key, list(chapter_id ORDER BY o) AS chapters FROM (SELECT lower(source) AS key, chapter_id, min(ord) AS o FROM {V.FOUND} GROUP BY ALL) GROUP BY key)"
GLOSSARY = f"(SELECT f.*, p % 1000000000 AS ord, t.chapters FROM {_FIRST} f LEFT JOIN {_TAGS} t ON lower(f.source) = t.key)"


def characters(s, d, keep="chapter_id % 3 = 1"):
    rows = V.found_terms(s, d).where(keep)
    role = F.when(F.col("ord") % 2 == 0, "").otherwise(F.concat(F.lit("r"), F.col("chapter_id").cast("string")))
    return rows.select("ord", F.col("source").alias("name"), F.col("target").alias("translation"), role.alias("role"), F.lit("").alias("description"), F.array("chapter_id").alias("chapters"))


_ROLE = "CASE WHEN ord % 2 = 0 THEN '' ELSE 'r' || chapter_id::VARCHAR END"


def merged_characters(s, d):
    rows = vocab.merged_characters(characters(s, d), characters(s, d, "chapter_id % 3 <> 1"))
    return rows.select("name", "translation", "role", joined(F.col("chapters")).alias("chapters"), "added")


def stress_store(s, d):
    return vocab.merged_stress(V.stress_forms(s, d))[0].select("term", "stressed", "approved", "merge", "ord")


def stress_conflicts(s, d):
    return vocab.merged_stress(V.stress_forms(s, d))[1]


_BASE = f"(SELECT lower(term) AS key, arg_min(struct_pack(term := term, stressed := stressed, approved := approved), merge::BIGINT * 1000000000 + ord) AS b, min(merge::BIGINT * 1000000000 + ord) AS p FROM {V.STRESS} GROUP BY ALL)"
_CONFLICTS = f"(SELECT merge, min(ord) AS ord, arg_min(term, ord) AS term, arg_min(stressed, ord) AS form, any_value(b.stressed) AS base, key FROM {V.STRESS} s JOIN {_BASE} ON lower(term) = key WHERE merge > 0 AND NOT b.approved AND lower(s.stressed) <> lower(b.stressed) GROUP BY merge, key)"


def decisions(s, d):
    c = vocab.deduplicated_conflicts(stress_conflicts(s, d))
    form = F.when(F.length("term") % 3 == 0, "").otherwise(F.element_at("variants", -1))
    return c.select("term", form.alias("stressed"))


def resolved(s, d):
    store = vocab.merged_stress(V.stress_forms(s, d))[0].select(F.col("ord").cast("int").alias("ord"), "term", "stressed", "approved", "chapters")
    return vocab.resolved(store, decisions(s, d)).select("term", "stressed", "approved")


def overrides(s, d):
    """Every eleventh word is fixed by configuration, and two names that no text has."""
    rows = V.found_terms(s, d).where("ord % 11 = 0").groupBy("source").agg(F.min("ord").alias("ord"))
    return rows.select("ord", "source", F.concat(F.lit("fixed "), "source").alias("target"), F.when(F.length("source") % 2 == 0, "place").otherwise("").alias("type")).union(s.createDataFrame([(10**9, "Nobody", "Nikto", ""), (10**9 + 1, "Nowhere", "", "place")], "ord long, source string, target string, type string"))


_OVER = f"(SELECT min(ord) AS ord, source, 'fixed ' || source AS target, CASE WHEN length(source) % 2 = 0 THEN 'place' ELSE '' END AS type FROM {V.FOUND} WHERE ord % 11 = 0 GROUP BY source)"


def chapter_ids(s, d):
    return V.chapters(s, d).select("id")


def translations(s, d):
    """Every third chapter is not translated yet; the text stands for its translation."""
    return V.chapters(s, d).where("id % 3 <> 0").select(F.col("id").alias("chapter_id"), F.col("source").alias("text"))


def summary_context(s, d):
    return context.previous_summaries(V.summaries(s, d), 2, ("conv_id",)).select("conv_id", "chapter_id", "context")


def violations(s, d):
    found = qa.glossary_violations(translations(s, d), glossary(s, d))
    return found.select("chapter_id", "source_term", "expected_target", "found_in_translation")


def occurrences(s, d):
    """Words of benchmark items in documents: the substring join, counted for each word."""
    return _occurrences(s, d, qa.containing)


def occurrences_by_pieces(s, d):
    """The same by pieces, as more terms than go along to the texts are joined."""
    return _occurrences(s, d, qa.containing_by_pieces)


def terms_of_all_lengths(s, d):
    """Every word of benchmark items, and every three words in a row that have up to 40 letters."""
    w = V.read(s, d, "benchmark").select(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1).alias("w"))
    three = F.expr("transform(sequence(1, greatest(size(w) - 2, 1)), i -> array_join(slice(w, i, 3), ' '))")
    return w.select(F.explode(F.concat("w", F.filter(three, lambda x: F.length(x).between(1, 40)))).alias("word"))


def occurrences_of_all_lengths(s, d):
    """Terms of one letter and more, looked for by their rarest pieces."""
    return _occurrences(s, d, qa.containing_by_pieces, terms_of_all_lengths(s, d))


def automaton_of_all_lengths(s, d):
    """The same terms in one automaton."""
    return _occurrences(s, d, qa.containing, terms_of_all_lengths(s, d))


def _occurrences(s, d, how, words=None):
    terms = (V.words(s, d) if words is None else words).select(F.lower("word").alias("word")).distinct().withColumn("key", F.xxhash64("word"))
    hits = how(V.text_parts(s, d), terms, "text", "word", "doc_id", "key")
    return hits.join(terms, "key").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def log_warnings(s, d):
    return qa.log_warnings(V.log_lines(s, d)).select("first_line", F.md5("entry").alias("entry"), "snippet")


_LOGGED = Sql(f"(SELECT *, sum(marker::INT) OVER (ORDER BY line_no) AS entry_no FROM (SELECT *, warn OR regexp_matches({TRIM.format('line')}, '^(\\[INFO\\]|INFO:|ERROR:)') AS marker FROM (SELECT *, regexp_matches(line, '^\\s*\\[(WARN|ERROR)\\]') AS warn FROM (SELECT line_no, regexp_replace(line, '\\x1b\\[[^m]*m', '', 'g') AS line FROM {V.LOG}))))")


def warning_chapters(s, d):
    """Warnings whose snippet stands in a chapter: snippets are first lines of documents here."""
    docs = V.text_parts(s, d)
    w = docs.select(F.col("doc_id").alias("first_line"), F.lit("").alias("entry"), F.substring(F.substring_index("text", "\n", 1), 1, 40).alias("snippet"))
    return qa.warnings_by_chapter(w, docs.select(F.col("doc_id").alias("chapter_id"), F.col("text").alias("ssml"))).select("first_line", "chapter_id")


def problem_words(s, d):
    rows = qa.problems(translations(s, d))
    return rows.select("chapter_id", F.size("words").cast("long").alias("words"), F.array_join("symbols", "").alias("symbols"))


def overview_rows(s, d):
    c = V.chapters(s, d)
    c = c.withColumn("raw_size", F.when(F.col("id") % 2 == 0, F.octet_length("source").cast("long") + 400).otherwise(0))
    g = glossary(s, d)
    t = translations(s, d)
    done = t.where("chapter_id % 2 = 0").select("chapter_id")
    return overview.chapter_overview(c, g, characters(s, d), V.stress_forms(s, d), t, done, done.where("chapter_id % 4 = 0"))


_OVERVIEW = f"""(SELECT id, title, raw_size, size, CASE WHEN raw_size > 0 THEN raw_size - size END AS diff, size < 1500 AS short, coalesce(raw_size > 0 AND raw_size - size > 300, false) AS large,
  coalesce(t.n, 0) AS terms, coalesce(c.n, 0) AS characters, coalesce(x.n, 0) AS stress, CASE WHEN id % 3 <> 0 THEN octet_length(encode(source)) END AS translated, id % 3 <> 0 AND id % 2 = 0 AS ssml, id % 3 <> 0 AND id % 4 = 0 AS audio
  FROM (SELECT *, octet_length(encode(title)) + octet_length(encode(source)) AS size FROM (SELECT id, title, source, CASE WHEN id % 2 = 0 THEN octet_length(encode(source)) + 400 ELSE 0 END AS raw_size FROM {V.CHAPTERS}))
  LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT unnest(chapters) AS k FROM {GLOSSARY}) GROUP BY k) t ON t.k = id
  LEFT JOIN (SELECT chapter_id AS k, count(*) AS n FROM {V.FOUND} WHERE chapter_id % 3 = 1 GROUP BY k) c ON c.k = id
  LEFT JOIN (SELECT chapter_id AS k, count(*) AS n FROM {V.STRESS} GROUP BY k) x ON x.k = id)"""


def batch_outcomes(s, d):
    rows = batch_files.parse_results(V.result_lines(s, d))
    return context.outcomes(rows, "translate").select("custom_id", "chapter_id", "content", "error", "outcome")


def run_counts(s, d):
    return context.run_counts(context.outcomes(batch_files.parse_results(V.result_lines(s, d)), "translate"))


def requests(s, d):
    c = V.chapters(s, d)
    rows = context.requests(c, "translate", context.translation_instructions("en", "ru"), context.translation_prompt(F.col("title"), F.col("source"), F.lit(""), F.lit("")), "m", max_tokens=100)
    v = batch_files.request_lines(rows)
    read = F.from_json("value", "custom_id string, method string, url string, body struct<instructions:string,max_output_tokens:long,model:string,input:array<struct<content:string,role:string>>>")
    return v.select(read.alias("r")).select("r.custom_id", "r.method", "r.url", "r.body.model", "r.body.max_output_tokens", F.md5(F.col("r.body.input")[0]["content"]).alias("input"))


QUERIES = {
    "g2_by_toc": split_chapters("toc"),
    "g3_by_headings": split_chapters("heading"),
    "g4_per_item": split_chapters("per-item"),
    "g1_split_index": split_index,
    "g2_skipped": skipped,
    "j1_spine": lambda s, d: segment.spine_rows(V.items(s, d).select("book", "spine_index", "id", F.lit(True).alias("linear")), V.items(s, d).where("spine_index % 7 <> 0").select("book", "id", "href", F.lit("text/html").alias("media_type"))).select("book", "spine_index", "id", "href"),
    "s13_split_input": lambda s, d: segment.split_input(V.items(s, d).drop("blocks"), V.items(s, d).where("spine_index % 3 = 0")).select("book", "spine_index", F.size("blocks").cast("long").alias("n")),
    "a18_blocks_text": lambda s, d: V.items(s, d).select("spine_index", F.md5(segment.blocks_text(F.col("blocks"))).alias("text"), segment.first_heading(F.col("blocks")).alias("heading")),
    "a1_term_chapters": lambda s, d: vocab.chapters_of(V.found_terms(s, d), existing(s, d), "source").select("key", joined(F.col("chapters")).alias("chapters")),
    "a5_merged_terms": lambda s, d: vocab.merged_terms(existing(s, d), new_terms(s, d)).select("source", "target", "type", "added"),
    "a6_merged_characters": merged_characters,
    "a7_stress_store": stress_store,
    "a7_stress_conflicts": lambda s, d: stress_conflicts(s, d).select("merge", "term", F.array_join("variants", ",").alias("variants")),
    "a8_chapter_tags": lambda s, d: vocab.with_chapter_tags(vocab.merged_stress(V.stress_forms(s, d))[0].drop("merge"), V.stress_forms(s, d).select("term", "ord", F.col("chapters")[0].alias("chapter_id"))).select("term", joined(F.array_sort("chapters")).alias("chapters")),
    "a9_stored_order": lambda s, d: vocab.stored_order(vocab.merged_stress(V.stress_forms(s, d))[0]).select("term", "ord"),
    "a10_unique_variants": lambda s, d: V.read(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.when(x["turn"] % 2 == 0, F.upper(x["role"])).otherwise(x["role"])).alias("v")).select("conv_id", F.array_join(vocab.unique_variants(F.col("v")), ",").alias("variants")),
    "a11_conflicts": lambda s, d: vocab.deduplicated_conflicts(stress_conflicts(s, d)).select("term", F.array_join("variants", ",").alias("variants")),
    "a12_resolved": resolved,
    "a13_counts": lambda s, d: vocab.counts_by_chapter(glossary(s, d)),
    "a14_totals": lambda s, d: overview.totals(overview_rows(s, d)),
    "j12_overview": lambda s, d: overview_rows(s, d),
    "k17_table_lines": lambda s, d: overview.table_lines(overview_rows(s, d)),
    "a16_prompt_blocks": lambda s, d: context.prompt_blocks(context.terms_of_chapters(glossary(s, d), chapter_ids(s, d))).select("chapter_id", F.md5("block").alias("block")),
    "a17_locked_terms": lambda s, d: context.locked_terms(overrides(s, d).withColumn("kind", F.when(F.col("type") == "place", "term").otherwise("character"))).select(F.md5("locked").alias("locked")),
    "a20_run_counts": run_counts,
    "j4_looked_up": lambda s, d: vocab.looked_up(V.words(s, d).select("item_id", "k", F.lower("word").alias("word")), "word", glossary(s, d).select("ord", "source", "target"), "source").select("item_id", "k", "target"),
    "j5_with_characters": lambda s, d: vocab.with_characters(glossary(s, d), characters(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("chapters")).alias("tags")),
    "j6_tagged": lambda s, d: glossary(s, d).select("source", joined(F.col("chapters")).alias("chapters")),
    "j7_overrides": lambda s, d: vocab.overridden(glossary(s, d), overrides(s, d), "source", "target", "type", "term").select("source", "target", "type"),
    "j8_stress_overrides": lambda s, d: vocab.overridden(vocab.merged_stress(V.stress_forms(s, d))[0].drop("merge"), overrides(s, d), "term", "stressed").select("term", "stressed"),
    "j9_violations": violations,
    "j9_occurrences": occurrences,
    "j9_by_pieces": occurrences_by_pieces,
    "j9_all_lengths": occurrences_of_all_lengths,
    "j9_all_lengths_automaton": automaton_of_all_lengths,
    "j10_warning_chapters": warning_chapters,
    "j11_chapter_terms": lambda s, d: context.terms_of_chapters(glossary(s, d), chapter_ids(s, d)).select("chapter_id", "source"),
    "p4_chapter_filter": lambda s, d: chapter_ids(s, d).where(within(F.col("id"), chapter_filter(5, "10-20", 1000))),
    "p5_pending": lambda s, d: batches.pending(chapter_ids(s, d), translations(s, d)),
    "p6_pending_stress": lambda s, d: batches.pending_stress(chapter_ids(s, d), translations(s, d), chapter_ids(s, d).where("id % 5 = 0")),
    "p7_processed": lambda s, d: vocab.processed(chapter_ids(s, d), V.stress_forms(s, d), [500, 501]),
    "p9_batch_ends": lambda s, d: V.read(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "expired").otherwise("in_progress").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n")).select("status", "n", batches.is_terminal(F.col("status")).alias("terminal"), F.when(batches.is_terminal(F.col("status")), F.coalesce(batches.terminal_error(F.col("status")), F.lit(""))).otherwise("").alias("error")),
    "p16_sanitized": lambda s, d: vocab.sanitized(V.stress_forms(s, d).withColumn("stressed", F.translate("stressed", "aeiou", "аеиоу"))).groupBy("merge").agg(F.count(F.lit(1)).alias("n")),
    "p17_prompt_pages": lambda s, d: context.prompt_pages(glossary(s, d), ("source", "target", "type"), 1000).select("page", F.octet_length("json").cast("long").alias("bytes"), F.md5("json").alias("json")),
    "a17_locked_pages": lambda s, d: context.locked_pages(glossary(s, d).withColumn("kind", F.col("type")), 500).select("page", F.md5("locked").alias("locked")),
    "a16_block_pages": lambda s, d: context.block_pages(glossary(s, d), ("type",), 700).select("type", "page", F.md5("block").alias("block")),
    "p17_for_prompt": lambda s, d: context.for_prompt(glossary(s, d), ("source", "target", "type")).select(F.md5("json").alias("json")),
    "a13_stress_counts": lambda s, d: vocab.counts_by_chapter(V.stress_forms(s, d)),
    "s18_batch_results": batch_outcomes,
    "t25_requests": requests,
    "w1_previous_summaries": summary_context,
    "w5_log_warnings": log_warnings,
    "x5_status": lambda s, d: batches.status_of(chapter_ids(s, d), translations(s, d), translations(s, d).where("chapter_id % 2 = 0"), translations(s, d).where("chapter_id % 4 = 0")).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    "x10_problems": problem_words,
    "s11_html_blocks": lambda s, d: exploded(with_blocks(V.read(s, d, "pages").select("page_id", "html"))).groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("length")),
    "t27_custom_ids": lambda s, d: V.chapters(s, d).select(custom_id("analyze", F.col("id")).alias("custom_id"), basename(F.concat(F.lit("a\\b/"), F.col("title"))).alias("name")),
}

def _skipped_sql() -> str:
    from ..functions.titles import classify_sql

    reason = "CASE WHEN c LIKE 'SKIP/%' THEN substr(c, 6) WHEN c LIKE 'KEEP/%' THEN substr(c, 6) ELSE 'ambiguous-default-skip' END"
    toc = f"SELECT book, 'toc' AS strategy, {reason} AS reason FROM (SELECT book, {classify_sql('title')} AS c FROM {V.TOC}) WHERE c NOT LIKE 'KEEP/%'"
    early = f"SELECT book, spine_index, coalesce(nullif(coalesce(arg_min(text, block_index) FILTER (kind = 'heading'), ''), ''), 'item' || spine_index::VARCHAR) AS title FROM {_STARTS} GROUP BY book, spine_index HAVING max(segment) = 0"
    heading = f"SELECT book, 'heading' AS strategy, {reason} AS reason FROM (SELECT book, {classify_sql('title')} AS c FROM ({early}))"
    return f"SELECT book, strategy, reason, count(*) AS n FROM ({toc} UNION ALL {heading}) GROUP BY ALL"


def _index_sql() -> str:
    n = lambda sql, name: f"LEFT JOIN (SELECT book, count(*) AS {name} FROM ({sql}) GROUP BY book) USING (book)"
    heading = f"SELECT book FROM (SELECT book, segment, count(*) FILTER (NOT starts) AS n FROM {_STARTS} WHERE segment > 0 GROUP BY book, segment) WHERE n > 0"
    counts = f"(SELECT book, coalesce(t, 0) AS t, coalesce(h, 0) AS h, i FROM (SELECT source AS book, count(*) AS i FROM documents GROUP BY source) {n(_toc_sql(), 't')} {n(heading, 'h')})"
    return f"SELECT book, CASE WHEN t >= 2 THEN t WHEN h >= 2 THEN h ELSE i END::INT AS chapter_count, 0 AS start_id, CASE WHEN t >= 2 THEN 'toc' WHEN h >= 2 THEN 'heading' ELSE 'per-item' END AS strategy, (t < 2 AND h < 2)::INT AS warnings FROM {counts}"


_ONE_CONFLICT = f"(SELECT key, term, list(form ORDER BY p) AS forms FROM (SELECT key, lower(form), arg_min(form, p) AS form, min(p) AS p FROM (SELECT key, unnest([base, form]) AS form, unnest([0, 1]) + 10 * (merge::BIGINT * 1000000000 + ord) AS p FROM {_CONFLICTS}) GROUP BY key, lower(form)) JOIN (SELECT key, arg_min(term, merge::BIGINT * 1000000000 + ord) AS term FROM {_CONFLICTS} GROUP BY key) USING (key) GROUP BY key, term)"
_ALL_LENGTHS = r"""WITH w AS (SELECT regexp_extract_all(text, '\pL+') AS w FROM benchmark),
  t AS (SELECT DISTINCT lower(unnest(w || list_filter(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' ')), lambda x: length(x) BETWEEN 1 AND 40))) AS word FROM w)
  SELECT word, count(*) AS n FROM t JOIN documents ON contains(lower(text), word) GROUP BY word"""
ORACLE_SQL = {
    "g1_split_index": _index_sql(),
    "g2_skipped": _skipped_sql(),
    "a12_resolved": f"SELECT b.term AS term, coalesce(form, b.stressed) AS stressed, b.approved OR form IS NOT NULL AS approved FROM {_BASE} LEFT JOIN (SELECT key AS k, CASE WHEN length(term) % 3 = 0 THEN '' ELSE forms[-1] END AS form FROM {_ONE_CONFLICT}) ON key = k WHERE form IS NULL OR form <> ''",
    "g2_by_toc": _toc_sql(),
    "g3_by_headings": f"SELECT book, (100 + row_number() OVER (PARTITION BY book ORDER BY segment))::INT AS id, title, source, section_ids FROM (SELECT book, segment, arg_min(text, spine_index * 100000 + block_index) FILTER (starts) AS title, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY spine_index, block_index) FILTER (text <> '' AND NOT starts), '')) AS source, array_to_string(list_transform(list_sort(list_distinct(list(spine_index))), lambda x: 'item' || x::VARCHAR), ',') AS section_ids, count(*) FILTER (NOT starts) AS n FROM {_STARTS} WHERE segment > 0 GROUP BY book, segment) WHERE n > 0",
    "g4_per_item": f"SELECT book, row_number() OVER (PARTITION BY book ORDER BY spine_index)::INT AS id, CASE WHEN title = '' THEN {_ITEM} ELSE title END AS title, source, {_ITEM} AS section_ids FROM (SELECT book, spine_index, coalesce(arg_min(text, block_index) FILTER (kind = 'heading'), '') AS title, md5(coalesce({_TEXT}, '')) AS source FROM {V.BLOCKS} GROUP BY ALL)",
    "j1_spine": "SELECT source AS book, doc_id AS spine_index, 'item' || doc_id::VARCHAR AS id, 'text/item' || doc_id::VARCHAR || '.xhtml' AS href FROM documents WHERE doc_id % 7 <> 0",
    "s13_split_input": "SELECT source AS book, doc_id AS spine_index, CASE WHEN doc_id % 3 = 0 THEN len(string_split(text, chr(10))) ELSE 0 END AS n FROM documents",
    "a18_blocks_text": f"SELECT spine_index, md5(coalesce({_TEXT}, '')) AS text, coalesce(arg_min(text, block_index) FILTER (kind = 'heading'), '') AS heading FROM {V.BLOCKS} GROUP BY spine_index",
    "a1_term_chapters": f"SELECT key, array_to_string(list(chapter_id ORDER BY side, o), ',') AS chapters FROM (SELECT key, chapter_id, min(side) AS side, arg_min(ord, side * 10000000000 + ord) AS o FROM (SELECT lower(source) AS key, chapter_id, ord, 0 AS side FROM {V.FOUND} UNION ALL SELECT lower(source), chapter_id, ord, 1 FROM {V.FOUND} WHERE (chapter_id - 1) % 3 = 0) GROUP BY ALL) GROUP BY key",
    "a5_merged_terms": f"SELECT source, target, type, p >= 1000000000 AS added FROM {_FIRST}",
    "a6_merged_characters": f"SELECT arg_min(source, p) AS name, coalesce(arg_min(target, p) FILTER (target <> ''), '') AS translation, coalesce(arg_min(role, p) FILTER (role <> ''), '') AS role, arg_min(chapter_id, p)::VARCHAR AS chapters, min(p) >= 1000000000 AS added FROM (SELECT *, {_ROLE} AS role, (chapter_id % 3 <> 1)::BIGINT * 1000000000 + ord AS p FROM {V.FOUND}) GROUP BY lower(source)",
    "a7_stress_store": f"SELECT b.term AS term, b.stressed AS stressed, b.approved AS approved, (p // 1000000000)::INT AS merge, p % 1000000000 AS ord FROM {_BASE}",
    "a7_stress_conflicts": f"SELECT merge::INT AS merge, term, base || ',' || form AS variants FROM {_CONFLICTS}",
    "a8_chapter_tags": f"SELECT b.term AS term, c AS chapters FROM {_BASE} JOIN (SELECT lower(term) AS k, array_to_string(list_sort(list_distinct(list(chapter_id))), ',') AS c FROM {V.STRESS} GROUP BY k) ON key = k",
    "a9_stored_order": f"SELECT b.term AS term, (row_number() OVER (ORDER BY octet_length(encode(b.term)) DESC, p % 1000000000) - 1)::INT AS ord FROM {_BASE}",
    "a10_unique_variants": "SELECT conv_id, string_agg(v, ',' ORDER BY t) AS variants FROM (SELECT conv_id, min(turn) AS t, arg_min(CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END, turn) AS v FROM conversations GROUP BY conv_id, lower(role)) GROUP BY conv_id",
    "a11_conflicts": f"SELECT term, string_agg(form, ',' ORDER BY p) AS variants FROM (SELECT key, lower(form), arg_min(form, p) AS form, min(p) AS p FROM (SELECT key, unnest([base, form]) AS form, unnest([0, 1]) + 10 * (merge::BIGINT * 1000000000 + ord) AS p FROM {_CONFLICTS}) GROUP BY key, lower(form)) JOIN (SELECT key, arg_min(term, merge::BIGINT * 1000000000 + ord) AS term FROM {_CONFLICTS} GROUP BY key) USING (key) GROUP BY key, term",
    "a13_counts": f"SELECT chapter_id::INT AS chapter_id, count(*) AS n FROM (SELECT unnest(chapters) AS chapter_id FROM {GLOSSARY}) GROUP BY ALL",
    "a14_totals": f"SELECT count(*) AS chapters, count(*) FILTER (short) AS short, count(*) FILTER (large) AS stripped, count(translated) AS translated, count(*) FILTER (ssml) AS ssml, count(*) FILTER (audio) AS audio FROM {_OVERVIEW}",
    "j12_overview": f"SELECT * FROM {_OVERVIEW}",
    "k17_table_lines": f"""SELECT id, printf('%-4d  %-8s  %-8s  %-7s  %-6d  %-6d  %-7d  %-9s  %-5s  %-5s  %s', id, CASE WHEN raw_size > 0 THEN raw_size::VARCHAR ELSE '-' END, size::VARCHAR || CASE WHEN short THEN ' (!)' ELSE '' END, coalesce(diff::VARCHAR, '-') || CASE WHEN large THEN '!' ELSE '' END,
  terms, characters, stress, coalesce(translated::VARCHAR, '-'), CASE WHEN ssml THEN 'yes' ELSE '-' END, CASE WHEN audio THEN 'yes' ELSE '-' END,
  CASE WHEN octet_length(encode(title)) > {overview.TITLE} THEN list_max([CASE WHEN octet_length(encode(substr(title, 1, n))) <= {overview.TITLE} THEN substr(title, 1, n) END for n in range(0, {overview.TITLE} + 1)]) || '...' ELSE title END) AS line FROM {_OVERVIEW}""",
    "a16_prompt_blocks": f"SELECT chapter_id::BIGINT AS chapter_id, md5('{context.GLOSSARY_HEAD.strip()}' || chr(10) || string_agg(lines, '' ORDER BY rank, type)) AS block FROM (SELECT chapter_id, rank, type, chr(10) || '[' || type || ']' || chr(10) || string_agg('  ' || source || ' = ' || target || chr(10), '' ORDER BY ord) AS lines FROM (SELECT unnest(chapters) AS chapter_id, source, target, type, ord, coalesce(nullif(list_position({list(context.TYPES)}, type), 0), 6) AS rank FROM {GLOSSARY}) WHERE chapter_id IN (SELECT doc_id + 1 FROM documents) GROUP BY chapter_id, rank, type) GROUP BY chapter_id",
    "a17_locked_terms": f"SELECT md5(string_agg('  ' || source || ' = ' || target || chr(10), '' ORDER BY type = 'place', ord)) AS locked FROM (SELECT * FROM {_OVER} UNION ALL SELECT 1000000000, 'Nobody', 'Nikto', '')",
    "a20_run_counts": "SELECT count(*) FILTER (k IN (0)) AS processed, count(*) FILTER (k IN (1, 2, 3, 4)) AS failed, count(*) FILTER (k = 5) AS unrecognised FROM (SELECT doc_id % 6 AS k FROM documents)",
    "j4_looked_up": f"SELECT item_id, k, g.target AS target FROM {V.WORDS} w LEFT JOIN {GLOSSARY} g ON lower(w.word) = lower(g.source)",
    "j5_with_characters": f"SELECT type, count(*) AS n, sum(t) AS tags FROM (SELECT 'character' AS type, 1 AS t FROM {V.FOUND} WHERE chapter_id % 3 = 1 AND target <> '' UNION ALL SELECT type, len(chapters) FROM {GLOSSARY} WHERE type <> 'character' AND lower(source) NOT IN (SELECT lower(source) FROM {V.FOUND} WHERE chapter_id % 3 = 1 AND target <> '')) GROUP BY type",
    "j6_tagged": f"SELECT source, array_to_string(chapters, ',') AS chapters FROM {GLOSSARY}",
    "j7_overrides": f"SELECT g.source AS source, coalesce(o.target, g.target) AS target, CASE WHEN o.type <> '' THEN o.type ELSE g.type END AS type FROM {GLOSSARY} g LEFT JOIN (SELECT lower(source) AS k, arg_min(target, ord) AS target, arg_min(type, ord) AS type FROM {_OVER} GROUP BY k) o ON lower(g.source) = k UNION ALL SELECT 'Nobody', 'Nikto', 'term' UNION ALL SELECT arg_min(source, ord), arg_min(target, ord), arg_min(CASE WHEN type = '' THEN 'term' ELSE type END, ord) FROM {_OVER} WHERE lower(source) NOT IN (SELECT lower(source) FROM {GLOSSARY}) GROUP BY lower(source)",
    "j8_stress_overrides": f"SELECT b.term AS term, coalesce(o.target, b.stressed) AS stressed FROM {_BASE} LEFT JOIN (SELECT lower(source) AS k, arg_min(target, ord) AS target FROM {_OVER} GROUP BY k) o ON key = k UNION ALL SELECT 'Nobody', 'Nikto'",
    "j9_violations": f"SELECT c.id AS chapter_id, g.source AS source_term, g.target AS expected_target, g.source AS found_in_translation FROM {V.CHAPTERS} c JOIN {GLOSSARY} g ON contains(lower(c.source), lower(g.source)) WHERE c.id % 3 <> 0",
    "j9_occurrences": f"SELECT word, count(*) AS n FROM (SELECT DISTINCT lower(word) AS word FROM {V.WORDS}) JOIN documents ON contains(lower(text), word) GROUP BY word",
    "j9_by_pieces": f"SELECT word, count(*) AS n FROM (SELECT DISTINCT lower(word) AS word FROM {V.WORDS}) JOIN documents ON contains(lower(text), word) GROUP BY word",
    "j9_all_lengths": _ALL_LENGTHS,
    "j9_all_lengths_automaton": _ALL_LENGTHS,
    "j10_warning_chapters": "SELECT w.doc_id AS first_line, min(d.doc_id) AS chapter_id FROM (SELECT doc_id, lower(substr(split_part(text, chr(10), 1), 1, 40)) AS q FROM documents) w JOIN documents d ON contains(lower(d.text), q) WHERE q <> '' GROUP BY ALL",
    "j11_chapter_terms": f"SELECT chapter_id::BIGINT AS chapter_id, source FROM (SELECT unnest(chapters) AS chapter_id, source FROM {GLOSSARY}) WHERE chapter_id IN (SELECT doc_id + 1 FROM documents)",
    "p4_chapter_filter": "SELECT doc_id + 1 AS id FROM documents WHERE doc_id + 1 = 5 OR doc_id + 1 BETWEEN 10 AND 20",
    "p5_pending": "SELECT doc_id + 1 AS id FROM documents WHERE (doc_id + 1) % 3 = 0",
    "p6_pending_stress": "SELECT doc_id + 1 AS id FROM documents WHERE (doc_id + 1) % 3 <> 0 AND (doc_id + 1) % 5 <> 0",
    "p7_processed": f"SELECT doc_id + 1 AS id, doc_id + 1 IN (500, 501) OR doc_id + 1 IN (SELECT chapter_id FROM {V.STRESS}) AS processed FROM documents",
    "p9_batch_ends": "SELECT status, n, status <> 'in_progress' AS terminal, CASE status WHEN 'expired' THEN 'batch expired before it was completed' ELSE '' END AS error FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'expired' ELSE 'in_progress' END AS status, count(*) AS n FROM orders GROUP BY ALL)",
    "p16_sanitized": f"SELECT merge::INT AS merge, count(*) AS n FROM {V.STRESS} WHERE regexp_matches(translate(stressed, 'aeiou', 'аеиоу'), '\\+[аеёиоуыэюяАЕЁИОУЫЭЮЯ]') GROUP BY ALL",
    "p17_prompt_pages": f"""WITH l AS (SELECT ord, '{{"source":"' || source || '","target":"' || target || '","type":"' || type || '"}}' AS line FROM {GLOSSARY}),
  b AS (SELECT ord, line, octet_length(encode(line)) + 1 AS n, coalesce(sum(octet_length(encode(line)) + 1) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
  p AS (SELECT before // 499 AS w, n > 499 AS alone, '[' || string_agg(line, ',' ORDER BY ord) || ']' AS json FROM b GROUP BY ALL)
  SELECT row_number() OVER (ORDER BY w, alone) AS page, octet_length(encode(json))::BIGINT AS bytes, md5(json) AS json FROM p""",
    "a17_locked_pages": f"""WITH l AS (SELECT type <> 'character' AS k, ord, '  ' || source || ' = ' || target || chr(10) AS line FROM {GLOSSARY} WHERE source <> '' AND target <> ''),
  b AS (SELECT k, ord, line, octet_length(encode(line)) AS n, coalesce(sum(octet_length(encode(line))) OVER (ORDER BY k, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
  p AS (SELECT before // 250 AS w, n > 250 AS alone, string_agg(line, '' ORDER BY k, ord) AS locked FROM b GROUP BY ALL)
  SELECT row_number() OVER (ORDER BY w, alone) AS page, md5(locked) AS locked FROM p""",
    "a16_block_pages": f"""WITH l AS (SELECT type, ord, CASE WHEN ord = min(ord) OVER (PARTITION BY type) THEN '{context.GLOSSARY_HEAD.strip()}' || chr(10) || chr(10) || '[' || type || ']' || chr(10) ELSE '' END || '  ' || source || ' = ' || target || chr(10) AS line FROM {GLOSSARY}),
  b AS (SELECT *, octet_length(encode(line)) AS n, coalesce(sum(octet_length(encode(line))) OVER (PARTITION BY type ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
  p AS (SELECT type, before // 350 AS w, n > 350 AS alone, string_agg(line, '' ORDER BY ord) AS block FROM b GROUP BY ALL)
  SELECT type, row_number() OVER (PARTITION BY type ORDER BY w, alone) AS page, md5(block) AS block FROM p""",
    "p17_for_prompt": f"""SELECT md5('[' || string_agg('{{"source":"' || source || '","target":"' || target || '","type":"' || type || '"}}', ',' ORDER BY ord) || ']') AS json FROM {GLOSSARY}""",
    "a13_stress_counts": f"SELECT chapter_id::INT AS chapter_id, count(*) AS n FROM {V.STRESS} GROUP BY ALL",
    "s18_batch_results": "SELECT CASE k WHEN 5 THEN 'other-' ELSE 'translate-chapter-' END || (doc_id + 1)::VARCHAR AS custom_id, CASE WHEN k = 5 THEN 0 ELSE doc_id + 1 END::INT AS chapter_id, CASE WHEN k IN (0, 5) THEN t ELSE '' END AS content, CASE k WHEN 1 THEN 'limit: too many' WHEN 2 THEN 'no response in output line' WHEN 3 THEN 'HTTP 500: ' || '{\"output\":[{\"type\":\"message\",\"content\":[{\"type\":\"output_text\",\"text\":' || to_json(t)::VARCHAR || '}]}]}' WHEN 4 THEN 'empty output text' ELSE '' END AS error, CASE k WHEN 0 THEN 'ok' WHEN 5 THEN 'unrecognised' ELSE 'failed' END AS outcome FROM (SELECT doc_id, doc_id % 6 AS k, split_part(text, chr(10), 1) AS t FROM documents)",
    "t25_requests": f"SELECT 'translate-chapter-' || id::VARCHAR AS custom_id, 'POST' AS method, '/v1/responses' AS url, 'm' AS model, 100::BIGINT AS max_output_tokens, md5('=== Chapter ===' || chr(10) || title || chr(10) || chr(10) || source) AS input FROM {V.CHAPTERS}",
    "w1_previous_summaries": f"SELECT conv_id, chapter_id, CASE WHEN chapter_id <= 1 OR len(l) = 0 THEN '' ELSE '{context.CONTEXT_HEAD.strip()}' || chr(10) || chr(10) || array_to_string(l, chr(10) || chr(10)) END AS context FROM (SELECT conv_id, chapter_id, list_filter(coalesce(list(CASE WHEN summary <> '' AND chapter_id >= 1 THEN '[Chapter ' || chapter_id::VARCHAR || ' summary]' || chr(10) || summary END) OVER (PARTITION BY conv_id ORDER BY chapter_id RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), []), lambda x: x IS NOT NULL) AS l FROM {V.SUMMARIES})",
    "w5_log_warnings": f"SELECT first_line, md5(entry) AS entry, substr(regexp_replace(regexp_extract(entry, 'for text ''([^'']*)''', 1), '<[^>]*>', '', 'g'), 1, 40) AS snippet FROM (SELECT min(line_no) AS first_line, {TRIM.format('string_agg(line, chr(10) ORDER BY line_no)')} AS entry, arg_min(warn, line_no) AS w FROM {_LOGGED} WHERE entry_no > 0 GROUP BY entry_no) WHERE w",
    "x5_status": "SELECT CASE WHEN t AND i % 4 = 0 THEN 'audio' WHEN t AND i % 2 = 0 THEN 'ssml' WHEN t THEN 'translated' ELSE 'raw' END AS status, count(*) AS n FROM (SELECT doc_id + 1 AS i, (doc_id + 1) % 3 <> 0 AS t FROM documents) GROUP BY ALL",
    "x10_problems": "SELECT doc_id + 1 AS chapter_id, len(list_distinct(list_filter(regexp_extract_all(text, '\\pL+'), lambda x: regexp_matches(x, '[A-Za-z]')))) AS words, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[\\p{Cyrillic}A-Za-z]', '', 'g'), '\\pL'))), '') AS symbols FROM documents WHERE (doc_id + 1) % 3 <> 0 AND regexp_matches(text, '\\pL')",
    "t27_custom_ids": f"SELECT 'analyze-chapter-' || id::VARCHAR AS custom_id, regexp_extract(title, '([^/\\\\]*)$', 1) AS name FROM {V.CHAPTERS}",
}
