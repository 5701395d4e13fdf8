"""Context of requests: summaries of the chapters before, glossaries by chapter, prompts, requests and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chapter_of, custom_id
from ..schemas import EXTRACTION
from ..shared import kept
from .scan import numbered, running
from .vocab import looked_up  # noqa: F401  part of this module's surface

#: Types of terms in the order of a prompt; others follow by name.
TYPES = ("character", "place", "organization", "title", "term")
# Headings of the blocks that requests are made of.
GLOSSARY_HEAD = "=== Glossary (use these translations consistently) ===\n"
CONTEXT_HEAD = "=== Previous chapter context ===\n\n"


def previous_summaries(summaries: DataFrame, count: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """summaries (.., chapter_id, summary) with ``context``: the labelled summaries of the ``count`` numbers before, gaps not
    filled from further back; empty for the first chapter."""
    if count <= 0:
        return summaries.withColumn("context", F.lit(""))
    label = F.concat(F.lit("[Chapter "), F.col("chapter_id").cast("string"), F.lit(" summary]\n"), F.col("summary"))
    # Each summary goes to the numbers after it, so chapters meet by number and no window holds a whole book.
    told = summaries.where((F.col("summary") != "") & (F.col("chapter_id") >= 1)).select(*by, F.struct("chapter_id", label.alias("text")).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("step"))
    told = told.groupBy(*(F.col(b).alias(f"__{b}") for b in by), (F.col("x.chapter_id") + F.col("step")).alias("__for")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n\n").alias("__told"))
    same = F.col("chapter_id") == F.col("__for")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    rows = summaries.join(told, same, "left")
    return rows.select(*summaries.columns, F.when((F.col("chapter_id") <= 1) | F.col("__told").isNull(), "").otherwise(F.concat(F.lit(CONTEXT_HEAD), F.col("__told"))).alias("context"))


def terms_of_chapters(terms: DataFrame, chapters: DataFrame) -> DataFrame:
    """(chapter_id, term columns) for each chapter (id) that a term is tagged with; untagged terms are in none."""
    exploded = terms.withColumn("chapter_id", F.explode(F.array_distinct("chapters")))
    return exploded.join(chapters.select(F.col("id").alias("chapter_id")).distinct(), "chapter_id")


def prompt_blocks(terms: DataFrame, by: tuple[str, ...] = ("chapter_id",)) -> DataFrame:
    """One text block for each group: terms by type, in order within it."""
    rank = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    rank = F.when(rank > 0, rank).otherwise(len(TYPES) + 1)
    line = F.concat(F.lit("  "), F.col("source"), F.lit(" = "), F.col("target"), F.lit("\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "")
    typed = terms.withColumn("rank", rank).groupBy(*by, "rank", "type").agg(lines.alias("lines"))
    section = F.concat(F.lit("\n["), F.col("type"), F.lit("]\n"), F.col("lines"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "type", section.alias("s")))), lambda x: x["s"]), "")
    return typed.groupBy(*by).agg(F.concat(F.lit(GLOSSARY_HEAD), body).alias("block"))


def locked_terms(overrides: DataFrame) -> DataFrame:
    """One row, locked: lines of overrides (kind character before term, ord) that have both sides."""
    line = F.concat(F.lit("  "), F.col("source"), F.lit(" = "), F.col("target"), F.lit("\n"))
    rows = overrides.where((F.col("source") != "") & (F.col("target") != "")).select(F.struct((F.col("kind") != "character").alias("k"), "ord", line.alias("line")).alias("x"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "").alias("locked"))


def for_prompt(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row, json: the rows as a JSON array of these columns, in order; bookkeeping stays out."""
    fields = F.struct("ord", F.struct(*columns).alias("v"))
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x["v"])).alias("json"))


#: Most bytes of a page of a list.
PAGE = 64 << 10


def paged(rows: DataFrame, line: Column, order: list[str], by: tuple[str, ...] = (), most: int = PAGE, between: str = "") -> DataFrame:
    """(by.., page, text): the lines of each group in their order, joined, in pages of at most ``most`` bytes (``between`` counted). Where a
    page begins follows from how many bytes come before, which a scan by ranges sums up, so a list of any length is many tasks. A line
    of more than half a page is a page of its own, and one that is longer than a page stays whole."""
    half = most // 2
    size = F.octet_length("line") + len(between.encode())
    lines = rows.select(*by, *order, line.alias("line"))
    placed = running(lines, list(by), order, inclusive=False, before=("sum", size.cast("long")))
    # At most one such line begins within half a page, and none after it.
    placed = placed.withColumn("cut", F.struct(F.expr(f"before div {half}").alias("window"), (size > half).alias("alone")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("before", *order, "line"))), lambda x: x["line"]), between)
    pages = kept(placed.groupBy(*by, "cut").agg(text.alias("text")))
    return pages.join(numbered(pages.select(*by, "cut"), list(by), ["cut"]).withColumnRenamed("number", "page"), [*by, "cut"]).select(*by, "page", "text")


def locked_pages(overrides: DataFrame, most: int = PAGE) -> DataFrame:
    """(page, locked): the lines of ``locked_terms`` in pages; joined they are its text."""
    line = F.concat(F.lit("  "), F.col("source"), F.lit(" = "), F.col("target"), F.lit("\n"))
    rows = overrides.where((F.col("source") != "") & (F.col("target") != "")).withColumn("k", F.col("kind") != "character")
    return paged(rows, line, ["k", "ord"], most=most).withColumnRenamed("text", "locked")


def prompt_pages(rows: DataFrame, columns: tuple[str, ...], most: int = PAGE) -> DataFrame:
    """(page, json): the rows of ``for_prompt`` in pages, each a JSON array; their elements in turn are its elements."""
    pages = paged(rows, F.to_json(F.struct(*columns)), ["ord"], most=most - 2, between=",")
    return pages.select("page", F.concat(F.lit("["), F.col("text"), F.lit("]")).alias("json"))


def block_pages(terms: DataFrame, by: tuple[str, ...] = ("chapter_id",), most: int = PAGE) -> DataFrame:
    """(by.., page, block): the text of ``prompt_blocks`` in pages, cut between lines; a type's heading goes with its first term."""
    rank = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    rows = terms.withColumn("rank", F.when(rank > 0, rank).otherwise(len(TYPES) + 1))
    typed = list(dict.fromkeys([*by, "rank", "type"]))
    first = rows.groupBy(*typed).agg(F.min("ord").alias("first"))
    top = first.groupBy(*by).agg(F.min(F.struct("rank", "type")).alias("top"))
    rows = rows.join(first, typed).join(top, [*by])
    head = F.when(F.col("ord") == F.col("first"), F.concat(F.when(F.struct("rank", "type") == F.col("top"), F.lit(GLOSSARY_HEAD)).otherwise(""), F.lit("\n["), F.col("type"), F.lit("]\n"))).otherwise("")
    line = F.concat(head, F.lit("  "), F.col("source"), F.lit(" = "), F.col("target"), F.lit("\n"))
    return paged(rows, line, [*typed[len(by) :], "ord"], by, most).withColumnRenamed("text", "block")


# Prompts. Wording is free; what matters is which parts stand in them and when.


def extraction_prompt(title: Column, source: Column, locked: str = "", target: str = "ru") -> Column:
    fixed = f"Use exactly these translations:\n{locked}\n" if locked else ""
    head = f"List the characters, names and recurring terms of this chapter with translations into {target}, and summarise it. Answer as JSON with characters, terms and summary.\n{fixed}"
    return F.concat(F.lit(head), F.lit("Title: "), title, F.lit("\n\n"), source)


def translation_instructions(source: str, target: str) -> str:
    return f"Translate from {source} to {target}. Keep paragraphs and tone. Answer with the translation only."


def translation_prompt(title: Column, source: Column, glossary: Column, context: Column) -> Column:
    part = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(c, F.lit("\n\n"))).otherwise("")
    return F.concat(part(glossary), part(context), F.lit("=== Chapter ===\n"), title, F.lit("\n\n"), source)


def summary_prompt(source: Column) -> Column:
    return F.concat(F.lit("Summarise this chapter in a few sentences.\n\n"), source)


def new_terms_prompt(source: Column, known: Column) -> Column:
    return F.concat(F.lit("List names and terms of this text that are not known yet. Known:\n"), known, F.lit("\n\n"), source)


def merge_prompt(characters: Column, terms: Column, locked: str = "") -> Column:
    fixed = f"Use exactly these translations:\n{locked}\n" if locked else ""
    return F.concat(F.lit(f"Unify these lists from all chapters. Answer as JSON with characters and terms.\n{fixed}Characters:\n"), characters, F.lit("\nTerms:\n"), terms)


def stress_prompt(text: Column, known: Column) -> Column:
    return F.concat(F.lit("Give words whose stress is not obvious, a plus sign in front of the stressed vowel. Answer as JSON with entries. Known:\n"), known, F.lit("\n\n"), text)


def requests(chapters: DataFrame, prefix: str, instructions: str, text: Column, model: str, json_mode: bool = False, max_tokens: int = 0) -> DataFrame:
    """One request for each chapter (id)."""
    return chapters.select(custom_id(prefix, F.col("id")).alias("custom_id"), F.lit(instructions).alias("instructions"), text.alias("input"), F.lit(model).alias("model"), F.lit(json_mode).alias("json_mode"), F.lit(max_tokens).cast("long").alias("max_tokens"))


def outcomes(results: DataFrame, prefix: str, schema: str | None = None, error_first: bool = False) -> DataFrame:
    """results (custom_id, content, error) with chapter_id, value (content read by ``schema``) and outcome: ok, failed or
    unrecognised. With ``error_first`` an error counts before an unknown id."""
    id_ = chapter_of(F.col("custom_id"), prefix)
    value = F.from_json("content", schema) if schema else F.col("content")
    rows = results.withColumn("chapter_id", id_).withColumn("value", value)
    failed = F.col("error") != ""
    unreadable = F.get_json_object("content", "$").isNull() if schema else F.col("value").isNull()
    unknown = F.col("chapter_id") <= 0
    first, second = ((failed, "failed"), (unknown, "unrecognised")) if error_first else ((unknown, "unrecognised"), (failed, "failed"))
    return rows.withColumn("outcome", F.when(first[0], first[1]).when(second[0], second[1]).when(unreadable, "failed").otherwise("ok"))


def place() -> Column:
    """The place of an entry by its chapter (chapter_id) and its number there (k), for any number of entries."""
    return F.col("chapter_id").cast("long") * (1 << 32) + F.col("k")


def extracted(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(characters, terms, summaries, outcomes) of analysis results; rows carry chapter_id and ord. Results are read once, whatever
    is made of the four."""
    rows = kept(outcomes(results, "analyze", EXTRACTION, error_first=True))
    good = rows.where("outcome = 'ok'")
    of = lambda name: good.select("chapter_id", F.posexplode(f"value.{name}").alias("k", "x")).select("chapter_id", place().alias("ord"), "x.*")
    summaries = good.select("chapter_id", F.coalesce(F.trim("value.summary"), F.lit("")).alias("summary")).where("summary <> ''")
    return of("characters"), of("terms"), summaries, rows.select("custom_id", "chapter_id", "outcome", "error")


def run_counts(rows: DataFrame) -> DataFrame:
    """One row: how many results were processed, failed or unrecognised."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return rows.agg(count("ok").alias("processed"), count("failed").alias("failed"), count("unrecognised").alias("unrecognised"))
