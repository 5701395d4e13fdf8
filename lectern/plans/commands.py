"""The stages of a project as commands. Tables live below the project's folders; the driver plans, executors work; models,
speech and encoders are injected. Each stage skips what exists unless forced."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ssml as markup
from ..functions.text import chapter_of, title_deduplicated, trimmed, vocabulary_applied, without_bad_symbols
from ..operators import context, overview, qa, segment, vocab
from ..shared import kept
from ..sources import epub
from ..sources.batches import parse_results
from ..streaming import batches, clients, speech
from .project import Config, chapter_filter, copy_files, load_config, replace_table, reset_guard, within, write_chapters, write_violations

BOOK = "book string, "
ORDERED = "ord long, "
TEXTS = "chapter_id int, text string"


class Project:
    def __init__(self, spark: SparkSession, root: str, provider: batches.Provider | None = None, config: Config | None = None):
        self.spark, self.root, self.provider = spark, root.rstrip("/"), provider
        self.config = config or load_config(root)
        self.store = batches.Store(spark, self.path("ai", "state"))

    def path(self, folder: str, name: str) -> str:
        return f"{self.root}/{getattr(self.config.paths, folder)}/{name}"

    def table(self, folder: str, name: str, schema: str, fmt: str = "json") -> DataFrame:
        return schemas.absent_as_empty(self.spark, self.path(folder, name), schema, fmt)

    def save(self, df: DataFrame, folder: str, name: str, fmt: str = "json") -> None:
        replace_table(df, self.path(folder, name), fmt)

    # -- stored tables

    def chapters(self) -> DataFrame:
        return self.table("chapters", "chapters", BOOK + schemas.CHAPTER)

    def glossary(self) -> DataFrame:
        return self.table("ai", "glossary", ORDERED + schemas.TERM)

    def characters(self) -> DataFrame:
        return self.table("ai", "characters", ORDERED + schemas.CHARACTER)

    def stress(self) -> DataFrame:
        return self.table("ai", "stress", schemas.STRESS)

    def summaries(self) -> DataFrame:
        return self.table("memory", "summaries", schemas.SUMMARY)

    def known_summaries(self) -> DataFrame:
        """(chapter_id, summary) of every chapter, an empty summary where none is stored."""
        return self.chapters().select(F.col("id").alias("chapter_id")).join(self.summaries(), "chapter_id", "left").fillna("", ["summary"])

    def translations(self) -> DataFrame:
        return self.table("translation", self.config.languages.target, TEXTS)

    def speech(self) -> DataFrame:
        return self.table("tts", "ssml", "chapter_id int, ssml string")

    def audio(self) -> DataFrame:
        return self.table("audio", "audio", "chapter_id int, audio binary", "parquet")

    def chosen(self, chapter: int = 0, span: str = "") -> DataFrame:
        c = self.chapters()
        ids = chapter_filter(chapter, span, c.count(), self.config.chapters.start_id) if chapter or span else None
        return c if ids is None else c.where(within(F.col("id"), ids))

    def needed(self, rows: DataFrame, what: str, stage: str) -> None:
        """Fails with guidance where a stage has nothing to work on."""
        if rows.isEmpty():
            raise LookupError(f"no {what} found: run {stage} first")

    # -- stages

    def import_book(self, archive: str, force: bool = False) -> None:
        if Path(self.path("extracted", "blocks")).exists() and not force:
            raise FileExistsError("the project has a book already")
        files = self.spark.read.format("binaryFile").load(archive)
        copy_files(self.spark, archive, self.path("extracted", "source"))
        for name in epub.TABLES:
            rows = epub.books(files, name).withColumnRenamed("path", "book")
            rows.write.mode("overwrite").json(self.path("extracted", name))

    def analyze_chapters(self, chapter: int = 0, span: str = "", strategy: str | None = None, strip: tuple[str, ...] = (), start_id: int | None = None, force: bool = False) -> DataFrame:
        """Returns the index; chapters and skipped sections are written."""
        from pyspark.sql import Window as W

        start = self.config.chapters.start_id if start_id is None else start_id
        read = lambda name: self.table("extracted", name, BOOK + epub.TABLES[name])
        items = segment.split_input(read("spine"), read("blocks").select("book", "spine_index", "blocks"))
        toc = read("toc").withColumn("toc_index", F.row_number().over(W.partitionBy("book").orderBy("Order")) - 1)
        chapters, skipped, index = segment.split(items, toc, start, strategy)
        chapters = segment.stripped(chapters, [*self.config.chapters.strip, *strip])
        ids = chapter_filter(chapter, span, chapters.count(), start) if chapter or span else None
        write_chapters(chapters, self.path("chapters", "chapters"), ids, force)
        self.save(skipped, "chapters", "skipped")
        self.save(index, "chapters", "index")
        return self.table("chapters", "index", BOOK + schemas.INDEX)

    def _overrides(self, kind: str) -> DataFrame:
        rows = getattr(self.config.glossary, kind)
        return self.spark.createDataFrame([(k, o.get("source", ""), o.get("target", ""), o.get("type", "") or "") for k, o in enumerate(rows)], "ord long, source string, target string, type string")

    def _batch(self, kind: str, requests: DataFrame, model: str, process: Callable[[DataFrame], None], every: int, go_on: bool) -> str:
        """Submits, or goes on with what is pending, waits and processes; a batch that ends otherwise than completed is an error. The
        next run takes its state away and starts anew, unless it is told to go on with it."""
        if self.provider is None:
            raise LookupError("no provider")
        state = self.store.load(kind)
        if state and state["status"] in batches.TERMINAL and not go_on:
            self.store.delete(kind)
            state = None
        if go_on and state is None:
            raise LookupError(f"no pending batch of {kind}: run it without --continue")
        if state is None:
            # A number for each request; services bound the requests of a batch.
            ids = sorted(r["id"] for r in requests.select(chapter_of(F.col("custom_id"), kind).alias("id")).collect())
            if not ids:
                return "nothing to do"
            batches.submit(self.store, self.provider, kind, requests, ids, model)
        batches.poll(self.store, self.provider, kind, every)
        return batches.finish(self.store, self.provider, kind, process)["status"]

    def analyze(self, chapter: int = 0, span: str = "", force: bool = False, go_on: bool = False, every: int = batches.POLL) -> str:
        """Vocabulary and summaries of chapters. Merging over chapters is a grouping here rather than a second request. Forced, it
        starts from an empty vocabulary."""
        self.needed(self.chapters(), "chapters", "analyze-chapters")
        done = self.summaries().select("chapter_id")
        todo = batches.pending(self.chosen(chapter, span), done, force)
        overrides = self._overrides("characters").withColumn("kind", F.lit("character")).unionByName(self._overrides("terms").withColumn("kind", F.lit("term")))
        locked = context.locked_terms(overrides).first()["locked"]
        text = context.extraction_prompt(F.col("title"), F.col("source"), locked, self.config.languages.target)
        requests = context.requests(todo, "analyze", "", text, self.config.model.helper_model, json_mode=True)

        def process(lines: DataFrame) -> None:
            chars, terms, summaries, out = context.extracted(parse_results(lines))
            counts = context.run_counts(out).first()
            if counts["processed"] == 0:
                raise RuntimeError("no result could be used")
            blank = lambda df: df.withColumn("chapters", F.array().cast("array<int>"))
            had_terms, had_characters = (df.where("false") if force else df for df in (self.glossary(), self.characters()))
            t = vocab.merged_terms(had_terms, blank(terms).withColumn("first_seen_chapter", F.col("chapter_id"))).select("ord", "source", "target", "type", "first_seen_chapter", "chapters")
            c = vocab.merged_characters(had_characters, blank(chars)).select("ord", "name", "translation", "role", "description", "chapters")
            t = vocab.overridden(t, self._overrides("terms"), "source", "target", "type", "term")
            c = vocab.overridden(c, self._overrides("characters"), "name", "translation")
            t = vocab.tagged(t, vocab.chapters_of(terms, had_terms, "source"), "source")
            c = vocab.tagged(c, vocab.chapters_of(chars, had_characters, "name"), "name")
            self.save(t.orderBy(F.lower("source"), "ord"), "ai", "glossary")
            self.save(c.orderBy(F.lower("name"), "ord"), "ai", "characters")
            kept = self.summaries().join(summaries.select("chapter_id"), "chapter_id", "left_anti")
            self.save(kept.unionByName(summaries), "memory", "summaries")

        return self._batch("analyze", requests, self.config.model.helper_model, process, every, go_on)

    def translate(self, chapter: int = 0, span: str = "", force: bool = False, go_on: bool = False, skip_memory: bool = False, every: int = batches.POLL) -> str:
        self.needed(self.chapters(), "chapters", "analyze-chapters")
        done = self.translations().select("chapter_id")
        todo = batches.pending(self.chosen(chapter, span), done, force)
        terms = vocab.with_characters(self.glossary(), self.characters())
        blocks = context.prompt_blocks(context.terms_of_chapters(terms, todo))
        before = context.previous_summaries(self.known_summaries(), 0 if skip_memory else 2).select("chapter_id", "context")
        rows = todo.join(blocks.withColumnRenamed("chapter_id", "id"), "id", "left").join(before.withColumnRenamed("chapter_id", "id"), "id", "left")
        text = context.translation_prompt(F.col("title"), F.col("source"), F.col("block"), F.col("context"))
        how = context.translation_instructions(self.config.languages.source, self.config.languages.target)
        requests = context.requests(rows, "translate", how, text, self.config.model.translation_model)

        def process(lines: DataFrame) -> None:
            good = context.outcomes(parse_results(lines), "translate").where("outcome = 'ok'")
            new = kept(good.select(F.col("chapter_id").cast("int").alias("chapter_id"), title_deduplicated(trimmed(F.col("content"))).alias("text")))
            rest = self.translations().join(new.select("chapter_id"), "chapter_id", "left_anti")
            self.save(rest.unionByName(new), "translation", self.config.languages.target)

        return self._batch("translate", requests, self.config.model.translation_model, process, every, go_on)

    def verify_glossary(self) -> DataFrame:
        self.needed(self.glossary(), "glossary", "analyze")
        self.needed(self.translations(), "translations", "translate")
        terms = vocab.with_characters(self.glossary(), self.characters())
        found = qa.glossary_violations(self.translations(), terms)
        write_violations(found, self.path("ai", "violations"))
        return self.table("ai", "violations", schemas.VIOLATION)

    def pronounce(self, chapter: int = 0, span: str = "", force: bool = False, go_on: bool = False, reset: bool = False, every: int = batches.POLL, decisions: DataFrame | None = None) -> str:
        """Stress vocabulary of translated chapters. ``decisions`` (term, stressed) settle conflicts; the rest keep the first form."""
        # Read anew each time: a reset puts the stored tables aside.
        processed = lambda: self.table("ai", "stress_processed", "id int")

        def run() -> str:
            todo = batches.pending_stress(self.chosen(chapter, span), self.translations(), processed(), force)
            rows = todo.select("id").join(self.translations().withColumnRenamed("chapter_id", "id"), "id")
            requests = context.requests(rows, "pronounce", "", context.stress_prompt(F.col("text"), F.lit("")), self.config.model.helper_model, json_mode=True)
            return self._batch("pronounce", requests, self.config.model.helper_model, process, every, go_on)

        def process(lines: DataFrame) -> None:
            entry = "entries array<struct<term:string, stressed:string>>"
            good = kept(context.outcomes(parse_results(lines), "pronounce", entry)).where("outcome = 'ok'")
            found = good.select("chapter_id", F.posexplode("value.entries").alias("k", "e")).select("chapter_id", context.place().alias("ord"), "e.term", "e.stressed")
            fixed = self.spark.createDataFrame([(k, p.get("term", ""), p.get("phonemes", ""), "") for k, p in enumerate(self.config.pronunciation)], "ord long, source string, target string, type string")
            clean = vocab.overridden(vocab.sanitized(found), fixed, "term", "stressed")
            as_entry = lambda df, merge: df.select(merge.alias("merge"), F.col("ord").cast("long").alias("ord"), "term", "stressed", F.lit(False).alias("approved"), F.array().cast("array<int>").alias("chapters"))
            stored = self.stress().select(F.lit(0).alias("merge"), F.col("ord").cast("long").alias("ord"), "term", "stressed", "approved", "chapters")
            store, conflicts = vocab.merged_stress(stored.unionByName(as_entry(clean, F.coalesce(F.col("chapter_id"), F.lit(2**30)).cast("int"))))
            store = vocab.with_chapter_tags(store.drop("merge"), clean.where("chapter_id is not null").select("chapter_id", "term", "ord"))
            if decisions is not None:
                store = vocab.resolved(store, decisions)
            self.save(vocab.stored_order(store.select("ord", "term", "stressed", "approved", "chapters")), "ai", "stress")
            self.save(vocab.deduplicated_conflicts(conflicts).select("term", "variants"), "ai", "stress_conflicts")
            self.save(processed().select("id").union(good.select(F.col("chapter_id").cast("int"))).distinct(), "ai", "stress_processed")

        if not reset:
            return run()
        with reset_guard(self.spark, self.path("ai", "stress")), reset_guard(self.spark, self.path("ai", "stress_processed")):
            return run()

    def ssml(self, chapter: int = 0, span: str = "", force: bool = False, on_problem: str = "fail", model: Callable[[str], str] | None = None) -> int:
        """Marked-up speech of translated chapters; returns how many. Latin words and foreign letters fail the stage, or are
        written in Cyrillic and left out with ``on_problem="transliterate"``. Stress comes from a model or the vocabulary,
        overrides on top."""
        todo = batches.pending(self.chosen(chapter, span).select("id"), self.speech(), force)
        rows = todo.join(self.translations().withColumnRenamed("chapter_id", "id"), "id")
        trouble = qa.problems(rows.withColumnRenamed("id", "chapter_id"))
        if on_problem == "fail" and not trouble.isEmpty():
            ids = [r["chapter_id"] for r in trouble.orderBy("chapter_id").limit(20).collect()]
            raise ValueError(f"letters that cannot be spoken in chapters {ids}")
        text = without_bad_symbols(markup.transliterated(F.col("text"))) if on_problem == "transliterate" else F.col("text")
        rows = rows.withColumn("text", text)
        rows = rows.withColumn("text", speech.stressed(F.col("text"), model)) if model else vocab.applied(rows, self.stress())
        fixed = [(p.get("term", ""), p.get("phonemes", "")) for p in self.config.pronunciation]
        new = rows.select(F.col("id").alias("chapter_id"), markup.generated(vocabulary_applied(F.col("text"), fixed)).alias("ssml"))
        kept = self.speech().join(new.select("chapter_id"), "chapter_id", "left_anti")
        n = new.count()
        self.save(kept.unionByName(new), "tts", "ssml")
        return n

    def tts(self, chapter: int = 0, span: str = "", force: bool = False, log: DataFrame | None = None, encode: Callable = clients.encoded, **engine) -> DataFrame | None:
        """Audio of marked-up chapters, converted by ``encode`` unless the project's format is WAV; of a server's log (line_no,
        line), the warnings by chapter are returned."""
        t = self.config.tts
        make = speech.engine(t.engine, speech.EngineConfig(t.voice, self.config.speech_language, t.sample_rate, t.server_url, t.parallel), **engine)
        todo = batches.pending(self.chosen(chapter, span).select("id"), self.audio(), force)
        rows = qa.guarded(self.speech().join(todo.select(F.col("id").alias("chapter_id")), "chapter_id"))
        kept = self.audio().join(rows.select("chapter_id"), "chapter_id", "left_anti")
        made = make(rows)
        if t.audio_format != "wav":
            made = made.withColumn("audio", clients.converted(F.col("audio"), t.audio_format, t.audio_bitrate, encode))
        self.save(kept.unionByName(made), "audio", "audio", fmt="parquet")
        return None if log is None else qa.warnings_by_chapter(qa.log_warnings(log), self.speech())

    def status(self) -> DataFrame:
        return batches.status_of(self.chapters(), self.translations(), self.speech(), self.audio())

    def overview(self) -> DataFrame:
        return overview.chapter_overview(self.chapters(), self.glossary(), self.characters(), self.stress(), self.translations(), self.speech(), self.audio())
