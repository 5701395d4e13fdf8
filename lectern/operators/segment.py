"""Chapters from books: by the table of contents, by headings, or item by item. All books at once, keyed by ``book``.

Inputs: ``items`` (book, spine_index, id, href, blocks) and ``toc`` (book, toc_index from 0, Title, SrcFile, SrcAnchor).
Chapters come as book + schemas.CHAPTER, skipped sections as book + schemas.SKIPPED.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, byte_prefix, trimmed
from ..functions.titles import classify, is_keep
from ..shared import kept
from .scan import numbered, running

TEXTUAL = ("heading", "paragraph", "list_item", "pre", "blockquote")
#: Bytes of a snippet; of the end of a text in which a trailer is looked for.
SNIPPET, TAIL = 200, 400
AMBIGUOUS = "ambiguous-default-skip"
_TOC = ("toc", "heading", "per-item")


def blocks_text(blocks: Column) -> Column:
    """Texts and [image: ...] marks, a blank line between them."""
    kept = F.filter(blocks, lambda b: (b["kind"].isin(*TEXTUAL) & (b["text"] != "")) | ((b["kind"] == "image") & (b["alt"] != "")))
    return F.array_join(F.transform(kept, lambda b: F.when(b["kind"] == "image", F.concat(F.lit("[image: "), b["alt"], F.lit("]"))).otherwise(b["text"])), "\n\n")


def first_heading(blocks: Column) -> Column:
    """Text of the first heading, empty if there is none."""
    heads = F.filter(blocks, lambda b: b["kind"] == "heading")
    return F.coalesce(F.get(heads, F.lit(0))["text"], F.lit(""))


def snippet(blocks: Column) -> Column:
    return byte_prefix(blocks_text(blocks), SNIPPET)


def _chapter(strategy: str, **columns: Column) -> list[Column]:
    """Columns of a chapter row, in the order of the schema."""
    have = {"raw_size": F.lit(0).cast("long"), "toc_entry_index": F.lit(-1), "detection_strategy": F.lit(strategy), "status": F.lit("raw")} | columns
    kinds = {"id": "int", "toc_entry_index": "int"}
    order = ("id", "title", "source", "raw_size", "section_ids", "toc_entry_index", "detection_strategy", "status")
    return [F.col("book"), *((have[c].cast(kinds[c]) if c in kinds else have[c]).alias(c) for c in order)]


def _skipped(strategy: str, title: Column, reason: Column, src: Column, text: Column) -> list[Column]:
    return [F.col("book"), title.alias("title"), reason.alias("reason"), src.alias("src_file"), text.alias("snippet"), F.lit(strategy).alias("strategy")]


#: Blocks of a bucket, by which sections meet the blocks that lie in them.
BUCKET = 256


def _anchored(entries: DataFrame, items: DataFrame) -> DataFrame:
    """(book, number, spine_index, start, stop) of entries whose anchor is that of a heading in their first file: blocks from start
    up to stop, where the next heading with another anchor stands, or to the item's end."""
    heads = items.select("book", "spine_index", F.size("blocks").alias("size"), F.posexplode("blocks").alias("block_index", "b")).where((F.col("b.kind") == "heading") & (F.col("b.anchor") != ""))
    heads = heads.select("book", "spine_index", "size", "block_index", F.col("b.anchor").alias("anchor"))
    # Runs of headings of one anchor: from the back, the last heading whose anchor differs from the one in front of it.
    key = ["book", "spine_index"]
    heads = heads.withColumn("back", -F.col("block_index"))
    heads = running(heads, key, ["block_index"], inclusive=False, front=("max", F.struct("block_index", "anchor")))
    first = F.coalesce(F.col("front.anchor") != F.col("anchor"), F.lit(True))
    heads = running(heads.select(*key, "size", "block_index", "anchor", "back", first.alias("first")), key, ["back"], inclusive=False, next=("max", F.when(F.col("first"), F.col("back"))))
    ends = heads.groupBy(*key, "anchor").agg(F.min(F.struct("block_index", F.coalesce(-F.col("next"), F.col("size")).alias("stop"))).alias("found"))
    wanted = entries.where(F.col("SrcAnchor") != "").select("book", "number", F.col("files")[0]["spine_index"].alias("spine_index"), F.col("SrcAnchor").alias("anchor"))
    return wanted.join(ends, [*key, "anchor"]).select("book", "number", "spine_index", F.col("found.block_index").alias("start"), F.col("found.stop").alias("stop"))


def _within(sections: DataFrame, items: DataFrame) -> DataFrame:
    """(book, number, blocks): the blocks of each section, by an interval join in buckets of their places."""
    rows = items.select("book", "spine_index", F.posexplode("blocks").alias("block_index", "b")).withColumn("bucket", F.expr(f"block_index div {BUCKET}"))
    wanted = sections.select("*", F.explode(F.expr(f"sequence(start div {BUCKET}, (stop - 1) div {BUCKET})")).alias("bucket"))
    found = rows.join(wanted, ["book", "spine_index", "bucket"]).where("block_index >= start AND block_index < stop")
    return found.groupBy("book", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "b"))), lambda x: x["b"]).alias("found"))


def by_toc(items: DataFrame, toc: DataFrame, start_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """Entries whose title is kept become chapters: their file's blocks, or from the heading with the entry's anchor up to the
    next heading with another one. An entry without a file gives none, but its number is used up."""
    c = classify(F.col("Title"))
    entries = toc.withColumn("decision", c["decision"]).withColumn("rule", c["rule"]).withColumn("file", basename(F.col("SrcFile")))
    named = items.withColumn("file", basename(F.col("href")))
    files = named.groupBy("book", "file").agg(F.array_sort(F.collect_list(F.struct("spine_index", "id"))).alias("files"))
    keep = entries.where(F.col("decision") == "KEEP").select("book", "toc_index", "Title", "SrcAnchor", "file")
    placed = kept(numbered(keep, ["book"], ["toc_index"], start_id).join(files, ["book", "file"]))
    whole, cut, some = placed, placed.where("false").select("book", "number", F.lit(True).alias("anchored")), None
    if not placed.where(F.col("SrcAnchor") != "").isEmpty():
        sections = kept(_anchored(placed, items))
        some = _within(sections, items)
        cut = sections.select("book", "number", F.lit(True).alias("anchored"))
        whole = placed.join(cut, ["book", "number"], "left_anti")
    whole = whole.select("book", "number", F.explode("files").alias("f")).select("book", "number", F.col("f.spine_index").alias("spine_index"))
    whole = whole.join(items.select("book", "spine_index", "blocks"), ["book", "spine_index"])
    # A chapter is one row, however many items it takes.
    whole = whole.groupBy("book", "number").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("spine_index", "blocks"))), lambda x: x["blocks"])).alias("found"))
    ids = F.transform("files", lambda f: f["id"])
    told = placed.join(cut, ["book", "number"], "left").select("book", "number", "toc_index", "Title", F.when(F.col("anchored"), F.slice(ids, 1, 1)).otherwise(ids).alias("section_ids"))
    chapters = told.join(some.unionByName(whole) if some else whole, ["book", "number"]).select(*_chapter("toc", id=F.col("number"), title=F.col("Title"), source=blocks_text(F.col("found")), section_ids=F.col("section_ids"), toc_entry_index=F.col("toc_index")))
    reason = F.when(F.col("decision") == "SKIP", F.col("rule")).otherwise(AMBIGUOUS)
    firsts = files.select("book", "file", F.col("files")[0]["spine_index"].alias("spine_index")).join(items.select("book", "spine_index", snippet(F.col("blocks")).alias("snippet")), ["book", "spine_index"]).drop("spine_index")
    skipped = entries.where(F.col("decision") != "KEEP").join(firsts, ["book", "file"], "left").select(*_skipped("toc", F.col("Title"), reason, F.col("SrcFile"), F.coalesce("snippet", F.lit(""))))
    return chapters, skipped


def by_headings(items: DataFrame, start_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """A kept heading of level 1 or 2 starts a chapter, which takes all blocks up to the next, across items. Chapters without
    blocks are dropped. Items before the first kept heading, without one, are skipped.

    Items are cut at their own starts; which chapter is open where an item begins comes from a scan over the items' last
    starts, so a book of any size is many tasks, and numbers come from a scan over the starts."""
    starts = lambda b: (b["kind"] == "heading") & b["level"].isin(1, 2) & is_keep(b["text"])
    at = F.filter(F.transform("blocks", lambda b, k: F.when(starts(b), k)), lambda k: k.isNotNull())
    cut = items.withColumn("at", at)
    lasts = cut.select("book", "spine_index", F.when(F.size("at") > 0, F.struct("spine_index", F.array_max("at").alias("block_index"))).alias("last"))
    opened = kept(running(kept(lasts), ["book"], ["spine_index"], inclusive=False, open=("max", F.col("last"))).drop("last"))
    piece = lambda a, b: F.slice("blocks", a + 1, F.greatest(b - a, F.lit(0)))
    front = cut.select("book", "spine_index", "id", piece(F.lit(0), F.coalesce(F.get("at", F.lit(0)), F.size("blocks"))).alias("body"), F.lit(None).cast("string").alias("title"))
    front = front.join(opened.where("open IS NOT NULL"), ["book", "spine_index"])
    own = cut.select("book", "spine_index", "id", "blocks", "at", F.posexplode("at").alias("n", "from"))
    own = own.withColumn("upto", F.coalesce(F.get("at", F.col("n") + 1), F.size("blocks")))
    own = own.select("book", "spine_index", "id", F.slice("blocks", F.col("from") + 2, F.col("upto") - F.col("from") - 1).alias("body"), F.get("blocks", F.col("from"))["text"].alias("title"), F.struct("spine_index", F.col("from").alias("block_index")).alias("open"))
    pieces = kept(own.unionByName(front))
    full = pieces.groupBy("book", "open").agg(F.sum(F.size("body")).alias("size")).where("size > 0").select("book", "open")
    numbers = numbered(full, ["book"], ["open"], start_id)
    place = F.struct("spine_index", F.col("title").isNull().alias("later"))
    found = pieces.groupBy("book", "open").agg(F.array_sort(F.collect_list(F.struct("spine_index", F.col("title").isNull().alias("later"), "body", "id"))).alias("parts"), F.min_by("title", place).alias("title"))
    ids = F.array_distinct(F.concat(F.slice(F.transform("parts", lambda x: x["id"]), 1, 1), F.transform(F.filter("parts", lambda x: F.size(x["body"]) > 0), lambda x: x["id"])))
    found = numbers.join(found, ["book", "open"])
    chapters = found.select(*_chapter("heading", id=F.col("number"), title=F.col("title"), source=blocks_text(F.flatten(F.transform("parts", lambda x: x["body"]))), section_ids=ids))
    early = cut.where((F.size("at") == 0) & (F.size("blocks") > 0)).drop("at").join(opened.where("open IS NULL").select("book", "spine_index"), ["book", "spine_index"])
    title = F.when(first_heading(F.col("blocks")) != "", first_heading(F.col("blocks"))).otherwise(F.col("id"))
    c = classify(title)
    reason = F.when(c["decision"] == "AMBIGUOUS", AMBIGUOUS).otherwise(c["rule"])
    return chapters, early.select(*_skipped("heading", title, reason, F.col("href"), snippet(F.col("blocks"))))


def per_item(items: DataFrame, start_id: int = 0) -> DataFrame:
    """Every item with blocks is a chapter, by its first heading or its id."""
    title = F.when(first_heading(F.col("blocks")) != "", first_heading(F.col("blocks"))).otherwise(F.col("id"))
    rows = items.where(F.size("blocks") > 0)
    rows = rows.join(numbered(rows.select("book", "spine_index"), ["book"], ["spine_index"], start_id), ["book", "spine_index"])
    return rows.select(*_chapter("per-item", id=F.col("number"), title=title, source=blocks_text(F.col("blocks")), section_ids=F.array("id")))


def split(items: DataFrame, toc: DataFrame, start_id: int = 0, force: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chapters, skipped, index). For each book the first strategy with two chapters or more; item by item where none has.
    ``force`` names one strategy for all. A strategy is run once, on the books that those before it left over."""
    if force is not None and force not in _TOC:
        raise ValueError(f"unknown strategy {force!r}: toc, heading or per-item")
    if force is None:
        # Each strategy reads the blocks anew, some several times.
        items = kept(items)
    left, outs = items.select("book").distinct(), []
    own = lambda df, books: df.join(books.select("book"), "book", "left_semi")
    for name in _TOC if force is None else (force,):
        open_items = own(items, left) if outs else items
        made, passed = by_toc(open_items, own(toc, left) if outs else toc, start_id) if name == "toc" else by_headings(open_items, start_id) if name == "heading" else (per_item(open_items, start_id), None)
        made = kept(made)
        counts = left.join(made.groupBy("book").agg(F.count(F.lit(1)).alias("n")), "book", "left").select("book", F.coalesce("n", F.lit(0)).alias("n"))
        last = name == "per-item" or force is not None
        counts = kept(counts)
        done = counts if last else counts.where("n >= 2")
        outs.append((name, own(made, done), passed if passed is None else own(passed, done), done))
        left = counts.where("n < 2").select("book")
    told = {"per-item": F.when(F.col("n") >= 2, F.array(F.lit("one chapter for each item: neither contents nor headings gave two"))).otherwise(F.array(F.lit("no strategy gave two chapters")))} if force is None else {}
    index = [done.select("book", F.col("n").cast("int").alias("chapter_count"), F.lit(start_id).alias("start_id"), F.lit(name).alias("strategy"), told.get(name, F.array().cast("array<string>")).alias("warnings")) for name, _, _, done in outs]
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    skipped = [s for _, _, s, _ in outs if s is not None] or [_nothing_skipped(items)]
    return union([made for _, made, _, _ in outs]), union(skipped), union(index)


def _nothing_skipped(items: DataFrame) -> DataFrame:
    text = F.lit("")
    return items.where("false").select(*_skipped("per-item", text, text, text, text))


def cut_trailer(text: str, trigger: str) -> str:
    """If the trigger, in any case, stands in the last TAIL bytes: cut at the last *** in front of it there, with the stars and
    blanks before, else at the trigger."""
    if not trigger or not text:
        return text
    data = text.encode()
    begin = max(0, len(data) - TAIL)
    tail = data[begin:].decode("utf-8", "surrogateescape")
    at = tail.lower().find(trigger.lower())
    if at < 0:
        return text
    cut = begin + len(tail[:at].encode("utf-8", "surrogateescape"))
    stars = data.rfind(b"***", begin, cut)
    if stars >= 0:
        cut = stars
        while cut and data[cut - 1] == 42:
            cut -= 1
        while cut and data[cut - 1] in b"\n\r \t":
            cut -= 1
    return data[:cut].decode("utf-8", "replace")


def without_trailer(text: Column, triggers: list[str]) -> Column:
    """All triggers in their order. Bytes and case folding meet here, so this is an Arrow function; of rows without a trigger in
    their last TAIL code points, which hold the last TAIL bytes, no text reaches it."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            for trigger in triggers:
                t = cut_trailer(t, trigger) if t else t
            return t

        return texts.map(one)

    tail = F.lower(F.right(text, F.lit(TAIL)))
    hit = reduce(lambda a, b: a | b, (F.contains(tail, F.lower(F.lit(x))) for x in triggers if x), F.lit(False))
    return F.coalesce(cut(F.when(hit, text)), text) if triggers else text


def stripped(chapters: DataFrame, triggers: list[str]) -> DataFrame:
    """Chapters without trailers, trimmed; raw_size keeps the bytes before."""
    if not triggers:
        return chapters
    size = (F.octet_length("title") + F.octet_length("source")).cast("long")
    return chapters.withColumn("raw_size", size).withColumn("source", trimmed(without_trailer(F.col("source"), triggers)))


def spine_rows(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Spine references with their manifest items; references without one are dropped, order stays."""
    items = manifest.select("book", "id", "href", "media_type")
    return refs.join(items, ["book", "id"]).select("book", "spine_index", "id", "href", "media_type", "linear")


def split_input(spine: DataFrame, blocks: DataFrame) -> DataFrame:
    """Spine items with their blocks, empty where none were stored."""
    stored = blocks.select("book", "spine_index", F.col("blocks").alias("stored"))
    kind = dict(blocks.dtypes)["blocks"]
    return spine.join(stored, ["book", "spine_index"], "left").select("book", "spine_index", "id", "href", F.coalesce("stored", F.array().cast(kind)).alias("blocks"))
