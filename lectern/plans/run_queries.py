"""Registered queries of whole runs: a batch from submission to its processed results, an incremental stream, a speech engine,
a project's tables; with their DuckDB twins."""

from __future__ import annotations

import html
import io
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio
from ..functions.text import chapter_of
from ..operators import context, recordings, segment
from ..sources import epub
from ..sources.batches import parse_results
from ..schemas import BATCH_STATE
from ..shared import folder as scratch
from ..shared import kept
from ..sources.html import exploded, with_blocks
from ..streaming import batches, lifecycle, speech
from . import views as V
from .project import write_chapters
from .text_queries import TRIM


def echo(lines: DataFrame) -> DataFrame:
    """A stand-in for a model: each answer is the first line of its request; every fifth fails."""
    id_, text = F.get_json_object("value", "$.custom_id"), F.get_json_object("value", "$.body.input[0].content")
    n = F.regexp_extract(id_, r"([0-9]+)\z", 1).cast("long")
    body = F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), F.substring_index(text, "\n", 1).alias("text"))).alias("content"))).alias("output"))
    error = F.when(n % 5 == 0, F.struct(F.lit("server").alias("code"), F.lit("busy").alias("message")))
    return lines.select(F.to_json(F.struct(id_.alias("custom_id"), F.when(n % 5 != 0, F.struct(F.lit(200).alias("status_code"), body.alias("body"))).alias("response"), error.alias("error"))).alias("value"))


def batch_run(s: SparkSession, d: str) -> DataFrame:
    """Requests are submitted, the state is polled and kept, results are read once; an interruption in between changes nothing."""
    root = scratch(s)
    store, provider = batches.Store(s, f"{root}/state"), batches.FakeProvider(echo, polls=3)
    requests = context.requests(V.chapters(s, d), "translate", "", F.col("source"), "m")
    batches.submit(store, provider, "translate", requests, [], "m")
    looks = iter([False, True])
    batches.poll(store, provider, "translate", sleep=lambda _: None, stop=lambda: next(looks, True))
    batches.poll(store, provider, "translate", sleep=lambda _: None)
    batches.finish(store, provider, "translate", lambda lines: context.outcomes(parse_results(lines), "translate").write.parquet(f"{root}/out"))
    return s.read.parquet(f"{root}/out").select("chapter_id", "outcome", F.md5("content").alias("content"))


def incremental_run(s: SparkSession, d: str) -> DataFrame:
    """Two runs over the same folder of new lines: each line is taken once."""
    root = scratch(s)
    V.log_lines(s, d).write.json(f"{root}/in")
    for _ in range(2):
        batches.incremental(s, f"{root}/in", "line_no long, line string", f"{root}/out", f"{root}/mark", lambda x: x.withColumn("warn", F.contains("line", F.lit("[WARN]")))).awaitTermination()
    return s.read.schema("line_no long, line string, warn boolean").parquet(f"{root}/out").groupBy("warn").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("total"))


def status_run(s: SparkSession, d: str) -> DataFrame:
    """A stream of status rows folded to the last of each type."""
    root = scratch(s)
    o = V.read(s, d, "orders").select(F.col("o_orderpriority").alias("type"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("status"), F.col("o_orderkey").alias("updated"))
    o.write.json(f"{root}/in")
    stream = s.readStream.schema("type string, status string, updated long").json(f"{root}/in")
    batches.status_stream(stream, f"status-{uuid.uuid4().hex}", f"{root}/mark", lambda rows: rows.write.mode("append").parquet(f"{root}/out")).awaitTermination()
    rows = s.read.schema("type string, status string, updated long").parquet(f"{root}/out")
    return rows.groupBy("type").agg(F.max_by("status", "updated").alias("status"), F.max("updated").alias("updated"))


#: States that orders report, by a number made of their key; the silence after which a customer's batch expires, in minutes.
REPORTED = ("validating", "validating", "in_progress", "in_progress", "completed", "processed", "deleted", "failed", "cancelled", "validating")
SILENCE, LATE = 2000, 64


def lifecycle_run(s: SparkSession, d: str) -> DataFrame:
    """Orders as updates of their customer's batch, a minute for each key, up to an hour out of order, every fifth twice, in
    four files; then a clock that lets the watermark pass them all."""
    root = scratch(s)
    o = V.read(s, d, "orders").select("o_custkey", "o_orderkey")
    known = F.element_at(F.array(*map(F.lit, REPORTED)), (F.col("o_orderkey") * 31 % 97 % 10 + 1).cast("int"))
    o = o.select(F.col("o_custkey").cast("string").alias("type"), known.alias("status"), "o_orderkey", F.explode(F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    o = o.withColumn("minute", F.col("o_orderkey") + F.col("o_orderkey") * 7919 % LATE + F.col("again"))
    rows = o.select("type", "status", F.timestamp_seconds((F.col("minute") + 1) * 60).alias("updated"), (F.col("o_orderkey") * 2 + F.col("again")).cast("long").alias("seq"), "o_orderkey")
    last = o.agg(F.max("o_orderkey").alias("k")).first()["k"] or 0
    for k in range(4):
        rows.where(F.expr(f"(o_orderkey * 4 - 1) div {max(last, 1)} = {k}") if k else F.expr(f"(o_orderkey * 4 - 1) div {max(last, 1)} < 1")).drop("o_orderkey").write.mode("append").json(f"{root}/in")
    s.range(1).select(F.lit("clock").alias("type"), F.lit("validating").alias("status"), F.timestamp_seconds(F.lit((last + 10 * SILENCE) * 60)).alias("updated"), F.lit(0).cast("long").alias("seq")).write.mode("append").json(f"{root}/in")
    stream = s.readStream.schema("type string, status string, updated timestamp, seq long").json(f"{root}/in")
    lifecycle.run_transitions(stream, SILENCE * 60, f"{2 * LATE} minutes", f"{root}/out", f"{root}/mark").awaitTermination()
    return lifecycle.last_states(s.read.schema(lifecycle.TRANSITIONS).parquet(f"{root}/out"))


def engine_run(s: SparkSession, d: str) -> DataFrame:
    rows = V.chapters(s, d).select(F.col("id").alias("chapter_id"), F.col("source").alias("ssml"))
    return speech.engine("noop")(rows).select("chapter_id", F.octet_length("audio").cast("long").alias("bytes"), F.hex(F.substring("audio", 41, 4)).alias("size"))


#: Media types of the items of odd books, in turns; all but the last are pages.
MEDIA = ("application/xhtml+xml", "application/x-dtbxhtml", "text/html", "image/svg+xml")


def archives(s: SparkSession, d: str, nav: bool = False, odd: bool = False) -> DataFrame:
    """(path, content): each document packed as a book of one item, a paragraph for each line, with an NCX, or with a navigation
    document of two levels besides. Odd books have a rootfile of another type in front, an entry whose name differs in case,
    and items of all types of ``MEDIA``."""

    def pack(batches_):
        for batch in batches_:
            out = []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = "".join(f"<p>{html.escape(line)}</p>" for line in (text or "").split("\n"))
                files = {
                    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/c.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
                    "OEBPS/c.opf": f'<package xmlns:dc="urn:dc"><metadata><dc:title>Book {n}</dc:title></metadata><manifest><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="none"/></spine></package>',
                    "OEBPS/t.ncx": f'<ncx><navMap><navPoint><navLabel><text>Chapter {n}</text></navLabel><content src="t/a.xhtml#x"/></navPoint></navMap></ncx>',
                    "OEBPS/t/a.xhtml": f"<html><body>{body}</body></html>",
                }
                if nav:
                    files["OEBPS/c.opf"] = files["OEBPS/c.opf"].replace("<manifest>", '<manifest><item id="v" href="nav/n.xhtml" properties="nav" media-type="application/xhtml+xml"/>')
                    files["OEBPS/nav/n.xhtml"] = f'<html><body><nav epub:type="landmarks"><ol><li><a href="z">Z</a></li></ol></nav><nav epub:type="toc"><ol><li><a href="t/a.xhtml#x">Part {n}</a><ol><li><a href="t/a.xhtml">Inner</a></li></ol></li></ol></nav></body></html>'
                if odd:
                    files["META-INF/container.xml"] = files["META-INF/container.xml"].replace("<rootfiles>", '<rootfiles><rootfile full-path="none.pdf" media-type="application/pdf"/>')
                    files["OEBPS/c.opf"] = files["OEBPS/c.opf"].replace('a.xhtml" media-type="application/xhtml+xml"', f'a.xhtml" media-type="{MEDIA[n % 4]}"')
                    files["OEBPS/T/A.XHTML"] = files.pop("OEBPS/t/a.xhtml")
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, content in files.items():
                        z.writestr(name, content)
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([str(n) for n in batch.column(0).to_pylist()]), pa.array(out, pa.binary())], names=["path", "content"])

    return V.text_parts(s, d).mapInArrow(pack, "path string, content binary")


def book_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = epub.books(archives(s, d), "blocks")
    return rows.select(F.col("path").cast("long").alias("doc_id"), "zip_path", F.size("blocks").cast("long").alias("n"), F.md5(segment.blocks_text(F.col("blocks"))).alias("text"))


def book_contents(s: SparkSession, d: str) -> DataFrame:
    packed = kept(archives(s, d))
    toc, meta, spine = (epub.books(packed, t) for t in ("toc", "metadata", "spine"))
    rows = meta.select("path", "title").join(toc.select("path", F.col("Title").alias("entry"), "SrcFile", "SrcAnchor"), "path").join(spine.groupBy("path").agg(F.count(F.lit(1)).alias("items")), "path")
    return rows.select(F.col("path").cast("long").alias("doc_id"), "title", "entry", F.col("SrcFile").alias("file"), F.col("SrcAnchor").alias("anchor"), "items")


def nav_contents(s: SparkSession, d: str) -> DataFrame:
    """Contents of books with a navigation document."""
    toc = epub.books(archives(s, d, nav=True), "toc")
    return toc.select(F.col("path").cast("long").alias("doc_id"), F.col("Order").alias("place"), F.col("Title").alias("entry"), F.col("SrcFile").alias("file"), F.col("SrcAnchor").alias("anchor"), F.col("Depth").alias("depth"), F.col("SourceKind").alias("kind"))


def batch_state(s: SparkSession, d: str) -> DataFrame:
    """The state row of a submitted batch after its first look."""
    store, provider = batches.Store(s, f"{scratch(s)}/state"), batches.FakeProvider(echo, polls=3)
    chapters = V.chapters(s, d).where("id % 2 = 1")
    requests = context.requests(chapters, "translate", "", F.col("source"), "large")
    ids = sorted(r["id"] for r in requests.select(chapter_of(F.col("custom_id"), "translate").alias("id")).collect())
    batches.submit(store, provider, "translate", requests, ids, "large")
    looks = iter([False, True])
    batches.poll(store, provider, "translate", sleep=lambda _: None, stop=lambda: next(looks, True))
    state = s.read.schema(BATCH_STATE).parquet(store.path("translate"))
    return state.select("type", "batch_id", "model", "endpoint", "status", "total", F.md5(F.array_join("chapter_ids", ",")).alias("chapters"), F.col("completed_at").isNotNull().alias("ended"))


def kept_chapters(s: SparkSession, d: str) -> DataFrame:
    """Chapters written three times: some, then all unforced with other texts, then some of them forced."""
    table, c = f"{scratch(s)}/chapters", V.chapters(s, d).select("id", "title", "source")
    texts = lambda mark: c.withColumn("source", F.concat(F.lit(mark), "source"))
    write_chapters(texts("first ").where("id % 2 = 0"), table)
    write_chapters(texts("second "), table)
    write_chapters(texts("third "), table, [(5, 49)], force=True)
    return s.read.schema(c.schema).json(table).select("id", "title", F.md5("source").alias("source"))


def replaced_chapters(s: SparkSession, d: str) -> DataFrame:
    """Forced and unfiltered, a table is replaced: chapters that are gone leave nothing behind."""
    table, c = f"{scratch(s)}/chapters", V.chapters(s, d).select("id", "title")
    write_chapters(c, table)
    write_chapters(c.where("id % 3 = 0"), table, force=True)
    return s.read.schema(c.schema).json(table).select("id", "title")


def joined_lines(s: SparkSession, d: str) -> DataFrame:
    """A tone for each line of a document, cut out of its file and joined in order under one header."""
    lines = V.text_parts(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    made = audio.joined_audio(lines.select("doc_id", "k", audio.tone(F.col("line")).alias("audio")), "doc_id", "k", "audio")
    le = lambda at: F.hex(F.substring("audio", at, 4))
    return made.select("doc_id", F.octet_length("audio").cast("long").alias("bytes"), le(5).alias("riff"), le(25).alias("rate"), le(41).alias("size"))


def line_segments(s: SparkSession, d: str) -> DataFrame:
    """Where the tone of each line lies in its document's file, header first."""
    lines = V.text_parts(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    made = recordings.segments(lines, "doc_id", "k", "line", audio.tone)
    return made.select("doc_id", "k", "offset", F.octet_length("bytes").cast("long").alias("bytes"))


def file_parts(s: SparkSession, d: str) -> DataFrame:
    """Files of lines in parts of 100,000 bytes and what they begin with."""
    lines = V.text_parts(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    made = recordings.files(lines, "doc_id", "k", "line", audio.tone, 100_000)
    le = lambda at: F.when(F.col("part") == 0, F.hex(F.substring("bytes", at, 4)))
    return made.select("doc_id", "part", "offset", F.octet_length("bytes").cast("long").alias("bytes"), le(5).alias("riff"), le(41).alias("size"))


def marked_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks of pages made of a document's lines, by turns in headings, paragraphs, list items, nested containers with scripts
    and images, preformatted text."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    k = F.col("k")
    n, line = (k % 6 + 1).cast("string"), esc(F.col("line"))
    tag = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    html = F.when(k % 5 == 0, tag("<h", n, ' id="a', k.cast("string"), '">', line, "</h", n, ">")).when(k % 5 == 1, tag("<p>", line, " <b>bold</b></p>")).when(k % 5 == 2, tag("<ul id='u'><li>", line, "</li></ul><hr>"))
    html = html.when(k % 5 == 3, tag("<div><section><p><i>", line, "</i></p></section><script>x</script></div>")).otherwise(tag('<div>loose<img alt="', line, '"></div>'))
    lines = V.text_parts(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).select("doc_id", "k", html.alias("h"))
    pages = lines.groupBy("doc_id").agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), F.lit("</body></html>")).alias("html"))
    rows = exploded(with_blocks(pages)).groupBy("doc_id", "kind", "level")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text", "alt", "anchor"))), lambda x: F.concat_ws("/", x["text"], x["alt"], x["anchor"])), "|")).alias("texts"))


def anchored(s: SparkSession, d: str) -> DataFrame:
    """Chapters from contents with anchors: two entries for each third item, at its first and at its tenth block."""
    items = V.items(s, d)
    marked = F.transform("blocks", lambda b, k: F.struct(b["kind"].alias("kind"), b["level"].alias("level"), F.when(b["kind"] == "heading", F.concat(F.lit("b"), k.cast("string"))).otherwise("").alias("anchor"), b["text"].alias("text"), b["alt"].alias("alt")))
    toc = V.toc(s, d).select("book", F.explode(F.array(F.lit(0), F.lit(9))).alias("at"), "toc_index", "SrcFile")
    toc = toc.select("book", (2 * F.col("toc_index") + (F.col("at") > 0).cast("int")).alias("toc_index"), F.concat(F.lit("Chapter "), F.col("at").cast("string")).alias("Title"), "SrcFile", F.concat(F.lit("b"), F.col("at").cast("string")).alias("SrcAnchor"))
    return segment.by_toc(items.withColumn("blocks", marked), toc)[0].select("book", "id", "title", F.md5("source").alias("source"), F.array_join("section_ids", ",").alias("section_ids"))


def speak(text: str, config: speech.EngineConfig) -> bytes:
    """A stand-in for a speech server: a sample of silence for each byte."""
    return audio.wav(np.zeros(len(text.encode())))


def http_engine_run(s: SparkSession, d: str) -> DataFrame:
    """Texts in chunks to a speech server, the answers joined in order."""
    rows = V.chapters(s, d).select(F.col("id").alias("chapter_id"), F.col("source").alias("ssml"))
    made = speech.engine("http", speech.EngineConfig(voice="v", server_url="http://localhost", parallel=4), client=speak)(rows)
    return made.select("chapter_id", F.octet_length("audio").cast("long").alias("bytes"), F.hex(F.substring("audio", 41, 4)).alias("size"))


QUERIES = {
    "e3_http_engine": http_engine_run,
    "t24_modelled": lambda s, d: V.text_parts(s, d).select("doc_id", F.md5(speech.stressed(F.col("text"), lambda x: "+" + x)).alias("text")),
    "s7_nav_contents": nav_contents,
    "x7_batch_state": batch_state,
    "k3_kept_chapters": kept_chapters,
    "k4_replaced_chapters": replaced_chapters,
    "t31_joined_lines": joined_lines,
    "a22_line_segments": line_segments,
    "a22_file_parts": file_parts,
    "s11_marked_blocks": marked_blocks,
    "j3_anchored_chapters": anchored,
    "s1_book_blocks": book_blocks,
    "s4_book_contents": book_contents,
    "x1_batch_run": batch_run,
    "x3_incremental_run": incremental_run,
    "x4_status_stream": status_run,
    "x4_lifecycle": lifecycle_run,
    "e2_noop_engine": engine_run,
    "t24_stressed": lambda s, d: V.text_parts(s, d).select("doc_id", F.md5(speech.stressed(F.col("text"))).alias("text")),
}

def tone_bytes(x: str) -> str:
    """Bytes of the audio of a tone for a text."""
    return f"(2 * floor(floor(least(0.5::DOUBLE + octet_length(encode({x})) / 2000.0::DOUBLE, 3.0) * 1e9) / 1e9 * 16000)::BIGINT)"


def little(n: str) -> str:
    """Four bytes of a number, lowest first, in hexadecimal digits."""
    return "printf('%02X%02X%02X%02X', " + ", ".join(f"(({n})::BIGINT >> {k}) & 255" for k in (0, 8, 16, 24)) + ")"


_LINE = "(SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_COLLAPSED = TRIM.format("regexp_replace({0}, '[ ' || chr(10) || chr(9) || chr(13) || ']+', ' ', 'g')")
_BLOCK_ROWS = f"""(SELECT doc_id, 10 * k AS o, CASE k % 5 WHEN 0 THEN 'heading' WHEN 2 THEN 'list_item' WHEN 4 THEN 'image' ELSE 'paragraph' END AS kind, CASE WHEN k % 5 = 0 THEN k % 6 + 1 ELSE 0 END AS level,
  CASE k % 5 WHEN 4 THEN '' WHEN 1 THEN {_COLLAPSED.replace('{0}', "line || ' bold'")} ELSE {_COLLAPSED.replace('{0}', 'line')} END AS text, CASE WHEN k % 5 = 4 THEN line ELSE '' END AS alt, CASE k % 5 WHEN 0 THEN 'a' || k::VARCHAR WHEN 2 THEN 'u' ELSE '' END AS anchor FROM {_LINE}
  UNION ALL SELECT doc_id, 10 * k + 1, 'hr', 0, '', '', '' FROM {_LINE} WHERE k % 5 = 2)"""
_PLACED = f"(SELECT book, file, 'Chapter ' || place::VARCHAR AS title, 2 * toc_index + (place > 0)::INT AS toc_index, place FROM (SELECT book, file, toc_index, unnest([0, 9]) AS place FROM {V.TOC}))"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM.format("regexp_replace(x, '[ ' || chr(9) || chr(13) || ']+', ' ', 'g')")}), lambda x: x <> '')"
ORACLE_SQL = {
    "e3_http_engine": f"SELECT doc_id + 1 AS chapter_id, 44 + 2 * octet_length(encode(text)) AS bytes, {little('2 * octet_length(encode(text))')} AS size FROM documents",
    "s7_nav_contents": "SELECT doc_id, k::INT AS place, CASE k WHEN 1 THEN 'Part ' || doc_id::VARCHAR ELSE 'Inner' END AS entry, 'OEBPS/t/a.xhtml' AS file, CASE k WHEN 1 THEN 'x' ELSE '' END AS anchor, k::INT AS depth, 'nav' AS kind FROM documents, (SELECT unnest([1, 2]) AS k)",
    "x7_batch_state": "SELECT 'translate' AS type, 'batch-1' AS batch_id, 'large' AS model, '/v1/responses' AS endpoint, 'in_progress' AS status, count(*) AS total, md5(string_agg((doc_id + 1)::VARCHAR, ',' ORDER BY doc_id)) AS chapters, false AS ended FROM documents WHERE (doc_id + 1) % 2 = 1",
    "k3_kept_chapters": f"SELECT id, title, md5(CASE WHEN id BETWEEN 5 AND 49 THEN 'third ' WHEN id % 2 = 0 THEN 'first ' ELSE 'second ' END || source) AS source FROM {V.CHAPTERS}",
    "k4_replaced_chapters": f"SELECT id, title FROM {V.CHAPTERS} WHERE id % 3 = 0",
    "t31_joined_lines": f"SELECT doc_id, 44 + n AS bytes, {little('36 + n')} AS riff, {little('16000')} AS rate, {little('n')} AS size FROM (SELECT doc_id, sum({tone_bytes('line')})::BIGINT AS n FROM {_LINE} GROUP BY doc_id)",
    "a22_line_segments": f"""SELECT doc_id, k::INT AS k, (44 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", n AS bytes FROM (SELECT doc_id, k, {tone_bytes('line')} AS n FROM {_LINE})
  UNION ALL SELECT DISTINCT doc_id, NULL::INT, 0::BIGINT, 44::BIGINT FROM {_LINE}""",
    "a22_file_parts": f"""WITH g AS (SELECT doc_id, k, (44 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place, n, (sum(n) OVER (PARTITION BY doc_id))::BIGINT AS total FROM (SELECT doc_id, k, {tone_bytes('line')} AS n FROM {_LINE})),
  a AS (SELECT doc_id, place, n, total FROM g UNION ALL SELECT DISTINCT doc_id, 0, 44, total FROM g),
  p AS (SELECT doc_id, place // 100000 AS part, min(place) AS place, sum(n)::BIGINT AS bytes, any_value(total) AS total FROM a GROUP BY ALL)
  SELECT doc_id, part, place AS "offset", bytes, CASE WHEN part = 0 THEN {little('36 + total')} END AS riff, CASE WHEN part = 0 THEN {little('total')} END AS size FROM p""",
    "s11_marked_blocks": f"SELECT doc_id, kind, level::INT AS level, count(*) AS n, md5(string_agg(text || '/' || alt || '/' || anchor, '|' ORDER BY o)) AS texts FROM {_BLOCK_ROWS} WHERE text <> '' OR kind IN ('heading', 'hr', 'image') GROUP BY doc_id, kind, level",
    "j3_anchored_chapters": f"""SELECT t.book AS book, number::INT AS id, title, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_index) FILTER (text <> '' AND (size <= place OR block_index BETWEEN place AND place + 8)), '')) AS source, 'item' || any_value(b.spine_index)::VARCHAR AS section_ids
  FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY toc_index) AS number FROM {_PLACED}) t JOIN (SELECT *, count(*) OVER (PARTITION BY book, spine_index) AS size FROM {V.BLOCKS}) b ON t.book = b.book AND t.file = 'item' || b.spine_index::VARCHAR || '.xhtml' GROUP BY t.book, number, title""",
    "s1_book_blocks": f"SELECT doc_id, 'OEBPS/t/a.xhtml' AS zip_path, len(l)::BIGINT AS n, md5(array_to_string(l, chr(10) || chr(10))) AS text FROM (SELECT doc_id, {_LINES} AS l FROM documents)",
    "s4_book_contents": "SELECT doc_id, 'Book ' || doc_id::VARCHAR AS title, 'Chapter ' || doc_id::VARCHAR AS entry, 'OEBPS/t/a.xhtml' AS file, 'x' AS anchor, 1::BIGINT AS items FROM documents",
    "x1_batch_run": "SELECT (doc_id + 1)::INT AS chapter_id, CASE WHEN (doc_id + 1) % 5 = 0 THEN 'failed' ELSE 'ok' END AS outcome, md5(CASE WHEN (doc_id + 1) % 5 = 0 THEN '' ELSE split_part(text, chr(10), 1) END) AS content FROM documents",
    "x3_incremental_run": f"SELECT contains(line, '[WARN]') AS warn, count(*) AS n, sum(line_no)::BIGINT AS total FROM {V.LOG} GROUP BY ALL",
    "x4_status_stream": "SELECT o_orderpriority AS type, arg_max(o_orderstatus || o_orderkey::VARCHAR, o_orderkey) AS status, max(o_orderkey) AS updated FROM orders GROUP BY type",
    "x4_lifecycle": f"""WITH RECURSIVE o AS (SELECT o_custkey::VARCHAR AS type, {list(REPORTED)}[o_orderkey * 31 % 97 % 10 + 1] AS status, o_orderkey AS k, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [0, 1] ELSE [0] END) AS again FROM orders),
  u AS (SELECT type, status, k + k * 7919 % {LATE} + again AS minute, row_number() OVER (PARTITION BY type ORDER BY k + k * 7919 % {LATE} + again, 2 * k + again) AS n FROM o),
  r AS (SELECT DISTINCT type, 0::BIGINT AS n, '' AS status, 0::BIGINT AS since, 0 AS accepted, 0 AS repeated, 0 AS rejected, 0 AS expired FROM o
    UNION ALL SELECT type, n, CASE WHEN good OR again THEN new ELSE old END, CASE WHEN good OR again THEN minute ELSE since END, accepted + good::INT, repeated + again::INT, rejected + (NOT good AND NOT again)::INT, expired + gone::INT
    FROM (SELECT *, new = old AS again, CASE old WHEN '' THEN new = 'validating' WHEN 'deleted' THEN new = 'validating' WHEN 'validating' THEN new IN ('in_progress', 'completed', 'failed', 'expired', 'cancelled')
        WHEN 'in_progress' THEN new IN ('completed', 'failed', 'expired', 'cancelled') WHEN 'completed' THEN new IN ('processed', 'deleted') ELSE new = 'deleted' END AND new <> old AS good
      FROM (SELECT r.type, u.n, u.status AS new, u.minute, r.accepted, r.repeated, r.rejected, r.expired, r.status IN ('validating', 'in_progress') AND r.since + {SILENCE} < u.minute AS gone,
        CASE WHEN r.status IN ('validating', 'in_progress') AND r.since + {SILENCE} < u.minute THEN 'expired' ELSE r.status END AS old, r.since FROM r JOIN u ON u.type = r.type AND u.n = r.n + 1))),
  z AS (SELECT * FROM r WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY type ORDER BY n DESC) = 1)
  SELECT type, nullif(CASE WHEN status IN ('validating', 'in_progress') THEN 'expired' ELSE status END, '') AS status, accepted::BIGINT AS accepted, repeated::BIGINT AS repeated, rejected::BIGINT AS rejected, (expired + (status IN ('validating', 'in_progress'))::INT)::BIGINT AS expired FROM z""",
    "e2_noop_engine": f"SELECT doc_id + 1 AS chapter_id, 44 + n AS bytes, {little('n')} AS size FROM (SELECT doc_id, {tone_bytes('text')} AS n FROM documents)",
    "t24_stressed": f"SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+'), lambda x: {TRIM.format('x')}), lambda x: x <> ''), chr(10))) AS text FROM documents",
    "t24_modelled": f"SELECT doc_id, md5(array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+'), lambda x: {TRIM.format('x')}), lambda x: x <> ''), lambda x: '+' || x), chr(10))) AS text FROM documents",
}
