import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern.plans import project_queries, run_queries
from lectern.sources import batches, epub
from lectern.sources.html import blocks_of, exploded, parse, with_blocks

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:language>en</dc:language></metadata>
<manifest><item id="c1" href="text/c1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="text/c2.xhtml" media-type="application/xhtml+xml"/><item id="img" href="i.png" media-type="image/png"/>{more}</manifest>
<spine><itemref idref="c1"/><itemref idref="gone"/><itemref idref="c2" linear="no"/><itemref idref="img"/></spine></package>"""
NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text> One </text></navLabel><content src="text/c1.xhtml#a"/><navPoint><navLabel><text>Sub</text></navLabel><content src="text/c1.xhtml"/></navPoint></navPoint><navPoint><navLabel><text>Two</text></navLabel><content src="text/c2.xhtml"/></navPoint></navMap></ncx>'
NAV = '<html><body><nav><ol><li><a href="x">X</a></li></ol></nav><nav epub:type="toc"><ol><li><span>Group</span><ol><li><a href="text/c1.xhtml">One</a></li></ol></li><li><a href="text/c2.xhtml#z">Two</a><ol><li><a href="text/c2.xhtml">In</a></li></ol></li></ol></nav></body></html>'
XHTML = '<html><body><h1 id="a">Chapter 1</h1><p>Hello  <b>big</b>\n world</p></body></html>'


def archive(**changes) -> bytes:
    more = changes.pop("more", '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>')
    files = {"META-INF/container.xml": CONTAINER, "OEBPS/content.opf": OPF.format(more=more), "OEBPS/toc.ncx": NCX, "OEBPS/text/c1.xhtml": XHTML, "OEBPS/text/c2.xhtml": "<p>Two", "OEBPS/nav.xhtml": NAV} | changes.pop("files", {})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            if v is not None:
                z.writestr(k, v)
    return out.getvalue()


def kinds(html):
    return [(b["kind"], b["level"], b["anchor"], b["text"] or b["alt"]) for b in blocks_of(html)]


def test_blocks():
    assert kinds('<body><div id="d"><h2>A</h2><h3 id="x">B</h3><p id="q">p</p></div><hr><img alt="pic"></body>') == [("heading", 2, "d", "A"), ("heading", 3, "x", "B"), ("paragraph", 0, "d", "p"), ("hr", 0, "", ""), ("image", 0, "", "pic")]
    assert kinds("<body>loose <span>lost</span><a>lost</a><blockquote id=b><p>q</p></blockquote></body>") == [("paragraph", 0, "b", "q")]
    assert kinds("<p>one<p>two<ul><li>a<li>b</ul><pre> x\n y </pre><h1></h1>") == [("paragraph", 0, "", "one"), ("paragraph", 0, "", "two"), ("list_item", 0, "", "a"), ("list_item", 0, "", "b"), ("pre", 0, "", "x y"), ("heading", 1, "", "")]
    assert kinds("<p>a<br>b &amp; &copy;</p><p> </p><script>x</script><style>y</style><nav><p>n</p></nav><svg><p>s</p></svg>") == [("paragraph", 0, "", "ab & ©")]
    assert kinds("<table><tr><td><p>c</p><td>loose</table><p>after") == [("paragraph", 0, "", "c"), ("paragraph", 0, "", "after")]
    assert kinds("") == [] and kinds("<html><head><title>t</title></head></html>") == []
    assert kinds(b"<p>\xff</p>") == [("paragraph", 0, "", "�")]
    assert parse("<title>t</title><p>x").find("p").content() == "x"


def test_deep_nesting():
    assert kinds("<div>" * 5000 + "<p>x</p>") == [("paragraph", 0, "", "x")]


def test_with_blocks(spark):
    rows = exploded(with_blocks(spark.createDataFrame([(1, "<h1>A</h1><p>b"), (2, None)], "id int, html string"))).collect()
    assert [(r["id"], r["block_index"], r["kind"], r["text"]) for r in rows] == [(1, 0, "heading", "A"), (1, 1, "paragraph", "b")]


def test_book():
    b = epub.Book(archive())
    assert b.metadata["title"] == "T" and b.metadata["creators"] == ["A", "B"]
    assert [(s["spine_index"], s["id"], s["linear"]) for s in b.spine] == [(0, "c1", True), (1, "c2", False), (2, "img", True)]
    assert [(t["Title"], t["SrcFile"], t["SrcAnchor"], t["Order"], t["Depth"]) for t in b.toc()] == [("One", "OEBPS/text/c1.xhtml", "a", 1, 1), ("Sub", "OEBPS/text/c1.xhtml", "", 2, 2), ("Two", "OEBPS/text/c2.xhtml", "", 3, 1)]
    assert [(i["item_id"], [x["text"] for x in i["blocks"]]) for i in b.blocks()] == [("c1", ["Chapter 1", "Hello big world"]), ("c2", ["Two"])]


def test_navigation():
    b = epub.Book(archive(more='<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="x nav"/>'))
    # A group with a label only takes its child's link, and the child has it again.
    assert [(t["Title"], t["Depth"], t["SourceKind"]) for t in b.toc()] == [("One", 1, "nav"), ("One", 2, "nav"), ("Two", 1, "nav"), ("In", 2, "nav")]
    empty = epub.Book(archive(more='<item id="nav" href="nav.xhtml" media-type="x" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', files={"OEBPS/nav.xhtml": "<p>none"}))
    assert len(empty.toc()) == 3
    assert epub.Book(archive(more="")).toc() == []


def test_broken_books():
    epub.Book(archive(files={"OEBPS/content.opf": None, "oebps/CONTENT.opf": OPF.format(more="")}))
    untyped = CONTAINER.replace("application/oebps-package+xml", "x")
    assert epub.Book(archive(files={"META-INF/container.xml": untyped})).opf_path == "OEBPS/content.opf"
    for files in ({"META-INF/container.xml": None}, {"OEBPS/content.opf": None}, {"OEBPS/content.opf": "<package><spine/></package>"}, {"META-INF/container.xml": "<container/>"}, {"OEBPS/content.opf": "<a"}):
        with pytest.raises(epub.BookError):
            epub.Book(archive(files=files))
    with pytest.raises(epub.BookError):
        epub.Book(b"not a zip")


def test_book_tables(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"b{k}.epub").write_bytes(archive())
    for table, n in (("metadata", 3), ("manifest", 12), ("spine", 9), ("toc", 9), ("blocks", 6)):
        assert epub.read_books(spark, str(tmp_path / "*.epub"), table).count() == n
    spark.dataSource.register(epub.EpubSource)
    rows = spark.read.format("epub").option("table", "blocks").load(str(tmp_path / "*.epub")).collect()
    assert len(rows) == 6 and rows[0]["blocks"][0]["kind"] == "heading"


def line(**x):
    return json.dumps(x)


def body(*texts):
    return {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": t} for t in texts]}]}


def test_results(spark):
    lines = [line(custom_id="a", response={"status_code": 200, "body": body("x", "y")}), "  ", line(custom_id="b", error={"code": "c", "message": "m"}, response={"status_code": 200, "body": body("x")}), line(custom_id="d"), line(custom_id="e", response={"status_code": 429, "body": {"k": 1}}), line(custom_id="f", response={"status_code": 200, "body": body("")})]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["custom_id"]: (r["content"], r["error"]) for r in batches.parse_results(df).collect()}
    assert got == {"a": ("xy", ""), "b": ("", "c: m"), "d": ("", "no response in output line"), "e": ("", 'HTTP 429: {"k":1}'), "f": ("", "empty output text")}
    bad = spark.createDataFrame([("not json",)], "value string")
    with pytest.raises(PySparkException):
        batches.parse_results(bad).collect()
    assert batches.parse_results(bad, strict=False).first()["error"] == "not a result line"


def test_requests(spark):
    rows = spark.createDataFrame([("a", "i", "t", "m", True, 0), ("b", "i", "t", "m", False, 5)], "custom_id string, instructions string, input string, model string, json_mode boolean, max_tokens long")
    a, b = (json.loads(r["value"]) for r in batches.request_lines(rows).collect())
    assert a == {"custom_id": "a", "method": "POST", "url": "/v1/responses", "body": {"input": [{"content": "t", "role": "user"}], "instructions": "i", "model": "m", "reasoning": {"effort": "none"}, "text": {"format": {"type": "json_object"}}}}
    assert b["body"]["max_output_tokens"] == 5 and "text" not in b["body"]


def test_small_books_are_read_together_and_packed_once(spark, monkeypatch):
    """Rows of many small books make one Arrow batch; queries that read several tables of books pack them once."""
    packed = run_queries.archives(spark, "/root/testdata/sf0.001", odd=True).limit(40).collect()
    batch = pa.RecordBatch.from_pydict({"path": [r["path"] for r in packed], "content": [bytes(r["content"]) for r in packed]})
    schema = epub._arrow_schema(spark, "path string, " + epub.TABLES["spine"])
    assert [b.num_rows for b in epub.parsed([batch], "spine", schema)] == [40]
    monkeypatch.setattr(epub, "SLICE", 1)
    assert [b.num_rows for b in epub.parsed([batch], "spine", schema)] == [1] * 40
    seen = spark.sparkContext.accumulator(0)

    def counted(path):
        seen.add(1)
        return path

    once = F.udf(counted, "string").asNondeterministic()
    books = spark.createDataFrame(packed).withColumn("path", once("path"))
    monkeypatch.setattr(run_queries, "archives", lambda *a, **k: books)
    assert project_queries.second_rootfile(spark, "").count() == 40 and seen.value == 40
    assert run_queries.book_contents(spark, "").count() == 40 and seen.value == 80
