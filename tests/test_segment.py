import pytest
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import segment
from lectern.operators.segment import cut_trailer
from lectern.plans import views as V
from lectern.plans.project_queries import forced_index

ITEM = f"book string, spine_index int, id string, href string, blocks {schemas.BLOCKS}"
TOC = "book string, toc_index int, Title string, SrcFile string, SrcAnchor string"


def h(text, level=1, anchor=""):
    return ("heading", level, anchor, text, "")


def p(text):
    return ("paragraph", 0, "", text, "")


def items(spark, *lists, book="b"):
    return spark.createDataFrame([(book, k, f"i{k}", f"x/i{k}.html", list(b)) for k, b in enumerate(lists)], ITEM)


def toc(spark, *entries, book="b"):
    return spark.createDataFrame([(book, k, *e) for k, e in enumerate(entries)], TOC)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_toc(spark):
    it = items(spark, [h("Copyright"), p("c")], [h("Chapter 1", 1, "a"), p("one"), h("Chapter 2", 1, "b"), p("two"), h("sub", 3), p("more")], [h("x"), ("image", 0, "", "", "pic"), ("hr", 0, "", "", "")])
    entries = toc(spark, ("Copyright", "i0.html", ""), ("Chapter 1", "y/i1.html", "a"), ("Chapter 2", "i1.html", "b"), ("Chapter 3", "gone.html", ""), ("Chapter 4", "i2.html", ""), ("Chapter 5", "i1.html", "nowhere"), ("Something", "i2.html", ""))
    chapters, skipped = segment.by_toc(it, entries, 700)
    assert rows(chapters, "id", "title", "source", "toc_entry_index") == [
        (701, "Chapter 1", "Chapter 1\n\none", 1),
        (702, "Chapter 2", "Chapter 2\n\ntwo\n\nsub\n\nmore", 2),
        (704, "Chapter 4", "x\n\n[image: pic]", 4),
        (705, "Chapter 5", "Chapter 1\n\none\n\nChapter 2\n\ntwo\n\nsub\n\nmore", 5),
    ]
    assert rows(skipped, "title", "reason", "snippet") == [("Copyright", "copyright", "Copyright\n\nc"), ("Something", "ambiguous-default-skip", "x\n\n[image: pic]")]


def test_headings(spark):
    it = items(spark, [h("Dedication"), p("d")], [p("lost"), h("Chapter 1"), p("a")], [p("b"), h("Chapter 2", 2), h("Chapter 3"), h("Chapter 4", 3), p("c")], [])
    chapters, skipped = segment.by_headings(it, 10)
    assert rows(chapters, "id", "title", "source", "section_ids") == [(11, "Chapter 1", "a\n\nb", ["i1", "i2"]), (12, "Chapter 3", "Chapter 4\n\nc", ["i2"])]
    assert rows(skipped, "title", "reason", "src_file") == [("Dedication", "dedication", "x/i0.html")]
    assert segment.by_headings(items(spark, [p("only")]))[0].isEmpty()


def test_items_and_choice(spark):
    it = items(spark, [h("A"), p("x")], [], [p("y")])
    assert rows(segment.per_item(it), "id", "title", "source") == [(1, "A", "A\n\nx"), (2, "i2", "y")]
    both = it.unionByName(items(spark, [h("Chapter 1"), p("a"), h("Chapter 2"), p("b")], book="h")).unionByName(items(spark, [p("a")], [p("b")], book="t")).unionByName(items(spark, [p("a")], book="one"))
    entries = toc(spark, ("Chapter 1", "i0.html", ""), ("Chapter 2", "i1.html", ""), book="t")
    chapters, _, index = segment.split(both, entries)
    assert rows(index, "book", "strategy", "chapter_count") == [("b", "per-item", 2), ("h", "heading", 2), ("one", "per-item", 1), ("t", "toc", 2)]
    assert {r["book"]: len(r["warnings"]) for r in index.collect()} == {"b": 1, "h": 0, "one": 1, "t": 0}
    assert rows(chapters, "book", "title") == [("b", "A"), ("b", "i2"), ("h", "Chapter 1"), ("h", "Chapter 2"), ("one", "i0"), ("t", "Chapter 1"), ("t", "Chapter 2")]
    assert rows(segment.split(both, entries, force="heading")[2], "book", "chapter_count") == [("b", 0), ("h", 2), ("one", 0), ("t", 0)]
    with pytest.raises(ValueError):
        segment.split(both, entries, force="magic")


def test_trailers(spark):
    assert cut_trailer("body\n\n***\nRead at X", "read at x") == "body"
    assert cut_trailer("body *****  Read at X", "Read") == "body"
    assert cut_trailer("a\n***\n" + "b" * 500 + " Read", "Read") == "a\n***\n" + "b" * 500 + " "
    assert cut_trailer("Read" + "b" * 500, "Read") == "Read" + "b" * 500
    assert cut_trailer("x", "") == "x" and cut_trailer("", "x") == ""
    assert cut_trailer("я" * 300 + " ЧИТАЙ", "читай") == "я" * 300 + " "
    df = spark.createDataFrame([(1, "T", " body\n***\nRead \n")], "id int, title string, source string").selectExpr("*", "0L as raw_size")
    assert rows(segment.stripped(df, ["Nothing", "read"]), "raw_size", "source") == [(17, "body")]
    assert rows(segment.stripped(df, []), "raw_size") == [(0,)]


def test_inputs(spark):
    refs = spark.createDataFrame([("b", 0, "x", True), ("b", 1, "gone", True)], "book string, spine_index int, id string, linear boolean")
    manifest = spark.createDataFrame([("b", "x", "x.html", "text/html")], "book string, id string, href string, media_type string")
    assert rows(segment.spine_rows(refs, manifest), "spine_index", "href") == [(0, "x.html")]
    it = items(spark, [p("a")], [p("b")])
    joined = segment.split_input(it.drop("blocks"), it.where("spine_index = 1").select("book", "spine_index", "blocks"))
    assert {r["spine_index"]: len(r["blocks"]) for r in joined.collect()} == {0: 0, 1: 1}


def _plain_headings(items):
    """Chapters of one book by headings, block by block: (title, texts, item ids), and the ids of skipped items."""
    chapters, skipped = [], []
    for n, blocks in items:
        met = bool(chapters)
        for kind, level, text in blocks:
            if kind == "heading" and level in (1, 2) and text.startswith("Chapter"):
                chapters.append((text, [], [f"i{n}"]))
            elif chapters:
                chapters[-1][1].append(text)
                if f"i{n}" not in chapters[-1][2]:
                    chapters[-1][2].append(f"i{n}")
        if blocks and not met and not chapters:
            skipped.append(f"h{n}")
    return [c for c in chapters if c[1]], skipped


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_large_book_in_many_tasks(spark, seed):
    """A book of all items: scans by ranges give what block by block gives; no window holds the book."""
    import random

    rng = random.Random(seed)
    block = lambda: rng.choice([("paragraph", 0, f"p{rng.random()}"), ("paragraph", 0, f"q{rng.random()}"), ("heading", rng.choice([1, 2, 3]), rng.choice(["Chapter 5", "Notes", "Other"]))])
    plain = [(n, [block() for _ in range(rng.choice([0, 1, 4, 9]))]) for n in range(300)]
    plain[:3] = [(0, [("paragraph", 0, "front")]), (1, []), (2, [("heading", 3, "Chapter 5"), ("paragraph", 0, "x")])]
    rows = [("b", n, f"i{n}", f"h{n}", [(k, lv, "", t, "") for k, lv, t in blocks]) for n, blocks in plain]
    df = spark.createDataFrame(rows, "book string, spine_index long, id string, href string, blocks array<struct<kind:string,level:int,anchor:string,text:string,alt:string>>")
    chapters, skipped = segment.by_headings(df, 10)
    want, front = _plain_headings(plain)
    got = sorted((r["id"], r["title"], r["source"], r["section_ids"]) for r in chapters.collect())
    assert got == [(k + 11, title, "\n\n".join(texts), ids) for k, (title, texts, ids) in enumerate(want)]
    assert sorted(r["src_file"] for r in skipped.collect()) == sorted(front)
    assert "windowspecdefinition(book" not in chapters._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_anchored_sections_of_any_length(spark, monkeypatch, seed):
    """Intervals of blocks by anchors against walking over the item's blocks."""
    import random

    monkeypatch.setattr(segment, "BUCKET", 4)
    rng = random.Random(seed)
    blocks = lambda n: [(rng.choice(["heading", "paragraph"]), 1, rng.choice(["", "a", "a", "b", "c"]), f"t{k}", "") for k in range(n)]
    items = [("b", n, f"i{n}", f"x/f{n % 5}.xhtml", blocks(rng.choice([0, 3, 40]))) for n in range(12)]
    toc = [("b", k, "Chapter 1", f"f{rng.randrange(6)}.xhtml", rng.choice(["", "a", "b", "c", "none"])) for k in range(25)]
    want = []
    for k, (_, _, title, file, anchor) in enumerate(toc):
        own = [i for i in items if i[3].endswith(file)]
        if not own:
            continue
        heads = [p for p, b in enumerate(own[0][4]) if b[0] == "heading"]
        start = next((p for p in heads if anchor and own[0][4][p][2] == anchor), None)
        if start is None:
            text, ids = [b[3] for i in own for b in i[4]], [i[2] for i in own]
        else:
            stop = next((p for p in heads if p > start and own[0][4][p][2] not in ("", anchor)), len(own[0][4]))
            text, ids = [b[3] for b in own[0][4][start:stop]], [own[0][2]]
        want.append((k + 1, "\n\n".join(text), ids, k))
    kind = "book string, spine_index long, id string, href string, blocks array<struct<kind:string,level:int,anchor:string,text:string,alt:string>>"
    made, _ = segment.by_toc(spark.createDataFrame(items, kind), spark.createDataFrame(toc, "book string, toc_index int, Title string, SrcFile string, SrcAnchor string"))
    assert sorted((r["id"], r["source"], r["section_ids"], r["toc_entry_index"]) for r in made.collect()) == want


def test_items_are_made_once(spark, monkeypatch):
    """Strategies read stored items, however often they need the blocks."""
    seen = spark.sparkContext.accumulator(0)

    def counted(name):
        seen.add(1)
        return name

    once = F.udf(counted, "string").asNondeterministic()
    block = "struct('heading' as kind, 1 as level, '' as anchor, concat('Chapter ', id) as text, '' as alt), struct('paragraph' as kind, 0 as level, '' as anchor, 'x' as text, '' as alt)"
    items = spark.range(20).selectExpr("'b' as book", "cast(id as int) as spine_index", "concat('i', id) as id", "concat('i', id) as href", f"array({block}) as blocks").withColumn("href", once("href"))
    toc = spark.createDataFrame([], TOC)
    monkeypatch.setattr(V, "items", lambda s, d: items)
    monkeypatch.setattr(V, "toc", lambda s, d: toc)
    assert sorted((r["strategy"], r["chapter_count"]) for r in forced_index(spark, "").collect()) == [("heading", 20), ("per-item", 20), ("toc", 0)]
    assert seen.value == 20
    chapters, _, index = segment.split(items, toc)
    assert [r["strategy"] for r in index.collect()] == ["heading"] and chapters.count() == 20 and seen.value == 40
