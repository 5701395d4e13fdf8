import pytest
from pyspark.sql import functions as F

from lectern.operators import context, qa, vocab

TERM = "ord long, source string, target string, type string, first_seen_chapter int, chapters array<int>"
CHAR = "ord long, name string, translation string, role string, description string, chapters array<int>"
STRESS = "merge int, ord long, term string, stressed string, approved boolean, chapters array<int>"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_terms(spark):
    old = spark.createDataFrame([(0, "Sect", "Секта", "term", 0, [1])], TERM)
    new = spark.createDataFrame([(0, "sect", "Другая", "term", 0, [2]), (1, "Qi", "Ци", "", 0, []), (2, "", "x", "", 0, []), (3, "y", "", "", 0, []), (4, "QI", "Чи", "", 0, [])], TERM)
    out = vocab.merged_terms(old, new)
    assert rows(out, "source", "target", "added") == [("Qi", "Ци", True), ("Sect", "Секта", False)]
    assert rows(vocab.merged_terms(out.drop("added"), new), "source", "target") == rows(out, "source", "target")


def test_characters(spark):
    old = spark.createDataFrame([(0, "Lin", "", "hero", "", [1])], CHAR)
    new = spark.createDataFrame([(0, "LIN", "Линь", "other", "", [2]), (1, "lin", "Лин", "", "tall", [3]), (2, "", "x", "", "", []), (3, "Bo", "Бо", "", "", None)], CHAR)
    assert rows(vocab.merged_characters(old, new), "name", "translation", "role", "description", "added") == [("Bo", "Бо", "", "", True), ("Lin", "Линь", "hero", "tall", False)]


def test_tags(spark):
    found = spark.createDataFrame([(2, 0, "Qi"), (1, 5, "qi"), (2, 9, "QI"), (3, 1, "")], "chapter_id int, ord long, source string")
    had = spark.createDataFrame([(0, "qi", "x", "", 0, [7, 1]), (1, "old", "y", "", 0, [4])], TERM)
    tags = vocab.chapters_of(found, had, "source")
    assert {r["key"]: r["chapters"] for r in tags.collect()} == {"qi": [2, 1, 7], "old": [4]}
    out = vocab.tagged(spark.createDataFrame([(0, "QI", "", "", 0, []), (1, "new", "", "", 0, [9])], TERM), tags, "source")
    assert rows(out, "source", "chapters") == [("QI", [2, 1, 7]), ("new", [9])]
    assert rows(vocab.counts_by_chapter(spark.createDataFrame([(0, "a", "", "", 0, [1, 1, 2]), (1, "b", "", "", 0, [2]), (2, "c", "", "", 0, None)], TERM)), "chapter_id", "n") == [(1, 1), (2, 2)]


def test_stress_merge(spark):
    e = [(0, 0, "Замок", "з+амок", False, [1]), (0, 1, "мука", "м+ука", True, [1]), (1, 0, "замок", "зам+ок", False, []), (1, 1, "замок", "з+АМОК", False, []), (1, 2, "мука", "мук+а", False, []), (2, 0, "ЗАМОК", "замо+к", False, []), (2, 1, "новое", "н+овое", False, []), (2, 2, "", "x", False, []), (1, 9, "замок", "замок+", False, [])]
    store, conflicts = vocab.merged_stress(spark.createDataFrame(e, STRESS))
    assert rows(store, "term", "stressed") == [("Замок", "з+амок"), ("мука", "м+ука"), ("новое", "н+овое")]
    # One conflict for a term and merge: of the third form in merge 1 nothing is told.
    assert rows(conflicts, "merge", "term", "variants") == [(1, "замок", ["з+амок", "зам+ок"]), (2, "ЗАМОК", ["з+амок", "замо+к"])]
    one = vocab.deduplicated_conflicts(conflicts)
    assert rows(one, "term", "variants") == [("замок", ["з+амок", "зам+ок", "замо+к"])]
    same = spark.createDataFrame([(1, 0, "а", ["x", "Y"]), (2, 0, "А", ["y", "z"])], "merge int, ord long, term string, variants array<string>")
    assert rows(vocab.deduplicated_conflicts(same), "term", "variants") == [("а", ["x", "Y", "z"])]


def test_decisions(spark):
    store = spark.createDataFrame([(0, "a", "+a", False, [1]), (1, "A", "a+", False, [2]), (2, "b", "+b", False, []), (3, "c", "+c", True, [])], "ord int, term string, stressed string, approved boolean, chapters array<int>")
    d = spark.createDataFrame([("A", ""), ("b", "b+"), ("new", "n+ew"), ("none", "")], "term string, stressed string")
    assert rows(vocab.resolved(store, d), "term", "stressed", "approved") == [("A", "a+", False), ("b", "b+", True), ("c", "+c", True), ("new", "n+ew", True)]
    assert [r["term"] for r in vocab.stored_order(spark.createDataFrame([(0, "ab", "", False, []), (1, "яб", "", False, []), (2, "cd", "", False, [])], "ord int, term string, stressed string, approved boolean, chapters array<int>")).collect()] == ["яб", "ab", "cd"]
    assert rows(vocab.sanitized(spark.createDataFrame([("а", "+а́"), ("б", "б"), ("в", "+в")], "term string, stressed string")), "term", "stressed") == [("а", "+а")]


def test_variants(spark):
    df = spark.createDataFrame([(["b", "", "B", "a", None, "A", "c"],)], "f array<string>")
    assert df.select(vocab.unique_variants(F.col("f")).alias("v")).first()["v"] == ["b", "a", "c"]


def test_overrides(spark):
    terms = spark.createDataFrame([(0, "Qi", "Ци", "term", 0, [1]), (1, "Bo", "Бо", "term", 0, [])], TERM)
    o = spark.createDataFrame([(0, "QI", "", "place"), (1, "qi", "no", ""), (2, "New", "Новый", ""), (3, "x", "", "")], "ord long, source string, target string, type string")
    assert rows(vocab.overridden(terms, o, "source", "target", "type", "term"), "source", "target", "type") == [("Bo", "Бо", "term"), ("New", "Новый", "term"), ("Qi", "", "place")]
    stress = vocab.override_entries(spark.createDataFrame([(0, "а", "+а"), (1, "", "x"), (2, "б", "")], "ord int, term string, phonemes string"))
    assert rows(stress, "term", "stressed") == [("а", "+а")]


def test_with_characters(spark):
    terms = spark.createDataFrame([(0, "lin", "x", "term", 0, [1]), (1, "Old", "y", "character", 0, [1]), (2, "Qi", "Ци", "term", 0, [2]), (3, "QI", "z", "term", 0, [3])], TERM)
    chars = spark.createDataFrame([(0, "Lin", "Линь", "", "", [5]), (1, "No", "", "", "", [5])], CHAR)
    assert rows(vocab.with_characters(terms, chars), "source", "type", "chapters") == [("Lin", "character", [5]), ("Qi", "term", [2])]
    assert rows(vocab.with_characters(terms, chars, legacy=True), "source", "chapters")[0] == ("Lin", [])
    chapters = spark.createDataFrame([(5,), (2,), (9,)], "id int")
    blocks = context.prompt_blocks(context.terms_of_chapters(vocab.with_characters(terms, chars), chapters))
    assert rows(blocks, "chapter_id", "block") == [(2, context.GLOSSARY_HEAD + "\n[term]\n  Qi = Ци\n"), (5, context.GLOSSARY_HEAD + "\n[character]\n  Lin = Линь\n")]
    assert context.terms_of_chapters(vocab.with_characters(terms, chars, legacy=True), chapters).where("type = 'character'").isEmpty()


def test_vocabulary_applied(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Замок и замок, подзамок"), (2, None), (3, "")], "id int, text string")
    entries = [(0, "замок", "з+амок"), (1, "", "x"), (2, "и", "и"), (3, "амок", "ам+ок"), (4, "подзамок", "подз+амок"), (5, "з", "зз")]
    store = spark.createDataFrame(entries, "ord int, term string, stressed string")
    want = [(1, "зз+ам+ок и зз+ам+ок, подз+амок"), (2, None), (3, "")]  # later entries see the marks of those before
    assert rows(vocab.applied(df, store), "id", "text") == want
    monkeypatch.setattr(vocab, "PASS_ENTRIES", 2)
    assert rows(vocab.applied(df, store), "id", "text") == want
    assert rows(vocab.applied(df, store.where("false")), "id", "text") == rows(df, "id", "text")


def test_summaries(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d"), (5, ""), (6, "f")], "chapter_id int, summary string")
    got = dict(rows(context.previous_summaries(df), "chapter_id", "context"))
    head = context.CONTEXT_HEAD
    assert got == {1: "", 2: head + "[Chapter 1 summary]\na", 4: head + "[Chapter 2 summary]\nb", 5: head + "[Chapter 4 summary]\nd", 6: head + "[Chapter 4 summary]\nd"}
    assert set(dict(rows(context.previous_summaries(df, 0), "chapter_id", "context")).values()) == {""}


def test_outcomes(spark):
    r = spark.createDataFrame([("analyze-chapter-1", '{"characters":[{"name":"Lin"}],"terms":[{"source":"Qi"}],"summary":" s "}', ""), ("bad", "", "boom"), ("analyze-chapter-3", "not json", ""), ("other-1", "{}", "")], "custom_id string, content string, error string")
    chars, terms, summaries, out = context.extracted(r)
    assert rows(out, "custom_id", "outcome") == [("analyze-chapter-1", "ok"), ("analyze-chapter-3", "failed"), ("bad", "failed"), ("other-1", "unrecognised")]
    assert rows(chars, "chapter_id", "name") == [(1, "Lin")] and rows(terms, "source") == [("Qi",)] and rows(summaries, "summary") == [("s",)]
    assert rows(context.outcomes(r, "analyze"), "custom_id", "outcome")[2] == ("bad", "unrecognised")


def test_substring_joins(spark):
    docs = spark.createDataFrame([(1, "Hello WORLD wide"), (2, "nothing here"), (3, ""), (4, None)], "d int, t string")
    terms = spark.createDataFrame([(1, "world"), (2, "o"), (3, ""), (4, "world wide web"), (5, "WORLD W"), (6, None)], "k int, q string")
    want = [(1, 1), (1, 2), (1, 5), (2, 2)]
    assert rows(qa.containing_by_pieces(docs, terms, "t", "q", "d", "k"), "d", "k") == want
    assert rows(qa.containing(docs, terms, "t", "q", "d", "k"), "d", "k") == want
    assert rows(qa.containing(docs, terms.where("false"), "t", "q", "d", "k"), "d", "k") == []
    twice = spark.createDataFrame([("a", "WORLD"), ("b", "world"), ("c", None)], "k string, q string")
    assert rows(qa.containing(docs, twice, "t", "q", "d", "k"), "d", "k") == [(1, "a"), (1, "b")]


def test_log(spark):
    lines = ["x", "[INFO] a", "more", "\x1b[33m[WARN] parsing for text '<s>Hello", "world</s>', gone", "\x1b[0mtail", "INFO: b", "[ERROR] no snippet", "ERROR: other", "after"]
    w = qa.log_warnings(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"))
    assert rows(w, "first_line", "entry", "snippet") == [(3, "[WARN] parsing for text '<s>Hello\nworld</s>', gone\ntail", "Hello\nworld"), (7, "[ERROR] no snippet", "")]
    ssml = spark.createDataFrame([(2, "<s>hello\nWORLD</s>"), (1, "<s>x</s>"), (5, "hello\nworld")], "chapter_id int, ssml string")
    assert rows(qa.warnings_by_chapter(w, ssml), "first_line", "chapter_id") == [(3, 2)]


def test_guard(spark):
    import pytest
    from pyspark.errors import PySparkException

    ok = spark.createDataFrame([("<speak><p>Да.</p></speak>",)], "ssml string")
    assert qa.guarded(ok).count() == 1
    with pytest.raises(PySparkException, match="latin"):
        qa.guarded(spark.createDataFrame([("<speak>abc</speak>",)], "ssml string")).collect()
    assert rows(qa.problems(spark.createDataFrame([(1, "да"), (2, "да abc é")], "chapter_id int, text string")), "chapter_id", "words", "symbols") == [(2, ["abc"], ["é"])]


@pytest.mark.parametrize("seed,salt", [(1, 100_000), (2, 3)])
def test_substring_joins_of_all_lengths(spark, monkeypatch, seed, salt):
    """Terms of 1 to 40 letters, hot pieces over salts, odd letters; both ways against plain search."""
    import random

    monkeypatch.setattr(qa, "SALT_TEXTS", salt)
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("aabAB é漢😀İ.") for _ in range(n))
    docs = [(k, rng.choice(["common start of all ", ""]) + text(rng.choice([0, 3, 60]))) for k in range(60)] + [(99, None)]
    terms = [(k, text(rng.choice([1, 2, 3, 5, 6, 9, 40]))) for k in range(60)] + [(k + 60, docs[k][1][3 : 3 + rng.randrange(1, 41)]) for k in range(60)] + [(500, "common start"), (501, None), (502, "")]
    d, q = spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(terms, "k int, q string")
    lower = {x: y for x, y in spark.createDataFrame([(x,) for _, x in docs + terms if x], "x string").distinct().select("x", F.lower("x")).collect()}
    want = sorted((i, k) for i, t in docs for k, x in terms if t and x and lower[x] in lower[t])
    assert rows(qa.containing_by_pieces(d, q, "t", "q", "d", "k"), "d", "k") == want
    assert rows(qa.containing(d, q, "t", "q", "d", "k"), "d", "k") == want
    plan = qa.containing_by_pieces(d, q, "t", "q", "d", "k")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def _entry_by_entry(text, entries):
    import re

    for term, form in entries:
        text = re.sub(rf"(?<![^\W_]){re.escape(term)}(?![^\W_])", lambda _: form, text, flags=re.I)  # noqa: B023
    return text


@pytest.mark.parametrize("seed", range(6))
def test_vocabulary_in_one_pass(seed):
    """Overlapping terms, terms within forms, repeated terms, odd boundaries: as entry by entry."""
    import random

    rng = random.Random(seed)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(400):
        letters = rng.choice(["ab +", "aB-_ ", "ав+ е.", "a +"])
        entries = [(some(rng.randrange(1, 6), letters), some(rng.randrange(1, 8), letters)) for _ in range(rng.randrange(1, 12))]
        text = some(rng.randrange(0, 60), letters)
        assert vocab.applier([e[0] for e in entries], [e[1] for e in entries])(text) == _entry_by_entry(text, entries), (text, entries)


def test_vocabulary_is_linear():
    """Twice as many entries that occur take about twice the time, not four times."""
    import time

    took = []
    for n in (2000, 8000):
        words = [f"w{k}x" for k in range(n)]
        apply = vocab.applier(words, [w[:1] + "+" + w[1:] for w in words])
        text = " ".join(words)
        begun = time.perf_counter()
        assert apply(text) == " ".join(w[:1] + "+" + w[1:] for w in words)
        took.append(time.perf_counter() - begun)
    assert took[1] < 10 * took[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_of_lists(spark, seed):
    """Pages joined are the whole list, each within the bound unless one entry is longer; each page of JSON is valid."""
    import json
    import random

    rng = random.Random(seed)
    terms = [(k, rng.choice(["é", "a", "漢"]) * rng.choice([1, 5, 30, 90, 200]), "t" * rng.randrange(9), rng.choice(["character", "place", "odd", "term"]), rng.choice([1, 2])) for k in range(120)]
    df = spark.createDataFrame(terms, "ord long, source string, target string, type string, chapter_id int").repartition(5)
    pages = [r["json"] for r in context.prompt_pages(df, ("source", "target"), 400).orderBy("page").collect()]
    whole = json.loads(context.for_prompt(df, ("source", "target")).first()["json"])
    assert [x for p in pages for x in json.loads(p)] == whole and len(pages) > 10
    assert all(len(p.encode()) <= 400 or len(json.loads(p)) == 1 for p in pages)
    kinds = df.withColumnRenamed("type", "kind")
    locked = [r["locked"] for r in context.locked_pages(kinds, 300).orderBy("page").collect()]
    assert "".join(locked) == context.locked_terms(kinds).first()["locked"] and all(len(p.encode()) <= 300 or p.count("\n") == 1 for p in locked)
    blocks = {r["chapter_id"]: r["block"] for r in context.prompt_blocks(df).collect()}
    paged = {}
    for r in context.block_pages(df, most=500).orderBy("chapter_id", "page").collect():
        paged[r["chapter_id"]] = paged.get(r["chapter_id"], "") + r["block"]
    assert paged == blocks


def test_substring_join_writes_no_pieces_of_texts(spark, monkeypatch):
    """Beyond one automaton, what is shuffled grows with the hits, not with the letters of the texts; passes and odd sizes; equal
    snippets are looked for once."""
    import random

    monkeypatch.setattr(qa, "MOST_PIECES", 7)
    monkeypatch.setattr(qa, "MOST_TERMS", 0)
    rng = random.Random(3)
    docs = [(k, "".join(rng.choice("abcdé😀 ") for _ in range(rng.randrange(0, 300)))) for k in range(60)]
    terms = [(k, docs[rng.randrange(60)][1][p : p + rng.choice([1, 2, 3, 5, 6, 7, 20, 40])]) for k, p in enumerate(rng.randrange(0, 200) for _ in range(40))] + [(99, "zzzzzzzzz")]
    d, q = spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(terms, "k int, q string")
    made = qa.containing(d, q, "t", "q", "d", "k")
    assert rows(made, "d", "k") == sorted((i, k) for i, t in docs for k, x in terms if x and x in t)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Generate explode(array_distinct" not in plan
    asked = []
    monkeypatch.setattr(qa, "containing", lambda docs, terms, *rest: asked.append(terms.count()) or qa.containing_by_pieces(docs, terms, *rest))
    w = spark.createDataFrame([(k, "e", x) for k, x in enumerate(["Hello w", "hello W", "", "none", "Hello w"])], "first_line int, entry string, snippet string")
    ssml = spark.createDataFrame([(4, "hello world"), (2, "HELLO WORLD"), (1, None)], "chapter_id int, ssml string")
    found = qa.warnings_by_chapter(w, ssml)
    assert rows(found, "first_line", "chapter_id") == [(0, 2), (1, 2), (4, 2)] and asked == [2]
    assert found.columns == ["first_line", "entry", "snippet", "chapter_id"]
