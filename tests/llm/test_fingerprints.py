"""Fingerprints and their trees against plain code."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprints as fp

md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain_tree(text):
    leaves = [[[f"{md5(x)}:{len(x)}" for x in re.findall("[^.!?,;]{1,64}[.!?,;]*|[.!?,;]+", p)] for p in s.split("\n")] for s in text.split("\n\n")]
    paragraphs = [[md5(",".join(p)) for p in s] for s in leaves]
    sections = [md5(",".join(s)) for s in paragraphs]
    return sha(",".join(sections)), paragraphs, {x for s in leaves for p in s for x in p}


def plain_likeness(a, b):
    size = lambda s: sum(int(x.split(":")[1]) for x in s)
    return 1.0 if a[0] == b[0] else 2 * size(a[2] & b[2]) / max(1, size(a[2]) + size(b[2]))


def plain_places(a, b):
    at = lambda x, k: x[k] if k < len(x) else None
    return [(s + 1, p + 1) for s in range(max(len(a[1]), len(b[1]))) for p in range(max(len(at(a[1], s) or []), len(at(b[1], s) or []))) if at(at(a[1], s) or [], p) != at(at(b[1], s) or [], p)]


def key(i, t):
    return sha(("0" if i is None else f"1{i}") + ":" + t)


def plain_rows(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), key(*r)))
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        a, b, c = map(plain_tree, (text, other, following))
        places = plain_places(a, b)
        yield i, len(text), sha(other), a[0], b[0], plain_likeness(a, b), plain_likeness(a, c), len(places), ":".join(map(str, places[0])) if places else ""


def same(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = [tuple(r) for r in fp.fingerprints(df).collect()]
    assert Counter(got) == Counter(plain_rows(rows))
    by_text = {r["text"] or "": sha(r["text"] or "") for r in df.collect()}
    assert len({r[3] for r in got}) == len(by_text)  # equal roots for equal texts alone


@pytest.mark.parametrize("seed,group", [(1, 64), (2, 2), (3, 8)])
def test_against_plain_code(spark, documents, monkeypatch, seed, group):
    monkeypatch.setattr(fp, "GROUP_ROWS", group)
    monkeypatch.setattr(fp, "RANGE_ROWS", 20)
    rng = random.Random(seed)
    unit = lambda: rng.choice(["word", "naïve", "漢字", "😀", " ", "  ", "\n", "\n\n", "\n\n\n", ".", "?!", ",", "x" * 70, "\t"])
    texts = ["".join(unit() for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(30)]
    same(documents([(rng.choice([None, *range(60)]), rng.choice([None, *texts])) for _ in range(120)]))


def test_edges(edge, documents):
    """Nulls, empty, long and repeated texts; one row; one row repeated; none."""
    same(edge)
    same(documents([(5, "only one. text")]))
    same(documents([(5, "again. and again")] * 9 + [(4, "b")] * 2))
    assert fp.fingerprints(documents([])).count() == 0


def test_copies_in_batches(documents, monkeypatch):
    monkeypatch.setattr(fp, "COPIES", 4)
    same(documents([(None, "x y z")] * 11 + [(1, None)] * 5))


def test_edits_are_located(spark):
    """A changed paragraph alone differs; a paragraph that goes in moves those of its own section only."""
    a = "one.\ntwo.\n\nthree.\nfour.\n\nfive."
    rows = [(a, a.replace("four", "4"), [(2, 2)]), (a, a.replace("two.", "two.\nnew."), [(1, 3)]), (a, a.replace("one.\n", "new.\none.\n"), [(1, 1), (1, 2), (1, 3)]), (a, a, []), (a, "", plain_places(plain_tree(a), plain_tree("")))]
    df = fp.with_tree(fp.with_tree(spark.createDataFrame([r[:2] for r in rows], "a string, b string"), "a", "x"), "b", "y")
    assert [[tuple(p) for p in r[0]] for r in df.select(fp.differing(F.col("x"), F.col("y"))).collect()] == [r[2] for r in rows]


def test_native(spark, documents):
    plan = fp.fingerprints(documents([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|SinglePartition, ENSURE_REQUIREMENTS.*text", plan)
