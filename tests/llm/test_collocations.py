"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lectern.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, " ".join(w[i : i + m])] += 1
    return f, n


def plain(f, n, least, most):
    candidates = {k: a for k, a in f.items() if " " in k[1] and a >= least}
    around = Counter()
    for (lang, phrase), a in candidates.items():
        w = phrase.split(" ")
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                k = (lang, " ".join(w[i : i + m]))
                around[k] = max(around[k], a)
    found = defaultdict(list)
    for (lang, phrase), a in candidates.items():
        w, cuts = phrase.split(" "), []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        if 100 * around[lang, phrase] < 80 * a:
            found[lang].append((-score, -a, phrase.encode(), left, right))
    return [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]


def with_langs(spark, rows):
    return spark.createDataFrame([(l, t, 1, "p", 2, "x", 3, 4) for l, t in rows], "lang string, text string, n int, phrase string, words int, piece string, block long, bucket long")


def same(spark, rows, least, most=2000):
    df = c.collocations(with_langs(spark, rows), least, most)
    assert df.columns == "lang rank phrase a l r n score".split()
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(plain(*plain_counts(rows), least, most))
    return got


@pytest.mark.parametrize("seed,block", [(1, 8 << 20), (2, 300), (3, 1)])
def test_against_plain_code(spark, monkeypatch, seed, block):
    """One block or many, frequent phrases on both sides of them, odd characters, overlaps."""
    monkeypatch.setattr(c, "BLOCK_BYTES", block)
    rng = random.Random(seed)
    vocabulary = ["a", "B", "of", "the", "naïve", "É", "漢字", "😀", "x y", "x" * 300, " "]
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "?!", "\x0b"])
    text = lambda n: "".join(rng.choice(vocabulary[: rng.choice([2, 5, 11])]) + gap() for _ in range(n))
    texts = [text(rng.choice([1, 4, 30])) for _ in range(40)] + ["the the the the the the"]
    rows = [(rng.choice(["en", "de", "und", None, ""]), rng.choice([None, "", *texts])) for _ in range(200)]
    assert same(spark, rows, 4)
    same(spark, rows, 3, most=7)


def test_edges(spark):
    """No rows, no words, one long text, one text very often."""
    assert same(spark, [], 2) == []
    assert same(spark, [("en", None), ("en", ""), (None, " .,\n\t")], 1) == []
    assert same(spark, [("en", "a b c d e " * 3000)], 30)
    assert same(spark, [("en", "To be, or not to be")] * 300 + [("en", "not to be or")], 30)


def test_odd_characters(spark):
    """Characters that other splitters take for blanks, and NUL, are parts of words."""
    words = ["a\x00b", "c\x1cd", "e\x85f", "g\xa0h", "i\u2028j", "\x00", "k\u3000"]
    rng = random.Random(4)
    rows = [("en", " ".join(rng.choice(words) for _ in range(12))) for _ in range(150)]
    assert same(spark, rows, 10)


def test_exact(spark):
    """Products beyond 64 bits, ties after flooring."""
    n = 9 * 10**15
    f = {"a": n + 1, "b": n + 2, "c": n, "a b": n, "b c": n, "a b c": n - 1, "d": n, "c d": n, "b c d": n, "a b c d": n - 2}
    found = spark.createDataFrame([("en", p, len(p.split()), k) for p, k in f.items()], "lang string, phrase string, words int, n long")
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in c.scored(found).collect()}
    for phrase in (p for p in f if " " in p):
        w = phrase.split()
        cuts = [(2000000 * f[phrase] // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        assert got[phrase] == (f[phrase], left, right, score)
