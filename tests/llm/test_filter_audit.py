"""The audit of filters against applying every order to every document."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from lectern.llm.filter_audit import audit

LABELS = "doc_id long, quality int, toxic int, part string, n int"


def plain_audit(rows, labels):
    """From (doc_id, text, source) and (doc_id, quality, toxic): the rows of the audit."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    known = [{x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2)]

    def fails(i, t):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and least[t] < i}

    judged = [(c or "", fails(i, t), i in known[0], i in known[1]) for i, t, c in rows]
    out, shapley = {}, Counter()
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [j for j in left if j[1][x]]
                left = [j for j in left if not j[1][x]]
                shapley[part, x] += len(gone)
                out[part, order, step] = (len(left), len(gone), sum(j[1][x] for j in own) - len(gone), sum(j[1][x] and sum(j[1].values()) == 1 for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    assert df.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {tuple(r[:3]): tuple(r[3:]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_orders(spark, documents, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["a", "b", "C", "#", "dd", "e"] + [str(k) for k in range(rng.choice([1, 400]))]) for _ in range(rng.choice([3, 199, 200, 260]))) for _ in range(25)]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", *texts]), rng.choice(["a", "a", "", None])) for _ in range(150)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x", 1) for _ in range(60)]
    assert got(audit(documents(rows), spark.createDataFrame(labels, LABELS))) == plain_audit(rows, labels)


def test_edges(spark, edge, documents):
    """Nulls, empty, long and repeated texts; no documents; no labels."""
    none = spark.createDataFrame([], LABELS)
    assert got(audit(edge, none)) == plain_audit([(r["doc_id"], r["text"], r["source"]) for r in edge.collect()], [])
    assert got(audit(documents([]), none)) == {}


def test_signs(spark, documents):
    """Shapley values of a part add up to the rows that any filter removes, for each order."""
    rows = [(i, "word " * (i % 5 * 80) + "#" * (i % 2), "s") for i in range(60)]
    found = got(audit(documents(rows), spark.createDataFrame([], LABELS)))
    removed = 60 - found["s", "ABCDE", 5][0]
    assert sum(found["s", "ABCDE", k][-1] for k in range(1, 6)) == 120 * removed
