"""Extra columns of any name keep their values through every operator that returns rows of its input."""

import random

import pytest

import corpus_pipeline
from lectern.llm.passages import without_repeats

#: Names that operators use for columns of their own, in either case.
RESERVED = "__n __id __source __doc __hash __spans __set1 __set2 __s1 __s2 __copy __cut __at __before __epochs __row __place __first __of __other0 __N2 size key rows n_chars2 node rep stays wins digest".split()


@pytest.fixture(scope="module")
def rows(spark):
    """Near copies, repeated passages, repeated and null ids, secrets; the extra columns of a row hold its number."""
    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(rng.randrange(40))
    shared = " ".join(word() for _ in range(80))
    texts = [" ".join(word() for _ in range(rng.choice([3, 40]))) for _ in range(20)] + [f"{word()} {shared} {word()}" for _ in range(6)] + [None, "", "token = abcdefgh12 and user=bob", "token = abcdefgh12 and user=bob"]
    ids = [rng.choice([None, k, k, 3]) for k in range(len(texts))]
    full = [(i, t, rng.choice(["a", "b", None]), len(t or ""), "en", *([k] * len(RESERVED))) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return full, spark.createDataFrame(full, "doc_id long, text string, source string, n_chars long, lang string, " + ", ".join(f"`{c}` long" for c in RESERVED))


def _holds(full, df, out, texts_change=False):
    assert out.columns == df.columns
    for r in out.collect():
        k = r[RESERVED[0]]
        want = full[k]
        assert tuple(r)[5:] == want[5:] and (r["doc_id"], r["source"], r["lang"]) == (want[0], want[2], want[4])
        assert texts_change or r["text"] == want[1]


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "secrets", "mix"])
def test_stages(spark, rows, tmp_path, name):
    full, df = rows
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, df, str(tmp_path))
    _holds(full, df, out, texts_change=name == "secrets")
    assert out.count() > 0


def test_all_stages(spark, rows, tmp_path):
    """One after the other, as the pipeline runs them."""
    full, df = rows
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    _holds(full, df, docs, texts_change=True)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_repeats(rows):
    full, df = rows
    out = without_repeats(df)
    _holds(full, df, out, texts_change=True)
    assert out.count() == len(full) and any(r["text"] != full[r[RESERVED[0]]][1] for r in out.collect())
