import pytest

import corpus_pipeline
from lectern.llm.queries import ORACLE_SQL, QUERIES

CONTRACTS = {
    "op1_": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2_": "doc_id size source_size target taken",
    "op4_": "query_id rank vec_id score",
    "op5_": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op6_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_": "doc_id n_shingles component_id kept",
    "op9_": "doc_id start n_tokens ids_crc32",
    "op10_": "doc_id n_bytes n_tokens over_limit",
    "op11_": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12_": "lang rank phrase a l r n score",
    "op13_": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


def test_one_query_each():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{k}" for k in range(1, 14)} and len(QUERIES) == 13


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, sf, name):
    df = QUERIES[name](spark, sf)
    for prefix, columns in CONTRACTS.items():
        if name.startswith(prefix):
            assert df.columns[: len(columns.split())] == columns.split() or set(columns.split()) <= set(df.columns)
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    if name.split("_")[0] not in ("op3", "op4", "op11", "op12"):
        assert df.count() == documents


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        sizes.append(docs.count())
        if name != "pieces":
            assert set(docs.columns) == set(columns)
        if name == "secrets":
            assert docs.where("text rlike 'token = \"[0-9a-f]{20,}'").isEmpty()
    assert len(corpus_pipeline.STAGES) == 5 and sizes[0] > sizes[1] == sizes[2] and sizes[3] == sizes[4]
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]


def plain_stages(rows, labelled):
    """The stages by plain code, from (doc_id, text, source): what each one leaves, in any order."""
    from collections import Counter, defaultdict

    from test_documents import plain_components, plain_targets, words

    text_of = lambda r: r[1] or ""
    assert not labelled  # without labels all stay
    yield Counter(rows)
    least = {}
    for k, _, c, _ in plain_components([(k, t) for k, (_, t, _) in enumerate(rows)]):
        best = least.get(c)
        if best is None or (rows[k][0], k) < (rows[best][0], best):
            least[c] = k
    rows = [rows[k] for k in least.values()]
    yield Counter(rows)
    from lectern.llm import secrets as s

    rows = [(i, t if t is None else s.redact(t, sorted({*s.scan(t)[0], *s.scan(t)[1]})), c) for i, t, c in rows]
    yield Counter(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += words(text_of(r))
    yield {c: (round(t), sizes[c]) for c, t in plain_targets(sizes).items()}


def test_stages_against_plain_code(spark, documents, tmp_path):
    """Nulls, empty texts, repeated rows, near copies and secrets through all stages."""
    import random
    from collections import Counter, defaultdict

    from lectern.llm.bpe import piece_coder
    from lectern.llm.queries import tokenizer_path
    from test_documents import near_rows, words

    rng = random.Random(21)
    rows = [(i, t, rng.choice(["a", "a", "b", None])) for i, t in near_rows(rng, 8, 6, 40)]
    rows += [(1, None, "a"), (2, "", "b"), (3, "  \n", None), (4, "one word", "a"), (4, "one word", "a"), (5, "token = abcdefgh12 and user=bob " + "x y z " * 20, "b")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = documents(rows)
    got = lambda d: [(r["doc_id"], r["text"], r["source"]) for r in d.collect()]
    plain = plain_stages(rows, [])
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "near_duplicates", "secrets"):
        df = stages[name](spark, df, str(tmp_path))
        assert df.columns == documents(rows).columns
        rows_, want = got(df), next(plain)
        assert Counter(rows_) == want if name != "near_duplicates" else Counter((i, c) for i, _, c in rows_) == Counter((i, c) for i, _, c in want.elements())
        df = documents(rows_)
    before = Counter(rows_)
    rows_, budgets, taken, most = got(stages["mix"](spark, df, str(tmp_path))), next(plain), defaultdict(int), defaultdict(int)
    for r in rows_:
        assert r in before and words(r[1])
        taken[r[2]] += words(r[1])
        most[r[2]] = max(most[r[2]], words(r[1]))
    for source, (budget, size) in budgets.items():
        assert 0 <= taken[source] - budget < max(1, most[source])
        copies = {rows_.count(r) for r in before if r[2] == source and words(r[1])}
        assert not copies or max(copies) <= min(copies | {budget // max(1, size)}) + 1
    coder = piece_coder(tokenizer_path("piece_bpe_32k.model")).library
    out = stages["pieces"](spark, documents(rows_), str(tmp_path)).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == Counter((i, tuple(coder.encode(t))) for i, t, _ in rows_)
    for name, stage in corpus_pipeline.STAGES:  # nothing in, nothing out
        assert stage(spark, documents([]), str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in found.fetchall())
