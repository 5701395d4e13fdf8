"""Registered queries against their SQL twins on odd texts."""

import duckdb

from lectern.plans.registry import ORACLE_SQL, QUERIES


def test_chunks_of_odd_texts(spark, tmp_path):
    """Documents without a sentence, words beyond a chunk, blanks beyond ASCII in sentences that are cut."""
    long_ = "word " * 300
    texts = ["", None, "  \n ", "\u3000", "+", "plain. Text…", "x" * 900, f"a {'y' * 2000} b. c", "&" * 400, f"{long_}\xa0{long_}\u2003\u3000end", f"{long_}\x0b{long_}", f"{long_}\n\n{long_}!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["t14_chunks"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLE_SQL["t14_chunks"]).fetchall()) and len(got) == 7
