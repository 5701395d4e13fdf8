"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

1. quality: documents that the ordinal classifier rejects (toxic or of low quality) go;
2. near_duplicates: one document of each group of near copies stays;
3. secrets: credentials in the text are replaced by the name of their kind;
4. mix: sources are taken up to their target weights, in whole documents, some more than once;
5. pieces: every text is encoded and decoded.

All but the last return the columns of ``documents``. The stages use fitted weights and hashes that SQL has no functions
for, so there is no SQL for the result; tests hold each stage against a plain computation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm._common import bounded_batches, new_path, table
from lectern.llm.mix import mixed_rows
from lectern.llm.near_dup import one_of_each
from lectern.llm.pieces import encode_decode
from lectern.llm.quality import accepted, fit_model
from lectern.llm.queries import tokenizer_path
from lectern.llm.secrets import redacted_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier keeps, fitted on those of ``docs`` that have labels. Null and empty texts are judged by the
    thresholds; without labels all rows stay; rows that repeat a doc_id are judged one by one; extra columns stay."""
    return accepted(docs, fit_model(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of its least doc_id. Rows without words all stay; rows of one doc_id with
    unlike texts all stay; rows without doc_id are compared by equal sets of shingles only; extra columns stay."""
    bounded_batches(spark)
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced by the name of their kind, and n_chars counted anew where a text changes.
    Null texts stay null; extra columns stay."""
    bounded_batches(spark)
    return redacted_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's budget allows, in whole documents. Null, empty and blank texts are in no budget and
    go; a null source is a source; equal rows share its passes; extra columns stay."""
    bounded_batches(spark)
    return mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids, a row for each row. Null and empty texts have no ids."""
    bounded_batches(spark)
    return encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), keep=("ids",))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
