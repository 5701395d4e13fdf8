"""Files of audio that is made of a narrow column: the audio itself is neither kept nor dealt out."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern import shared
from lectern.functions import audio
from lectern.operators import recordings
from lectern.plans import run_queries


def _whole(rows, key):
    got: dict = {}
    for r in rows.orderBy(key, "offset").collect():
        assert len(got.get(r[key], b"")) == r["offset"]
        got[r[key]] = got.get(r[key], b"") + bytes(r["bytes"])
    return got


def test_files_of_made_audio(spark):
    """Segments and parts of tones of lines, null ones and files of one line among them, are the plainly joined bytes."""
    rng = random.Random(3)
    rows = [(k, c, None if rng.random() < 0.2 else "x" * rng.randrange(2000)) for k in range(6) for c in range(rng.choice([1, 2, 9]))]
    df = spark.createDataFrame(rows, "k long, c int, t string").repartition(3)
    tones = {(r["k"], r["c"]): bytes(r["a"]) for r in df.select("k", "c", audio.tone(F.col("t")).alias("a")).collect()}
    want = {k: audio.concatenated([tones[x] for x in sorted(tones) if x[0] == k]) for k, _ in tones}
    pieces = recordings.segments(df, "k", "c", "t", audio.tone)
    made = recordings.files(df, "k", "c", "t", audio.tone, 30_000)
    assert _whole(pieces, "k") == _whole(made, "k") == want
    parts = recordings.parts(pieces, "k", 30_000)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, parts.collect())) and made.count() > 12


def test_files_of_stored_audio(spark):
    """Audio that is there already, with chunks before and after it, in parts of a few bytes."""
    wav = audio.wav(np.arange(9))
    rows = [(1, 0, wav + b"tail"), (2, 0, wav), (2, 1, wav + b"tail"), (2, 2, None), (3, 0, audio.wav(np.arange(0)))]
    df = spark.createDataFrame(rows, "k long, c int, a binary")
    assert _whole(recordings.files(df, "k", "c", "a", most=7), "k") == {1: wav + b"tail", 2: audio.concatenated([wav, wav]), 3: rows[-1][2]}


def test_audio_is_not_kept(spark, tmp_path, monkeypatch):
    """What is written and dealt out for files of lines is far smaller than the audio."""
    rows = [(k, "\n".join(f"line {j} of {k}" for j in range(40))) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    kept = []

    def keep(df):
        kept.append(df.schema)
        return shared.kept(df)

    monkeypatch.setattr(recordings, "kept", keep)
    for query in (run_queries.line_segments, run_queries.file_parts):
        out = query(spark, str(tmp_path))
        assert out.count() > 20
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert kept and not [f for schema in kept for f in schema.fields if f.dataType.simpleString() == "binary"]
