import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import audio
from lectern.operators import overview
from lectern.plans import project
from lectern.plans.commands import Project
from lectern.plans.project import Config
from lectern.plans.project_queries import answered
from lectern.streaming import batches, speech


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_filter():
    assert project.chapter_filter(0, "", 5) is None
    assert project.chapter_filter(3, "", 5) == [(3, 3)] and project.chapter_filter(1, "2-3x", 5) == [(1, 1), (2, 3)] and project.chapter_filter(701, "", 2, 700) == [(701, 701)]
    for chapter, span in ((6, ""), (0, "3-2"), (0, "0-2"), (0, "1-6"), (0, "a-b"), (0, "3"), (-1, "")):
        with pytest.raises(ValueError):
            project.chapter_filter(chapter, span, 5)


def test_config(tmp_path):
    c = project.load_config(str(tmp_path))
    assert c.project == tmp_path.name and c.languages.target == "ru" and c.tts.engine == "noop" and c.audio_extension == ".mp3"
    c.chapters.strip = ["Read at"]
    project.save_config(str(tmp_path), c)
    assert project.load_config(str(tmp_path)) == c
    (tmp_path / "config.yaml").write_text("tts: {audio_format: wav}\nunknown: 1\n")
    assert project.load_config(str(tmp_path)).audio_extension == ".wav"
    (tmp_path / "config.yaml").write_text("languages: {source: ''}\n")
    with pytest.raises(ValueError):
        project.load_config(str(tmp_path))


def test_layout_and_sinks(spark, tmp_path):
    layout = project.Layout(str(tmp_path), project.Config()).ensure()
    assert layout.chapter(7).name == "chapter_007.json" and layout.chapter(1400).name == "chapter_1400.json" and layout.translation(1).name == "chapter_001.ru.txt"
    project.save_json(layout.chapter(1), {"a": "я"})
    assert layout.chapter(1).read_text() == '{\n  "a": "я"\n}\n'
    project.save_bytes(layout.ssml(1), b"x")
    project.save_bytes(layout.dirs["tts"] / ".hidden.ssml", b"x")
    assert dict(rows(overview.stage_counts(spark, str(tmp_path)), "stage", "files")) == {"chapters": 1, "tts": 1}
    table = str(tmp_path / "table")
    make = lambda t, n=3: spark.createDataFrame([(i, t) for i in range(1, n + 1)], "id int, title string")
    project.write_chapters(make("a"), table, [(1, 2)])
    project.write_chapters(make("b"), table)
    read = lambda: rows(spark.read.schema("title string, id int").json(table), "id", "title")
    assert read() == [(1, "a"), (2, "a"), (3, "b")]
    project.write_chapters(make("c"), table, [(2, 2)], force=True)
    assert read() == [(1, "a"), (2, "c"), (3, "b")]
    project.write_chapters(make("d", 2), table, force=True)
    assert read() == [(1, "d"), (2, "d")]


def test_untouched_buckets_stay(spark, tmp_path, monkeypatch):
    """A forced range rewrites its own buckets; files of the others keep their names and times."""
    monkeypatch.setattr(project, "BUCKET", 10)
    table = str(tmp_path / "table")
    make = lambda t: spark.createDataFrame([(i, t) for i in range(1, 51)], "id int, title string")
    project.write_chapters(make("a"), table)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.json")}
    before = files()
    project.write_chapters(make("b"), table, [(12, 13), (31, 31)], force=True)
    after = files()
    changed = {p.parent.name for p, _ in set(before.items()) ^ set(after.items())}
    assert changed == {"bucket=1", "bucket=3"}
    got = rows(spark.read.schema("id int, title string").json(table), "id", "title")
    assert got == [(i, "b" if i in (12, 13, 31) else "a") for i in range(1, 51)]


def test_broken_replacement(spark, tmp_path, monkeypatch):
    """A run that ends between the two moves, or before them, leaves the old table readable, and the next one replaces it."""
    from lectern import shared
    from lectern.schemas import absent_as_empty

    table = str(tmp_path / "t")
    make = lambda t: spark.createDataFrame([(1, t)], "id int, t string")
    read = lambda: rows(absent_as_empty(spark, table, "id int, t string"), "id", "t")
    project.replace_table(make("old"), table)
    real = shared.Store.rename
    for broken in (1, 2):
        moves = []

        def rename(self, a, b, broken=broken, moves=moves):
            moves.append(b)
            if len(moves) == broken:
                raise OSError("gone")
            real(self, a, b)

        monkeypatch.setattr(shared.Store, "rename", rename)
        with pytest.raises(OSError):
            project.replace_table(make("new"), table)
        monkeypatch.setattr(shared.Store, "rename", real)
        assert read() == [(1, "old")]
    project.replace_table(make("new"), table)
    assert read() == [(1, "new")] and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["t"]
    with pytest.raises(RuntimeError), project.reset_guard(spark, table):
        assert read() == []
        project.replace_table(make("half"), table)
        raise RuntimeError
    assert read() == [(1, "new")]


def test_reset_guard(spark, tmp_path):
    store = tmp_path / "s.json"
    store.write_text("old")
    with pytest.raises(RuntimeError), project.reset_guard(spark, str(store)):
        assert not store.exists()
        store.write_text("half")
        raise RuntimeError
    assert store.read_text() == "old"
    with project.reset_guard(spark, str(store)):
        store.write_text("new")
    assert store.read_text() == "new" and list(tmp_path.iterdir()) == [store]


def answer(lines):
    body = F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), F.lit("ok").alias("text"))).alias("content"))).alias("output"))
    return lines.select(F.to_json(F.struct(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response"))).alias("value"))


def test_batches(spark, tmp_path):
    store, provider = batches.Store(spark, str(tmp_path)), batches.FakeProvider(answer, polls=3)
    requests = spark.createDataFrame([("t-chapter-1", "i", "x", "m", False, 0)], "custom_id string, instructions string, input string, model string, json_mode boolean, max_tokens long")
    assert store.load("t") is None
    state = batches.submit(store, provider, "t", requests, [1], "m")
    assert batches.submit(store, provider, "t", requests, [1], "m")["batch_id"] == state["batch_id"] and len(provider.jobs) == 1
    waits: list = []
    batches.poll(store, provider, "t", 30, waits.append, stop=lambda: len(waits) >= 1)
    assert store.load("t")["status"] == "in_progress"
    ended = batches.poll(store, provider, "t", 30, waits.append)
    assert ended["status"] == "completed" and store.load("t")["completed_at"] is not None and waits == [30, 30]
    seen: list = []
    batches.finish(store, provider, "t", lambda lines: seen.extend(json.loads(r["value"])["custom_id"] for r in lines.collect()))
    assert seen == ["t-chapter-1"] and store.load("t") is None
    failed = batches.FakeProvider(answer, ends="expired")
    batches.submit(store, failed, "t", requests, [1], "m")
    batches.poll(store, failed, "t", sleep=lambda s: None)
    with pytest.raises(RuntimeError, match="expired"):
        batches.finish(store, failed, "t", lambda lines: None)
    assert batches.poll_seconds(9) == 60 and batches.poll_seconds(10) == 10


def test_streams(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([(1, "a")], "id int, t string").write.json(src)
    run = lambda: batches.incremental(spark, src, "id int, t string", out, mark, lambda d: d.withColumn("t", F.upper("t"))).awaitTermination()
    run()
    spark.createDataFrame([(2, "b")], "id int, t string").write.mode("append").json(src)
    run()
    run()
    assert rows(spark.read.parquet(out), "id", "t") == [(1, "A"), (2, "B")]
    ups = str(tmp_path / "ups")
    spark.createDataFrame([("t", "in_progress", 1), ("t", "completed", 2), ("u", "failed", 1)], "type string, status string, updated long").write.json(ups)
    got: list = []
    q = batches.status_stream(spark.readStream.schema("type string, status string, updated long").json(ups), "s", str(tmp_path / "cp"), lambda d: got.extend(rows(d, "type", "status")))
    q.awaitTermination()
    assert got == [("t", "completed"), ("u", "failed")]


def test_engines(spark):
    with pytest.raises(LookupError, match="http, noop"):
        speech.engine("none")
    with pytest.raises(ValueError):
        speech.register_engine("noop", speech.noop_engine)
    with pytest.raises(ValueError):
        speech.engine("http", speech.EngineConfig())
    df = spark.createDataFrame([(1, "<speak>" + "".join(f"<s>{'x' * 300}{k}.</s>" for k in range(9)) + "</speak>"), (2, "<speak><s>b</s></speak>")], "chapter_id int, ssml string")

    def client(text, config):
        return audio.wav(np.full(1, text.count("<s>")))

    out = speech.engine("http", speech.EngineConfig(voice="v", server_url="http://x", parallel=3), client=client)(df)
    assert {r["chapter_id"]: np.frombuffer(bytes(r["audio"])[44:], "<i2").tolist() for r in out.collect()} == {1: [2, 2, 2, 2, 1], 2: [1]}
    assert speech.engine("noop")(df).count() == 2


def test_stress_model(spark):
    df = spark.createDataFrame([("Один. Два!\n\nбум",)], "t string")

    def model(s):
        if "бум" in s:
            raise ValueError
        return "+" + s

    assert df.select(speech.stressed(F.col("t"), model).alias("r")).first()["r"] == "+Один.\n+Два!\nбум"
    assert df.select(speech.stressed(F.col("t")).alias("r")).first()["r"] == "Один.\nДва!\nбум"


def test_buckets_of_chapters_are_single_files(spark, tmp_path):
    """Rows of all buckets in every task give a file a bucket, appended or replaced."""
    rows = spark.range(4000).select(F.col("id").cast("int").alias("id"), F.lit("t").alias("title")).repartition(16)
    table = f"{tmp_path}/chapters"
    for force in (False, True):
        project.write_chapters(rows, table, force=force)
        for k in range(4):
            assert len(list((tmp_path / "chapters" / f"bucket={k}").glob("*.json"))) == 1
        assert spark.read.json(table).count() == 4000


def test_results_of_a_batch_are_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(line):
        seen.add(1)
        return line

    once = counted.asNondeterministic()
    p = Project(spark, f"{tmp_path}/p", batches.FakeProvider(lambda lines: answered(lines).select(once("value").alias("value"))), Config())
    project.write_chapters(spark.range(1, 31).selectExpr("'b' as book", "cast(id as int) as id", "'t' as title", "'text' as source"), p.path("chapters", "chapters"))
    p.analyze()
    assert p.summaries().count() == 30 and p.characters().count() == 3
    assert seen.value == 30
