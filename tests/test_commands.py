import json

from pyspark.sql import functions as F
from test_sources import archive

from lectern.__main__ import main
from lectern.plans.commands import Project
from lectern.plans.project import Config, Glossary
from lectern.streaming.batches import FakeProvider

ANALYSIS = json.dumps({"characters": [{"name": "Lin", "translation": "Линь", "role": "hero", "description": ""}], "terms": [{"source": "world", "target": "мир", "type": "term"}], "summary": "All is well."})
STRESS = json.dumps({"entries": [{"term": "мир", "stressed": "м+ир"}, {"term": "плохо", "stressed": "плохо"}]})
TEXT = "Глава\n\nГлава\n\nmир и мир. Линь!".replace("m", "м")


def answer(lines):
    id_ = F.get_json_object("value", "$.custom_id")
    text = F.when(id_.startswith("analyze"), ANALYSIS).when(id_.startswith("pronounce"), STRESS).otherwise(TEXT)
    body = F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), text.alias("text"))).alias("content"))).alias("output"))
    return lines.select(F.to_json(F.struct(id_.alias("custom_id"), F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response"))).alias("value"))


def test_whole_project(spark, tmp_path):
    book = tmp_path / "b.epub"
    book.write_bytes(archive(files={"OEBPS/text/c2.xhtml": "<h1>Chapter 2</h1><p>More of the world"}))
    config = Config(glossary=Glossary(characters=[{"source": "Extra", "target": "Экстра"}], terms=[{"source": "World", "target": "Мир"}]), pronunciation=[{"term": "Линь", "phonemes": "Л+инь"}])
    p = Project(spark, str(tmp_path / "p"), FakeProvider(answer), config)
    p.import_book(str(book))
    index = p.analyze_chapters().first()
    assert (index["strategy"], index["chapter_count"]) == ("heading", 2)
    assert p.analyze() == "completed"
    assert {(r["source"], r["target"], tuple(r["chapters"])) for r in p.glossary().collect()} == {("world", "Мир", (1, 2))}
    assert {(r["name"], r["translation"]) for r in p.characters().collect()} == {("Lin", "Линь"), ("Extra", "Экстра")}
    assert p.analyze() == "nothing to do"
    assert p.translate(chapter=1) == "completed" and p.translate() == "completed" and p.translate() == "nothing to do"
    assert {r["text"] for r in p.translations().collect()} == {"Глава\n\nмир и мир. Линь!"}
    assert p.verify_glossary().count() == 0
    assert p.pronounce() == "completed"
    assert {(r["term"], r["stressed"], tuple(sorted(r["chapters"]))) for r in p.stress().collect()} == {("мир", "м+ир", (1, 2)), ("Линь", "Л+инь", ())}
    assert p.pronounce(reset=True) == "completed" and p.stress().count() == 2
    assert p.ssml() == 2 and p.ssml() == 0
    assert p.speech().first()["ssml"] == "<speak>\n<p><s>Глава</s></p>\n<p><s>м+ир и м+ир.</s><s>Л+инь!</s></p>\n</speak>"
    assert p.tts(encode=lambda wav, kind, rate: kind.encode() + wav[:4]) is None
    assert {bytes(r["audio"]) for r in p.audio().collect()} == {b"mp3RIFF"}
    assert (tmp_path / "p" / "extracted" / "source" / "b.epub").read_bytes() == book.read_bytes() or list((tmp_path / "p").rglob("source/b.epub"))
    assert {r["status"] for r in p.status().collect()} == {"audio"}
    row = p.overview().where("id = 1").first()
    assert (row["terms"], row["characters"], row["stress"], row["ssml"], row["audio"]) == (1, 1, 1, True, True)


def test_command_line(spark, tmp_path, capsys):
    book = tmp_path / "b.epub"
    book.write_bytes(archive())
    root = str(tmp_path / "p")
    assert main(["version"]) == 0
    assert main(["import", root, "--source", str(book)]) == 0
    assert main(["analyze-chapters", root, "--strategy", "per-item", "--start-id", "700"]) == 0
    assert main(["chapters", root]) == 0
    assert main(["status", root]) == 0
    # The stages that ask a model take its service from the project, or here from the caller.
    for command, more in (("analyze", []), ("translate", ["--skip-memory"]), ("pronounce", ["--reset"])):
        assert main([command, root, "--poll-interval", "60", *more], FakeProvider(answer)) == 0
    assert main(["verify-glossary", root]) == 0 and main(["ssml", root, "--use-stress-json"]) == 0
    out = capsys.readouterr().out
    assert out.count("completed") == 3
    assert "701" in out and "raw" in out


def test_failed_batches_do_not_block(spark, tmp_path, capsys):
    """A batch that fails is an error once; the next run starts anew. A pending one is resumed; --continue needs one."""
    import pytest

    book = tmp_path / "b.epub"
    book.write_bytes(archive())
    root = str(tmp_path / "p")
    provider = FakeProvider(answer, ends="failed")
    p = Project(spark, root, provider)
    with pytest.raises(LookupError, match="analyze-chapters first"):
        p.analyze()
    p.import_book(str(book))
    p.analyze_chapters()
    with pytest.raises(LookupError, match="without --continue"):
        p.analyze(go_on=True)
    with pytest.raises(RuntimeError, match="batch failed"):
        p.analyze()
    assert main(["analyze", root, "--continue"], provider) == 1 and "batch failed" in capsys.readouterr().err
    assert len(provider.jobs) == 1
    provider.ends = "completed"
    assert p.analyze() == "completed" and len(provider.jobs) == 2
    with pytest.raises(LookupError, match="translate first"):
        p.verify_glossary()


def test_force_starts_from_an_empty_vocabulary(spark, tmp_path):
    book = tmp_path / "b.epub"
    book.write_bytes(archive())
    p = Project(spark, str(tmp_path / "p"), FakeProvider(answer))
    p.import_book(str(book))
    p.analyze_chapters()
    p.save(spark.createDataFrame([(0, "Old", "Старый", "term", 1, [1])], "ord long, source string, target string, type string, first_seen_chapter int, chapters array<int>"), "ai", "glossary")
    assert p.analyze() == "completed"
    assert {r["source"] for r in p.glossary().collect()} == {"Old", "world"}
    assert p.analyze(force=True) == "completed"
    assert {r["source"] for r in p.glossary().collect()} == {"world"}
