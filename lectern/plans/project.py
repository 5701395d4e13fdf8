"""A project's configuration, folders and sinks."""

from __future__ import annotations

import json
import re
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Store, beside, kept, settled


@dataclass
class Languages:
    source: str = "en"
    target: str = "ru"


@dataclass
class Model:
    base_url: str = ""
    translation_model: str = "default"
    helper_model: str = "default"
    max_retries: int = 3


@dataclass
class Speech:
    engine: str = "noop"
    voice: str = ""
    language: str = "ru"
    speed: float = 1.0
    pitch: float = 1.0
    sample_rate: int = 48_000
    server_url: str = ""
    audio_format: str = "mp3"
    audio_bitrate: str = "128k"
    parallel: int = 1


@dataclass
class Paths:
    source: str = "source"
    extracted: str = "extracted"
    chapters: str = "chapters"
    ai: str = "ai"
    translation: str = "translation"
    memory: str = "memory"
    tts: str = "tts"
    audio: str = "audio"


@dataclass
class Glossary:
    characters: list[dict] = field(default_factory=list)
    terms: list[dict] = field(default_factory=list)


@dataclass
class Chapters:
    strip: list[str] = field(default_factory=list)
    start_id: int = 0


@dataclass
class Config:
    project: str = "book"
    languages: Languages = field(default_factory=Languages)
    model: Model = field(default_factory=Model)
    tts: Speech = field(default_factory=Speech)
    paths: Paths = field(default_factory=Paths)
    glossary: Glossary = field(default_factory=Glossary)
    pronunciation: list[dict] = field(default_factory=list)
    chapters: Chapters = field(default_factory=Chapters)

    def check(self) -> Config:
        for name, value in (("languages.source", self.languages.source), ("languages.target", self.languages.target), ("model.translation_model", self.model.translation_model), ("model.helper_model", self.model.helper_model)):
            if not value:
                raise ValueError(f"{name} must not be empty")
        return self

    @property
    def audio_extension(self) -> str:
        return ".wav" if self.tts.audio_format == "wav" else ".mp3"

    @property
    def speech_language(self) -> str:
        return self.tts.language or self.languages.target


def _over(base, values: dict):
    """A dataclass with the given values over its own; unknown ones are passed over."""
    for f in fields(base):
        if values.get(f.name) is not None:
            old = getattr(base, f.name)
            setattr(base, f.name, _over(old, values[f.name]) if is_dataclass(old) else values[f.name])
    return base


def load_config(root: str) -> Config:
    """config.yaml over the defaults; the defaults where there is none."""
    import yaml

    path = Path(root, "config.yaml")
    base = Config(project=Path(root).name or "book")
    return _over(base, yaml.safe_load(path.read_text()) or {}).check() if path.exists() else base


def save_config(root: str, config: Config) -> None:
    import yaml

    Path(root, "config.yaml").write_text(yaml.safe_dump(asdict(config), allow_unicode=True, sort_keys=False))


class Layout:
    """Folders of a project; files are named by chapter."""

    def __init__(self, root: str, config: Config):
        self.root = Path(root)
        self.dirs = {f.name: self.root / getattr(config.paths, f.name) for f in fields(config.paths)}
        self.target = config.languages.target
        self.ext = config.audio_extension

    def ensure(self) -> Layout:
        for d in (*self.dirs.values(), self.dirs["extracted"] / "raw", self.dirs["extracted"] / "blocks"):
            d.mkdir(parents=True, exist_ok=True)
        return self

    def chapter(self, n: int) -> Path:
        return self.dirs["chapters"] / f"chapter_{n:03d}.json"

    def summary(self, n: int) -> Path:
        return self.dirs["memory"] / f"chapter_{n:03d}.summary.txt"

    def translation(self, n: int) -> Path:
        return self.dirs["translation"] / f"chapter_{n:03d}.{self.target}.txt"

    def ssml(self, n: int) -> Path:
        return self.dirs["tts"] / f"chapter_{n:03d}.ssml"

    def audio(self, n: int) -> Path:
        return self.dirs["audio"] / f"chapter_{n:03d}{self.ext}"


def chapter_filter(chapter: int, span: str, count: int, start_id: int = 0) -> list[tuple[int, int]] | None:
    """Numbers chosen by one chapter, a span M-N, or both, as ranges (both ends included); None for all. What follows a number is
    passed over."""
    if not chapter and not span:
        return None
    low, high = start_id + 1, start_id + count
    chosen = []
    if chapter:
        if not low <= chapter <= high:
            raise ValueError(f"chapter {chapter} out of range ({low}-{high})")
        chosen.append((chapter, chapter))
    if span:
        ends = span.split("-", 1)
        found = [re.match(r"\s*([+-]?\d+)", e) for e in ends]
        if len(ends) != 2 or not all(found):
            raise ValueError(f"a range is M-N, not {span!r}")
        a, b = (int(m[1]) for m in found)
        if a < low or b > high or a > b:
            raise ValueError(f"range {a}-{b} out of range ({low}-{high})")
        chosen.append((a, b))
    return chosen


def within(c: Column, ranges: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, (c.between(low, high) for low, high in ranges), F.lit(False))


def save_json(path: Path, value) -> None:
    """Two spaces of indent and a line end, replaced as a whole."""
    save_bytes(path, (json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode())


def save_bytes(path: Path, data: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    temp = path.with_name(f".{path.name}.tmp")
    temp.write_bytes(data)
    temp.replace(path)


def copy_files(spark, source: str, folder: str) -> None:
    """Files of any store into a folder of any store, by name, as they are."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found, into = jvm.Path(source), jvm.Path(folder)
    fs, target = found.getFileSystem(conf), into.getFileSystem(conf)
    target.mkdirs(into)
    for status in fs.globStatus(found) or []:
        jvm.FileUtil.copy(fs, status.getPath(), target, jvm.Path(into, status.getPath().getName()), False, True, conf)


def replace_table(df: DataFrame, path: str, fmt: str = "json", by: tuple[str, ...] = ()) -> None:
    """Replaces a table, also one that ``df`` reads: written beside it, then the old one is put aside and the new one moved into
    its place. Whatever fails in between, ``settled`` finds one of them whole."""
    settled(df.sparkSession, path)
    new, aside = beside(path, "next"), beside(path, "previous")
    # A part is one file, not one for each task that has rows of it.
    (df.repartition(*by) if by else df).write.mode("overwrite").partitionBy(*by).format(fmt).save(new)
    store = Store(df.sparkSession, path)
    store.delete(aside)
    if store.exists(path):
        store.rename(path, aside)
    store.rename(new, path)
    store.delete(aside)
    df.sparkSession.catalog.refreshByPath(path)


#: Numbers of chapters that share a bucket of their table.
BUCKET = 1000


def write_chapters(chapters: DataFrame, table: str, chosen: list[tuple[int, int]] | None = None, force: bool = False) -> None:
    """Chapters into a table in buckets of their numbers. What exists is kept unless forced; forced and unfiltered, the table is
    replaced, so stale chapters go; forced for some ranges, only buckets of these are read and written again."""
    from ..schemas import absent_as_empty

    spark = chapters.sparkSession
    bucket = F.floor(F.col("id") / BUCKET).cast("int").alias("bucket")
    rows = chapters if chosen is None else chapters.where(within(F.col("id"), chosen))
    if force and chosen is None:
        replace_table(rows.select("*", bucket), table, by=("bucket",))
        return
    settled(spark, table)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chapters.schema) + ", bucket int"
    have = absent_as_empty(spark, table, kinds)
    if not force:
        # Texts are not shuffled for a join where nothing is stored yet.
        added = rows if have.isEmpty() else rows.join(have.select("id").distinct(), "id", "left_anti")
        added.select(*chapters.columns, bucket).repartition("bucket").write.mode("append").partitionBy("bucket").json(table)
        return
    touched = have.where(within(F.col("bucket"), [(low // BUCKET, high // BUCKET) for low, high in chosen]))
    left = touched.join(rows.select("id"), "id", "left_anti").select(*chapters.columns, "bucket")
    # Written apart first, as it reads what it replaces.
    new = kept(left.unionByName(rows.select(*chapters.columns, bucket)))
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(table)
    spark.catalog.refreshByPath(table)


def write_violations(rows: DataFrame, table: str) -> None:
    """Always written, so that a clean run leaves no stale findings."""
    rows.write.mode("overwrite").json(table)


@contextmanager
def reset_guard(spark: SparkSession, path: str):
    """The store at ``path``, in any file system, is put aside and comes back if what follows fails. A copy from a broken run is
    kept as it is."""
    store, backup = Store(spark, path), path + ".backup"
    settled(spark, path)
    if store.exists(path) and not store.exists(backup):
        store.rename(path, backup)
    else:
        store.delete(path)
    try:
        yield
    except BaseException:
        if store.exists(backup):
            store.delete(path)
            store.delete(beside(path, "previous"))
            store.rename(backup, path)
        raise
    store.delete(backup)
