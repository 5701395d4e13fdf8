"""Speech engines by name, and stress models: text columns in, audio or stressed text out, external services injected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audio import joined_audio, tone
from ..functions.chunks import chunked
from ..functions.text import stress_sentences
from ..shared import kept


@dataclass(frozen=True)
class EngineConfig:
    voice: str = ""
    language: str = "ru"
    sample_rate: int = 48_000
    server_url: str = ""
    parallel: int = 1


#: Bytes of texts that a task of requests takes in one round.
ROUND = 256 << 20
#: An engine turns a DataFrame (chapter_id, ssml) into (chapter_id, audio).
Engine = Callable[[DataFrame], DataFrame]
_ENGINES: dict[str, Callable[..., Engine]] = {}


def register_engine(name: str, factory: Callable[..., Engine]) -> None:
    if name in _ENGINES:
        raise ValueError(f"engine {name} is registered already")
    _ENGINES[name] = factory


def engine(name: str, config: EngineConfig = EngineConfig(), **more) -> Engine:
    if name not in _ENGINES:
        raise LookupError(f"unknown engine {name}; known are {', '.join(engines())}")
    return _ENGINES[name](config, **more)


def engines() -> list[str]:
    return sorted(_ENGINES)


def noop_engine(config: EngineConfig) -> Engine:
    """A tone for each text, for runs without a service."""
    return lambda rows: rows.select("chapter_id", tone(F.col("ssml")).alias("audio"))


def http_engine(config: EngineConfig, client: Callable[[str, EngineConfig], bytes] | None = None) -> Engine:
    """Chunks go to a client, over all chapters at once, and are joined in their order. ``client`` is called on executors."""
    if not config.server_url or not config.voice:
        raise ValueError("the engine needs a server and a voice")
    call = client or post

    def run(rows: DataFrame) -> DataFrame:
        # Requests run in as many tasks as the engine may ask at once, so many texts go in rounds, one after another.
        size = rows.agg(F.sum(F.octet_length("ssml"))).first()[0] or 0
        rounds = -(-size // (max(1, config.parallel) * ROUND))
        if rounds < 2:
            return spoken(rows)
        turn = F.pmod(F.xxhash64("chapter_id"), F.lit(rounds))
        return reduce(DataFrame.unionByName, [kept(spoken(rows.where(turn == k))) for k in range(rounds)])

    def spoken(rows: DataFrame) -> DataFrame:
        parts = rows.select("chapter_id", F.posexplode(chunked(F.col("ssml"))).alias("chunk", "text"))

        def speak(batches):
            for batch in batches:
                audio = [call(t, config) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(audio, pa.binary())], names=["chapter_id", "chunk", "audio"])

        kind = dict(rows.dtypes)["chapter_id"]
        spread = parts.repartition(max(1, config.parallel), "chapter_id", "chunk")
        return joined_audio(spread.mapInArrow(speak, f"chapter_id {kind}, chunk int, audio binary"), "chapter_id", "chunk", "audio")

    return run


def post(text: str, config: EngineConfig, timeout: float = 600.0) -> bytes:
    """One request to a speech server."""
    import json
    from urllib.request import Request, urlopen

    body = json.dumps({"text": text, "voice": config.voice, "sample_rate": config.sample_rate, "ssml": True}).encode()
    with urlopen(Request(config.server_url.rstrip("/") + "/synthesize", body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
        return answer.read()


def healthy(config: EngineConfig, timeout: float = 10.0) -> bool:
    from urllib.request import urlopen

    with urlopen(config.server_url.rstrip("/") + "/health", timeout=timeout) as answer:
        return answer.status == 200


def stressed(text: Column, model: Callable[[str], str] | None = None) -> Column:
    """Sentence by sentence through a model, joined by line ends. Blank sentences pass; one that the model fails on stays as it
    is. Without a model the sentences stay."""
    if model is None:
        return F.array_join(stress_sentences(text), "\n")

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        def one(s: str) -> str:
            try:
                return model(s) if s.strip() else s
            except Exception:
                return s

        # A client takes all sentences of a text in one request, and its errors fail the stage.
        many = getattr(model, "sentences", None)
        return lists.map(lambda x: many(list(x)) if many else [one(s) for s in x])

    return F.array_join(run(stress_sentences(text)), "\n")


register_engine("noop", noop_engine)
register_engine("http", http_engine)
