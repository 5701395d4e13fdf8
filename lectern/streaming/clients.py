"""Clients of services over HTTP: stress of sentences, batches and single calls of a model; a server for a stress model; and
the audio encoder. The transport is a function, so other stacks and tests bring their own."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import time
import uuid
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import ENDPOINT

#: (method, url, body, headers, seconds) -> body of the answer; other states than 2xx raise.
Transport = Callable[[str, str, "bytes | None", dict, float], bytes]
#: Seconds for a stress request and for others; sentences of a request; requests of a batch; most workers of a server.
STRESS_SECONDS, SECONDS, MOST_REQUESTS, MOST_WORKERS = 300.0, 600.0, 50_000, 12


def over_http(method: str, url: str, body: bytes | None, headers: dict, seconds: float) -> bytes:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, body, headers, method=method), timeout=seconds) as answer:
        return answer.read()


class StressClient:
    """A stress service: sentences in, the same with marks out, in one request."""

    def __init__(self, server: str, transport: Transport = over_http):
        self.server, self.transport = server.rstrip("/"), transport

    def sentences(self, sentences: list[str]) -> list[str]:
        if not sentences:
            return []
        body = json.dumps({"sentences": sentences}).encode()
        answer = json.loads(self.transport("POST", f"{self.server}/api/stress", body, {"Content-Type": "application/json"}, STRESS_SECONDS))
        if len(found := answer["results"]) != len(sentences):
            raise ValueError(f"{len(sentences)} sentences went out, {len(found)} came back")
        return found

    def __call__(self, sentence: str) -> str:
        return self.sentences([sentence])[0]


def stress_answer(body: bytes, model: Callable[[str], str]) -> bytes:
    """The server's side of ``StressClient``. Blank sentences pass; one that the model fails on stays as it is."""

    def one(s: str) -> str:
        try:
            return model(s) if s and s.strip() else s
        except Exception:
            return s

    return json.dumps({"results": [one(s) for s in json.loads(body)["sentences"]]}).encode()


def stress_server(load: Callable[[], Callable[[str], str]], host: str = "127.0.0.1", port: int = 0):
    """A server (not started) that loads its model at the first request."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    held: list = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            if self.path != "/api/stress":
                self.send_error(404)
                return
            held[:] = held or [load()]
            out = stress_answer(self.rfile.read(int(self.headers["Content-Length"])), held[0])
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def server_workers(cores: int | None = None, asked: int | None = None) -> int:
    """Worker processes of a speech server, each with one thread and its own copy of the model."""
    return asked or min(cores or os.cpu_count() or 1, MOST_WORKERS)


class ModelService:
    """A model behind a responses API: batches (as ``batches.Provider``) and single calls. The key is given or taken from the
    environment; failed requests are tried again up to ``retries`` times."""

    def __init__(self, base_url: str, key: str | None = None, retries: int = 3, transport: Transport = over_http, pause: float = 1.0):
        self.base, self.retries, self.transport, self.pause = base_url.rstrip("/"), retries, transport, pause
        self.key = key or os.environ.get("MODEL_API_KEY", "")
        if not self.key:
            raise LookupError("no key for the model service")

    def _send(self, method: str, path: str, body: bytes | None = None, kind: str = "application/json") -> bytes:
        headers = {"Authorization": f"Bearer {self.key}"} | ({"Content-Type": kind} if body is not None else {})
        for left in range(self.retries, -1, -1):
            try:
                return self.transport(method, self.base + path, body, headers, SECONDS)
            except OSError as e:
                # An answer that says the request is wrong will not change.
                if not left or 400 <= getattr(e, "code", 500) < 500 and getattr(e, "code", 500) not in (408, 409, 429):
                    raise
                time.sleep(self.pause)
        raise AssertionError

    def submit(self, lines: DataFrame) -> dict:
        """Uploads the request lines (value) as one file and starts a batch of it."""
        rows = [r["value"] for r in lines.select("value").limit(MOST_REQUESTS + 1).collect()]
        if len(rows) > MOST_REQUESTS:
            raise ValueError(f"a batch has at most {MOST_REQUESTS} requests")
        mark = uuid.uuid4().hex
        part = f'--{mark}\r\nContent-Disposition: form-data; name="purpose"\r\n\r\nbatch\r\n--{mark}\r\nContent-Disposition: form-data; name="file"; filename="batch.jsonl"\r\nContent-Type: application/jsonl\r\n\r\n'
        body = part.encode() + "".join(r + "\n" for r in rows).encode() + f"\r\n--{mark}--\r\n".encode()
        file_id = json.loads(self._send("POST", "/files", body, f"multipart/form-data; boundary={mark}"))["id"]
        batch = json.loads(self._send("POST", "/batches", json.dumps({"input_file_id": file_id, "endpoint": ENDPOINT, "completion_window": "24h"}).encode()))
        return {"batch_id": batch["id"], "input_file_id": file_id, "status": batch["status"]}

    def status(self, batch_id: str) -> dict:
        b = json.loads(self._send("GET", f"/batches/{batch_id}"))
        counts = b.get("request_counts") or {}
        return {"status": b["status"], "output_file_id": b.get("output_file_id") or "", "error_file_id": b.get("error_file_id") or "", **{k: counts[k] for k in ("total", "completed", "failed") if k in counts}}

    def download(self, spark: SparkSession, file_id: str) -> DataFrame:
        """The lines of a result file, which is as bounded as its batch."""
        text = self._send("GET", f"/files/{file_id}/content").decode()
        return spark.createDataFrame([(line,) for line in text.split("\n") if line.strip()], "value string")

    def cancel(self, batch_id: str) -> None:
        self._send("POST", f"/batches/{batch_id}/cancel", b"{}")

    def call(self, user: str, model: str, instructions: str = "", json_mode: bool = False, max_tokens: int = 0) -> str:
        """The text of one answer; an empty one is an error."""
        body = {"model": model, "input": [{"role": "user", "content": user}], "reasoning": {"effort": "none"}}
        body |= {"instructions": instructions} if instructions else {}
        body |= {"text": {"format": {"type": "json_object"}}} if json_mode else {}
        body |= {"max_output_tokens": max_tokens} if max_tokens > 0 else {}
        answer = json.loads(self._send("POST", "/responses", json.dumps(body).encode()))
        text = "".join(p.get("text", "") for o in answer.get("output", []) if o.get("type") == "message" for p in o.get("content", []) if p.get("type") == "output_text")
        if not text:
            raise ValueError(f"model {model} gave no text")
        return text


def encode_command(source: str, target: str, kind: str, bitrate: str) -> list[str]:
    """The encoder's command line: mono; codec and bit rate for the kinds that are known."""
    rate = "128k" if not bitrate else bitrate if bitrate.lower().endswith("k") else bitrate + "k"
    codec = {"mp3": ["-c:a", "libmp3lame", "-b:a", rate], "aac": ["-c:a", "aac", "-b:a", rate]}.get(kind.lower(), [])
    return ["ffmpeg", "-y", "-i", source, "-ac", "1", *codec, target]


def encoded(wav: bytes, kind: str, bitrate: str) -> bytes:
    """WAV through the encoder, in a folder of the worker that is gone afterwards."""
    with tempfile.TemporaryDirectory() as folder:
        source, target = Path(folder, "in.wav"), Path(folder, f"out.{kind}")
        source.write_bytes(wav)
        done = subprocess.run(encode_command(str(source), str(target), kind, bitrate), capture_output=True, check=False)
        if done.returncode:
            raise RuntimeError(f"the encoder failed: {done.stderr.decode(errors='replace').strip()}")
        return target.read_bytes()


def converted(audio: Column, kind: str, bitrate: str = "", encode: Callable[[bytes, str, str], bytes] = encoded) -> Column:
    """Audio in another format; WAV stays as it is."""
    if kind == "wav":
        return audio

    @F.pandas_udf("binary")
    def run(files: pd.Series) -> pd.Series:
        return files.map(lambda x: encode(bytes(x), kind, bitrate) if x is not None else None)

    return run(audio)
